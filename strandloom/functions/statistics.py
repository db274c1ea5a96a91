"""Tests and models: sums are made by aggregation, only a few numbers per group meet NumPy."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import special as sp
from strandloom.operators.ordered import prefix_sum_within
from strandloom.session import materialize


def per_row(f, returns: str, *columns: Column) -> Column:
    """A NumPy-backed function of a few numbers per row, Arrow-batched; null if any input is null."""

    @F.pandas_udf(returns)
    def run(*args: pd.Series) -> pd.Series:
        rows = zip(*args, strict=True)
        return pd.Series([None if any(v is None or v != v for v in r if not isinstance(v, np.ndarray)) else f(*r) for r in rows], dtype=object if returns.startswith("array") else None)

    return run(*columns)


def hypergeometric(x: Column, n: Column, k: Column, m: Column, upper: bool = True) -> Column:
    """P(X >= x) (or <= x) of the overlap of ``m`` drawn with ``k`` marked among ``n``."""
    return per_row(lambda a, b, c, d: sp.hypergeometric_tail(int(a), int(b), int(c), int(d), upper), "double", x, n, k, m)


def hypergeometric_logs(df: DataFrame, seen: str) -> DataFrame:
    """Rows with ``n``, ``k``, ``m``, once for each possible overlap ``i``, and in ``l`` the logarithm of its probability over that of the overlap ``seen``.

    A row's logarithms are computed once and sent in batches of up to 65,536.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("i", T.LongType()), T.StructField("l", T.DoubleType())])
    names = df.columns

    def run(batches):
        for b in batches:
            for at, row in enumerate(b.select(["n", "k", "m", seen]).to_pylist()):
                x, logs = sp.log_hypergeometric(row["n"], row["k"], row["m"])
                logs = logs - logs[row[seen] - x[0]]
                for first in range(0, len(x), 1 << 16):
                    part = slice(first, first + (1 << 16))
                    same = b.take(pa.array(np.full(len(x[part]), at)))
                    yield pa.RecordBatch.from_arrays([*same.columns, pa.array(x[part], pa.int64()), pa.array(logs[part])], names=[*names, "i", "l"])

    return df.mapInArrow(run, schema)


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Array (odds ratio, lower, upper, p) of each 2 x 2 table."""
    return per_row(lambda *t: [float(v) for v in sp.fisher_2x2(*map(int, t))], "array<double>", a, b, c, d)


def sample_odds_ratio(a: Column, b: Column, c: Column, d: Column, continuity: float = 0.0) -> Column:
    return (a + continuity) * (d + continuity) / F.nullif((b + continuity) * (c + continuity), F.lit(0.0))


def log_odds(hits: Column, n: Column, continuity: float = 0.0) -> Column:
    """Logit of a share."""
    return F.ln((hits + continuity) / (n - hits + continuity))


def adjusted(df: DataFrame, p: str, into: str = "p_adjusted", group: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: the least p m / rank over all p from there on; null and NaN stay null and don't count.

    Ranks and the running minimum over distinct p values come from range-sorted scans: groups
    and p values may be of any number.
    """
    group = group or []
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    counted = df.where(ok).groupBy(*group, p).agg(F.count("*").alias("_c"))
    ranked = prefix_sum_within(counted, group, [p], "_c", "_rank")
    m = counted.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group))).agg(F.sum("_c").alias("_m"))
    both = ranked.join(m, [ranked[g].eqNullSafe(m[f"_g{i}"]) for i, g in enumerate(group)]) if group else ranked.join(F.broadcast(m))
    raw = both.select(*group, F.col(p), (-F.col(p).cast("double")).alias("_falling"), (F.col(p) * F.col("_m") / F.col("_rank")).alias("_q"))
    later = prefix_sum_within(raw, group, ["_falling"], "_q", "_least", least=True)
    # stored, so that a plain exchange lies below the join and a p that very many rows have can be split
    adj = materialize(later.select(*(F.col(g).alias(f"_h{i}") for i, g in enumerate(group)), F.col(p).alias("_p"), F.least(F.lit(1.0), F.col("_least")).alias(into)))
    return df.join(adj, [df[p] == adj["_p"], *(df[g].eqNullSafe(adj[f"_h{i}"]) for i, g in enumerate(group))], "left").drop("_p", *(f"_h{i}" for i in range(len(group))))


def rank_sums(df: DataFrame, value: str, first: Column, group: list[str] | None = None) -> DataFrame:
    """Per group: n1, n2, the rank sum of rows where ``first`` holds, and the tie sum of t^3 - t.

    Ranks of equal values are shared. Values are counted first, so equal values of a third of
    all rows are one row; ranks come from a prefix sum over distinct values.
    """
    group = group or []
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & first.isNotNull()
    counted = df.where(ok).groupBy(*group, value).agg(F.count("*").alias("_c"), F.count(F.when(first, 1)).alias("_c1"))
    ranked = prefix_sum_within(counted, group, [value], "_c", "_upto")
    rank = F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2.0
    return ranked.groupBy(*group).agg(
        F.sum("_c1").alias("n1"), F.sum(F.col("_c") - F.col("_c1")).alias("n2"), F.sum(rank * F.col("_c1")).alias("rank_sum"), F.sum(F.col("_c").cast("double") * F.col("_c") * F.col("_c") - F.col("_c")).alias("ties")
    )


def wilcoxon(sums: DataFrame) -> DataFrame:
    """Rank-sum test from ``rank_sums``: U, z with tie and continuity correction, two-sided p, AUROC, and ``p_exact``.

    ``p_exact`` is the exact two-sided p where both groups have fewer than 50 values without ties, as is
    usual; null elsewhere, where ``p_value``, of the normal law, stands alone.
    """
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    middle = n1 * n2 / 2
    var = n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = (u - middle - 0.5 * F.signum(u - middle)) / F.sqrt(var)
    p = per_row(lambda z: float(min(1.0, 2 * sp.normal_sf(abs(z)))), "double", z)
    small = (n1 > 0) & (n2 > 0) & (n1 < 50) & (n2 < 50) & (F.col("ties") == 0)
    exact = per_row(lambda u, a, b: rank_sum_exact(int(u), int(a), int(b)), "double", *(F.when(small, x) for x in (u, n1, n2)))
    return sums.select("*", u.alias("u"), z.alias("z"), (u / (n1 * n2)).alias("auroc"), p.alias("p_value"), exact.alias("p_exact"))


@lru_cache(maxsize=4096)
def _rank_sum_law(n1: int, n2: int) -> np.ndarray:
    """Probabilities of U = 0, 1, ... n1 n2: how many of all choices of n1 among n1 + n2 ranks give each.

    Choices are counted by the Gaussian binomial, multiplied out factor by factor.
    """
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    for i in range(1, n1 + 1):
        up = n2 + i
        ways[up:] = ways[up:] - ways[: len(ways) - up] if up < len(ways) else ways[up:]
        for k in range(i, len(ways)):  # divided by 1 - x^i
            ways[k] += ways[k - i]
    return ways / ways.sum()


def rank_sum_exact(u: int, n1: int, n2: int) -> float:
    """Exact two-sided p of the rank-sum test without ties."""
    law = _rank_sum_law(min(n1, n2), max(n1, n2))
    return float(min(1.0, 2 * min(law[: u + 1].sum(), law[u:].sum())))


def signed_rank_paired(first: list[float], second: list[float], mu: float = 0.0) -> tuple[float, float]:
    """Paired signed-rank test: that of the pairs' differences; pairs with a missing value don't count."""
    return signed_rank_exact([a - b for a, b in zip(first, second, strict=True) if a is not None and b is not None], mu)


@lru_cache(maxsize=64)
def _signed_rank_law(n: int) -> np.ndarray:
    """Probabilities of the sums of ranks 1 to n with random signs."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r]
    return ways / ways.sum()


def signed_rank_exact(values: list[float], mu: float = 0.0) -> tuple[float, float]:
    """One-sample signed-rank test: (V, exact two-sided p without ties, else the normal approximation)."""
    d = np.array([v - mu for v in values if v is not None and not math.isnan(v) and v != mu])
    n = len(d)
    if n == 0:
        return 0.0, 1.0
    _, at, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    order = (np.cumsum(counts) - (counts - 1) / 2)[at]
    v = float(order[d > 0].sum())
    if n < 50 and counts.max() == 1:
        p = _signed_rank_law(n)
        low, high = p[: int(v) + 1].sum(), p[int(v) :].sum()
        return v, float(min(1.0, 2 * min(low, high)))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - float((counts**3 - counts).sum()) / 48
    z = (v - mean - 0.5 * np.sign(v - mean)) / math.sqrt(var)
    return v, float(min(1.0, 2 * sp.normal_sf(abs(z))))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, the correlation of average-tie ranks and the two-sided p of its t; rows with a null are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("_c"))

    def ranks(c: str) -> DataFrame:
        hist = rows.groupBy(c).agg(F.sum("_c").alias("_n"))
        up = prefix_sum_within(hist, [], [c], "_n", "_upto")
        return up.select(F.col(c).alias(f"_v{c}"), (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(f"_r{c}"))

    a, b = ranks(x), ranks(y)
    both = rows.join(a, rows[x] == a[f"_v{x}"]).join(b, rows[y] == b[f"_v{y}"])
    c, rx, ry = F.col("_c").cast("double"), F.col(f"_r{x}"), F.col(f"_r{y}")
    n = F.sum("_c")
    mean = (n + 1) / 2.0
    s = both.agg(n.alias("n"), F.sum(c * rx * rx).alias("xx"), F.sum(c * ry * ry).alias("yy"), F.sum(c * rx * ry).alias("xy"), mean.alias("m"))
    nm = F.col("n") * F.col("m") * F.col("m")
    s = s.select("n", ((F.col("xy") - nm) / F.sqrt((F.col("xx") - nm) * (F.col("yy") - nm))).alias("rho"))
    return s.withColumn("p_value", correlation_p(F.col("rho"), F.col("n")))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of ``n`` pairs by Student's law; null below three pairs."""
    return per_row(lambda r, n: None if n < 3 else 0.0 if abs(r) >= 1 else 2 * sp.t_sf(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2), "double", r, n)


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """One row: the statistic, degrees of freedom and p of the two columns' table."""
    both = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).select(F.col(row).alias("_a"), F.col(column).alias("_b"))
    cells = both.groupBy("_a", "_b").agg(F.count("*").alias("o"))
    r, c = cells.groupBy("_a").agg(F.sum("o").alias("r")), cells.groupBy("_b").agg(F.sum("o").alias("c"))
    n = cells.agg(F.sum("o").alias("n"), F.count_distinct("_a").alias("nr"), F.count_distinct("_b").alias("nc"))  # one row
    # sum of (o - e)^2 / e over all cells, empty ones included, is n (sum of o^2 / (r c) - 1)
    s = cells.join(r, "_a").join(c, "_b").agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s")).join(n)
    x, k = F.col("n") * (F.col("s") - 1), (F.col("nr") - 1) * (F.col("nc") - 1)
    return s.select(x.alias("statistic"), k.alias("df"), per_row(lambda x, k: sp.chi2_sf(x, k), "double", x, k).alias("p_value"))


def welch(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row: means, t, degrees of freedom and two-sided p of the difference of two groups."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    s = df.agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    q1, q2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = (F.col("m1") - F.col("m2")) / F.sqrt(q1 + q2)
    k = (q1 + q2) * (q1 + q2) / (q1 * q1 / (F.col("n1") - 1) + q2 * q2 / (F.col("n2") - 1))
    return s.select("n1", "n2", "m1", "m2", t.alias("t"), k.alias("df"), per_row(lambda t, k: 2 * sp.t_sf(abs(t), k), "double", t, k).alias("p_value"))


def exact_split_p(a: list[float], b: list[float]) -> float:
    """Share of all splits of the values into groups of these sizes whose difference of means is at least as large."""
    values = np.array([*a, *b], dtype=float)
    seen = abs(np.mean(a) - np.mean(b))
    splits = list(itertools.combinations(range(len(values)), len(a)))
    total = values.sum()
    diffs = [abs((s := values[list(c)].sum()) / len(a) - (total - s) / len(b)) for c in splits]
    # splits that mirror the seen one differ from it by rounding only, which grows with the values
    return float(np.mean(np.array(diffs) >= seen - 1e-9 * max(1.0, np.abs(values).max())))


def _gram(df: DataFrame, y: Column, xs: list[Column], weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """X'WX, X'Wy, y'Wy, sum of wy and n in one aggregation; the number of columns, not of rows, reaches the driver."""
    cols = [F.lit(1.0), *xs]
    w = F.lit(1.0) if weight is None else weight
    k = len(cols)
    sums = [F.sum(w * cols[i] * cols[j]) for i in range(k) for j in range(i, k)]
    sums += [F.sum(w * c * y) for c in cols] + [F.sum(w * y * y), F.sum(w * y), F.count("*")]
    ok = y.isNotNull()
    for x in xs:
        ok = ok & x.isNotNull()
    row = df.where(ok).agg(*sums).first()
    g = np.zeros((k, k))
    at = 0
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[at] or 0.0
            at += 1
    return g, np.array([v or 0.0 for v in row[at : at + k]]), row[at + k] or 0.0, row[at + k + 1] or 0.0, row[at + k + 2]


def linear_model(df: DataFrame, y: Column, xs: dict[str, Column]) -> pd.DataFrame:
    """Least squares with intercept: estimate, standard error, t, p, robust (HC3) error and VIF by term; attrs: r2, adj_r2, n, f, f_p."""
    cols = list(xs.values())
    g, xy, yy, sy, n = _gram(df, y, cols)
    inv = np.linalg.pinv(g)
    beta = inv @ xy
    rss = max(yy - beta @ xy, 0.0)
    tss = yy - sy * sy / n
    k = len(beta)
    s2 = rss / (n - k)
    se = np.sqrt(np.diag(inv) * s2)
    # leverage-corrected errors need one more pass: sums of squared residuals over (1 - h)^2 by pairs of columns
    design = [F.lit(1.0), *cols]
    fit = sum((F.lit(float(b)) * c for b, c in zip(beta, design, strict=True)), F.lit(0.0))
    h = sum((F.lit(float(inv[i, j])) * design[i] * design[j] for i in range(k) for j in range(k)), F.lit(0.0))
    meat, _, _, _, _ = _gram(df, y, cols, ((y - fit) / (1 - h)) * ((y - fit) / (1 - h)))
    hc3 = np.sqrt(np.diag(inv @ meat @ inv))
    c = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / n
    d = np.sqrt(np.diag(c))
    vif = np.concatenate([[np.nan], np.diag(np.linalg.pinv(c / np.outer(d, d)))])
    t = beta / se
    out = pd.DataFrame({"term": ["(intercept)", *xs], "estimate": beta, "std_error": se, "t": t, "p_value": [2 * sp.t_sf(abs(v), n - k) for v in t], "hc3_error": hc3, "vif": vif})
    f = ((tss - rss) / (k - 1)) / s2 if k > 1 and s2 > 0 else math.nan
    out.attrs = {"n": n, "rss": rss, "df": n - k, "r2": 1 - rss / tss, "adj_r2": 1 - rss / tss * (n - 1) / (n - k), "f": f, "f_p": sp.f_sf(f, k - 1, n - k) if k > 1 else math.nan}
    return out


def nested_f(small: pd.DataFrame, large: pd.DataFrame) -> tuple[float, float]:
    """F and p of what the larger model adds."""
    a, b = small.attrs, large.attrs
    k = a["df"] - b["df"]
    f = (a["rss"] - b["rss"]) / k / (b["rss"] / b["df"])
    return f, sp.f_sf(f, k, b["df"])


def logistic_model(counts: DataFrame, hits: str, n: str, xs: dict[str, str], rounds: int = 50) -> pd.DataFrame:
    """Logistic regression by reweighted least squares on grouped counts: estimate, error, z, p, odds ratio and interval; attrs: log_likelihood.

    ``counts`` has one row per combination of predictors. Each round is one aggregation.
    """
    cols = [F.col(c).cast("double") for c in xs.values()]
    design = [F.lit(1.0), *cols]
    k = len(design)
    beta = np.zeros(k)
    y, total = F.col(hits).cast("double"), F.col(n).cast("double")
    rows = counts.cache()
    for _ in range(rounds):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, design, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        w = total * p * (1 - p)
        g, _, _, _, _ = _gram(rows, y, cols, w)
        score = rows.agg(*(F.sum(c * (y - total * p)) for c in design)).first()
        step = np.linalg.pinv(g) @ np.array([v or 0.0 for v in score])
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    eta = sum((F.lit(float(b)) * c for b, c in zip(beta, design, strict=True)), F.lit(0.0))
    ll = rows.agg(F.sum(y * eta - total * F.log1p(F.exp(eta)))).first()[0]
    rows.unpersist()
    se = np.sqrt(np.diag(np.linalg.pinv(g)))
    z = beta / se
    out = pd.DataFrame({"term": ["(intercept)", *xs], "estimate": beta, "std_error": se, "z": z, "p_value": 2 * sp.normal_sf(np.abs(z)), "odds_ratio": np.exp(beta), "lower": np.exp(beta - 1.959963984540054 * se), "upper": np.exp(beta + 1.959963984540054 * se)})
    out.attrs = {"log_likelihood": ll, "terms": k}
    return out


def likelihood_ratio(small: pd.DataFrame, large: pd.DataFrame) -> tuple[float, float]:
    x = 2 * (large.attrs["log_likelihood"] - small.attrs["log_likelihood"])
    return x, sp.chi2_sf(max(x, 0.0), large.attrs["terms"] - small.attrs["terms"])


def empirical_p(null: Column, observed: Column, alternative: str = "greater", plus_one: bool = True) -> Column:
    """Aggregate: the share of a null's draws at least as extreme as the observed value.

    ``alternative``: greater, less, doubled (twice the smaller tail, at most 1) or absolute.
    """
    n = F.count(null)
    extra = 1 if plus_one else 0

    def share(condition: Column) -> Column:
        return (F.count(F.when(condition, 1)) + extra) / (n + extra)

    if alternative == "greater":
        return share(null >= observed)
    if alternative == "less":
        return share(null <= observed)
    if alternative == "absolute":
        return share(F.abs(null) >= F.abs(observed))
    return F.least(F.lit(1.0), 2 * F.least(share(null >= observed), share(null <= observed)))


def null_summary(df: DataFrame, group: list[str], null: str, observed: str) -> DataFrame:
    """Per group: observed, null mean, deviation and 95 % quantile (by lines between order statistics), z, fold, and the Monte-Carlo floor and error of p."""
    p = empirical_p(F.col(null), F.col(observed))
    s = df.groupBy(*group).agg(F.max(observed).alias("observed"), F.count(null).alias("n_perm"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"), F.percentile(null, 0.95).alias("null_q95"), p.alias("p_empirical"))
    z = (F.col("observed") - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0))
    error = F.sqrt(F.col("p_empirical") * (1 - F.col("p_empirical")) / F.col("n_perm"))
    return s.select("*", z.alias("z"), (F.col("observed") / F.nullif(F.col("null_mean"), F.lit(0.0))).alias("fold"), (1 / (F.col("n_perm") + 1)).alias("p_floor"), error.alias("p_error"))


def inflation(summaries: DataFrame, group: str, base: str) -> DataFrame:
    """Summaries of nulls with ``inflation``: each null's mean over that of the null named ``base``."""
    of = summaries.where(F.col(group) == base).agg(F.max("null_mean").alias("_base"))  # one row
    return summaries.join(F.broadcast(of)).withColumn("inflation", F.col("null_mean") / F.nullif(F.col("_base"), F.lit(0.0))).drop("_base")


def detectable_difference(p1: float, n1: int, n2: int, power: float = 0.8, alpha: float = 0.05) -> float:
    """The least p2 > p1 that a two-proportion test finds with the given power."""
    za, zb = sp.normal_quantile(1 - alpha / 2), sp.normal_quantile(power)
    lo, hi = p1, 1.0
    for _ in range(100):
        p2 = (lo + hi) / 2
        pool = (n1 * p1 + n2 * p2) / (n1 + n2)
        need = za * math.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2)) + zb * math.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
        lo, hi = (p2, hi) if p2 - p1 < need else (lo, p2)
    return (lo + hi) / 2


def detectable_auc(n1: int, n2: int, power: float = 0.8, alpha: float = 0.05) -> float:
    """The AUC a rank-sum test finds with the given power (Noether)."""
    z = sp.normal_quantile(1 - alpha / 2) + sp.normal_quantile(power)
    share = n1 / (n1 + n2)
    return 0.5 + z / math.sqrt(12 * share * (1 - share) * (n1 + n2))


def moderated_t(sums: DataFrame, mean: str, variance: str, df: str, n: str) -> DataFrame:
    """Moderated t of per-probe means: each variance is shrunk towards a prior whose two parameters come from the moments of log variances.

    Probes may differ in degrees of freedom. Probes without variance take no part in the
    prior. One aggregation; an empty table gives an empty result.
    """
    d = F.col(df).cast("double")
    centred = F.ln(variance) - per_row(lambda k: sp.digamma(k / 2) - math.log(k / 2), "double", d)
    spread = per_row(lambda k: sp.trigamma(k / 2), "double", d)
    ok = sums.where((F.col(variance) > 0) & (d > 0)).select(centred.alias("z"), spread.alias("s"))
    m = ok.agg(F.avg("z"), F.var_samp("z"), F.avg("s")).first()
    if m[0] is None:
        return sums.select("*", *(F.lit(None).cast("double").alias(c) for c in ("t", "p_value")))
    left = (m[1] or 0.0) - m[2]
    d0 = 2 * sp.trigamma_inverse(left) if left > 1e-9 else math.inf
    s0 = math.exp(m[0] + sp.digamma(d0 / 2) - math.log(d0 / 2)) if math.isfinite(d0) else math.exp(m[0])
    shrunk = F.lit(s0) if not math.isfinite(d0) else (F.lit(d0 * s0) + d * F.col(variance)) / (d + F.lit(d0))
    t = F.col(mean) / F.sqrt(shrunk / F.col(n))
    total = d + F.lit(min(d0, 1e9))
    return sums.select("*", t.alias("t"), per_row(lambda t, k: 2 * sp.t_sf(abs(t), k), "double", t, total).alias("p_value"))


def difference_in_differences(df: DataFrame, group: list[str], treated: Column, after: Column, value: str) -> DataFrame:
    """Per group: the four cell means and the difference of the differences."""
    means = {f"m{i}{j}": F.avg(F.when((treated if i else ~treated) & (after if j else ~after), F.col(value))) for i in (1, 0) for j in (1, 0)}
    s = df.groupBy(*group).agg(*(m.alias(n) for n, m in means.items()))
    return s.withColumn("did", (F.col("m11") - F.col("m10")) - (F.col("m01") - F.col("m00")))


def to_rows(spark, frame: pd.DataFrame, schema: str) -> DataFrame:
    """A model's few rows as a DataFrame."""
    names = T.StructType.fromDDL(schema).fieldNames()
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame[names].itertuples(index=False)]
    return spark.createDataFrame(rows, schema)
