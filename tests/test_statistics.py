import math
import time
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F
from strandloom.functions import special as sp
from strandloom.functions import statistics as st
from strandloom.plans import statistics_queries as sq


def test_hypergeometric_goldens():
    assert sp.hypergeometric_tail(114, 25078, 2053, 693) == pytest.approx(4.38798e-13, rel=1e-5)
    assert sp.hypergeometric_tail(50, 25078, 684, 693) == pytest.approx(4.95573e-10, rel=1e-5)
    assert sp.hypergeometric_tail(0, 10, 3, 4) == pytest.approx(1) and sp.hypergeometric_tail(4, 10, 3, 4) == 0
    assert sp.hypergeometric_tail(1, 10, 3, 4, upper=False) + sp.hypergeometric_tail(2, 10, 3, 4) == pytest.approx(1)
    assert sp.hypergeometric_quantile(0.95, 100, 30, 20) == 9


def test_fisher_golden_and_brute_force():
    ratio, lower, upper, p = sp.fisher_2x2(99, 746, 70, 99)
    assert ratio == pytest.approx(0.188121, abs=2e-6) and lower < ratio < upper
    assert p == pytest.approx(8.327e-18, rel=1e-3)
    assert math.isnan(sp.fisher_2x2(0, 0, 3, 4)[0]) and sp.fisher_2x2(0, 0, 3, 4)[3] == 1
    assert sp.fisher_2x2(5, 0, 0, 5)[0] == math.inf
    assert sp.fisher_table([[99, 746], [70, 99]]) == pytest.approx(p, rel=1e-6)
    assert sp.fisher_table([[3, 1], [2, 4], [0, 5]]) == pytest.approx(brute_table([[3, 1], [2, 4], [0, 5]]))
    assert sp.fisher_table([[0, 0], [2, 4]]) == 1


def brute_table(t):
    t = np.array(t)
    rows, cols = t.sum(axis=1), t.sum(axis=0)
    f = math.factorial
    const = math.prod(map(f, rows)) * math.prod(map(f, cols)) / f(int(t.sum()))
    prob = lambda col: const / math.prod(f(x) * f(r - x) for x, r in zip(col, rows, strict=True))
    seen, total = prob(t[:, 0]), 0.0
    for a in range(rows[0] + 1):
        for b in range(rows[1] + 1):
            c = cols[0] - a - b
            if 0 <= c <= rows[2] and (p := prob([a, b, c])) <= seen * (1 + 1e-7):
                total += p
    return total


def test_fisher_table_of_large_counts():
    """Some 1.9 million tables have these margins: made one by one they took half a minute."""
    t = np.array([[5000, 6000], [5300, 5900], [80, 100]])
    (r, s, u), k = t.sum(axis=1).tolist(), int(t[:, 0].sum())
    f = np.array([math.lgamma(i + 1) for i in range(int(t.sum()) + 1)])
    part = lambda n, x: f[n] - f[x] - f[n - x]
    of = lambda i, l: part(r, i) + part(s, k - i - l) + part(u, l)
    l, i = (x.ravel() for x in np.meshgrid(np.arange(u + 1), np.arange(r + 1)))
    there = (k - i - l >= 0) & (k - i - l <= s)
    logs = of(i[there], l[there])
    p = np.exp(logs[logs <= of(5000, 80) + 1e-7] - part(int(t.sum()), k)).sum()
    began = time.process_time()
    assert sp.fisher_table(t.tolist()) == pytest.approx(p, rel=1e-8) == sp.fisher_table(t.T.tolist())
    assert sp.fisher_table(t[[2, 0, 1]].tolist()) == pytest.approx(p, rel=1e-8)
    assert time.process_time() - began < 8


@pytest.mark.parametrize("t", [[[4, 0], [0, 5], [3, 3]], [[2, 2], [2, 2], [2, 2]], [[0, 7], [1, 0], [0, 9]], [[6, 1], [6, 1], [0, 8]], [[9, 3], [1, 1], [12, 30]]])
def test_fisher_table_with_ties_and_edges(t):
    assert sp.fisher_table(t) == pytest.approx(brute_table(t), rel=1e-9)


def test_distributions():
    assert sp.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert float(sp.normal_sf(1.96)) == pytest.approx(0.0249979, abs=1e-7)
    assert 2 * sp.t_sf(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert sp.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert sp.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert sp.binomial_test(7, 10, 0.5) == pytest.approx(0.34375)
    lo, hi = sp.binomial_interval(7, 10)
    assert (lo, hi) == (pytest.approx(0.3475471, abs=1e-6), pytest.approx(0.9332605, abs=1e-6))
    assert sp.trigamma(sp.trigamma_inverse(0.37)) == pytest.approx(0.37, rel=1e-8)
    assert sp.digamma(1) == pytest.approx(-0.5772156649015329)


def test_adjusted(spark):
    p = [0.01, 0.02, 0.03, 0.04, 0.5, 0.02]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)] + [(90, None), (91, float("nan"))], "i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in st.adjusted(df, "p").collect()}
    order = sorted(range(6), key=lambda i: p[i])
    want, low = {}, 1.0
    for rank in range(6, 0, -1):
        i = order[rank - 1]
        low = min(low, p[i] * 6 / rank)
        want[i] = low
    assert all(got[i] == pytest.approx(want[i]) for i in want) and got[90] is None and got[91] is None


def test_rank_sum_matches_pairs(spark):
    a, b = [1.0, 4.0, 4.0, 7.0, 9.0], [2.0, 4.0, 5.0, 5.0]
    df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b] + [(None, True), (float("nan"), False), (3.0, None)], "x double, g boolean")
    r = st.wilcoxon(st.rank_sums(df, "x", F.col("g"))).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["u"] == u and r["auroc"] == pytest.approx(u / 20) and 0 < r["p_value"] <= 1


def test_signed_rank_is_exact():
    v = [1.1, -0.4, 2.2, 3.1, -0.9]
    stat, p = st.signed_rank_exact(v)
    ranks = np.argsort(np.argsort(np.abs(v))) + 1
    all_v = [sum(c) for k in range(6) for c in combinations(ranks, k)]
    low, high = np.mean(np.array(all_v) <= stat), np.mean(np.array(all_v) >= stat)
    assert stat == sum(r for r, x in zip(ranks, v, strict=True) if x > 0) and p == pytest.approx(min(1, 2 * min(low, high)))
    assert st.signed_rank_exact([None, float("nan")]) == (0.0, 1.0)


def test_spearman_and_chi_square(spark):
    xy = [(1.0, 2), (2.0, 1), (2.0, 4), (5.0, 4), (9.0, 9)]
    df = spark.createDataFrame(xy + [(None, 1)], "x double, y int")
    rank = lambda v: np.array([sum(w < z for w in v) + (sum(w == z for w in v) + 1) / 2 for z in v])
    want = np.corrcoef(rank([a for a, _ in xy]), rank([b for _, b in xy]))[0, 1]
    r = st.spearman(df, "x", "y").first()
    assert r["n"] == 5 and r["rho"] == pytest.approx(want)
    t = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 12, "r string, c string")
    assert st.chi_square(t, "r", "c").first()["statistic"] == pytest.approx(30 * (10 * 12 - 5 * 3) ** 2 / (15 * 15 * 13 * 17))


def test_linear_model(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=200), rng.normal(size=200)
    y = 1 + 2 * x - z + rng.normal(size=200) * (1 + np.abs(x))
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(x, z, y, strict=True)] + [(1.0, None, 1.0)], "x double, z double, y double")
    m = st.linear_model(df, F.col("y"), {"x": F.col("x"), "z": F.col("z")})
    X = np.column_stack([np.ones(200), x, z])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    res = y - X @ beta
    inv = np.linalg.inv(X.T @ X)
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    hc3 = np.sqrt(np.diag(inv @ (X.T * (res / (1 - h)) ** 2) @ X @ inv))
    assert np.allclose(m["estimate"], beta) and np.allclose(m["hc3_error"], hc3)
    assert np.allclose(m["std_error"], np.sqrt(np.diag(inv) * (res @ res) / 197))
    assert m["vif"][1] == pytest.approx(1 / (1 - np.corrcoef(x, z)[0, 1] ** 2))
    small = st.linear_model(df.where("z is not null"), F.col("y"), {"x": F.col("x")})
    f, p = st.nested_f(small, m)
    assert f == pytest.approx(m["t"][2] ** 2) and p == pytest.approx(m["p_value"][2], rel=1e-6)


def test_logistic_model_meets_its_scores(spark):
    counts = spark.createDataFrame([(0.0, 3, 20), (1.0, 8, 22), (2.0, 15, 21)], "x double, y int, n int")
    m = st.logistic_model(counts, "y", "n", {"x": "x"})
    b = m["estimate"].to_numpy()
    x, y, n = np.array([0, 1, 2.0]), np.array([3, 8, 15]), np.array([20, 22, 21])
    p = 1 / (1 + np.exp(-(b[0] + b[1] * x)))
    assert abs((y - n * p).sum()) < 1e-6 and abs((x * (y - n * p)).sum()) < 1e-6
    null = st.logistic_model(counts, "y", "n", {})
    assert st.likelihood_ratio(null, m)[1] < 0.001


def test_welch_and_splits(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 6.0, 7.0]
    df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b], "x double, g boolean")
    r = st.welch(df, "x", F.col("g")).first()
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 3
    assert r["t"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb))
    assert st.exact_split_p([1, 2, 3], [7, 8, 9]) == pytest.approx(2 / 20)


def test_empirical_p(spark):
    df = spark.createDataFrame([(float(v), 3.0) for v in (-4, -1, 0, 1, 2, 3, 5)], "d double, o double")
    d, o = F.col("d"), F.col("o")
    got = df.agg(*(st.empirical_p(d, o, a, k).alias(f"{a}{k}") for a in ("greater", "less", "doubled", "absolute") for k in (True, False))).first()
    assert list(got) == pytest.approx([3 / 8, 2 / 7, 7 / 8, 6 / 7, 6 / 8, 4 / 7, 4 / 8, 3 / 7])


def test_moderated_t_and_detectable(spark):
    rng = np.random.default_rng(4)
    s2 = rng.chisquare(3, size=300) / 3 * 1 / rng.gamma(4, 0.25, size=300)
    df = spark.createDataFrame([(i, 0.5, float(v), 3, 4) for i, v in enumerate(s2)], "i int, m double, v double, d int, n int")
    t = st.moderated_t(df, "m", "v", "d", "n").collect()
    plain = np.array([0.5 / math.sqrt(v / 4) for v in s2])
    mod = np.array([r["t"] for r in sorted(t, key=lambda r: r["i"])])
    assert mod.std() < plain.std() and np.corrcoef(np.argsort(np.argsort(plain)), np.argsort(np.argsort(mod)))[0, 1] > 0.999
    assert st.moderated_t(df.limit(0), "m", "v", "d", "n").collect() == []
    assert st.detectable_difference(0.2, 100, 100) == pytest.approx(0.38, abs=0.02)
    assert st.detectable_auc(50, 50) == pytest.approx(0.5 + (1.959964 + 0.841621) / math.sqrt(12 * 0.25 * 100), abs=1e-5)


def test_fisher_fits_of_large_counts(spark, monkeypatch):
    """Each of some 80,000 possible counts took all logarithms of its table; seen counts of probability under 1e-300 were not checked at all."""
    tables = [(20_000, 21_000, 300_000, 310_000), (30_000, 11_000, 200_000, 410_000)]
    fits = [(f"m{i}", *t, *sp.fisher_2x2(*t)[:3]) for i, t in enumerate(tables)]
    wrong = ("w", *tables[1], 6.0, 5.0, 7.0)
    names = "motif_id string, a bigint, b bigint, c bigint, d bigint, odds_ratio double, lower double, upper double"
    began = time.monotonic()
    for more, want in (([], (0, 0, 0)), ([wrong], (1, 1, 1))):
        monkeypatch.setattr(sq, "st3_fisher", lambda *_, more=more: spark.createDataFrame(fits + more, names))
        assert tuple(sq.st3_fisher_fits(spark, "").first()) == want
    assert time.monotonic() - began < 45


def test_hypergeometric_logs(spark):
    df = spark.createDataFrame([("a", 4, 10, 5, 6), ("b", 0, 3, 1, 1)], "name string, seen bigint, n bigint, k bigint, m bigint")
    c = math.comb
    want = [(g, i, c(k, i) * c(n - k, m - i) / (c(k, x) * c(n - k, m - x))) for g, x, n, k, m in df.collect() for i in range(max(0, m + k - n), min(k, m) + 1)]
    got = sorted((r["name"], r["i"], math.exp(r["l"])) for r in st.hypergeometric_logs(df, "seen").collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_fisher_of_large_counts_meets_its_definition():
    a, b, c, d = 5_000, 7_000, 40_000, 90_000
    ratio, lower, upper, _ = sp.fisher_2x2(a, b, c, d)
    x = np.arange(a + b + 1)
    f = np.array([math.lgamma(i + 1) for i in range(a + b + c + d + 1)])
    logs = -f[x] - f[a + c - x] - f[a + b - x] - f[d - a + x]

    def share(r):
        w = np.exp((v := logs + x * math.log(r)) - v.max())
        return w / w.sum()

    assert (share(ratio) * x).sum() == pytest.approx(a)
    assert share(lower)[x >= a].sum() == pytest.approx(0.025) == share(upper)[x <= a].sum()


def test_fisher_table_query_on_many_hits(spark, tmp_path):
    """One motif's 68,000 hits have 10 million tables with the same margins."""
    cells = [("+", 16.0, 15_000), ("+", 3.0, 18_700), ("-", 14.0, 15_100), ("-", 13.9, 18_700), (".", 20.0, 290), (".", 1.0, 330), ("*", 20.0, 5), ("+", None, 5), ("-", float("nan"), 5)]
    few = [("+", 16.0, 3), ("+", 3.0, 1), ("-", 14.0, 2), ("-", 13.9, 4), (".", 1.0, 5)]
    counts = spark.createDataFrame([(m, *c) for m, t in (("many", cells), ("few", few), ("#", few)) for c in t], "motif_id string, strand string, score double, n int")
    counts.selectExpr("motif_id", "strand", "score", "explode(sequence(1, n))").drop("col").write.parquet(f"{tmp_path}/fimo.parquet")
    began = time.monotonic()
    got = {r["motif_id"]: tuple(r)[1:] for r in sq.st4_fisher_table(spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 60
    assert set(got) == {"many", "few"} and got["many"][:6] == (15_000, 18_700, 15_100, 18_700, 290, 330) and got["few"][:6] == (3, 1, 2, 4, 0, 5)
    assert got["few"][6] == pytest.approx(brute_table([[3, 1], [2, 4], [0, 5]]))
    chi2 = sum((x - r * c / n) ** 2 / (r * c / n) for r, row in ((33_700, (15_000, 18_700)), (33_800, (15_100, 18_700)), (620, (290, 330))) for x, c, n in zip(row, (30_390, 37_730), (68_120, 68_120), strict=True))
    assert got["many"][6] == pytest.approx(sp.chi2_sf(chi2, 2), rel=1e-2)


@pytest.mark.parametrize("off, within", [(2_000, (1e-4, 1)), (4_000, (1e-20, 1e-5)), (60_000, (0, 0))])
def test_fisher_table_of_three_large_rows(off, within):
    """2.7 million hits spread evenly over the strands: some 500 million tables are near the seen one, each with logarithms of its own before."""
    t = [[450_000, 450_000], [450_000 + off, 450_000 - off], [450_000, 450_000]]
    chi2 = sum((v - (1_350_000 + s * off) / 3) ** 2 / ((1_350_000 + s * off) / 3) for row in t for s, v in zip((1, -1), row, strict=True))
    began = time.process_time()
    p = sp.fisher_table(t)
    assert time.process_time() - began < 5
    assert within[0] <= p <= within[1] and p == pytest.approx(sp.chi2_sf(chi2, 2), rel=1e-2)


def test_fisher_table_of_random_counts():
    rng = np.random.default_rng(7)
    for t in rng.integers(0, [[[4, 4], [30, 6], [12, 25]]], size=(60, 3, 2)).tolist():
        assert sp.fisher_table(t) == pytest.approx(brute_table(t) if np.sum(t, axis=0).all() else 1, rel=1e-9)


def test_fisher_table_query_spreads_motifs(spark, tmp_path):
    """All motifs' tables were tested in one task."""
    spark.range(400).selectExpr("concat('m', id % 20) AS motif_id", "substr('+-.', cast(id % 3 AS int) + 1, 1) AS strand", "double(id % 29) AS score").write.parquet(f"{tmp_path}/fimo.parquet")
    tasks = [r["n"] for r in sq.st4_fisher_table(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).agg(F.count("p_value").alias("n")).collect()]
    assert sum(tasks) == 20 and len(tasks) == 4 and max(tasks) < 8
