"""Table verbs: lookups, first rows, bins, cross tables, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators.ordered import prefix_sum_within


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in a total order; nulls in a key form a group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def lookup(df: DataFrame, table: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Left join that takes the first matching row of ``table``; null keys match none."""
    return df.join(first_by(table.where(F.col(key).isNotNull()), [key], order), key, "left")


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the value of keys that have exactly one, null for keys that have several."""
    seen = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key)
    found = seen.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return found.select(key, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(value))


def cascade(df: DataFrame, key: str, passes: list[tuple[DataFrame, str]], into: str) -> DataFrame:
    """Map ``key`` by the first of several (name, target) tables that has it; ambiguous names and targets claimed by an earlier pass don't count."""
    todo = df.select(key).where(F.col(key).isNotNull()).distinct()
    done: DataFrame | None = None
    for i, (table, target) in enumerate(passes):
        named = unambiguous(table.select(F.col(table.columns[0]).alias(key), F.col(target).alias(into)), key, into).where(F.col(into).isNotNull())
        if done is not None:
            named = named.join(done.select(into).distinct(), into, "left_anti")
        hit = todo.join(named, key).select(key, into, F.lit(i + 1).alias("pass"))
        todo = todo.join(hit, key, "left_anti")
        done = hit if done is None else done.unionByName(hit)
    return df.join(done, key, "left")


def exact_quantiles(df: DataFrame, column: str, shares: list[float], group: list[str] | None = None) -> DataFrame:
    """(group, q) with linear-interpolated quantiles of the values that are not null or NaN, as an array in the order of ``shares``.

    Values are counted, the counts prefix-summed in a range-sorted scan, and each
    quantile's two neighbours are found by their running count: no group is sorted in one task.
    Without groups there is one row, of nulls for a table without values.
    """
    group = group or []
    ok = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))
    counted = df.where(ok).groupBy(*group, column).agg(F.count("*").alias("_c"))
    totals = counted.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group))).agg(F.sum("_c").alias("_n"))
    running = prefix_sum_within(counted, group, [column], "_c", "_upto")
    same = [running[g].eqNullSafe(totals[f"_g{i}"]) for i, g in enumerate(group)]
    both = running.join(totals, same) if same else running.join(F.broadcast(totals))  # without groups: one row
    found = []
    for k, share in enumerate(shares):
        at = (F.col("_n") - 1) * F.lit(float(share))
        low = F.floor(at)
        value = F.col(column).cast("double")
        found += [F.min(F.when(F.col("_upto") > low, value)).alias(f"_lo{k}"), F.min(F.when(F.col("_upto") > low + 1, value)).alias(f"_hi{k}"), F.max(at - low).alias(f"_f{k}")]
    ends = both.groupBy(*group).agg(*found)
    line = [F.col(f"_lo{k}") + F.when(F.col(f"_f{k}") > 0, F.col(f"_f{k}") * (F.col(f"_hi{k}") - F.col(f"_lo{k}"))).otherwise(0.0) for k in range(len(shares))]
    return ends.select(*group, F.array(*line).alias("q"))


def binned(value: Column, edges: Column) -> Column:
    """The number of edges below a value, plus 1: bin of ``(e1, e2], (e2, e3] ...`` with equal edges counted once."""
    return F.size(F.filter(F.array_distinct(edges), lambda e: e < value)) + 1


def cross_table(df: DataFrame, rows: str, columns: str, levels: list[str], margin: bool = True) -> DataFrame:
    """Counts of ``columns``' levels per ``rows``, and with ``margin`` each row's total."""
    counts = [F.count(F.when(F.col(columns) == v, 1)).alias(v) for v in levels]
    return df.groupBy(rows).agg(*counts, *([F.count("*").alias("total")] if margin else []))


def in_all(df: DataFrame, member: str, group: str) -> DataFrame:
    """Members that occur in every group: the n-way intersection in one aggregation."""
    n = df.select(F.count_distinct(group).alias("_n"))
    seen = df.groupBy(member).agg(F.count_distinct(group).alias("_m"))
    return seen.join(n, F.col("_m") == F.col("_n"), "left_semi").select(member)


def complement_split(df: DataFrame, key: str, seed: int, share: float = 0.5) -> DataFrame:
    """Each row in one of two halves by its key's hash: repeatable, and the halves have nothing in common."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return df.withColumn("half", F.when(part < share, 1).otherwise(2))


def interpolated(df: DataFrame, curve: DataFrame, group: str, x: str, y: str, at: str) -> DataFrame:
    """``y`` of each group's curve at ``at`` by straight lines between its points; null outside them."""
    w = W.partitionBy(group).orderBy(x)
    segments = curve.select(F.col(group), F.col(x).alias("_x0"), F.col(y).alias("_y0"), F.lead(x).over(w).alias("_x1"), F.lead(y).over(w).alias("_y1"))
    hit = df.join(segments, group).where((F.col(at) >= F.col("_x0")) & (F.col(at) < F.col("_x1")))
    line = F.col("_y0") + (F.col(at) - F.col("_x0")) * (F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0"))
    return hit.select(*df.columns, line.alias(y))


def stars(p: Column) -> Column:
    """Marks of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
