"""Randomisation with keyed draws: the same key gives the same number on any cluster.

Draws are the first 32 bits of an md5 of seed, replicate and row key. Resamples are
ranks of draws within (replicate, stratum), so sampling is without replacement and
exact in size, and nothing depends on where rows lie.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators.ordered import rank_within
from strandloom.session import materialize


def draw(seed: int | str, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) fixed by seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def replicates(df: DataFrame, n: int, into: str = "rep") -> DataFrame:
    """Each row once per replicate 1 to ``n``."""
    return df.withColumn(into, F.explode(F.sequence(F.lit(1), F.lit(n))))


def random_intervals(df: DataFrame, lengths: DataFrame, key: str, start: str, end: str, row: str, n: int, seed: int) -> DataFrame:
    """``n`` replicates of the intervals, each of the same key and width at a uniform start; ``lengths`` is (key, length)."""
    placed = replicates(df, n).join(lengths, key)
    width = F.col(end) - F.col(start)
    u = draw(seed, F.col("rep"), F.col(row))
    s = F.floor(u * F.greatest(F.col("length") - width + 1, F.lit(1)))
    return placed.withColumns({"_s": s, "_e": s + width}).drop(start, end, "length").withColumnsRenamed({"_s": start, "_e": end})


def resample(pool: DataFrame, row: str, n: int, size: int, seed: int, distributed: bool = False) -> DataFrame:
    """(rep, row of pool) for ``n`` replicates of ``size`` rows without replacement.

    Only a window with a limit is used: each task keeps its ``size`` smallest draws. With
    ``distributed`` (sizes near the pool's) ranks come from a range-sorted scan.
    """
    drawn = replicates(pool, n).withColumn("_u", draw(seed, F.col("rep"), F.col(row)))
    if distributed:
        return rank_within(drawn, ["rep"], ["_u", row], "_r").where(F.col("_r") <= size).drop("_u", "_r")
    return drawn.withColumn("_r", F.row_number().over(W.partitionBy("rep").orderBy("_u", row))).where(F.col("_r") <= size).drop("_u", "_r")


def matched_resample(pool: DataFrame, row: str, stratum: str, needs: DataFrame, n: int, seed: int) -> DataFrame:
    """(rep, row of pool) with exactly the wanted number per stratum; ``needs`` is (stratum, need). A smaller pool gives what it has."""
    wanted = needs.groupBy(stratum).agg(F.sum("need").alias("need"))
    drawn = replicates(pool.join(wanted, stratum), n).withColumn("_u", draw(seed, F.col("rep"), F.col(row)))
    ranked = rank_within(drawn, ["rep", stratum], ["_u", row], "_r")
    return ranked.where(F.col("_r") <= F.col("need")).drop("_u", "_r", "need")


def pool_sufficiency(pool: DataFrame, stratum: str, needs: DataFrame, times: int = 10) -> DataFrame:
    """(stratum, need, available, enough): whether the pool has ``times`` the wanted number."""
    have = pool.groupBy(stratum).agg(F.count("*").alias("available"))
    want = needs.groupBy(stratum).agg(F.sum("need").alias("need"))
    a = F.coalesce("available", F.lit(0))
    return want.join(have, stratum, "left").select(stratum, "need", a.alias("available"), (a >= F.col("need") * times).alias("enough"))


def permuted_labels(df: DataFrame, row: str, label: str, n: int, seed: int) -> DataFrame:
    """``df`` in ``n`` replicates with ``label`` shuffled among the rows of each."""
    base = df.select(row, label)
    order = rank_within(base, [], [row], "_k")
    mixed = rank_within(replicates(base, n).withColumn("_u", draw(seed, F.col("rep"), F.col(row))), ["rep"], ["_u", row], "_k")
    labels = order.select("_k", F.col(label).alias("_new"))
    given = mixed.join(labels, "_k").select("rep", F.col(row).alias("_row"), "_new")
    return df.join(given, df[row] == given["_row"]).drop(label, "_row").withColumnRenamed("_new", label)


def split_half(df: DataFrame, row: str, seed: int) -> DataFrame:
    """Each row in half 1 or 2 of an even split."""
    ranked = rank_within(df.withColumn("_u", draw(seed, F.col(row))), [], ["_u", row], "_r")
    return ranked.withColumn("half", (F.col("_r") % 2 + 1).cast("int")).drop("_u", "_r")


def bootstrap(df: DataFrame, row: str, n: int, seed: int) -> DataFrame:
    """``n`` replicates of as many rows as ``df`` has, drawn with replacement: (rep, row, copies), rows never drawn left out.

    Each slot draws a position; positions are counted, so a replicate is one row per item drawn.
    """
    order = rank_within(df.select(row), [], [row], "_k")
    size = order.agg(F.max("_k")).first()[0] or 0
    slots = replicates(order.select(F.col("_k").alias("_slot")), n)
    at = (F.floor(draw(seed, F.col("rep"), F.col("_slot")) * size) + 1).alias("_k")
    return slots.select("rep", at).groupBy("rep", "_k").agg(F.count("*").alias("copies")).join(order, "_k").select("rep", row, "copies")


def random_windows(lengths: DataFrame, key: str, n: int, width: int, seed: int, rounds: int = 4, after: int = 0) -> DataFrame:
    """(draw_id, key, start, end): windows at positions uniform over all keys' lengths, ``rounds`` times as many as asked, in drawing order.

    The caller removes what it excludes and keeps the first ``n``. Draws go on behind draw ``after``.
    """
    usable = lengths.where(F.col("length") >= width)
    w = W.partitionBy(F.lit(0)).orderBy(key)  # a row per key: few
    ends = usable.select(key, "length", F.sum(F.col("length") - width + 1).over(w).alias("_to"))
    ends = ends.withColumn("_from", F.col("_to") - (F.col("length") - width + 1))
    total = ends.agg(F.max("_to").alias("_all"))
    spark = lengths.sparkSession
    ids = spark.range(after + 1, after + n * rounds + 1).withColumnRenamed("id", "draw_id")
    at = F.floor(draw(seed, F.col("draw_id")) * F.col("_all"))
    drawn = ids.join(F.broadcast(total)).withColumn("_at", at)  # one row of totals
    hit = drawn.join(F.broadcast(ends), (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    s = F.col("_at") - F.col("_from")
    return hit.select("draw_id", key, s.alias("start"), (s + width).alias("end"))


def kept_windows(lengths: DataFrame, key: str, n: int, width: int, seed: int, keep: Callable[[DataFrame], DataFrame], rounds: int = 40) -> DataFrame:
    """The first ``n`` random windows that ``keep`` lets through: up to ``rounds`` rounds of 4 ``n`` draws each, a warning if they don't suffice."""
    found, have = None, 0
    for k in range(rounds):
        kept = materialize(keep(random_windows(lengths, key, n, width, seed, after=4 * n * k)).orderBy("draw_id").limit(n))
        found = kept if found is None else found.unionByName(kept)
        have += kept.count()
        if have >= n:
            break
    else:
        warnings.warn(f"{have} of {n} windows kept after {rounds} rounds of {4 * n} draws", stacklevel=2)
    return found.orderBy("draw_id").limit(n)
