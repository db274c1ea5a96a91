"""Read-level stages: duplicates, fragment size, enriched regions, threshold sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.statistics import per_row
from strandloom.operators.intervals import Cols, overlap_pairs
from strandloom.operators.islands import blocks_and_gaps


def five_prime(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "-", end - 1).otherwise(start)


def without_duplicates(df: DataFrame, key: str, start: str, end: str, strand: str, row: str) -> DataFrame:
    """The row of smallest id for each key, strand and 5' position: found by aggregation, so a pile-up is one row per task."""
    at = five_prime(F.col(start), F.col(end), F.col(strand))
    kept = df.groupBy(key, strand, at.alias("_at")).agg(F.min(row).alias("_row")).select("_row")
    return df.join(kept, df[row] == kept["_row"], "left_semi")


def usable_reads(df: DataFrame, flag: str, quality: str, exclude: int = 1804, least: int = 30) -> DataFrame:
    """Reads of enough quality with none of the excluded flag bits."""
    return df.where((F.col(quality) >= least) & (F.col(flag).bitwiseAND(exclude) == 0))


def cross_correlation(df: DataFrame, key: str, start: str, end: str, strand: str, shifts: list[int]) -> DataFrame:
    """(shift, correlation) of 5' counts on the two strands, the second moved by each shift, over positions where either strand begins.

    Counts per position are joined with their shifted selves; empty positions of a
    track of ``span`` positions enter through the moments only.
    """
    at = five_prime(F.col(start), F.col(end), F.col(strand))
    n = df.where(F.col(strand).isin("+", "-")).groupBy(F.col(key).alias("k"), at.alias("p"), F.col(strand).alias("d")).agg(F.count("*").alias("n"))
    plus = n.where("d = '+'").select("k", "p", F.col("n").cast("double").alias("x"))
    minus = n.where("d = '-'").select("k", F.col("p").alias("q"), F.col("n").cast("double").alias("y"))
    moved = minus.withColumn("shift", F.explode(F.array(*(F.lit(s) for s in shifts)))).withColumn("p", F.col("q") - F.col("shift"))
    both = plus.join(moved, ["k", "p"]).groupBy("shift").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    span = n.groupBy("k").agg((F.max("p") - F.min("p") + 1).alias("w")).agg(F.sum("w").cast("double").alias("w"))
    sx = plus.agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    sy = minus.agg(F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    m = F.broadcast(span.join(sx).join(sy))  # one row of moments
    all_shifts = df.sparkSession.createDataFrame([(s,) for s in shifts], "shift int").join(both, "shift", "left").join(m)
    top = F.coalesce("xy", F.lit(0.0)) - F.col("sx") * F.col("sy") / F.col("w")
    r = top / F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / F.col("w")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("w")))
    return all_shifts.select("shift", r.alias("correlation"))


def extension(first: Column, second: Column, warn: int = 30) -> tuple[Column, Column]:
    """Mean of two fragment estimates, rounded down, and whether they differ by more than ``warn``; null if one is missing."""
    return F.floor((first + second) / 2), F.abs(first - second) > warn


def poisson_tail(n: int, rate: float) -> float:
    """P(X >= n)."""
    if n <= 0:
        return 1.0
    if rate <= 0:
        return 0.0
    if n <= rate:  # the lower sum is the short one
        return max(0.0, 1.0 - sum(math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(n)))
    total, k = 0.0, n
    while True:
        term = math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        total += term
        k += 1
        if term < total * 1e-17 or k > n + 10_000:
            return min(1.0, total)


def enriched_regions(df: DataFrame, key: str, start: str, end: str, bin_size: int, most_p: float) -> DataFrame:
    """(key, start, end, p_value): merged bins with more read starts than a Poisson law with the key's mean allows.

    An approximation of model-based peak calling: one rate per key, bins instead of windows.
    """
    bins = df.where(F.col(key).isNotNull() & F.col(start).isNotNull()).groupBy(F.col(key).alias("k"), F.floor(F.col(start) / bin_size).alias("b")).agg(F.count("*").alias("n"))
    rates = bins.groupBy("k").agg((F.sum("n") / (F.max("b") - F.min("b") + 1)).alias("rate"))
    p = per_row(lambda n, r: poisson_tail(int(n), float(r)), "double", F.col("n"), F.col("rate"))
    hot = bins.join(rates, "k").withColumn("p", p).where(F.col("p") <= most_p)
    spans = hot.select("k", (F.col("b") * bin_size).alias("s"), (F.col("b") * bin_size + bin_size - 1).alias("e"))
    blocks = blocks_and_gaps(spans, ["k"], "s", "e").where("piece = 'block'").select("k", F.col("from_pos").alias("f"), F.col("to_pos").alias("t"))
    per = hot.withColumn("s", F.col("b") * bin_size)
    pairs = overlap_pairs(per.select("k", "s", (F.col("s") + 1).alias("e"), "p"), blocks.withColumn("t", F.col("t") + 1), Cols("k", "s", "e", "s"), Cols("k", "f", "t", "f"), width=bin_size * 16)
    best = pairs.groupBy("b_k", "b_f", "b_t").agg(F.min("a_p").alias("p_value"))
    return best.select(F.col("b_k").alias(key), F.col("b_f").alias(start), F.col("b_t").alias(end), "p_value")


def threshold_sweep(df: DataFrame, value: str, thresholds: list[float], group: list[str]) -> DataFrame:
    """(group, threshold, n): rows at or below each threshold, all thresholds in one pass."""
    met = F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col(value) <= t)
    hits = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*group, F.explode(met).alias("threshold"))
    return hits.groupBy(*group, "threshold").agg(F.count("*").alias("n"))
