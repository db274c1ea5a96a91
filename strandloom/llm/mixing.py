"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.ordered import prefix_sum_within
from strandloom.session import materialize


def source_rates(items: DataFrame, source: str, size: str, targets: DataFrame, share: str, repeats: str, total: int | None = None) -> DataFrame:
    """Per source of either table: sizes, target and the expected copies of each of its items.

    Targets are scaled to sum to 1 over the sources that have something to give. With
    ``total`` None the mix is as large as all targets allow at once: the source that
    reaches its cap first sets the size. With a larger ``total`` capped sources fall
    short, and the report shows it. Sources without a target contribute nothing.
    """
    sums = items.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_items"), F.coalesce(F.sum(size), F.lit(0)).alias("n_tokens"))
    wanted = targets.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.max(share).alias("target_share"), F.max(repeats).alias("max_repeats"))
    both = wanted.join(sums, "source", "full_outer").withColumns({"n_items": F.coalesce("n_items", F.lit(0)), "n_tokens": F.coalesce("n_tokens", F.lit(0))})
    gives = (F.col("n_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    weight = F.when(gives, F.col("target_share"))
    least = F.min(F.when(gives, F.col("max_repeats") * F.col("n_tokens") / F.col("target_share")))
    sums_row = both.agg(F.coalesce(F.sum(weight), F.lit(1.0)).alias("w"), F.coalesce(least, F.lit(0.0)).alias("t")).first()
    goal = float(total) if total is not None else sums_row["t"] * sums_row["w"]
    aimed = weight / F.lit(sums_row["w"])
    rate = F.least(F.col("max_repeats").cast("double"), F.lit(goal) * aimed / F.col("n_tokens"))
    return both.select("source", "n_items", "n_tokens", "target_share", "max_repeats", aimed.alias("aimed_share"), F.when(gives, rate).otherwise(F.lit(0.0)).alias("copies_each"))


def mix_sources(
    items: DataFrame, item: str, source: str, size: str, targets: DataFrame, share: str = "target_share", repeats: str = "max_repeats", total: int | None = None, seed: int = 1
) -> DataFrame:
    """(item, source, copy_no, size): each item as often as integers are crossed by its source's running total of expected copies.

    Within a source items are ordered by size, then item; their expected copies are
    prefix-summed, one random offset per source is added, and an item comes once for
    each integer its step crosses. As rates are at most ``max_repeats``, no item comes
    more often; along the size order every stretch of items gives its due, so token
    totals stay within about one item of the target. Items with null or zero size, with a
    null source or a source without target are left out. The same seed gives the same mix.
    """
    rates = source_rates(items, source, size, targets, share, repeats, total).select(F.col("source").alias("_s"), "copies_each").where("copies_each > 0")
    # at most one row per row of the targets' table
    rows = items.where(F.col(size) > 0).select(F.col(item).alias("_i"), F.col(source).alias("_s"), F.col(size).alias("_n"))
    placed = prefix_sum_within(rows.join(F.broadcast(rates), "_s"), ["_s"], ["_n", "_i"], "copies_each", "_upto")
    out = T.StructType([placed.schema["_i"], placed.schema["_s"], T.StructField("copy_no", T.IntegerType()), placed.schema["_n"]])

    def emit(batches):
        for b in batches:
            names = b.column("_s").dictionary_encode()
            starts = np.array([zlib.crc32(f"{seed}|{s}".encode()) / 2**32 for s in names.dictionary.to_pylist()])[names.indices.to_numpy()]
            upto = b.column("_upto").to_numpy()
            rate = b.column("copies_each").to_numpy()
            # totals are sums of one rate: counted back in steps, both ends of a step are the same number for both neighbours
            step = np.rint(upto / rate)
            copies = (np.floor(starts + step * rate) - np.floor(starts + (step - 1) * rate)).astype(np.int64)
            at = np.repeat(np.arange(len(copies)), copies)
            if len(at):
                number = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies) + 1
                taken = [b.column(c).take(pa.array(at)) for c in ("_i", "_s", "_n")]
                yield pa.RecordBatch.from_arrays([taken[0], taken[1], pa.array(number.astype(np.int32)), taken[2]], names=out.fieldNames())

    return placed.mapInArrow(emit, out).withColumnsRenamed({"_i": item, "_s": source, "_n": size})


def mix_report(
    items: DataFrame, item: str, source: str, size: str, targets: DataFrame, share: str = "target_share", repeats: str = "max_repeats", total: int | None = None, seed: int = 1
) -> DataFrame:
    """Per source of either table: target and actual share of the mix, its items, copies, tokens and largest number of repeats."""
    mixed = mix_sources(items, item, source, size, targets, share, repeats, total, seed)
    per_item = mixed.groupBy(F.col(source).alias("source"), item).agg(F.count("*").alias("c"), F.sum(size).alias("t"))
    got = materialize(per_item.groupBy("source").agg(F.count("*").alias("n_used"), F.sum("c").alias("n_copies"), F.max("c").alias("most_repeats"), F.sum("t").alias("mixed_tokens")))
    whole = got.agg(F.sum("mixed_tokens")).first()[0] or 0
    rates = source_rates(items, source, size, targets, share, repeats, total)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_used", "n_copies", "most_repeats", "mixed_tokens")}
    joined = rates.join(got, rates["source"].eqNullSafe(got["source"]), "left").drop(got["source"]).withColumns(zero)
    return joined.select(
        F.col("source").alias(source), "target_share", F.round("aimed_share", 6).alias("aimed_share"), F.round(F.col("mixed_tokens") / F.lit(whole), 6).alias("actual_share"),
        "max_repeats", "most_repeats", "n_items", "n_used", "n_copies", "n_tokens", "mixed_tokens",
    )
