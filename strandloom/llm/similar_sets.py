"""All pairs of records whose sets of values are similar, by T-occurrence list merging.

Inverted lists are partitioned by prefix value: with values ordered from rare to
frequent, two sets of Jaccard similarity >= t share a value among the first
``n - ceil(t n) + 1`` of each. Every partition holds the records that have its value
in their prefix and inverted lists of all their values. A record probes them for
records that occur in at least T of its lists: the longest lists are set aside,
a heap merges the short ones and skips ids that cannot reach their count, and ids
that remain are looked up in the long lists by binary search.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ordered import range_sorted
from strandloom.operators.skew import join_unique
from strandloom.session import materialize

#: Records of one prefix value that one task takes at a time; larger lists are split into blocks of this size.
BLOCK = 2000

_EPS = 1e-9


def needed(size: int, threshold: float) -> int:
    """Least overlap of a set of ``size`` with any smaller or equal set of similarity >= threshold."""
    return math.ceil(threshold * size - _EPS)


def merge_skip(lists: list[list[int]], least: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(id, occurrences) for ids in [low, high) that occur in at least ``least`` of the ascending lists.

    Ids that cannot reach the count are jumped over: after taking ``least - 1`` heads
    off the heap their lists move on to the id then at its top.
    """
    heap, at = [], []
    for k, ids in enumerate(lists):
        p = bisect_left(ids, low)
        at.append(p)
        if p < len(ids) and ids[p] < high:
            heap.append((ids[p], k))
    heapq.heapify(heap)
    while len(heap) >= least:
        top = heap[0][0]
        taken = []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= least:
            yield top, len(taken)
            goal = top + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                return
            goal = heap[0][0]
        for k in taken:
            ids = lists[k]
            p = bisect_left(ids, goal, at[k])
            at[k] = p
            if p < len(ids) and ids[p] < high:
                heapq.heappush(heap, (ids[p], k))


def occurrences(values: list[int], index: dict[int, list[int]], least: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(id, occurrences) for ids in [low, high) in at least ``least`` of the values' lists; the longest lists are only searched."""
    lists = sorted((index[v] for v in values if v in index), key=len)
    if len(lists) < least:
        return
    # as many long lists as pay: each set aside lowers the count to reach among the short ones
    longest = len(lists[-1])
    aside = min(least - 1, int(least / (0.02 * math.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    for found, n in merge_skip(short, least - aside, low, high):
        for left, ids in enumerate(long):
            if n + len(long) - left < least:
                break
            p = bisect_left(ids, found)
            n += p < len(ids) and ids[p] == found
        if n >= least:
            yield found, n


def block_pairs(rows: list[tuple[int, bool, int, np.ndarray]], value: int, threshold: float, i: int, j: int) -> Iterator[tuple[int, int, int]]:
    """(record, record, overlap) of similar records whose first common value is ``value``.

    rows: (block, own, record, ascending values). With i == j all pairs count, else pairs of
    a record of block i with one of block j. At least one record of a pair is ``own``: two guests
    of a window of lengths meet in the window below.
    """
    if len(rows) == 2:
        (block, own, a, x), (other, mine, b, y) = rows
        if (own or mine) and (i == j or block != other):
            low, high = (len(x), len(y)) if len(x) < len(y) else (len(y), len(x))
            if low >= needed(high, threshold):
                common = np.intersect1d(x, y, assume_unique=True)
                if len(common) and common[0] == value and len(common) >= threshold * (low + high - len(common)) - _EPS:
                    yield (a, b, len(common)) if len(x) <= len(y) else (b, a, len(common))
        return
    rows.sort(key=lambda r: (len(r[3]), r[2]))
    sizes = [len(r[3]) for r in rows]
    if sizes[-2] < needed(sizes[-1], threshold) and all(a < needed(b, threshold) for a, b in pairwise(sizes)):
        return
    index: dict[int, list[int]] = {}
    for k, (block, own, record, array) in enumerate(rows):
        size, values = sizes[k], array.tolist()
        least = needed(size, threshold)
        low = bisect_left(sizes, least)
        if low < k:
            mine = None
            for other, overlap in occurrences(values, index, least, low, k):
                if (i != j and rows[other][0] == block) or not (own or rows[other][1]):
                    continue
                if overlap < threshold * (size + sizes[other] - overlap) - _EPS:
                    continue
                mine = mine or set(values)
                first = next(v for v in rows[other][3].tolist() if v in mine)
                if first == value:
                    yield rows[other][2], record, overlap
        for v in values:
            index.setdefault(v, []).append(k)


def set_classes(df: DataFrame, record: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Classes of records with the same set: (class_id, values, n_values, n_records, shared), and membership (record, class_id).

    Values are numbered from rare to frequent over all rows; ``shared`` is the least
    number of a value that more than one row has. The class id is the hash of the set, so that
    membership needs no join, whatever a class's size.
    """
    pairs = materialize(df.where(F.col(record).isNotNull() & F.col(value).isNotNull()).select(F.col(record).alias("_r"), F.col(value).alias("_v")))
    placed = range_sorted(pairs.groupBy("_v").agg(F.count("*").alias("_n")), ["_n", "_v"])
    # numbers in the stored order: ascending and unique, not dense; the row's place is in the low 33 bits
    ranks = materialize(placed.select("_v", F.monotonically_increasing_id().alias("_i"), "_n"))
    total, shared = ranks.agg(F.sum("_n"), F.min(F.when(F.col("_n") > 1, F.col("_i")))).first()  # one row
    numbered = join_unique(pairs, ranks, "_v", "_n", total or 0)
    records = materialize(
        numbered.groupBy("_r").agg(F.sort_array(F.collect_set("_i")).alias("values")).withColumn("class_id", F.sha2(F.array_join("values", ","), 256))
    )
    classes = records.groupBy("class_id").agg(F.first("values").alias("values"), F.count("*").alias("n_records"))
    return classes.select("*", F.size("values").alias("n_values"), F.lit(shared).cast("bigint").alias("shared")), records.select(F.col("_r").alias(record), "class_id")


def similar_classes(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(class_a, class_b, overlap) for different classes of Jaccard similarity >= threshold, each pair once.

    Values of one record only make no list. A list of at most ``block`` records is one task's
    work. A longer one is cut by length first: sets more than ``1 / threshold`` times as long as
    others never meet them, so each set goes to the window of its own length and to
    the next one; windows still longer than a block are split into blocks that meet pairwise.
    """
    numbered = materialize(classes.select("class_id", "values", F.coalesce("shared", F.lit(2**62)).alias("shared"), F.monotonically_increasing_id().alias("c")))
    size = F.size("values")
    first = size - F.ceil(F.lit(threshold) * size - F.lit(_EPS)).cast("int") + 1
    prefix = F.filter(F.slice("values", F.lit(1), first), lambda v: v >= F.col("shared"))
    # windows of lengths: a set and one at most 1 / threshold times as long are in the same or in neighbouring ones
    window = F.floor(F.ln(size.cast("double")) / F.lit(1e-6 - math.log(min(threshold, 0.999)))).cast("int")
    posts = numbered.select(F.explode(prefix).alias("v"), window.alias("w"), "c")
    lengths = materialize(posts.groupBy("v", "w").agg(F.count("*").alias("n")))
    long = lengths.groupBy("v").agg(F.sum("n").alias("all")).where(F.col("all") > block).select("v")
    any_long = not long.isEmpty()
    # of long lists: records of each window, own and guests of the one below, and the blocks they make
    held = lengths.join(long, "v", "left_semi").select("v", F.explode(F.array("w", F.col("w") + 1)).alias("w"), "n")
    cuts = held.groupBy("v", "w").agg(F.ceil(F.sum("n") / block).cast("int").alias("k"))
    cuts = materialize(cuts) if any_long else cuts
    rows = numbered.select(F.explode(prefix).alias("v"), window.alias("w"), "c", "values")
    short = (rows.join(long, "v", "left_anti") if any_long else rows).select("v", F.lit(-1).alias("w"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("b"), F.lit(True).alias("own"), "c", "values")
    windows = F.explode(F.array(F.struct(F.col("w"), F.lit(True).alias("own")), F.struct((F.col("w") + 1).alias("w"), F.lit(False).alias("own"))))
    guests = rows.join(long, "v", "left_semi").select("v", "c", "values", windows.alias("x")).select("v", "x.w", "x.own", "c", "values")
    spread = (
        guests.join(cuts, ["v", "w"])
        .withColumn("b", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("v", "w", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "own", "c", "values")
    )
    grouped = (short.unionByName(spread) if any_long else short).repartition("v", "w", "i", "j").sortWithinPartitions("v", "w", "i", "j")

    def probe(batches):
        names = ["a", "b", "overlap"]

        def pairs_of(key, rows_):
            found: list[tuple[int, int, int]] = []
            for pair in block_pairs(rows_, key[0], threshold, key[2], key[3]):
                found.append(pair)
                if len(found) >= 10_000:  # a block may have millions of pairs: they leave as they are found
                    yield found
                    found = []
            if found:
                yield found

        def found_in(batches):
            key, rows_ = None, []
            for batch in batches:
                keys = list(zip(*(batch.column(k).to_pylist() for k in ("v", "w", "i", "j")), strict=True))
                b, own, c = (batch.column(k).to_pylist() for k in ("b", "own", "c"))
                sets, offsets = batch.column("values").values.to_numpy(), batch.column("values").offsets.to_numpy()
                for r, here in enumerate(keys):
                    if key != here:
                        if len(rows_) > 1:
                            yield from pairs_of(key, rows_)
                        key, rows_ = here, []
                    rows_.append((b[r], own[r], c[r], sets[offsets[r] : offsets[r + 1]]))
            if len(rows_) > 1:
                yield from pairs_of(key, rows_)

        waiting: list[tuple[int, int, int]] = []
        for found in found_in(batches):
            waiting += found
            if len(waiting) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*waiting, strict=True)], names=names)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*waiting, strict=True)], names=names)

    found = grouped.mapInArrow(probe, "a bigint, b bigint, overlap bigint")
    ids = numbered.select("c", "class_id")
    return (
        found.join(ids.select(F.col("c").alias("a"), F.col("class_id").alias("class_a")), "a")
        .join(ids.select(F.col("c").alias("b"), F.col("class_id").alias("class_b")), "b")
        .select("class_a", "class_b", "overlap")
    )


def similar_pairs(df: DataFrame, record: str, value: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(record_a, record_b), a < b, of different records whose sets have Jaccard similarity >= threshold.

    ``df`` has one row per record and value; repeated rows change nothing, rows with a
    null record or value are left out, so that a record without values forms no pair.
    Similarity is decided between distinct sets and then handed to their members.
    Other columns are ignored. An empty table gives no pairs.
    """
    classes, members = set_classes(df, record, value)
    links = similar_classes(classes, threshold, block)
    a, b = (members.select(F.col(record).alias(f"_{x}"), F.col("class_id").alias(f"class_{x}")) for x in "ab")
    between = links.join(a, "class_a").join(b, "class_b").select("_a", "_b")
    within = a.join(b, F.col("class_a") == F.col("class_b")).where(F.col("_a") < F.col("_b")).select("_a", "_b")
    return between.unionByName(within).select(F.least("_a", "_b").alias(f"{record}_a"), F.greatest("_a", "_b").alias(f"{record}_b"))
