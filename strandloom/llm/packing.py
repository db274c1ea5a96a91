"""Filling fixed-capacity containers with items, shortest pack first over the length histogram."""

from __future__ import annotations

import logging
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.ordered import rank_within
from strandloom.session import materialize

log = logging.getLogger(__name__)

#: Slots of all kinds (32 bytes each) that are broadcast; more of them meet the items by a join on kind, length and stretch of ranks.
SLOTS = 1 << 18

#: Ranks of a stretch in that join.
STRETCH = 1 << 16


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Packing patterns (number of containers, lengths in each) that use up the histogram.

    Lengths are placed longest first, each item into the container with the most room
    left. Containers alike are one pattern with a count, so the work follows the number
    of different lengths and patterns, not the number of items.
    """
    room: dict[int, list[tuple[int, tuple | None]]] = defaultdict(list)  # room left -> [(containers, (pattern before, length))]
    most = -1
    done: list[tuple[int, tuple]] = []

    def put(left: int, count: int, pattern: tuple) -> None:
        nonlocal most
        if left:
            room[left].append((count, pattern))
            most = max(most, left)
        else:
            done.append((count, pattern))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            while most > 0 and not room.get(most):
                room.pop(most, None)
                most -= 1
            if most < length:  # it fits nowhere: open containers and fill them with this length
                each = capacity // length
                full, part = divmod(n, each)
                for count, copies in ((full, each), (1 if part else 0, part)):
                    if count:
                        pattern = None
                        for _ in range(copies):
                            pattern = (pattern, length)
                        put(capacity - copies * length, count, pattern)
                n = 0
            else:
                count, pattern = room[most].pop()
                here, used = most, min(count, n)
                if count > used:
                    room[here].append((count - used, pattern))
                put(here - length, used, (pattern, length))
                n -= used
    out = []
    for count, pattern in done + [p for left in room.values() for p in left]:
        lengths = []
        while pattern is not None:
            pattern, length = pattern
            lengths.append(length)
        out.append((count, lengths[::-1]))
    return out


def _slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each slot, its first container, its place in the container and the tokens before it."""
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    container = 0
    for count, lengths in patterns:
        before = 0
        for place, length in enumerate(lengths):
            slots[length].append((ranks[length], container, place, before))
            ranks[length] += count
            before += length
        container += count
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for length, rows in slots.items()}


def pieces(items: DataFrame, item: str, size: str, containers: DataFrame, kind: str, capacity: str) -> DataFrame:
    """(kind, item, piece_no, n_tokens, n_pieces): each item once per kind, whole unless it exceeds the capacity.

    An item beyond the capacity becomes pieces of exactly the capacity and one of the
    rest. ``containers`` is the table of kinds: a few rows, read by its aggregates'
    map; it never grows with the items.
    """
    kinds = [(r[0], r[1]) for r in containers.where(F.col(capacity) > 0).groupBy(kind).agg(F.max(capacity)).collect()]
    rows = items.where(F.col(item).isNotNull() & (F.col(size) > 0)).select(F.col(item).alias("_item"), F.col(size).cast("bigint").alias("_n"))
    if not kinds:
        rows, kinds = rows.limit(0), [(None, 1)]
    known = F.explode(F.array(*(F.struct(F.lit(k).cast("string").alias("kind"), F.lit(int(c)).alias("cap")) for k, c in kinds)))
    rows = rows.select("*", known.alias("_c")).select("*", F.col("_c.kind").alias("_kind"), F.col("_c.cap").alias("_cap"))
    n = F.ceil(F.col("_n") / F.col("_cap")).cast("int")
    rows = rows.select("_kind", "_cap", "_item", "_n", n.alias("_pieces"), F.explode(F.sequence(F.lit(1), n)).alias("_piece"))
    return rows.select("_kind", "_cap", "_item", "_piece", F.least(F.col("_cap"), F.col("_n") - (F.col("_piece") - 1) * F.col("_cap")).cast("int").alias("_size"), "_pieces")


def _placed_by_join(ranked: DataFrame, slots: dict[str, dict[int, tuple[np.ndarray, ...]]], most: dict[str, dict[int, int]]) -> DataFrame:
    """Items with their slots, where there are too many slots to broadcast: a slot covers ranks up to the next one's, in every stretch they touch."""
    spark = ranked.sparkSession
    parts = []
    for kind, sizes in slots.items():
        for size, (first, container, place, before) in sizes.items():
            n = len(first)
            last = np.append(first[1:], most[kind][size])
            parts.append(pa.table({"_kind": pa.array([kind] * n), "_size": pa.array(np.full(n, size, np.int32)), "f": first, "l": last, "c": container, "p": place.astype(np.int32), "o": before.astype(np.int32)}))
    table = spark.createDataFrame(pa.concat_tables(parts))
    spread = table.withColumn("s", F.explode(F.sequence(F.floor(F.col("f") / STRETCH), F.floor((F.col("l") - 1) / STRETCH))))
    at = F.col("_rank") - 1
    rows = ranked.withColumn("s", F.floor(at / STRETCH)).alias("i").join(spread.alias("t"), ["_kind", "_size", "s"]).where((at >= F.col("f")) & (at < F.col("l")))
    return rows.select(
        F.col("_kind").alias("kind"), (F.col("c") + at - F.col("f")).alias("container_id"), F.col("p").alias("place"), F.col("o").alias("offset"),
        F.col("_item").alias("item"), F.col("_piece").alias("piece_no"), F.col("_pieces").alias("n_pieces"), F.col("_size").alias("n_tokens"),
    )


def fill_containers(items: DataFrame, item: str, size: str, containers: DataFrame, kind: str, capacity: str, most_slots: int = SLOTS) -> DataFrame:
    """(kind, container_id, place, offset, item, piece_no, n_pieces, n_tokens) for each item and each kind.

    Items with a null or non-positive size take no room and come in no container; an item
    that exceeds a capacity is split, no other is. Equal sizes are told apart by
    item and piece, so the same table always gives the same containers. Extra
    columns are ignored; an empty table gives an empty result.

    The driver sees the histogram only: at most ``capacity`` rows a kind. Ranks within a
    length, which may be that of a third of all items, come from a range-sorted scan. Slots
    are broadcast if there are at most ``most_slots`` of them, and joined otherwise.
    """
    spark = items.sparkSession
    cut = pieces(items, item, size, containers, kind, capacity)
    ranked = rank_within(cut, ["_kind", "_size"], ["_item", "_piece"], "_rank")
    plans, capacities = defaultdict(dict), {}
    for r in cut.groupBy("_kind", "_cap", "_size").count().collect():
        plans[r["_kind"]][r["_size"]] = r["count"]
        capacities[r["_kind"]] = r["_cap"]
    slots = {k: _slots(shortest_pack_first(h, capacities[k])) for k, h in plans.items()}
    n_slots = sum(len(x[0]) for sizes in slots.values() for x in sizes.values())
    log.info("%d slots of %d kinds, %s", n_slots, len(slots), "broadcast" if n_slots <= most_slots else "joined")
    if n_slots > most_slots:
        return _placed_by_join(ranked, slots, plans).withColumnsRenamed({"kind": kind, "item": item})
    sent = spark.sparkContext.broadcast(slots)
    out = T.StructType.fromDDL("kind string, container_id bigint, place int, `offset` int, piece_no int, n_pieces int, n_tokens int")
    out = T.StructType([out[0], out[1], out[2], out[3], T.StructField("item", ranked.schema["_item"].dataType), *out.fields[4:]])

    def place(batches):
        for b in batches:
            kinds = b.column("_kind").dictionary_encode()
            names, coded = kinds.dictionary.to_pylist(), kinds.indices.to_numpy(zero_copy_only=False)
            sizes = b.column("_size").to_numpy()
            ranks = b.column("_rank").to_numpy() - 1
            ids, places, offsets = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
            edges = [0, *(np.flatnonzero((np.diff(sizes) != 0) | (np.diff(coded) != 0)) + 1).tolist(), len(sizes)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                starts, first, at, before = sent.value[names[coded[lo]]][int(sizes[lo])]
                k = np.searchsorted(starts, ranks[lo:hi], side="right") - 1
                ids[lo:hi] = first[k] + ranks[lo:hi] - starts[k]
                places[lo:hi] = at[k]
                offsets[lo:hi] = before[k]
            yield pa.RecordBatch.from_arrays(
                [b.column("_kind"), pa.array(ids), pa.array(places.astype(np.int32)), pa.array(offsets.astype(np.int32)), b.column("_item"), b.column("_piece"), b.column("_pieces"), b.column("_size")],
                names=out.fieldNames(),
            )

    return ranked.mapInArrow(place, out).withColumnsRenamed({"kind": kind, "item": item})


def fill_report(items: DataFrame, item: str, size: str, containers: DataFrame, kind: str, capacity: str) -> DataFrame:
    """Per kind: containers, items, split items, items without size, tokens and the share of the room that is filled."""
    cut = materialize(pieces(items, item, size, containers, kind, capacity).groupBy("_kind", "_cap", "_size").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_piece") == 1, 1).otherwise(0)).alias("items"), F.sum(F.when((F.col("_piece") == 1) & (F.col("_pieces") > 1), 1).otherwise(0)).alias("split")))
    rows = []
    for k, cap in sorted({(r["_kind"], r["_cap"]) for r in cut.select("_kind", "_cap").distinct().collect()}):
        hist = {r["_size"]: r["n"] for r in cut.where(F.col("_kind") == k).select("_size", "n").collect()}
        rows.append((k, sum(c for c, _ in shortest_pack_first(hist, cap))))
    packed = items.sparkSession.createDataFrame(rows, "_kind string, n_containers bigint")
    sums = cut.groupBy("_kind", "_cap").agg(F.sum("items").alias("n_items"), F.sum("split").alias("n_split"), F.sum(F.col("n") * F.col("_size")).alias("n_tokens"))
    filled = F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("_cap")), 6).alias("fill_share")
    return sums.join(packed, "_kind").select(F.col("_kind").alias(kind), F.col("_cap").alias(capacity), "n_containers", "n_items", "n_split", "n_tokens", filled)
