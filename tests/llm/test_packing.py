import math
import random
from collections import Counter, defaultdict

import pytest

from strandloom.llm.packing import fill_containers, fill_report, shortest_pack_first


def item_by_item(lengths, capacity):
    """Worst fit, longest first, one item at a time: the number of containers."""
    room = []
    for x in sorted(lengths, reverse=True):
        at = max(range(len(room)), key=room.__getitem__, default=None)
        if at is None or room[at] < x:
            room.append(capacity - x)
        else:
            room[at] -= x
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_up_the_histogram(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 512])
    lengths = [min(capacity, 1 + int(rng.expovariate(1 / (capacity / rng.choice([2, 5, 20]))))) for _ in range(rng.choice([1, 50, 800]))]
    patterns = shortest_pack_first(dict(Counter(lengths)), capacity)
    used = Counter()
    for count, packed in patterns:
        assert count > 0 and sum(packed) <= capacity
        for x in packed:
            used[x] += count
    assert used == Counter(lengths)
    assert sum(c for c, _ in patterns) == item_by_item(lengths, capacity)


def test_one_length_fills_containers():
    assert shortest_pack_first({5: 1000}, 512) == [(9, [5] * 102), (1, [5] * 82)]


def test_assignment(spark):
    rng = random.Random(3)
    items = [(i, min(3000, int(rng.lognormvariate(4, 1.2)))) for i in range(1500)] + [(10_000 + i, 7) for i in range(700)] + [(20_000, 0), (20_001, None), (20_002, 5000)]
    df = spark.createDataFrame([(i, n, "x", 5) for i, n in items], "doc bigint, n int, kind string, place int")
    kinds = spark.createDataFrame([("small", 100), ("large", 1024)], "kind string, cap int")
    got = fill_containers(df, "doc", "n", kinds, "kind", "cap").collect()
    for kind, cap in (("small", 100), ("large", 1024)):
        mine = [r for r in got if r["kind"] == kind]
        fill, pieces, spans = Counter(), defaultdict(list), defaultdict(list)
        for r in mine:
            fill[r["container_id"]] += r["n_tokens"]
            pieces[r["doc"]].append((r["piece_no"], r["n_tokens"]))
            spans[r["container_id"]].append((r["offset"], r["offset"] + r["n_tokens"], r["place"]))
        assert max(fill.values()) <= cap and sorted(fill) == list(range(len(fill)))
        sizes = {i: n for i, n in items if n}
        assert {i: sum(n for _, n in p) for i, p in pieces.items()} == sizes
        assert all(len(p) == math.ceil(sizes[i] / cap) for i, p in pieces.items())
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and [x[2] for x in s] == list(range(len(s)))
        total = sum(sizes.values())
        assert len(fill) <= total / cap * 1.1 + 2
    report = {r["kind"]: r for r in fill_report(df, "doc", "n", kinds, "kind", "cap").collect()}
    assert report["small"]["n_containers"] == len({r["container_id"] for r in got if r["kind"] == "small"})
    assert report["small"]["n_items"] == len([1 for _, n in items if n]) and report["small"]["n_split"] == len([1 for _, n in items if n and n > 100])
    assert sorted(map(tuple, got)) == sorted(map(tuple, fill_containers(df.repartition(7), "doc", "n", kinds, "kind", "cap").collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "doc bigint, n int")
    kinds = spark.createDataFrame([("k", 10)], "kind string, cap int")
    assert fill_containers(df, "doc", "n", kinds, "kind", "cap").collect() == []
    one = spark.createDataFrame([(1, 5)], "doc bigint, n int")
    assert fill_containers(one, "doc", "n", kinds.limit(0), "kind", "cap").collect() == []


def test_joined_slots_are_the_broadcast_ones(spark):
    """Where slots are too many to broadcast, a join by stretches of ranks gives the same places."""
    from strandloom.llm import packing

    items = spark.range(4000).selectExpr("id as i", "cast(id * id % 97 + 1 as int) as n")
    kinds = spark.createDataFrame([("a", 64), ("b", 250)], "k string, cap int")
    old, packing.STRETCH = packing.STRETCH, 16
    try:
        one = packing.fill_containers(items, "i", "n", kinds, "k", "cap")
        other = packing.fill_containers(items, "i", "n", kinds, "k", "cap", most_slots=0)
        assert one.dtypes == other.dtypes
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    finally:
        packing.STRETCH = old
