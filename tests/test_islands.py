from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandloom.operators.islands import blocks_and_gaps

FEW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def brute(items, max_gap=None):
    out = []
    by = {}
    for k, s, e in items:
        if s is not None and e is not None:
            by.setdefault(k, []).append((min(s, e), max(s, e)))
    for k, v in by.items():
        v.sort()
        blocks = [list(v[0])]
        for s, e in v[1:]:
            if s <= blocks[-1][1] + 1:
                blocks[-1][1] = max(blocks[-1][1], e)
            else:
                blocks.append([s, e])
        out += [(k, "block", s, e) for s, e in blocks]
        for (_, a), (b, _) in zip(blocks, blocks[1:], strict=False):
            if max_gap is None or b - 1 - a <= max_gap:
                out.append((k, "gap", a + 1, b - 1))
    return sorted(out, key=repr)


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 80) | st.none(), st.integers(0, 80) | st.none()), max_size=50), st.integers(1, 6), st.sampled_from([None, 3]))
def test_blocks_match_a_loop(spark, rows, items, partitions, max_gap):
    df = spark.createDataFrame(items, "k string, a int, b int")
    got = blocks_and_gaps(df, ["k"], "a", "b", max_gap, partitions=partitions)
    assert rows(got, "k", "piece", "from_pos", "to_pos") == brute(items, max_gap)


def test_one_block_over_all_partitions(spark, rows):
    # a long interval first, and an entity that fills every partition
    items = [("hot", 0, 100_000)] + [("hot", i * 7, i * 7 + 3) for i in range(3000)] + [("hot", 200_000, 200_001), ("cold", 1, 2)]
    df = spark.createDataFrame(items, "k string, a int, b int")
    assert rows(blocks_and_gaps(df, ["k"], "a", "b", partitions=9), "k", "piece", "from_pos", "to_pos") == brute(items)


def test_gaps_over_partition_edges(spark, rows):
    items = [("hot", i * 10, i * 10 + 4) for i in range(500)]
    df = spark.createDataFrame(items, "k string, a int, b int")
    assert rows(blocks_and_gaps(df, ["k"], "a", "b", partitions=8), "k", "piece", "from_pos", "to_pos") == brute(items)


def test_wide_positions_and_touch(spark, rows):
    big = 2**61
    items = [("x", -big, -big + 5), ("x", big, big + 1), ("y", 1, 2), ("y", 4, 5)]
    df = spark.createDataFrame(items, "k string, a bigint, b bigint")
    assert rows(blocks_and_gaps(df, ["k"], "a", "b"), "k", "piece", "from_pos", "to_pos") == brute(items)
    near = blocks_and_gaps(df.where("k = 'y'"), ["k"], "a", "b", touch=2)
    assert rows(near, "from_pos", "to_pos") == [(1, 5)]


def test_empty_and_clashing_names(spark, rows):
    empty = spark.createDataFrame([], "k string, a int, b int")
    assert blocks_and_gaps(empty, ["k"], "a", "b").collect() == []
    df = spark.createDataFrame([("x", 1, 2, "p", 9)], "piece string, a int, b int, _pid string, from_pos int")
    got = blocks_and_gaps(df.withColumnRenamed("piece", "k"), ["k"], "a", "b")
    assert rows(got, "k", "piece", "from_pos", "to_pos") == [("x", "block", 1, 2)]
