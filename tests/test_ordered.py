import random
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandloom.operators.ordered import prefix_sum_within, rank_within

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 9), st.integers(-5, 5) | st.none()), max_size=60), st.integers(1, 6))
def test_running_totals_match_a_loop(spark, items, partitions):
    data = [(g, o, i, v) for i, (g, o, v) in enumerate(items)]
    df = spark.createDataFrame(data, "g string, o int, i int, v int")
    got = {r["i"]: (r["s"], r["n"]) for r in rank_within(prefix_sum_within(df, ["g"], ["o", "i"], "v", "s", partitions), ["g"], ["o", "i"], "n", partitions).collect()}
    sums, counts, want = defaultdict(int), defaultdict(int), {}
    for g, _, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        sums[g] += v or 0
        counts[g] += 1
        want[i] = sums[g], counts[g]
    assert got == want


def test_one_group_over_many_partitions(spark):
    n = 5000
    order = list(range(n))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([("hot", x, 0.5) for x in order], "g string, x int, w double")
    got = prefix_sum_within(df, ["g"], ["x"], "w", partitions=7)
    assert got.rdd.getNumPartitions() == 7
    assert all(abs(r["running"] - 0.5 * (r["x"] + 1)) < 1e-9 for r in got.collect())


def test_no_groups_and_empty(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "x int")
    assert [(r["x"], r["rank"]) for r in rank_within(df, [], ["x"]).orderBy("x").collect()] == [(1, 1), (2, 2), (3, 3)]
    empty = spark.createDataFrame([], "g string, x int")
    assert rank_within(empty, ["g"], ["x"]).collect() == []
