import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandloom.llm.similar_sets import merge_skip, occurrences, set_classes, similar_pairs

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def brute(sets, t):
    ids = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def table(spark, sets):
    rows = [(k, v, 1) for k, s in sets.items() for v in s]
    return spark.createDataFrame(rows + rows[:3] + [(None, "x", 1), ("r0", None, 1)], "r string, v string, class_id int")


def run(spark, sets, t, block=2000):
    return [(x["r_a"], x["r_b"]) for x in similar_pairs(table(spark, sets), "r", "v", t, block).collect()]


@FEW
@given(st.lists(st.frozensets(st.sampled_from("abcdefghij"), max_size=8), max_size=25), st.sampled_from([0.5, 0.7, 1.0]))
def test_pairs_match_a_loop(spark, found, t):
    sets = {f"r{i}": set(s) for i, s in enumerate(found)}
    got = run(spark, sets, t)
    assert len(got) == len(set(got)) and set(got) == brute(sets, t)


@pytest.mark.parametrize("block", [3, 2000])
def test_hot_values_and_blocks(spark, block):
    rng = random.Random(7)
    sets = {}
    for i in range(150):
        base = {"hot1", "hot2", "hot3"} if i % 3 == 0 else {"hot1"}
        sets[f"r{i:03d}"] = base | {f"g{rng.randrange(12)}" for _ in range(rng.randrange(6))}
    for i in range(150, 200):  # copies of one set
        sets[f"r{i:03d}"] = {"hot1", "c1", "c2", "c3"}
    got = run(spark, sets, 0.7, block)
    assert len(got) == len(set(got)) and set(got) == brute(sets, 0.7)


def test_merge_and_search_match_counting():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 30))) for _ in range(rng.randrange(1, 8))]
        least, low, high = rng.randrange(1, 6), rng.randrange(0, 10), rng.randrange(20, 41)
        n = {i: sum(i in x for x in lists) for i in range(40)}
        want = {(i, k) for i, k in n.items() if k >= least and low <= i < high}
        assert set(merge_skip(lists, least, low, high)) == want
        assert set(occurrences(list(range(len(lists))), dict(enumerate(lists)), least, low, high)) == want


def test_classes_and_empty(spark, rows):
    sets = {"a": {"x", "y"}, "b": {"y", "x"}, "c": {"z"}}
    classes, members = set_classes(table(spark, sets).where("r <> 'r0'"), "r", "v")
    assert rows(classes, "n_values", "n_records") == [(1, 1), (2, 2)] and members.count() == 3
    assert run(spark, {}, 0.7) == []
