import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from strandloom.llm.components import connected_groups, prune

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def brute(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return sorted((v, find(v)) for v in parent)


def run(spark, edges, **more):
    df = spark.createDataFrame([(a, b, "w", 1) for a, b in edges], "left_id string, right_id string, w string, vertex int")
    return sorted(tuple(r) for r in connected_groups(df, "left_id", "right_id", "node", "grp", **more).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_rounds_on_arrays(found):
    edges = [(a, b) for a, b in found if a != b]
    if edges:
        u, v = np.array(edges).T
        assert sorted(zip(*(x.tolist() for x in prune(np.concatenate([u, v]), np.concatenate([v, u]))), strict=True)) == brute(edges)


@FEW
@given(st.lists(st.tuples(st.sampled_from([None, *"abcdefghijkl"]), st.sampled_from([None, *"abcdefghijkl"])), max_size=25))
def test_groups_match_union_find(spark, edges):
    assert run(spark, edges) == brute(edges)


def test_long_chain_star_and_repeats(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(200)]
    star = [("hub", f"s{i}") for i in range(500)]
    edges = chain + [(b, a) for a, b in chain[:50]] + star + star + [("lone", "lone")]
    assert run(spark, edges) == brute(edges)


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.xxhash64(c) % 50])
def test_all_rounds_as_shuffles(spark, hashed):
    """Without the array step, and with identifiers that share hashes."""
    rng = random.Random(3)
    hub = [("hub", f"h{i}") for i in range(300)]
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    pairs = [(f"p{rng.randrange(200)}", f"p{rng.randrange(200)}") for _ in range(120)]
    edges = hub + hub[:40] + chain + pairs
    assert run(spark, edges, local=0, hashed=hashed) == brute(edges)


def test_a_hub_is_not_gathered(spark):
    """In the plan of a round a vertex with many links meets a broadcast, and the shuffle gets the others only."""
    from strandloom.operators.skew import join_unique
    from strandloom.session import materialize

    rows = materialize(spark.createDataFrame([(0 if i % 2 else i, i) for i in range(20_000)], "u long, v long"))
    table = materialize(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")))
    got = join_unique(rows, table, "u", "d", 20_000)
    assert got.count() == 20_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and "LeftAnti" in plan
    assert got.columns == ["u", "v", "m"]


def test_empty(spark):
    assert run(spark, []) == []
