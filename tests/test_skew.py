from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import statistics as st
from strandloom.operators.ordered import prefix_sum_within
from strandloom.operators.skew import join_unique
from strandloom.session import materialize, release


@pytest.mark.parametrize("hot", [True, False])
def test_join_keeps_every_row(spark, rows, hot):
    data = [(0 if hot and i % 3 == 0 else i % 700, i) for i in range(3000)] + [(None, 1), (5000, 2)]
    left = materialize(spark.createDataFrame(data, "k long, v long"))
    table = materialize(left.where("k < 5000").groupBy("k").agg(F.max("v").alias("m"), F.count("*").alias("d")))
    got = join_unique(left, table, "k", "d", left.count())
    assert rows(got) == rows(left.join(table.drop("d"), "k"))
    assert join_unique(left.limit(0), table.limit(0), "k", "d", 0).collect() == []


def test_running_minimum(spark):
    rng = np.random.default_rng(2)
    data = [("h" if i % 2 else f"g{i % 5}", i, float(rng.integers(0, 50)) if i % 7 else None) for i in range(400)]
    got = prefix_sum_within(spark.createDataFrame(data, "g string, o long, v double"), ["g"], ["o"], "v", "least", partitions=5, least=True).collect()
    seen: dict = {}
    for r in sorted(got, key=lambda r: (r["g"], r["o"])):
        seen[r["g"]] = min(seen.get(r["g"], float("inf")), float("inf") if r["v"] is None else r["v"])
        assert r["least"] == seen[r["g"]]
    assert len(got) == 400


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (2, 5), (4, 3), (5, 5)])
def test_exact_rank_sum_counts_all_choices(n1, n2):
    ranks = range(1, n1 + n2 + 1)
    us = [sum(c) - n1 * (n1 + 1) // 2 for c in combinations(ranks, n1)]
    for u in range(n1 * n2 + 1):
        low, high = (np.mean([x <= u for x in us]), np.mean([x >= u for x in us]))
        assert st.rank_sum_exact(u, n1, n2) == pytest.approx(min(1.0, 2 * min(low, high)))


def test_released_rows_are_gone(spark):
    df = materialize(spark.range(10))
    assert df.count() == 10
    release(df, spark.range(3))  # the second one was never stored
    with pytest.raises(Exception, match="(?i)checkpoint|exist|file"):
        df.count()
