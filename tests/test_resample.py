from collections import Counter

import pytest
from pyspark.sql import functions as F
from strandloom.operators import resample as rs


def test_draws_repeat_and_spread(spark):
    df = spark.range(2000).select("id", rs.draw(5, F.col("id")).alias("u"), rs.draw(5, F.col("id")).alias("v"), rs.draw(6, F.col("id")).alias("w"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.sum((F.col("u") != F.col("v")).cast("int")), F.corr("u", "w")).first()
    assert abs(r[0] - 0.5) < 0.03 and 0 <= r[1] and r[2] < 1 and r[3] == 0 and abs(r[4]) < 0.1


def test_samples_have_exact_sizes(spark):
    pool = spark.range(300).withColumn("s", F.col("id") % 3)
    for distributed in (False, True):
        got = rs.resample(pool, "id", 4, 50, 1, distributed)
        assert got.groupBy("rep").agg(F.count_distinct("id").alias("n")).select("n").distinct().collect()[0][0] == 50
    one, two = (sorted(map(tuple, rs.resample(pool, "id", 2, 9, 1, d).select("rep", "id").collect())) for d in (False, True))
    assert one == two
    needs = spark.createDataFrame([(0, 7), (1, 1000), (2, 0), (9, 5)], "s bigint, need int")
    got = Counter((r["rep"], r["s"]) for r in rs.matched_resample(pool, "id", "s", needs, 2, 1).collect())
    assert got == {(1, 0): 7, (2, 0): 7, (1, 1): 100, (2, 1): 100}
    assert sorted(tuple(r) for r in rs.pool_sufficiency(pool, "s", needs).collect()) == [(0, 7, 100, True), (1, 1000, 100, False), (2, 0, 100, True), (9, 5, 0, False)]


def test_labels_halves_and_bootstrap(spark):
    df = spark.range(101).withColumn("g", F.col("id") % 4)
    p = rs.permuted_labels(df, "id", "g", 3, 2)
    want = Counter(i % 4 for i in range(101))
    for rep in (1, 2, 3):
        assert Counter(r["g"] for r in p.where(F.col("rep") == rep).collect()) == want
    assert sorted(r["count"] for r in rs.split_half(df, "id", 1).groupBy("half").count().collect()) == [50, 51]
    b = rs.bootstrap(df, "id", 5, 3).groupBy("rep").agg(F.sum("copies").alias("n"), F.count("*").alias("d")).collect()
    assert [r["n"] for r in b] == [101] * 5 and all(50 < r["d"] < 80 for r in b)


def test_random_places_stay_inside(spark):
    df = spark.createDataFrame([("x", 5, 25, "a"), ("y", 0, 100, "b"), ("z", 0, 3, "c")], "k string, s bigint, e bigint, i string")
    lengths = spark.createDataFrame([("x", 30), ("y", 100)], "k string, length bigint")
    got = rs.random_intervals(df, lengths, "k", "s", "e", "i", 20, 1).collect()
    assert len(got) == 40 and all(0 <= r["s"] and r["e"] <= (30 if r["k"] == "x" else 100) and r["e"] - r["s"] in (20, 100) for r in got)
    w = rs.random_windows(lengths, "k", 50, 25, 1).collect()
    assert len(w) == 200 and all(r["end"] - r["start"] == 25 and r["end"] <= (30 if r["k"] == "x" else 100) for r in w) and {r["k"] for r in w} == {"x", "y"}


def test_windows_are_drawn_until_enough_are_kept(spark):
    lengths = spark.createDataFrame([("x", 1000)], "k string, length bigint")
    got = rs.kept_windows(lengths, "k", 20, 10, 1, lambda d: d.where(F.col("start") < 80)).collect()
    assert len(got) == 20 and len({r["draw_id"] for r in got}) == 20 and all(r["start"] < 80 for r in got)
    with pytest.warns(UserWarning, match="0 of 5"):
        assert rs.kept_windows(lengths, "k", 5, 10, 1, lambda d: d.where("false"), rounds=2).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "id bigint, g int")
    assert rs.permuted_labels(none, "id", "g", 2, 1).count() == 0
    assert rs.bootstrap(none, "id", 2, 1).count() == 0 and rs.resample(none, "id", 2, 3, 1).count() == 0
