import statistics as stats

import pytest

from pyspark.sql import functions as F
from strandloom.operators import tables as tb


def test_first_lookup_and_unambiguous(spark, rows):
    t = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4), (None, 0)], "k string, v int")
    assert rows(tb.first_by(t, ["k"], [F.col("v")])) == [("a", 1), ("b", 3), (None, 0)]
    left = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    assert rows(tb.lookup(left, t, "k", [F.col("v")])) == [("a", 1), ("c", None), (None, None)]
    m = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", "z"), ("c", None)], "k string, v string")
    assert rows(tb.unambiguous(m, "k", "v")) == [("a", None), ("b", "z")]


def test_cascade_respects_order_and_claims(spark, rows):
    one = spark.createDataFrame([("a", "T1"), ("b", "T2"), ("b", "T3")], "n string, t string")
    two = spark.createDataFrame([("b", "T1"), ("c", "T1"), ("d", "T9"), ("a", "T8")], "n string, t string")
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "n string")
    assert rows(tb.cascade(df, "n", [(one, "t"), (two, "t")], "target")) == [("a", "T1", 1), ("b", None, None), ("c", None, None), ("d", "T9", 2), (None, None, None)]


@pytest.mark.parametrize("values", [[1.0], [3, 1, 2], [5, 5, 5, 1], list(range(10)), [0.1 * i * i for i in range(37)]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None), ("g", float("nan"))], "g string, x double")
    got = tb.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"]).first()["q"]
    s = sorted(values)
    for p, q in zip([0.0, 0.25, 0.5, 0.9, 1.0], got, strict=True):
        h = (len(s) - 1) * p
        lo = int(h)
        assert q == pytest.approx(s[lo] + (h - lo) * (s[min(lo + 1, len(s) - 1)] - s[lo]))
    assert got[2] == pytest.approx(stats.median(values))
    assert [tuple(r) for r in tb.exact_quantiles(df.limit(0), "x", [0.5]).collect()] == [([None],)]
    assert tb.exact_quantiles(df.limit(0), "x", [0.5], ["g"]).collect() == []


def test_bins_sets_halves_and_lines(spark, rows):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 9.0)], "v double")
    assert [r[0] for r in df.select(tb.binned(F.col("v"), F.array(*(F.lit(x) for x in (2.0, 2.0, 5.0))))).collect()] == [1, 1, 2, 3]
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, g int")
    assert rows(tb.in_all(s, "k", "g")) == [("a",)]
    ids = spark.range(2000)
    halves = tb.complement_split(ids, "id", 3, 0.425).groupBy("half").count().collect()
    assert sum(r["count"] for r in halves) == 2000 and abs(dict((r["half"], r["count"]) for r in halves)[1] - 850) < 120
    curve = spark.createDataFrame([("g", 0.0, 0.0), ("g", 10.0, 5.0), ("g", 20.0, 0.0)], "g string, x double, y double")
    at = spark.createDataFrame([("g", 4.0), ("g", 15.0), ("g", 30.0)], "g string, a double")
    assert rows(tb.interpolated(at, curve, "g", "x", "y", "a")) == [("g", 15.0, 2.5), ("g", 4.0, 2.0)]


def test_cross_table_and_stars(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", "x")], "r string, c string")
    assert rows(tb.cross_table(df, "r", "c", ["x", "y"])) == [("a", 1, 1, 3), ("b", 1, 0, 1)]
    p = spark.createDataFrame([(0.0001,), (0.005,), (0.02,), (0.5,)], "p double")
    assert [r[0] for r in p.select(tb.stars(F.col("p"))).collect()] == ["***", "**", "*", "ns"]
