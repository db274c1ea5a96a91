import math

import pytest

from pyspark.sql import functions as F
from strandloom.operators import reads as rd


def test_poisson_tail():
    for n, rate in ((0, 2.0), (1, 0.5), (3, 2.0), (10, 2.5), (2, 30.0)):
        want = 1 - sum(math.exp(-rate) * rate**k / math.factorial(k) for k in range(n))
        assert rd.poisson_tail(n, rate) == pytest.approx(want, rel=1e-6)
    assert rd.poisson_tail(400, 1.0) < 1e-300 and rd.poisson_tail(5, 0.0) == 0.0


def test_duplicates_flags_and_sweep(spark, rows):
    df = spark.createDataFrame([(1, "x", 5, 10, "+", 0, 40), (2, "x", 5, 20, "+", 1024, 40), (3, "x", 1, 10, "-", 0, 10), (4, "x", 2, 10, "-", 16, 60)], "i int, k string, s int, e int, d string, flag int, q int")
    assert rows(rd.without_duplicates(df, "k", "s", "e", "d", "i"), "i") == [(1,), (3,)]
    assert rows(rd.usable_reads(df, "flag", "q"), "i") == [(1,), (4,)]
    v = spark.createDataFrame([("a", 0.5), ("a", 0.05), ("a", None), ("b", float("nan"))], "g string, p double")
    assert rows(rd.threshold_sweep(v, "p", [0.1, 1.0], ["g"])) == [("a", 0.1, 1), ("a", 1.0, 2)]
    x = spark.createDataFrame([(180, 220), (100, 103), (None, 5)], "a int, b int")
    a, w = rd.extension(F.col("a"), F.col("b"))
    assert rows(x.select(a, w)) == [(101, False), (200, True), (None, None)]


def test_shift_is_found(spark):
    plus = [("x", p, p + 36, "+") for p in range(0, 5000, 97)]
    minus = [("x", p + 150 - 35, p + 151, "-") for p in range(0, 5000, 97)]
    df = spark.createDataFrame(plus + minus, "k string, s int, e int, d string")
    got = {r["shift"]: r["correlation"] for r in rd.cross_correlation(df, "k", "s", "e", "d", [0, 100, 150, 200]).collect()}
    assert max(got, key=got.get) == 150 and got[150] > 0.9


def test_regions(spark, rows):
    reads = [("x", i * 100, 0) for i in range(500)] + [("x", 20_000 + i, 0) for i in range(60)] + [("x", 20_110 + i, 0) for i in range(50)]
    df = spark.createDataFrame(reads, "k string, s int, e int")
    assert rows(rd.enriched_regions(df, "k", "s", "e", 100, 1e-6), "k", "s", "e") == [("x", 20_000, 20_200)]
    assert rd.enriched_regions(df.limit(0), "k", "s", "e", 100, 0.1).count() == 0
