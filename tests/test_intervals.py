import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from strandloom.operators import intervals as iv
from strandloom.plans import interval_queries as iq

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
interval = st.tuples(st.sampled_from(["x", "y", None]), st.integers(0, 300), st.integers(0, 120) | st.none())
DDL = "chrom string, chrom_start bigint, chrom_end bigint, name string"


def table(spark, items, prefix):
    return spark.createDataFrame([(k, s, None if w is None else s + w, f"{prefix}{i}") for i, (k, s, w) in enumerate(items)], DDL)


def pairs(a, b, gap=None, within=False):
    out = []
    for i, (k, s, w) in enumerate(a):
        for j, (m, t, v) in enumerate(b):
            if k is None or k != m or w is None or v is None:
                continue
            near = s < t + v and t < s + w if gap is None else t - (s + w) <= gap and s - (t + v) <= gap
            if near and (not within or (t <= s and s + w <= t + v)):
                out.append((f"a{i}", f"b{j}"))
    return sorted(out, key=repr)


@FEW
@given(st.lists(interval, max_size=25), st.lists(interval, max_size=25), st.sampled_from([None, 0, 7]), st.sampled_from([4, 64]))
def test_pairs_match_a_loop(spark, rows, a, b, gap, width):
    got = iv.overlap_pairs(table(spark, a, "a"), table(spark, b, "b"), max_gap=gap, width=width)
    assert rows(got, "a_name", "b_name") == pairs(a, b, gap)
    inside = iv.overlap_pairs(table(spark, a, "a"), table(spark, b, "b"), width=width, within=True)
    assert rows(inside, "a_name", "b_name") == pairs(a, b, None, True)


@FEW
@given(st.lists(interval, max_size=20), st.lists(interval, max_size=20))
def test_nearest_matches_a_loop(spark, a, b):
    got = {r["name"]: r["distance"] for r in iv.nearest(table(spark, a, "a"), table(spark, b, "b"), width=50).collect()}
    for i, (k, s, w) in enumerate(a):
        far = [max(0, t - (s + w), s - (t + v)) for m, t, v in b if k is not None and k == m and w is not None and v is not None]
        assert got[f"a{i}"] == (min(far) if far else None)


def test_counts_semi_and_anti_agree(spark, rows):
    a = table(spark, [("x", 0, 10), ("x", 20, 10), ("y", 0, 5), (None, 0, 5), ("x", 5, None)], "a")
    b = table(spark, [("x", 5, 1), ("x", 9, 30), ("x", 9, 30)], "b").withColumn("extra", F.lit(1))
    assert rows(iv.overlap_counts(a, b), "name", "n_overlaps") == [("a0", 3), ("a1", 2), ("a2", 0), ("a3", 0), ("a4", 0)]
    assert rows(iv.overlapping(a, b), "name") == [("a0",), ("a1",)]
    assert rows(iv.overlapping(a, b, keep=False), "name") == [("a2",), ("a3",), ("a4",)]


@FEW
@given(st.lists(interval, max_size=25), st.lists(interval, max_size=25), st.sampled_from([None, 0, 7]))
def test_counts_match_a_loop(spark, rows, a, b, gap):
    want = {f"a{i}": 0 for i in range(len(a))}
    for x, _ in pairs(a, b, gap):
        want[x] += 1
    assert rows(iv.overlap_counts(table(spark, a, "a"), table(spark, b, "b"), max_gap=gap), "name", "n_overlaps") == sorted(want.items(), key=repr)


def test_an_arm_long_interval_makes_few_rows(spark):
    """One interval over a whole arm costs at most a row a level, on either side."""
    long = table(spark, [("x", 0, 30_000_000)], "l")
    short = spark.range(2_000).selectExpr("'x' as chrom", "id * 15000 as chrom_start", "id * 15000 + 200 as chrom_end", "concat('s', id) as name")
    for a, b in ((long, short), (short, long)):
        got = iv.overlap_pairs(a, b, width=1024)
        assert got.count() == 2_000
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and "Generate explode" in plan
    own = iv._own_bin(F.lit(0).cast("bigint"), F.lit(30_000_000).cast("bigint"), 1024)
    assert spark.range(1).select(F.size(iv._bins_above(F.lit(0).cast("bigint"), own, 1024)).alias("n")).first()["n"] <= 9


def test_adjacent_intervals_do_not_overlap_but_are_within_gap_0(spark):
    a, b = table(spark, [("x", 0, 10)], "a"), table(spark, [("x", 10, 5)], "b")
    assert iv.overlap_pairs(a, b).count() == 0
    assert iv.overlap_pairs(a, b, max_gap=0).count() == 1
    assert iv.nearest(a, b).first()["distance"] == 0


def test_merge_consensus_coverage(spark, rows):
    a = table(spark, [("x", 0, 10), ("x", 10, 5), ("x", 30, 5), ("x", 32, 1), ("x", 50, 0)], "a")
    assert rows(iv.merged(a), "chrom_start", "chrom_end") == [(0, 15), (30, 35)]
    assert rows(iv.merged(a, max_gap=15), "chrom_start", "chrom_end") == [(0, 35)]
    b = table(spark, [("x", 31, 10)], "b")
    assert rows(iv.consensus([a, b], 2), "chrom_start", "chrom_end", "n_sets") == [(30, 41, 2)]
    depth = iv.mean_coverage(b, a)
    assert depth.first()["mean_depth"] == pytest.approx((4 + 1) / 10)


def test_windows(spark):
    row = spark.createDataFrame([(10, 20, "+"), (10, 20, "-"), (10, 20, None)], "s bigint, e bigint, d string")
    s, e, d = F.col("s"), F.col("e"), F.col("d")
    up, down = iv.promoter_window(s, e, d, 5, 2)
    lo, hi = iv.clamp(s, e, F.lit(15))
    m, n = iv.centred(s, e, 3)
    c, f = iv.sub_interval(s, e, d, 2, 4)
    got = [tuple(r) for r in row.select(iv.anchor(s, e, d), iv.anchor(s, e, d, "end"), up, down, lo, hi, m, n, c, f).collect()]
    assert got == [(10, 19, 5, 12, 10, 15, 12, 19, 11, 14), (19, 10, 18, 25, 10, 15, 12, 19, 16, 19), (10, 19, 5, 12, 10, 15, 12, 19, 11, 14)]
    odd = spark.createDataFrame([(10, 21)], "s bigint, e bigint")
    assert [tuple(r) for r in odd.select(iv.centred(s, e, 0)[0], iv.centred(s, e, 0, 1)[0]).collect()] == [(15, 16)]


def test_lift_takes_the_widest_segment_and_turns_reversed_blocks(spark, rows):
    chain = spark.createDataFrame([("x", 0, 100, "n", 1000, 1100, "+"), ("x", 100, 200, "m", 500, 600, "-")], "chrom string, chrom_start bigint, chrom_end bigint, to_key string, to_start bigint, to_end bigint, to_strand string")
    a = table(spark, [("x", 10, 20), ("x", 90, 40), ("x", 400, 5)], "a")
    assert rows(iv.lift(a, chain)) == [("a0", "n", 1010, 1030), ("a1", "m", 570, 600)]
    assert rows(iv.lift(a, chain, widest=False)) == [("a0", "n", 1010, 1030)]


def test_empty_tables(spark):
    none = table(spark, [], "a")
    one = table(spark, [("x", 1, 2)], "b")
    assert iv.overlap_pairs(none, one).count() == 0 and iv.overlap_pairs(one, none).count() == 0
    assert iv.nearest(one, none).first()["distance"] is None and iv.nearest(none, one).count() == 0
    assert iv.merged(none).count() == 0 and iv.intersections(one, none).count() == 0


@FEW
@given(st.lists(st.tuples(st.sampled_from("xy"), st.integers(-200, 300), st.sampled_from([0, 1, 7, 64, 65, 200, 1024, 1025, 5_000_000])), max_size=25), st.lists(st.tuples(st.sampled_from("xy"), st.integers(-200, 300), st.sampled_from([0, 3, 64, 900, 70_000])), max_size=25))
def test_pairs_by_grids_match_a_loop(spark, rows, a, b):
    left, right = (table(spark, t, n).selectExpr("name as hit_id", "chrom", "chrom_start as s", "chrom_end as e") for t, n in ((a, "a"), (b, "b")))
    assert rows(iq._grid_pairs(left, right), "x", "y") == pairs(a, b)


def test_pairs_that_one_way_finds_are_counted(spark):
    hits = spark.createDataFrame([(i,) for i in range(6)], "hit_id bigint")
    one = lambda a, _: a.selectExpr("hit_id as x", "explode(sequence(hit_id, hit_id + 2)) as y")
    other = lambda a, _: one(a, _).where("not (x = 1 and y = 2)").unionByName(a.where("hit_id = 3").selectExpr("hit_id as x", "explode(array(3, 9, 9)) as y"))
    assert tuple(iq._compared(hits, hits, one, one).first()) == (0, 0)
    # (3, 3) comes twice and (3, 9) only by the second way, (1, 2) only by the first
    assert tuple(iq._compared(hits, hits, one, other).first()) == (1, 2)
    assert tuple(iq._compared(hits, hits, one, lambda a, _: one(a, _).where("false")).first()) == (18, 0)


def test_two_ways_on_one_chromosome(spark, tmp_path):
    """Comparing each hit with all of its chromosome took 6.4 billion comparisons here."""
    spark.range(800).selectExpr("'c' as chrom", "id * 5000 as chrom_start", "id * 5000 + 4000 as chrom_end", "concat('p', id) as name", "0 as score", "'+' as strand").write.parquet(f"{tmp_path}/joint_peaks.parquet")
    hit = ["id as hit_id", "'m' as motif_id", "concat('p', id % 800) as sequence_name", "cast(id div 800 * 19 + 1 as int) as start", "cast(id div 800 * 19 + 12 as int) as stop", "if(id div 800 % 2 = 0, '+', '-') as strand", "1D as score", "1D as p_value"]
    spark.range(160_000).selectExpr(*hit).unionByName(spark.range(160_000, 160_800).selectExpr(*hit[:3], "3 as start", "30 as stop", "'-' as strand", *hit[6:])).write.parquet(f"{tmp_path}/fimo.parquet")
    began = time.monotonic()
    assert tuple(iq.j14_two_ways(spark, str(tmp_path)).first()) == (0, 0)
    assert time.monotonic() - began < 45
