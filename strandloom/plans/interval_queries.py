"""Overlap, proximity, nearest, merge and coverage queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators import intervals as iv
from strandloom.operators.ordered import prefix_sum_within
from strandloom.operators.tables import first_by, in_all
from strandloom.plans.base import HITS, PEAKS, VISITS, Registry, hits, peaks, visits
from strandloom.session import materialize, release, table

REG = Registry()
HIT = iv.Cols("chrom", "s", "e", "hit_id")
VISIT = iv.Cols("event_type", "s", "e", "event_id")
HOUR = 3_600_000_000
BIN = 1 << 33  # about two hours, for times in microseconds
PLUS = "plus"


def _split(spark, folder):
    """Hits of the two strands, as two sets."""
    h = hits(spark, folder)
    return h.where("hit_strand = '+'"), h.where("hit_strand = '-'")


_TWO = f"WITH {HITS}, plus AS (SELECT * FROM hit WHERE hit_strand = '+'), minus AS (SELECT * FROM hit WHERE hit_strand = '-')\n"
_MEET = "a.chrom = b.chrom AND a.s < b.e AND b.s < a.e"


@REG.add("j1_overlap_pairs", _TWO + f"SELECT a.hit_id AS a_hit_id, b.hit_id AS b_hit_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM plus a JOIN minus b ON {_MEET}")
def j1_overlap_pairs(spark, folder):
    a, b = _split(spark, folder)
    p = iv.overlap_pairs(a, b, HIT, HIT, width=64)
    return p.select("a_hit_id", "b_hit_id", F.greatest("a_s", "b_s").alias("s"), F.least("a_e", "b_e").alias("e"))


#: Grids of ``_grid_pairs``: their cells are two to these powers wide.
_GRIDS = range(6, 64, 4)


def _grid_pairs(a, b):
    """(x, y) of all overlapping hits of two sets: those that meet in a cell of a grid, told once, in the cell where the later one begins.

    An interval's own grid is the finest whose cells are as wide as it, so it lies in at most two of them. Two intervals
    meet on the coarser of their grids: ``way`` 0 where that is the right one's, 1 where only the left one's.
    """
    length, own = F.col("e") - F.col("s"), F.lit(_GRIDS[-1])
    for g in reversed(_GRIDS[:-1]):
        own = F.when(length <= 1 << g, g).otherwise(own)
    a, b = a.withColumn("own", own), b.withColumn("own", own)
    used = sorted(r["own"] for r in a.select("own").union(b.select("own")).distinct().collect()) or [_GRIDS[0]]  # at most one row a grid

    def cells(g, way, where):
        last = F.greatest(F.col("e") - 1, F.col("s"))
        return F.when(where, F.transform(F.sequence(F.shiftright("s", g), F.shiftright(last, g)), lambda c: F.struct(F.lit(g).alias("g"), F.lit(way).alias("way"), c.alias("cell"))))

    def spread(df, id_, *found):
        at = F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("at")
        return df.select(F.col("hit_id").alias(id_), "chrom", "s", "e", at).select(id_, "chrom", "s", "e", "at.*")

    mine = F.col("own")
    left = spread(a, "x", *(cells(g, 0, mine <= g) for g in used), *(cells(g, 1, mine == g) for g in used[1:])).alias("a")
    right = spread(b, "y", *(cells(g, 0, mine == g) for g in used), *(cells(g, 1, mine < g) for g in used[1:])).alias("b")
    begins = F.greatest("a.s", "b.s")
    home = F.lit(None)
    for g in used:
        home = F.when(F.col("a.g") == g, F.shiftright(begins, g)).otherwise(home)
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("chrom", "g", "way", "cell")]
    return left.join(right, [*same, F.col("a.s") < F.col("b.e"), F.col("b.s") < F.col("a.e"), home == F.col("a.cell")]).select("x", "y")


def _only_one_way(first, second):
    """Numbers of pairs (x, y) found more often by the first and by the second."""
    differ = first.withColumn("n", F.lit(1)).unionByName(second.withColumn("n", F.lit(-1))).groupBy("x", "y").agg(F.sum("n").alias("n"))
    return differ.agg(F.count_if(F.col("n") > 0).cast("int").alias("only_first"), F.count_if(F.col("n") < 0).cast("int").alias("only_second"))


def _partners_differ(first, second):
    """The x whose partners y are not the same in both: their number, sums of the halves of a 64-bit hash or the sum of bits of another hash differ.

    A row an x and task is shuffled, not a row a pair.
    """
    def marked(pairs, n):
        h = F.xxhash64("y")
        return pairs.select("x", F.lit(n).alias("n"), (h.bitwiseAND(F.lit(0xFFFFFFFF)) * n).alias("low"), (F.shiftrightunsigned(h, 32) * n).alias("high"), F.xxhash64(F.lit(1), "y").alias("bits"))

    both = marked(first, 1).unionByName(marked(second, -1)).groupBy("x")
    return both.agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bit_xor("bits").alias("bits")).where("n <> 0 or low <> 0 or high <> 0 or bits <> 0").select("x")


def _compared(a, b, first, second):
    """``_only_one_way`` of two overlap joins of a and b; pairs themselves are compared where partners differ."""
    odd = materialize(_partners_differ(first(a, b), second(a, b)))
    if odd.isEmpty():
        release(odd)
        return a.sparkSession.range(1).select(F.lit(0).alias("only_first"), F.lit(0).alias("only_second"))
    some = a.join(odd, F.col("hit_id").eqNullSafe(F.col("x")), "left_semi")
    return _only_one_way(first(some, b), second(some, b))


@REG.add("j14_two_ways", "SELECT 0 AS only_first, 0 AS only_second")
def j14_two_ways(spark, folder):
    """The overlap join against a second implementation that shares no code with it: a join on the cells of grids; pairs that only one finds."""
    a, b = (x.select("hit_id", "chrom", "s", "e") for x in _split(spark, folder))

    def binned(a, b):
        return iv.overlap_pairs(a, b, HIT, HIT, width=64).select(F.col("a_hit_id").alias("x"), F.col("b_hit_id").alias("y"))

    return _compared(a, b, binned, _grid_pairs)


@REG.add("j9_joint_set", _TWO + f"SELECT DISTINCT a.chrom, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM plus a JOIN minus b ON {_MEET}")
def j9_joint_set(spark, folder):
    a, b = _split(spark, folder)
    return iv.intersections(a, b, HIT, HIT, width=64)


@REG.add("j2_within_gap", _TWO + "SELECT a.hit_id AS a_hit_id, count(*) AS n FROM plus a JOIN minus b ON a.chrom = b.chrom AND b.s - a.e <= 1000 AND a.s - b.e <= 1000 GROUP BY 1")
def j2_within_gap(spark, folder):
    a, b = _split(spark, folder)
    return iv.overlap_pairs(a, b, HIT, HIT, max_gap=1000).groupBy("a_hit_id").agg(F.count("*").alias("n"))


@REG.add("j3_overlapping", _TWO + f"SELECT hit_id, chrom, s, e FROM plus a WHERE EXISTS (SELECT 1 FROM minus b WHERE {_MEET})")
def j3_overlapping(spark, folder):
    a, b = _split(spark, folder)
    return iv.overlapping(a, b, HIT, HIT).select("hit_id", "chrom", "s", "e")


@REG.add("j4_not_overlapping", _TWO + f"SELECT hit_id, chrom, s, e FROM plus a WHERE NOT EXISTS (SELECT 1 FROM minus b WHERE {_MEET})")
def j4_not_overlapping(spark, folder):
    a, b = _split(spark, folder)
    return iv.overlapping(a, b, HIT, HIT, keep=False).select("hit_id", "chrom", "s", "e")


@REG.add("j5_overlap_counts", f"WITH {HITS} SELECT p.name, count(h.hit_id) AS n_hits FROM peak p LEFT JOIN hit h ON p.chrom = h.chrom AND p.chrom_start < h.e AND h.s < p.chrom_end GROUP BY p.name")
def j5_overlap_counts(spark, folder):
    return iv.overlap_counts(peaks(spark, folder), hits(spark, folder), iv.DEFAULT, HIT, into="n_hits").select("name", "n_hits")


@REG.add("j6_events_in_busy_time", f"WITH {VISITS} SELECT DISTINCT a.event_id FROM visit a JOIN visit b ON a.event_type = b.event_type AND a.user_id <> b.user_id AND a.s < b.e AND b.s < a.e")
def j6_events_in_busy_time(spark, folder):
    v = visits(spark, folder)
    """Events that overlap another user's on their type: all they overlap, less those of their own user; no pairs are made."""
    known = v.where("user_id is not null").withColumn("own", F.struct("event_type", "user_id"))
    of_all = iv.overlap_counts(known, known, VISIT, VISIT, into="n_all")
    own = iv.Cols("own", "s", "e", "event_id")
    both = iv.overlap_counts(of_all, known.select("own", "s", "e"), own, own, into="n_own")
    return both.where("n_all > n_own").select("event_id")


@REG.add("j7_within", f"WITH {HITS} SELECT h.hit_id, p.name AS inside FROM hit h JOIN peak p ON h.chrom = p.chrom AND p.chrom_start <= h.s AND h.e <= p.chrom_end")
def j7_within(spark, folder):
    p = iv.overlap_pairs(hits(spark, folder), peaks(spark, folder), HIT, iv.DEFAULT, within=True)
    return p.select(F.col("a_hit_id").alias("hit_id"), F.col("b_name").alias("inside"))


@REG.add("j8_first_overlap", f"WITH {HITS} SELECT hit_id, name AS first_peak FROM (SELECT h.hit_id, p.name, row_number() OVER (PARTITION BY h.hit_id ORDER BY p.chrom_start, p.name) AS r FROM hit h JOIN peak p ON h.chrom = p.chrom AND p.chrom_start < h.e AND h.s < p.chrom_end) WHERE r = 1")
def j8_first_overlap(spark, folder):
    p = iv.overlap_pairs(hits(spark, folder).select("hit_id", "chrom", "s", "e"), peaks(spark, folder), HIT, iv.DEFAULT)
    best = p.groupBy(F.col("a_hit_id").alias("hit_id")).agg(F.min(F.struct("b_chrom_start", "b_name")).alias("m"))
    return best.select("hit_id", F.col("m.b_name").alias("first_peak"))


_NEAREST = f"""WITH {HITS}, best AS (SELECT * FROM hit WHERE hit_score >= 12 AND NOT isnan(hit_score))
SELECT p.name, min(greatest(0, b.s - p.chrom_end, p.chrom_start - b.e)) AS distance FROM peak p LEFT JOIN best b ON p.chrom = b.chrom GROUP BY p.name"""


@REG.add("j10_nearest_distance", _NEAREST)
def j10_nearest_distance(spark, folder):
    best = hits(spark, folder).where("hit_score >= 12 and not isnan(hit_score)")
    return iv.nearest(peaks(spark, folder), best, iv.DEFAULT, HIT).select("name", "distance")


_NEAREST_ID = f"""WITH {HITS}, best AS (SELECT * FROM hit WHERE hit_score >= 12 AND NOT isnan(hit_score)), met AS (
  SELECT p.name, b.hit_id, b.s, b.e, b.s <= p.chrom_start AS before, greatest(0, CASE WHEN b.s <= p.chrom_start THEN p.chrom_start - b.e ELSE b.s - p.chrom_end END) AS d
  FROM peak p JOIN best b ON p.chrom = b.chrom
), one AS (
  SELECT name, arg_min(hit_id, (-e, s, hit_id)) FILTER (before) AS id_b, min(d) FILTER (before) AS d_b, arg_min(hit_id, (s, hit_id)) FILTER (NOT before) AS id_a, min(d) FILTER (NOT before) AS d_a FROM met GROUP BY 1
)
SELECT p.name, CASE WHEN d_a IS NULL OR d_b <= d_a THEN id_b ELSE id_a END AS nearest_id, least(d_b, d_a) AS distance FROM peak p LEFT JOIN one o ON p.name = o.name"""


@REG.add("j11_nearest_id", _NEAREST_ID)
def j11_nearest_id(spark, folder):
    best = hits(spark, folder).where("hit_score >= 12 and not isnan(hit_score)")
    return iv.nearest(peaks(spark, folder), best, iv.DEFAULT, HIT).select("name", "nearest_id", "distance")


_ANNOTATE = f"""WITH {HITS}, start_site AS (
  SELECT DISTINCT chrom, CASE WHEN strand = '-' THEN chrom_end - 1 ELSE chrom_start END AS pos, strand FROM peak
), ranked AS (
  SELECT h.hit_id, CASE WHEN t.strand = '-' THEN t.pos - (h.s + (h.e - h.s) // 2) ELSE (h.s + (h.e - h.s) // 2) - t.pos END AS d,
    row_number() OVER (PARTITION BY h.hit_id ORDER BY abs(h.s + (h.e - h.s) // 2 - t.pos), t.pos, coalesce(t.strand, '')) AS r
  FROM hit h JOIN start_site t ON h.chrom = t.chrom AND abs(h.s + (h.e - h.s) // 2 - t.pos) <= 5000
)
SELECT hit_id, d AS signed_distance, CASE WHEN d BETWEEN -1000 AND 0 THEN 'promoter' WHEN d BETWEEN 1 AND 1000 THEN 'first kb' WHEN d < 0 THEN 'upstream' ELSE 'downstream' END AS feature
FROM ranked WHERE r = 1"""


@REG.add("j12_annotate", _ANNOTATE)
def j12_annotate(spark, folder):
    """Signed distance to the nearest start site within 5,000 positions, and a class by priority."""
    p = peaks(spark, folder)
    sites = p.select("chrom", iv.anchor(F.col("chrom_start"), F.col("chrom_end"), F.col("strand")).alias("pos"), "strand").distinct().withColumn("pos_end", F.col("pos") + 1)
    h = hits(spark, folder).select("hit_id", "chrom", (F.col("s") + F.floor((F.col("e") - F.col("s")) / 2)).alias("mid")).withColumn("mid_end", F.col("mid") + 1)
    pairs = iv.overlap_pairs(h, sites, iv.Cols("chrom", "mid", "mid_end", "hit_id"), iv.Cols("chrom", "pos", "pos_end", "pos"), max_gap=4999, width=4096)
    near = pairs.select(F.col("a_hit_id").alias("hit_id"), F.abs(F.col("a_mid") - F.col("b_pos")).alias("far"), "b_pos", F.coalesce("b_strand", F.lit("")).alias("b_strand"), "a_mid")
    best = near.groupBy("hit_id").agg(F.min(F.struct("far", "b_pos", "b_strand", "a_mid")).alias("m"))
    d = iv.signed_distance(F.col("m.a_mid"), F.col("m.b_pos"), F.col("m.b_strand"))
    feature = F.when(d.between(-1000, 0), "promoter").when(d.between(1, 1000), "first kb").when(d < 0, "upstream").otherwise("downstream")
    return best.select("hit_id", d.alias("signed_distance"), feature.alias("feature"))


@REG.add("j13_best_hit", f"WITH {HITS} SELECT name, arg_max(s, (hit_score, -hit_id)) AS best_start, max(hit_score) AS best_score FROM hit WHERE hit_score IS NOT NULL AND NOT isnan(hit_score) GROUP BY name")
def j13_best_hit(spark, folder):
    h = hits(spark, folder).where("hit_score is not null and not isnan(hit_score)")
    return h.groupBy("name").agg(F.max_by("s", F.struct("hit_score", -F.col("hit_id"))).alias("best_start"), F.max("hit_score").alias("best_score"))


_LAGGED = "(SELECT name, motif_id, (s + e) // 2 - lag((s + e) // 2) OVER (PARTITION BY name, motif_id ORDER BY (s + e) // 2, hit_id) AS d FROM hit WHERE motif_id IS NOT NULL)"


@REG.add("j15_closest_pair", f"WITH {HITS} SELECT name, motif_id, min(d) AS closest FROM {_LAGGED} WHERE d IS NOT NULL GROUP BY name, motif_id")
def j15_closest_pair(spark, folder):
    """The least distance between two midpoints of a group: neighbours in order suffice, no pairs are formed."""
    mid = F.floor((F.col("s") + F.col("e")) / 2)
    h = hits(spark, folder).where("motif_id is not null").withColumn("mid", mid)
    d = F.col("mid") - F.lag("mid").over(W.partitionBy("name", "motif_id").orderBy("mid", "hit_id"))
    return h.withColumn("d", d).where("d is not null").groupBy("name", "motif_id").agg(F.min("d").alias("closest"))


_REGISTER = _TWO.replace("plus AS", "one AS").replace("minus AS", "other AS").replace("hit_strand = '+'", "motif_id < 'LIB030' AND motif_id NOT LIKE '#%' AND hit_strand IN ('+', '-')").replace("hit_strand = '-'", "motif_id >= 'LIB030' AND hit_strand IN ('+', '-')")


@REG.add("j16_register", _REGISTER + """SELECT CASE WHEN a.hit_strand = '-' THEN a.e - b.e ELSE b.s - a.s END AS shift, count(*) AS n FROM one a JOIN other b
ON a.name = b.name AND a.hit_strand = b.hit_strand AND abs(a.s - b.s) <= 60 GROUP BY 1""")
def j16_register(spark, folder):
    """How far hits of one set lie from hits of another on the same sequence and strand, in reading direction."""
    h = hits(spark, folder).where("hit_strand in ('+', '-')").withColumns({"k": F.concat_ws("|", "name", "hit_strand"), "s1": F.col("s") + 1})
    c = iv.Cols("k", "s", "s1", "hit_id")
    one, other = h.where("motif_id < 'LIB030' and motif_id not like '#%'"), h.where("motif_id >= 'LIB030'")
    p = iv.overlap_pairs(one, other, c, c, max_gap=59, width=64)
    shift = F.when(F.col("a_hit_strand") == "-", F.col("a_e") - F.col("b_e")).otherwise(F.col("b_s") - F.col("a_s"))
    return p.groupBy(shift.alias("shift")).agg(F.count("*").alias("n"))


@REG.add("j20_same_coordinates", f"WITH {PEAKS} SELECT p.name, count(*) AS n_rows FROM peak p JOIN joint_peaks j ON p.chrom = j.chrom AND p.chrom_start = j.chrom_start AND p.chrom_end = j.chrom_end GROUP BY p.name")
def j20_same_coordinates(spark, folder):
    key = ["chrom", "chrom_start", "chrom_end"]
    counts = table(spark, folder, "joint_peaks").groupBy(*key).agg(F.count("*").alias("n_rows"))
    return peaks(spark, folder).join(counts, key).select("name", "n_rows")


_CHAIN = """chain AS (
  SELECT DISTINCT chrom, (chrom_start // 50000) * 50000 AS f, (chrom_start // 50000) * 50000 + 30000 AS t, chrom || '_new' AS to_key, (chrom_start // 50000) * 50000 + 777 AS g,
    CASE WHEN (chrom_start // 50000) % 2 = 0 THEN '+' ELSE '-' END AS to_strand FROM peak
)"""
_LIFT = f"""WITH {PEAKS}, {_CHAIN}, seg AS (
  SELECT p.name, c.to_key, greatest(p.chrom_start, c.f) AS lo, least(p.chrom_end, c.t) AS hi, c.f, c.t, c.g, c.to_strand
  FROM peak p JOIN chain c ON p.chrom = c.chrom AND p.chrom_start < c.t AND c.f < p.chrom_end
), moved AS (
  SELECT name, to_key, CASE WHEN to_strand = '-' THEN g + (t - f) - (hi - f) ELSE g + lo - f END AS to_start, hi - lo AS w FROM seg
)
SELECT name, to_key, to_start, to_start + w AS to_end FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY w DESC, to_key, to_start) AS r FROM moved) WHERE r = 1"""


@REG.add("j23_lift", _LIFT)
def j23_lift(spark, folder):
    p = peaks(spark, folder)
    f = F.floor(F.col("chrom_start") / 50_000) * 50_000
    strand = F.when(F.floor(F.col("chrom_start") / 50_000) % 2 == 0, "+").otherwise("-")
    chain = p.select("chrom", f.alias("chrom_start"), (f + 30_000).alias("chrom_end"), F.concat("chrom", F.lit("_new")).alias("to_key"), (f + 777).alias("to_start"), (f + 30_777).alias("to_end"), strand.alias("to_strand")).distinct()
    return iv.lift(p, chain)


_MERGE = """b AS (
  SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM src)
), m AS (SELECT k, min(s) AS s, max(e) AS e FROM b GROUP BY k, g)"""


@REG.add("i1_merge", f"WITH {VISITS}, src AS (SELECT event_type AS k, s, e FROM visit), {_MERGE} SELECT k AS event_type, s, e FROM m")
def i1_merge(spark, folder):
    return iv.merged(visits(spark, folder), VISIT)


_CONS = f"""WITH {HITS}, src AS (SELECT DISTINCT chrom AS k, s, e FROM hit WHERE hit_strand IN ('+', '-', '.') AND e > s), {_MERGE},
v AS (SELECT m.k, m.s, m.e, count(DISTINCT h.hit_strand) AS n FROM m JOIN hit h ON m.k = h.chrom AND m.s < h.e AND h.s < m.e WHERE h.hit_strand IN ('+', '-', '.') GROUP BY 1, 2, 3)
SELECT k AS chrom, s, e, n AS n_sets FROM v WHERE n >= 2"""


@REG.add("i2_consensus", _CONS)
def i2_consensus(spark, folder):
    h = hits(spark, folder)
    return iv.consensus([h.where(F.col("hit_strand") == x) for x in "+-."], 2, HIT, width=64)


@REG.add("i3_mean_depth", f"""WITH {HITS} SELECT p.name, round(coalesce(sum(CASE WHEN h.s IS NOT NULL THEN least(p.chrom_end, h.e) - greatest(p.chrom_start, h.s) END), 0) / nullif(p.chrom_end - p.chrom_start, 0), 9) AS mean_depth
FROM peak p LEFT JOIN hit h ON p.chrom = h.chrom AND p.chrom_start < h.e AND h.s < p.chrom_end GROUP BY p.name, p.chrom_start, p.chrom_end""")
def i3_mean_depth(spark, folder):
    d = iv.mean_coverage(peaks(spark, folder), hits(spark, folder), iv.DEFAULT, HIT)
    return d.select("name", F.round("mean_depth", 9).alias("mean_depth"))


@REG.add("s16_region_signal", f"""WITH {HITS}, ok AS (SELECT * FROM hit WHERE hit_score IS NOT NULL AND NOT isnan(hit_score))
SELECT p.name, round(coalesce(sum((least(p.chrom_end, h.e) - greatest(p.chrom_start, h.s)) * h.hit_score), 0) / nullif(p.chrom_end - p.chrom_start, 0), 6) AS signal
FROM peak p LEFT JOIN ok h ON p.chrom = h.chrom AND p.chrom_start < h.e AND h.s < p.chrom_end GROUP BY p.name, p.chrom_start, p.chrom_end""")
def s16_region_signal(spark, folder):
    ok = hits(spark, folder).where("hit_score is not null and not isnan(hit_score)")
    d = iv.mean_coverage(peaks(spark, folder), ok, iv.DEFAULT, HIT, weight="hit_score", into="signal")
    return d.select("name", F.round("signal", 6).alias("signal"))


_FRIP = f"""WITH {VISITS}, src AS (SELECT event_type AS k, s, e FROM visit WHERE value >= 25), {_MERGE}
SELECT v.event_type, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM m WHERE m.k = v.event_type AND m.s < v.s + 1 AND v.s < m.e)) AS n_inside FROM visit v GROUP BY 1"""


@REG.add("i5_share_inside", _FRIP)
def i5_share_inside(spark, folder):
    """Events inside the merged intervals of the large ones: the fraction of reads in peaks."""
    v = visits(spark, folder)
    regions = iv.merged(v.where("value >= 25"), VISIT)
    points = v.withColumn("e", F.col("s") + 1)
    inside = iv.overlap_counts(points, regions, VISIT, iv.Cols("event_type", "s", "e", "s"))
    return inside.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_overlaps") > 0, 1)).alias("n_inside"))


_WINDOWS = f"""WITH {PEAKS} SELECT name,
 CASE WHEN strand = '-' THEN chrom_end - 1 ELSE chrom_start END AS anchor, chrom_start + (chrom_end - chrom_start - 1) // 2 AS centre,
 CASE WHEN strand = '-' THEN chrom_end - 100 ELSE chrom_start - 500 END AS up_from, CASE WHEN strand = '-' THEN chrom_end + 500 ELSE chrom_start + 100 END AS down_to,
 greatest(0, least(chrom_start, 20000000)) AS cut_from, least(20000000, greatest(chrom_end, 0)) AS cut_to,
 (chrom_start + chrom_end) // 2 - 100 AS mid_from, (chrom_start + chrom_end) // 2 + 101 AS mid_to, (chrom_start + 1 + chrom_end) // 2 - 100 AS mid1_from,
 CASE WHEN strand = '-' THEN chrom_end - 8 ELSE chrom_start + 3 END AS core_from, CASE WHEN strand = '-' THEN chrom_end - 3 ELSE chrom_start + 8 END AS core_to FROM peak"""


@REG.add("i6_i11_windows", _WINDOWS)
def i6_i11_windows(spark, folder):
    """Anchors, promoters, clamps, fixed windows of both parities and sub-intervals of every peak."""
    s, e, strand = F.col("chrom_start"), F.col("chrom_end"), F.col("strand")
    up, down = iv.promoter_window(s, e, strand, 500, 100)
    lo, hi = iv.clamp(s, e, F.lit(20_000_000))
    m0, m1 = iv.centred(s, e, 100)
    k0, _ = iv.centred(s, e, 100, base=1)
    c0, c1 = iv.sub_interval(s, e, strand, 4, 8)
    return peaks(spark, folder).select("name", iv.anchor(s, e, strand).alias("anchor"), iv.anchor(s, e, strand, "center").alias("centre"), up.alias("up_from"), down.alias("down_to"), lo.alias("cut_from"), hi.alias("cut_to"), m0.alias("mid_from"), m1.alias("mid_to"), k0.alias("mid1_from"), c0.alias("core_from"), c1.alias("core_to"))


_FLANKS = f"""WITH {HITS}, f AS (
 SELECT name, 'left' AS side, chrom, greatest(0, chrom_start - 50) AS s, chrom_start AS e FROM peak UNION ALL SELECT name, 'right', chrom, chrom_end, chrom_end + 50 FROM peak)
SELECT name, side, s, e FROM f WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.chrom = f.chrom AND f.s < h.e AND h.s < f.e)"""


@REG.add("i10_clear_flanks", _FLANKS)
def i10_clear_flanks(spark, folder):
    c = iv.Cols("chrom", "chrom_start", "chrom_end", "flank")
    f = iv.flanks(peaks(spark, folder), 50).withColumn("flank", F.concat_ws("|", "name", "side"))
    clear = iv.overlapping(f, hits(spark, folder), c, HIT, keep=False)
    return clear.select("name", "side", F.col("chrom_start").alias("s"), F.col("chrom_end").alias("e"))


@REG.add("i12_to_genome", f"WITH {HITS} SELECT hit_id, chrom, s, e FROM hit")
def i12_to_genome(spark, folder):
    return hits(spark, folder).select("hit_id", "chrom", "s", "e")


@REG.add("i13_set_operations", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def i13_set_operations(spark, folder):
    """All three set operations from one aggregation."""
    flags = table(spark, folder, "lineitem").where("l_returnflag in ('A', 'R') and l_partkey is not null").groupBy(F.col("l_partkey").alias("k")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    ops = F.array(F.lit("union"), F.when(F.col("a") & F.col("b"), "intersect"), F.when(F.col("a") & ~F.col("b"), "except"))
    return flags.select(F.explode(F.array_compact(ops)).alias("op"), "k")


@REG.add("i14_in_all_sets", "SELECT l_partkey AS k FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_shipdate_year) = (SELECT count(DISTINCT year(l_shipdate)) FROM lineitem)".replace("l_shipdate_year", "year(l_shipdate)"))
def i14_in_all_sets(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("y"))
    return in_all(rows, "k", "y")


@REG.add("i15_covered_fraction", f"WITH {VISITS}, src AS (SELECT event_type AS k, s, e FROM visit), {_MERGE}, span AS (SELECT max(e) - min(s) AS w FROM visit) SELECT k AS event_type, count(*) AS n_blocks, CAST(sum(e - s) AS BIGINT) AS covered, round(sum(e - s) / max(w), 9) AS fraction FROM m, span GROUP BY k")
def i15_covered_fraction(spark, folder):
    v = visits(spark, folder)
    span = v.agg((F.max("e") - F.min("s")).alias("w"))  # one row
    m = iv.merged(v, VISIT).groupBy("event_type").agg(F.count("*").alias("n_blocks"), F.sum(F.col("e") - F.col("s")).alias("covered"))
    return m.join(F.broadcast(span)).select("event_type", "n_blocks", "covered", F.round(F.col("covered") / F.col("w"), 9).alias("fraction"))


_SHARED = f"""WITH {HITS}, n AS (SELECT p.name, count(DISTINCT h.hit_strand) FILTER (h.hit_strand IN ('+', '-', '.')) AS k FROM peak p LEFT JOIN hit h ON p.chrom = h.chrom AND p.chrom_start < h.e AND h.s < p.chrom_end GROUP BY 1)
SELECT k AS n_sets, count(*) AS n_peaks FROM n GROUP BY 1"""


@REG.add("i16_shared_by", _SHARED)
def i16_shared_by(spark, folder):
    p = peaks(spark, folder)
    pairs = iv.overlap_pairs(p.select("name", "chrom", "chrom_start", "chrom_end"), hits(spark, folder).where("hit_strand in ('+', '-', '.')").select("chrom", "s", "e", "hit_strand"), iv.DEFAULT, HIT)
    sets = pairs.groupBy(F.col("a_name").alias("name")).agg(F.count_distinct("b_hit_strand").alias("k"))
    return p.join(sets, "name", "left").groupBy(F.coalesce("k", F.lit(0)).alias("n_sets")).agg(F.count("*").alias("n_peaks"))


_MATRIX = f"""WITH {VISITS}, n AS (SELECT event_type, count(*) AS n FROM visit GROUP BY 1), p AS (
 SELECT a.event_type AS a, b.event_type AS b, count(DISTINCT a.event_id) AS hit FROM visit a JOIN visit b ON a.event_type <> b.event_type AND a.user_id = b.user_id AND a.s < b.e AND b.s < a.e GROUP BY 1, 2)
SELECT p.a AS set_a, p.b AS set_b, p.hit AS n_overlapping, round(100.0 * p.hit / n.n, 6) AS percent FROM p JOIN n ON p.a = n.event_type"""


@REG.add("i17_overlap_matrix", _MATRIX)
def i17_overlap_matrix(spark, folder):
    """Share of each type's visits that overlap a visit of each other type by the same user."""
    v = visits(spark, folder)
    c = iv.Cols("user_id", "s", "e", "event_id")
    slim = v.select("event_id", "user_id", "event_type", "s", "e")
    # a type's visits of one user are merged first: at most one piece where many overlap each other
    pieces = iv.merged(slim.where("user_id is not null").withColumn("k", F.struct("user_id", "event_type")), iv.Cols("k", "s", "e", "event_id"))
    pieces = pieces.select("k.user_id", "k.event_type", "s", "e")
    p = iv.overlap_pairs(slim, pieces, c, c, width=BIN).where("a_event_type <> b_event_type")
    hit = p.groupBy(F.col("a_event_type").alias("set_a"), F.col("b_event_type").alias("set_b")).agg(F.count_distinct("a_event_id").alias("n_overlapping"))
    n = v.groupBy(F.col("event_type").alias("set_a")).agg(F.count("*").alias("n"))
    return hit.join(n, "set_a").select("set_a", "set_b", "n_overlapping", F.round(100.0 * F.col("n_overlapping") / F.col("n"), 6).alias("percent"))


@REG.add("i18_distinct_ranges", "SELECT DISTINCT chrom, chrom_start, chrom_end, strand FROM joint_peaks WHERE chrom IN ('chr2L', 'chr2R', 'chr3L', 'chr3R', 'chr4', 'chrX')")
def i18_distinct_ranges(spark, folder):
    kept = table(spark, folder, "joint_peaks").where(F.col("chrom").isin("chr2L", "chr2R", "chr3L", "chr3R", "chr4", "chrX"))
    return kept.select("chrom", "chrom_start", "chrom_end", "strand").distinct()


_BINNED = f"""WITH {HITS}, b AS (SELECT chrom, s // 50000 AS b, count(*) FILTER (hit_strand = '+') AS x, count(*) FILTER (hit_strand = '-') AS y FROM hit GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM b)
SELECT count(*) AS n_bins, round(corr(rx, ry), 9) AS spearman FROM r"""


@REG.add("i19_bin_correlation", _BINNED)
def i19_bin_correlation(spark, folder):
    """Rank correlation of two tracks' counts over bins; ranks of counts come from the counts' histogram, so bins are never sorted in one task."""
    h = hits(spark, folder)
    b = h.groupBy("chrom", F.floor(F.col("s") / 50_000).alias("b")).agg(F.count(F.when(F.col("hit_strand") == "+", 1)).alias("x"), F.count(F.when(F.col("hit_strand") == "-", 1)).alias("y"))

    def ranks(v):
        hist = prefix_sum_within(b.groupBy(v).agg(F.count("*").alias("n")), [], [v], "n", "upto")
        return hist.select(v, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias(f"r{v}"))

    r = b.join(ranks("x"), "x").join(ranks("y"), "y")
    return r.agg(F.count("*").alias("n_bins"), F.round(F.corr("rx", "ry"), 9).alias("spearman"))


_PROFILE = f"""WITH {HITS} SELECT CAST(floor((h.s - p.chrom_start) / 50.0) * 50 AS BIGINT) AS offset_from, count(*) FILTER (h.hit_strand = '+') AS plus, count(*) FILTER (h.hit_strand = '-') AS minus,
round(log2((count(*) FILTER (h.hit_strand = '+') + 1) / (count(*) FILTER (h.hit_strand = '-') + 1)), 9) AS log2_ratio
FROM peak p JOIN hit h ON p.chrom = h.chrom AND p.chrom_start - 1000 < h.s + 1 AND h.s < p.chrom_start + 1000 GROUP BY 1"""


@REG.add("i20_anchor_profile", _PROFILE)
def i20_anchor_profile(spark, folder):
    """Counts and log ratio of two tracks by position relative to the peaks' starts, 1,000 to either side."""
    a = peaks(spark, folder).select("name", "chrom", F.col("chrom_start").alias("at"), (F.col("chrom_start") - 1000).alias("f"), (F.col("chrom_start") + 1000).alias("t"))
    h = hits(spark, folder).select("chrom", "s", (F.col("s") + 1).alias("e"), "hit_strand")
    p = iv.overlap_pairs(a, h, iv.Cols("chrom", "f", "t", "name"), iv.Cols("chrom", "s", "e", "s"))
    plus, minus = (F.count(F.when(F.col("b_hit_strand") == x, 1)) for x in "+-")
    by = (F.floor((F.col("b_s") - F.col("a_at")) / 50) * 50).alias("offset_from")
    return p.groupBy(by).agg(plus.alias("plus"), minus.alias("minus"), F.round(F.log2((plus + 1) / (minus + 1)), 9).alias("log2_ratio"))


@REG.add("b2_mark_duplicates", "SELECT count(*) AS n_rows, count(*) FILTER (r = 1) AS n_kept FROM (SELECT row_number() OVER (PARTITION BY sequence_name, strand, CASE WHEN strand = '-' THEN \"stop\" ELSE \"start\" END ORDER BY hit_id) AS r FROM fimo)")
def b2_mark_duplicates(spark, folder):
    """Rows that share sequence, strand and 5' position: the first is kept."""
    five = F.when(F.col("strand") == "-", F.col("stop")).otherwise(F.col("start"))
    f = table(spark, folder, "fimo")
    kept = first_by(f.select("hit_id", "sequence_name", "strand", five.alias("five")), ["sequence_name", "strand", "five"], [F.col("hit_id")])
    return f.agg(F.count("*").alias("n_rows")).join(kept.agg(F.count("*").alias("n_kept")))


QUERIES, SQL = REG.queries, REG.sql
