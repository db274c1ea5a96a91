"""Read-level stages, threshold sweeps, and nulls by simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import statistics as st
from strandloom.operators import intervals as iv
from strandloom.operators import reads as rd
from strandloom.operators import resample as rs
from strandloom.plans.base import HITS, PEAKS, Registry, hits, peaks
from strandloom.plans.resampling_queries import SEED, _u
from strandloom.session import table

REG = Registry()
HIT = iv.Cols("chrom", "s", "e", "hit_id")


@REG.add("a9_mean_of_probes", f"WITH {HITS}, ok AS (SELECT * FROM hit WHERE hit_score IS NOT NULL AND NOT isnan(hit_score)) SELECT p.name, h.hit_strand, count(*) AS n, round(avg(h.hit_score), 9) AS mean_score FROM peak p JOIN ok h ON p.chrom = h.chrom AND p.chrom_start < h.e AND h.s < p.chrom_end GROUP BY 1, 2")
def a9_mean_of_probes(spark, folder):
    """Mean score of the hits over each peak, per track."""
    ok = hits(spark, folder).where("hit_score is not null and not isnan(hit_score)").select("chrom", "s", "e", "hit_strand", "hit_score")
    pairs = iv.overlap_pairs(peaks(spark, folder).select("name", "chrom", "chrom_start", "chrom_end"), ok, iv.DEFAULT, HIT)
    return pairs.groupBy(F.col("a_name").alias("name"), F.col("b_hit_strand").alias("hit_strand")).agg(F.count("*").alias("n"), F.round(F.avg("b_hit_score"), 9).alias("mean_score"))


@REG.add("w10_genome_order", "SELECT chrom, chrom_start, chrom_end, name FROM joint_peaks WHERE chrom IS NOT NULL ORDER BY chrom, chrom_start")
def w10_genome_order(spark, folder):
    return table(spark, folder, "joint_peaks").where("chrom is not null").select("chrom", "chrom_start", "chrom_end", "name").orderBy("chrom", "chrom_start")


@REG.add("b2_kept_reads", "SELECT min(hit_id) AS hit_id FROM fimo WHERE sequence_name IS NOT NULL AND \"start\" IS NOT NULL AND \"stop\" IS NOT NULL AND strand IS NOT NULL GROUP BY sequence_name, strand, CASE WHEN strand = '-' THEN \"stop\" - 1 ELSE \"start\" END")
def b2_kept_reads(spark, folder):
    f = table(spark, folder, "fimo").where("sequence_name is not null and start is not null and stop is not null and strand is not null").select("hit_id", "sequence_name", "start", "stop", "strand")
    return rd.without_duplicates(f, "sequence_name", "start", "stop", "strand", "hit_id").select("hit_id")


_ENRICHED = f"""WITH {HITS}, b AS (SELECT chrom AS k, s // 1000 AS b, count(*) AS n FROM hit GROUP BY 1, 2), r AS (SELECT k, sum(n) / (max(b) - min(b) + 1) AS rate FROM b GROUP BY 1),
below AS (SELECT k, b, n, sum(exp(-rate + i * ln(rate) - lgamma(i + 1.0))) AS c FROM (SELECT b.k, b.b, b.n, r.rate, unnest(range(n, n + 400)) AS i FROM b JOIN r ON b.k = r.k) GROUP BY 1, 2, 3),
hot AS (SELECT k, b FROM below WHERE c <= 1e-5), island AS (SELECT k, b, b - row_number() OVER (PARTITION BY k ORDER BY b) AS g FROM hot)
SELECT k AS chrom, min(b) * 1000 AS s, max(b) * 1000 + 1000 AS e FROM island GROUP BY k, g"""


@REG.add("b3_regions", _ENRICHED)
def b3_regions(spark, folder):
    """Where hits are denser than chance: the merged bins alone."""
    return b3_enriched_regions(spark, folder).select("chrom", "s", "e")


@REG.add("b3_enriched_regions")
def b3_enriched_regions(spark, folder):
    """Bins of hits denser than chance, merged."""
    return rd.enriched_regions(hits(spark, folder), "chrom", "s", "e", 1000, 1e-5)


_SHIFTS = "[-100, -50, 0, 5, 10, 20, 50, 100]"
_CROSS = f"""WITH {HITS}, n AS (SELECT chrom AS k, CASE WHEN hit_strand = '-' THEN e - 1 ELSE s END AS p, hit_strand AS d, CAST(count(*) AS DOUBLE) AS n FROM hit WHERE hit_strand IN ('+', '-') GROUP BY ALL),
w AS (SELECT sum(w) AS w FROM (SELECT max(p) - min(p) + 1 AS w FROM n GROUP BY k)), a AS (SELECT sum(n) AS sx, sum(n * n) AS sxx FROM n WHERE d = '+'), b AS (SELECT sum(n) AS sy, sum(n * n) AS syy FROM n WHERE d = '-'),
t AS (SELECT unnest({_SHIFTS}) AS shift), c AS (SELECT t.shift, sum(x.n * y.n) AS xy FROM t, n x JOIN n y ON x.d = '+' AND y.d = '-' AND x.k = y.k WHERE x.p = y.p - t.shift GROUP BY 1)
SELECT t.shift, round((coalesce(c.xy, 0) - sx * sy / w) / sqrt((sxx - sx * sx / w) * (syy - sy * sy / w)), 9) AS correlation FROM t LEFT JOIN c ON t.shift = c.shift, w, a, b"""


@REG.add("b5_cross_correlation")
def b5_cross_correlation(spark, folder):
    """Strand cross-correlation of 5' positions."""
    c = rd.cross_correlation(hits(spark, folder), "chrom", "s", "e", "hit_strand", [-100, -50, 0, 5, 10, 20, 50, 100])
    return c.select("shift", F.round("correlation", 9).alias("correlation"))


@REG.add("b6_threshold_sweep", "SELECT motif_id, t AS threshold, count(*) AS n FROM fimo, (SELECT unnest([CAST(0.00001 AS DOUBLE), 0.0001, 0.001, 0.01]) AS t) WHERE p_value <= t AND NOT isnan(p_value) GROUP BY 1, 2")
def b6_threshold_sweep(spark, folder):
    return rd.threshold_sweep(table(spark, folder, "fimo"), "p_value", [0.00001, 0.0001, 0.001, 0.01], ["motif_id"])


@REG.add("b7_extension", "SELECT motif_id, CAST(floor((min(\"stop\" - \"start\") + max(\"stop\" - \"start\")) / 2.0) AS BIGINT) AS extension, abs(min(\"stop\" - \"start\") - max(\"stop\" - \"start\")) > 30 AS differs FROM fimo WHERE \"start\" <= \"stop\" GROUP BY 1")
def b7_extension(spark, folder):
    w = F.col("stop") - F.col("start")
    f = table(spark, folder, "fimo").where("start <= stop").groupBy("motif_id").agg(F.min(w).alias("a"), F.max(w).alias("b"))
    size, differs = rd.extension(F.col("a"), F.col("b"))
    return f.select("motif_id", size.alias("extension"), differs.alias("differs"))


_EQUAL = f"""WITH {PEAKS}, f AS (SELECT name, chrom, chrom_end - chrom_start AS w FROM peak), least_n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM f GROUP BY chrom)),
d AS (SELECT i AS rep, f.*, row_number() OVER (PARTITION BY i, chrom ORDER BY {_u('i', 'name')}, name) AS r FROM f, range(1, 11) t(i))
SELECT rep, chrom, count(*) AS n, round(avg(w), 4) AS mean_width FROM d, least_n WHERE r <= least_n.n GROUP BY 1, 2"""


@REG.add("n10_equal_counts", _EQUAL)
def n10_equal_counts(spark, folder):
    """Every chromosome subsampled to the smallest one's number of peaks, ten times."""
    f = peaks(spark, folder).select("name", "chrom", (F.col("chrom_end") - F.col("chrom_start")).alias("w"))
    n = f.groupBy("chrom").agg(F.count("*").alias("n"))
    needs = n.select("chrom").join(n.agg(F.min("n").alias("need")))  # one row of the least
    m = rs.matched_resample(f, "name", "chrom", needs, 10, SEED)
    return m.groupBy(F.col("rep").cast("bigint").alias("rep"), "chrom").agg(F.count("*").alias("n"), F.round(F.avg("w"), 4).alias("mean_width"))


@REG.add("n14_power_by_draws", f"""WITH r AS (SELECT i AS rep, count(*) FILTER ({_u('i', 'e.event_id')} < 0.5) AS a, count(*) FILTER ({_u('i', 'e.event_id')} >= 0.5) AS b,
 count(*) FILTER ({_u('i', 'e.event_id')} < 0.5 AND value >= 25) AS x, count(*) FILTER ({_u('i', 'e.event_id')} >= 0.5 AND value >= 25) AS y FROM events e, range(1, 31) t(i) WHERE value IS NOT NULL GROUP BY 1)
SELECT rep, a, b, x, y FROM r""")
def n14_power_by_draws(spark, folder):
    """Random splits of all events and the share of large values in each half: the tables a power estimate tests."""
    e = rs.replicates(table(spark, folder, "events").where("value is not null").select("event_id", "value"), 30)
    one = rs.draw(SEED, F.col("rep"), F.col("event_id")) < 0.5
    big = F.col("value") >= 25
    return e.groupBy(F.col("rep").cast("bigint").alias("rep")).agg(F.count_if(one).alias("a"), F.count_if(~one).alias("b"), F.count_if(one & big).alias("x"), F.count_if(~one & big).alias("y"))


_LOGC = "(lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - {1} + 1.0))"
_REJECT = REG.sql["n14_power_by_draws"].replace("SELECT rep, a, b, x, y FROM r", "") + f""", g AS (SELECT rep, x, a + b AS n, x + y AS k, a AS m FROM r),
l AS (SELECT rep, x, i, {_LOGC.format('k', 'i')} + {_LOGC.format('(n - k)', '(m - i)')} - {_LOGC.format('n', 'm')} AS l FROM (SELECT *, unnest(range(greatest(0, m + k - n), least(k, m) + 1)) AS i FROM g)),
h AS (SELECT rep, l AS seen FROM l WHERE i = x), p AS (SELECT l.rep, sum(exp(l)) FILTER (l <= seen + 1e-7) AS p FROM l JOIN h ON l.rep = h.rep GROUP BY 1)
SELECT count(*) AS n, avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) AS rejected, round(sqrt(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) * (1 - avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END)) / count(*)), 9) AS error FROM p"""


@REG.add("n14_rejections", _REJECT)
def n14_rejections(spark, folder):
    """The share of random splits that Fisher's test rejects, with its error: the type-I check of the power estimate."""
    t = n14_power_by_draws(spark, folder)
    p = t.withColumn("p", st.fisher(F.col("x"), F.col("a") - F.col("x"), F.col("y"), F.col("b") - F.col("y"))[3])
    share = F.avg((F.col("p") < 0.05).cast("double"))
    return p.agg(F.count("*").alias("n"), share.alias("rejected"), F.round(F.sqrt(share * (1 - share) / F.count("*")), 9).alias("error"))


REG.sql["b5_cross_correlation"] = _CROSS
QUERIES, SQL = REG.queries, REG.sql
