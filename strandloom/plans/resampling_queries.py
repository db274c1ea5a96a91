"""Keyed permutations, matched resamples and their nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import statistics as st
from strandloom.operators import intervals as iv
from strandloom.operators import resample as rs
from strandloom.operators import tables as tb
from strandloom.plans.base import HITS, PEAKS, Registry, hits, peaks
from strandloom.session import table

REG = Registry()
SEED = 20260801


def _u(*keys: str) -> str:
    text = " || '|' || ".join([f"'{SEED}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0)"


_LENGTHS = "len AS (SELECT chrom, CAST(max(chrom_end) + 1000 AS BIGINT) AS length FROM peak GROUP BY 1)"


def _lengths(p):
    return p.groupBy("chrom").agg((F.max("chrom_end") + 1000).cast("bigint").alias("length"))


_RANDOM = f"""WITH {PEAKS}, {_LENGTHS}, r AS (SELECT p.name, p.chrom, i AS rep, CAST(floor({_u('i', 'p.name')} * greatest(l.length - (p.chrom_end - p.chrom_start) + 1, 1)) AS BIGINT) AS s, p.chrom_end - p.chrom_start AS w
 FROM peak p JOIN len l ON p.chrom = l.chrom, range(1, 6) t(i))"""


@REG.add("n1_random_regions", _RANDOM + " SELECT name, rep, chrom, s AS chrom_start, s + w AS chrom_end FROM r")
def n1_random_regions(spark, folder):
    p = peaks(spark, folder).select("name", "chrom", "chrom_start", "chrom_end")
    r = rs.random_intervals(p, _lengths(p), "chrom", "chrom_start", "chrom_end", "name", 5, SEED)
    return r.select("name", "rep", "chrom", "chrom_start", "chrom_end")


_STRONG = f"{HITS}, strong AS (SELECT DISTINCT chrom, s, e FROM hit WHERE hit_score >= 12 AND NOT isnan(hit_score))"
_NULL = _RANDOM.replace(PEAKS, _STRONG) + """, n AS (SELECT rep, count(*) AS k FROM r WHERE EXISTS (SELECT 1 FROM strong h WHERE h.chrom = r.chrom AND r.s < h.e AND h.s < r.s + r.w) GROUP BY 1)
SELECT t.i AS rep, coalesce(n.k, 0) AS n_overlapping FROM range(1, 6) t(i) LEFT JOIN n ON n.rep = t.i"""


@REG.add("n2_overlap_null", _NULL)
def n2_overlap_null(spark, folder):
    """How many randomly placed peaks overlap a strong hit, per replicate, replicates without any kept."""
    p = peaks(spark, folder).select("name", "chrom", "chrom_start", "chrom_end")
    r = rs.random_intervals(p, _lengths(p), "chrom", "chrom_start", "chrom_end", "name", 5, SEED).withColumn("row", F.concat_ws("|", "rep", "name"))
    strong = hits(spark, folder).where("hit_score >= 12 and not isnan(hit_score)").select("chrom", "s", "e").distinct()
    met = iv.overlapping(r, strong, iv.Cols("chrom", "chrom_start", "chrom_end", "row"), iv.Cols("chrom", "s", "e", "s"))
    n = met.groupBy("rep").agg(F.count("*").alias("k"))
    reps = spark.range(1, 6).select(F.col("id").cast("int").alias("rep"))
    return reps.join(n, "rep", "left").select(F.col("rep").cast("bigint").alias("rep"), F.coalesce("k", F.lit(0)).alias("n_overlapping"))


@REG.add("n4_pool_sample", f"SELECT rep, event_id FROM (SELECT i AS rep, event_id, row_number() OVER (PARTITION BY i ORDER BY {_u('i', 'event_id')}, event_id) AS r FROM events, range(1, 6) t(i)) WHERE r <= 200")
def n4_pool_sample(spark, folder):
    e = table(spark, folder, "events").select("event_id")
    return rs.resample(e, "event_id", 5, 200, SEED).select(F.col("rep").cast("bigint").alias("rep"), "event_id")


_MATCH = f"""WITH need AS (SELECT l_linenumber AS s, count(*) AS need FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48 GROUP BY 1),
pool AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, l_linenumber AS s, l_extendedprice FROM lineitem WHERE l_returnflag <> 'R'),
d AS (SELECT i AS rep, p.*, row_number() OVER (PARTITION BY i, p.s ORDER BY {_u('i', 'k')}, k) AS r FROM pool p, range(1, 4) t(i))
SELECT d.rep, d.s AS l_linenumber, count(*) AS n, round(avg(d.l_extendedprice), 4) AS mean_price FROM d JOIN need n ON d.s = n.s WHERE d.r <= n.need GROUP BY 1, 2"""


@REG.add("n5_matched_resample", _MATCH)
def n5_matched_resample(spark, folder):
    """Lines of the pool matched in number per stratum to the picked ones."""
    line = table(spark, folder, "lineitem")
    needs = line.where("l_returnflag = 'R' and l_quantity >= 48").groupBy("l_linenumber").agg(F.count("*").alias("need"))
    pool = line.where("l_returnflag <> 'R'").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row"), "l_linenumber", "l_extendedprice")
    m = rs.matched_resample(pool, "row", "l_linenumber", needs, 3, SEED)
    return m.groupBy(F.col("rep").cast("bigint").alias("rep"), "l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


@REG.add("n9_pool_sufficiency", "WITH need AS (SELECT l_linenumber AS s, count(*) AS need FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48 GROUP BY 1), pool AS (SELECT l_linenumber AS s, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT need.s AS l_linenumber, CAST(need AS BIGINT) AS need, coalesce(n, 0) AS available, coalesce(n, 0) >= need * 10 AS enough FROM need LEFT JOIN pool ON need.s = pool.s")
def n9_pool_sufficiency(spark, folder):
    line = table(spark, folder, "lineitem")
    needs = line.where("l_returnflag = 'R' and l_quantity >= 48").groupBy("l_linenumber").agg(F.count("*").alias("need"))
    return rs.pool_sufficiency(line.where("l_returnflag <> 'R'"), "l_linenumber", needs)


_FLAGS = f"""WITH {PEAKS}, f AS (SELECT name, chrom_end - chrom_start >= 400 AS wide, strand = '+' AS plus FROM peak), d AS (
 SELECT i AS rep, f.*, row_number() OVER (PARTITION BY i ORDER BY {_u('i', 'name')}, name) AS r FROM f, range(1, 21) t(i))
SELECT rep, count(*) FILTER (wide) AS n_wide, count(*) FILTER (plus) AS n_plus FROM d WHERE r <= 100 GROUP BY 1"""


@REG.add("n6_n18_flag_sampling", _FLAGS)
def n6_n18_flag_sampling(spark, folder):
    """Flags computed once per row; one draw scored against all of them."""
    f = peaks(spark, folder).select("name", (F.col("chrom_end") - F.col("chrom_start") >= 400).alias("wide"), (F.col("strand") == "+").alias("plus"))
    s = rs.resample(f, "name", 20, 100, SEED)
    return s.groupBy(F.col("rep").cast("bigint").alias("rep")).agg(F.count_if("wide").alias("n_wide"), F.count_if("plus").alias("n_plus"))


_LABELS = f"""WITH s AS (SELECT s_suppkey AS k, s_acctbal AS v, s_nationkey % 2 AS g FROM supplier), o AS (SELECT k, g, row_number() OVER (ORDER BY k) AS r FROM s),
m AS (SELECT i AS rep, s.k, s.v, row_number() OVER (PARTITION BY i ORDER BY {_u('i', 's.k')}, s.k) AS r FROM s, range(1, 51) t(i))
SELECT m.rep, round(avg(m.v) FILTER (o.g = 1) - avg(m.v) FILTER (o.g = 0), 6) AS difference FROM m JOIN o ON m.r = o.r GROUP BY 1"""


@REG.add("n12_label_permutation", _LABELS)
def n12_label_permutation(spark, folder):
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), (F.col("s_nationkey") % 2).alias("g"))
    p = rs.permuted_labels(s, "k", "g", 50, SEED)
    mean = lambda g: F.avg(F.when(F.col("g") == g, F.col("v")))
    return p.groupBy(F.col("rep").cast("bigint").alias("rep")).agg(F.round(mean(1) - mean(0), 6).alias("difference"))


_EMPIRICAL = _LABELS.replace("SELECT m.rep, round", ", x AS (SELECT m.rep, round") + """), obs AS (SELECT round(avg(v) FILTER (g = 1) - avg(v) FILTER (g = 0), 6) AS obs FROM s)
SELECT count(*) AS n_perm, max(obs) AS observed, round(avg(difference), 5) AS null_mean, round((count(*) FILTER (difference >= obs) + 1) / (count(*) + 1), 9) AS p_greater,
 round((count(*) FILTER (difference <= obs) + 1) / (count(*) + 1), 9) AS p_less, round(least(1.0, 2 * least(count(*) FILTER (difference >= obs) / count(*), count(*) FILTER (difference <= obs) / count(*))), 9) AS p_doubled,
 round(count(*) FILTER (abs(difference) >= abs(obs)) / count(*), 9) AS p_absolute FROM x, obs"""
_EMPIRICAL = _EMPIRICAL.replace("FROM s, range(1, 51) t(i))\n, x AS", "FROM s, range(1, 51) t(i)), x AS")


@REG.add("st20_empirical_p", _EMPIRICAL)
def st20_empirical_p(spark, folder):
    """The four empirical p-values of an observed difference."""
    s = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("v"), (F.col("s_nationkey") % 2).alias("g"))
    mean = lambda g: F.avg(F.when(F.col("g") == g, F.col("v")))
    obs = s.agg(F.round(mean(1) - mean(0), 6).alias("obs"))  # one row
    x = n12_label_permutation(spark, folder).join(F.broadcast(obs))
    d, o = F.col("difference"), F.col("obs")
    return x.agg(
        F.count("*").alias("n_perm"), F.max("obs").alias("observed"), F.round(F.avg("difference"), 5).alias("null_mean"),
        F.round(st.empirical_p(d, o, "greater"), 9).alias("p_greater"), F.round(st.empirical_p(d, o, "less"), 9).alias("p_less"),
        F.round(st.empirical_p(d, o, "doubled", False), 9).alias("p_doubled"), F.round(st.empirical_p(d, o, "absolute", False), 9).alias("p_absolute"),
    )


_SUMMARY = _NULL.replace("SELECT t.i AS rep, coalesce(n.k, 0) AS n_overlapping FROM range(1, 6) t(i) LEFT JOIN n ON n.rep = t.i", """x AS (SELECT t.i AS rep, coalesce(n.k, 0) AS k FROM range(1, 6) t(i) LEFT JOIN n ON n.rep = t.i),
o AS (SELECT count(*) AS obs FROM peak p WHERE EXISTS (SELECT 1 FROM strong h WHERE h.chrom = p.chrom AND p.chrom_start < h.e AND h.s < p.chrom_end)),
m AS (SELECT max(obs) AS observed, count(*) AS n_perm, avg(k) AS mean, stddev_samp(k) AS sd, quantile_cont(k, 0.95) AS q95, (count(*) FILTER (k >= obs) + 1) / (count(*) + 1) AS p FROM x, o)
SELECT 'peaks by strong hits' AS test, observed, n_perm, round(mean, 6) AS null_mean, round(sd, 6) AS null_sd, round(q95, 6) AS null_q95, round(p, 9) AS p_empirical, round((observed - mean) / nullif(sd, 0), 6) AS z,
 round(observed / nullif(mean, 0), 6) AS fold, round(1 / (n_perm + 1), 9) AS p_floor, round(sqrt(p * (1 - p) / n_perm), 9) AS p_error FROM m""").replace("GROUP BY 1)\nx AS", "GROUP BY 1),\nx AS")


@REG.add("st20_null_summary", _SUMMARY)
def st20_null_summary(spark, folder):
    """z, fold and error of the overlap null against the observed overlap."""
    p = peaks(spark, folder)
    strong = hits(spark, folder).where("hit_score >= 12 and not isnan(hit_score)").select("chrom", "s", "e").distinct()
    obs = iv.overlapping(p, strong, iv.DEFAULT, iv.Cols("chrom", "s", "e", "s")).agg(F.count("*").alias("observed_n"))  # one row
    null = n2_overlap_null(spark, folder).join(F.broadcast(obs)).withColumn("test", F.lit("peaks by strong hits"))
    found = st.null_summary(null, ["test"], "n_overlapping", "observed_n")
    digits = {"null_mean": 6, "null_sd": 6, "null_q95": 6, "p_empirical": 9, "z": 6, "fold": 6, "p_floor": 9, "p_error": 9}
    return found.withColumns({c: F.round(c, d) for c, d in digits.items()})


_INFLATION = f"""WITH {PEAKS}, f AS (SELECT name, chrom, chrom_end - chrom_start AS w, coalesce(strand, '.') AS k FROM peak), need AS (SELECT k, count(*) AS need FROM f WHERE w >= 400 GROUP BY 1), size AS (SELECT sum(need) AS size FROM need),
a AS (SELECT i AS rep, f.*, row_number() OVER (PARTITION BY i ORDER BY {_u('i', 'name')}, name) AS r FROM f, range(1, 21) t(i)),
b AS (SELECT i AS rep, f.*, row_number() OVER (PARTITION BY i, f.k ORDER BY {_u('i', 'name')}, name) AS r FROM f, range(1, 21) t(i)),
n AS (SELECT 'plain' AS null_name, rep, avg(w) AS v FROM a, size WHERE r <= size GROUP BY 2 UNION ALL SELECT 'matched', rep, avg(w) FROM b JOIN need ON b.k = need.k WHERE r <= need GROUP BY 2),
s AS (SELECT null_name, avg(v) AS m FROM n GROUP BY 1)
SELECT null_name, round(m, 6) AS null_mean, round(m / (SELECT m FROM s WHERE null_name = 'plain'), 9) AS inflation FROM s"""


@REG.add("st20_inflation", _INFLATION)
def st20_inflation(spark, folder):
    """By how much a null matched by stratum exceeds a plain one, for widths of peaks drawn like the wide ones."""
    f = peaks(spark, folder).select("name", (F.col("chrom_end") - F.col("chrom_start")).alias("w"), F.coalesce("strand", F.lit(".")).alias("k"))
    needs = f.where("w >= 400").groupBy("k").agg(F.count("*").alias("need"))
    all_ = f.where("w >= 400").agg(F.count("*").alias("need")).withColumn("one", F.lit(1))  # one row
    plain = rs.matched_resample(f.withColumn("one", F.lit(1)), "name", "one", all_, 20, SEED)
    matched = rs.matched_resample(f, "name", "k", needs, 20, SEED)
    means = [x.groupBy(F.lit(n).alias("null_name"), "rep").agg(F.avg("w").alias("v")) for n, x in (("plain", plain), ("matched", matched))]
    null = means[0].unionByName(means[1]).withColumn("observed_w", F.lit(0.0))
    found = st.inflation(st.null_summary(null, ["null_name"], "v", "observed_w"), "null_name", "plain")
    return found.select("null_name", F.round("null_mean", 6).alias("null_mean"), F.round("inflation", 9).alias("inflation"))


# nulls whose stratum is a feature, a universe or a length ----------------------------------------------

_FEATURED = f"""WITH {HITS}, f AS (SELECT h.hit_id, h.hit_score >= 12 AND NOT isnan(h.hit_score) AS strong, h.p_value <= 0.0001 AS small,
  CASE WHEN (h.s + h.e) // 2 - p.chrom_start < 100 THEN 'start' WHEN p.chrom_end - (h.s + h.e) // 2 < 100 THEN 'end' ELSE 'body' END AS feature FROM hit h JOIN peak p ON h.name = p.name)"""


def _features(spark, folder):
    """Hits with the part of their peak they lie in."""
    p = peaks(spark, folder).select("name", "chrom_start", "chrom_end")
    h = hits(spark, folder).join(p, "name")
    mid = F.floor((F.col("s") + F.col("e")) / 2)
    feature = F.when(mid - F.col("chrom_start") < 100, "start").when(F.col("chrom_end") - mid < 100, "end").otherwise("body")
    strong = F.coalesce((F.col("hit_score") >= 12) & ~F.isnan("hit_score"), F.lit(False))
    return h.select("hit_id", strong.alias("strong"), F.coalesce(F.col("p_value") <= 0.0001, F.lit(False)).alias("small"), feature.alias("feature"))


@REG.add("n3_feature_matched", _FEATURED + f""", need AS (SELECT feature, count(*) AS need FROM f WHERE strong GROUP BY 1),
d AS (SELECT i AS rep, f.*, row_number() OVER (PARTITION BY i, f.feature ORDER BY {_u('i', 'hit_id')}, hit_id) AS r FROM f, range(1, 6) t(i))
SELECT rep, d.feature, count(*) AS n, count(*) FILTER (small) AS n_small FROM d JOIN need ON d.feature = need.feature WHERE r <= need GROUP BY 1, 2""")
def n3_feature_matched(spark, folder):
    """A null that keeps how many hits lie in each part of their peak."""
    f = _features(spark, folder)
    m = rs.matched_resample(f, "hit_id", "feature", f.where("strong").groupBy("feature").agg(F.count("*").alias("need")), 5, SEED)
    return m.groupBy(F.col("rep").cast("bigint").alias("rep"), "feature").agg(F.count("*").alias("n"), F.count_if("small").alias("n_small"))


@REG.add("n7_universe", _FEATURED + f""", u AS (SELECT * FROM f WHERE feature = 'start'), d AS (SELECT i AS rep, u.*, row_number() OVER (PARTITION BY i ORDER BY {_u('i', 'hit_id')}, hit_id) AS r FROM u, range(1, 6) t(i))
SELECT rep, count(*) AS n, count(*) FILTER (strong) AS n_strong FROM d WHERE r <= 100 GROUP BY 1""")
def n7_universe(spark, folder):
    """Draws from a universe only: hits near the starts of peaks."""
    m = rs.resample(_features(spark, folder).where("feature = 'start'"), "hit_id", 5, 100, SEED)
    return m.groupBy(F.col("rep").cast("bigint").alias("rep")).agg(F.count("*").alias("n"), F.count_if("strong").alias("n_strong"))


_TILES = ", ".join(f"{i / 20!r}" for i in range(1, 20))


@REG.add("n8_length_matched", f"""WITH q AS (SELECT quantile_cont(p_retailprice, [{_TILES}]) AS e FROM part), f AS (SELECT p_partkey, p_size, len(list_filter(list_distinct(q.e), lambda x: x < p_retailprice)) + 1 AS bin FROM part, q WHERE p_retailprice IS NOT NULL),
need AS (SELECT bin, count(*) AS need FROM f WHERE p_size >= 45 GROUP BY 1), d AS (SELECT i AS rep, f.*, row_number() OVER (PARTITION BY i, f.bin ORDER BY {_u('i', 'p_partkey')}, p_partkey) AS r FROM f, range(1, 6) t(i))
SELECT rep, d.bin, count(*) AS n, round(avg(p_size), 6) AS mean_size FROM d JOIN need ON d.bin = need.bin WHERE r <= need GROUP BY 1, 2""")
def n8_length_matched(spark, folder):
    """A null matched on a measure in 20 quantile bins."""
    part = table(spark, folder, "part").where("p_retailprice is not null").select("p_partkey", "p_size", "p_retailprice")
    edges = tb.exact_quantiles(part, "p_retailprice", [i / 20 for i in range(1, 20)]).select(F.col("q").alias("e"))  # one row
    f = part.join(F.broadcast(edges)).select("p_partkey", "p_size", tb.binned(F.col("p_retailprice"), F.col("e")).cast("bigint").alias("bin"))
    m = rs.matched_resample(f, "p_partkey", "bin", f.where("p_size >= 45").groupBy("bin").agg(F.count("*").alias("need")), 5, SEED)
    return m.groupBy(F.col("rep").cast("bigint").alias("rep"), "bin").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("mean_size"))


def _drawn_sql(width, stretches):
    """Windows drawn over all keys, those that meet no stretch, the first 500 in drawing order."""
    return f"""WITH {PEAKS}, {_LENGTHS}, ends AS (SELECT chrom, length, CAST(sum(length - {width} + 1) OVER (ORDER BY chrom) AS BIGINT) AS upto FROM len WHERE length >= {width}),
d AS (SELECT i AS draw_id, CAST(floor({_u('i')} * (SELECT max(upto) FROM ends)) AS BIGINT) AS at FROM range(1, 80001) t(i)),
w AS (SELECT draw_id, chrom, d.at - (upto - (length - {width} + 1)) AS s FROM d JOIN ends ON d.at >= upto - (length - {width} + 1) AND d.at < upto), no AS ({stretches})
SELECT draw_id, chrom, s AS "start", s + {width} AS "end" FROM w WHERE NOT EXISTS (SELECT 1 FROM no WHERE no.chrom = w.chrom AND w.s < no.e AND no.s < w.s + {width}) ORDER BY draw_id LIMIT 500"""


@REG.add("n11_clear_intervals", _drawn_sql(101, "SELECT chrom, unnest(range(0, length, 10000)) AS s, s + 1000 AS e FROM len"))
def n11_clear_intervals(spark, folder):
    """Uniform windows that hold no unknown letter, drawn until 500 are kept; unknown letters fill the first tenth of every 10,000."""
    lengths = _lengths(peaks(spark, folder))
    unknown = lengths.select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(10_000).cast("bigint"))).alias("s")).withColumn("e", F.col("s") + 1000)
    clear = lambda drawn: iv.overlapping(drawn, unknown, iv.Cols("chrom", "start", "end", "draw_id"), iv.Cols("chrom", "s", "e", "s"), keep=False)
    return rs.kept_windows(lengths, "chrom", 500, 101, SEED, clear)


@REG.add("n13_power_curve", f"""WITH s AS (SELECT s_suppkey AS k, s_acctbal AS v, s_nationkey % 2 AS g FROM supplier), o AS (SELECT k, v, g, row_number() OVER (ORDER BY k) AS r, count(*) OVER () AS n FROM s),
d AS (SELECT i AS rep, CAST(floor({_u('i', 'o.r')} * o.n) + 1 AS BIGINT) AS r FROM o, range(1, 41) t(i)), b AS (SELECT d.rep, o.v, o.g FROM d JOIN o ON d.r = o.r),
m AS (SELECT rep, avg(v) FILTER (g = 1) - avg(v) FILTER (g = 0) AS diff, sqrt(var_samp(v) FILTER (g = 1) / count(v) FILTER (g = 1) + var_samp(v) FILTER (g = 0) / count(v) FILTER (g = 0)) AS se FROM b GROUP BY 1)
SELECT x AS shift, round(avg(CASE WHEN abs((diff + x) / se) >= 1.96 THEN 1.0 ELSE 0.0 END), 6) AS power FROM m, (SELECT unnest([0, 500, 1000, 2000, 4000]) AS x) GROUP BY 1""")
def n13_power_curve(spark, folder):
    """Bootstrap replicates, a shift added to one group, and the share of replicates that find it."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), (F.col("s_nationkey") % 2).alias("g"))
    b = rs.bootstrap(s, "k", 40, SEED).join(s, "k")
    v, c = F.col("v"), F.col("copies")

    def moments(g):
        n, t, q = (F.sum(F.when(F.col("g") == g, x)) for x in (c, v * c, v * v * c))
        return n, t / n, (q - t * t / n) / (n - 1)

    (n1, m1, v1), (n0, m0, v0) = moments(1), moments(0)
    per = b.groupBy("rep").agg((m1 - m0).alias("diff"), F.sqrt(v1 / n1 + v0 / n0).alias("se"))
    shifts = F.explode(F.array(*(F.lit(x) for x in (0, 500, 1000, 2000, 4000))))
    found = F.when(F.abs((F.col("diff") + F.col("shift")) / F.col("se")) >= 1.96, 1.0).otherwise(0.0)
    return per.withColumn("shift", shifts).groupBy("shift").agg(F.round(F.avg(found), 6).alias("power"))


@REG.add("n15_split_half", f"SELECT event_id, CAST(row_number() OVER (ORDER BY {_u('event_id')}, event_id) % 2 + 1 AS INTEGER) AS half FROM events")
def n15_split_half(spark, folder):
    return rs.split_half(table(spark, folder, "events").select("event_id"), "event_id", SEED)


@REG.add("n16_shuffle_counts", "WITH s AS (SELECT hit_id, motif_id || '_shuf_' || (hit_id % 37 + 1) AS name, score FROM fimo WHERE motif_id IS NOT NULL) SELECT i AS rep, count(s.hit_id) AS n FROM range(1, 51) t(i) LEFT JOIN s ON CAST(regexp_extract(s.name, '_shuf_([0-9]+)$', 1) AS BIGINT) = t.i AND s.score >= 12 AND NOT isnan(s.score) GROUP BY 1")
def n16_shuffle_counts(spark, folder):
    """Replicate numbers parsed from names; replicates without hits kept as 0."""
    f = table(spark, folder, "fimo").where("motif_id is not null and score >= 12 and not isnan(score)")
    name = F.concat("motif_id", F.lit("_shuf_"), (F.col("hit_id") % 37 + 1).cast("string"))
    n = f.select(F.regexp_extract(name, "_shuf_([0-9]+)$", 1).cast("bigint").alias("rep")).groupBy("rep").agg(F.count("*").alias("k"))
    return spark.range(1, 51).withColumnRenamed("id", "rep").join(n, "rep", "left").select("rep", F.coalesce("k", F.lit(0)).alias("n"))


@REG.add("n17_random_windows", _drawn_sql(201, "SELECT chrom, chrom_start AS s, chrom_end AS e FROM peak"))
def n17_random_windows(spark, folder):
    """The first 500 of drawn windows that overlap no peak."""
    p = peaks(spark, folder)
    clear = lambda drawn: iv.overlapping(drawn, p, iv.Cols("chrom", "start", "end", "draw_id"), iv.DEFAULT, keep=False)
    return rs.kept_windows(_lengths(p), "chrom", 500, 201, SEED, clear)


QUERIES, SQL = REG.queries, REG.sql
