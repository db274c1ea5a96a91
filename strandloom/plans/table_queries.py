"""Filters, key joins, aggregates, windows and ranking."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators import tables as tb
from strandloom.operators.ordered import prefix_sum_within
from strandloom.plans.base import PEAKS, Registry, peaks
from strandloom.session import table

REG = Registry()
LINE = "lineitem"


@REG.add("proj1_p2_chromosomes", """SELECT chrom, count(*) AS n_rows, count(*) FILTER (regexp_matches(chrom || chr(9), '^chr[234X][LR]?\\s')) AS n_by_pattern,
count(*) FILTER (chrom IN ('chr2L', 'chr2R', 'chr3L', 'chr3R', 'chr4', 'chrX')) AS n_by_list FROM joint_peaks GROUP BY chrom""")
def proj1_p2_chromosomes(spark, folder):
    listed = F.col("chrom").isin("chr2L", "chr2R", "chr3L", "chr3R", "chr4", "chrX")
    pattern = F.concat("chrom", F.lit("\t")).rlike(r"^chr[234X][LR]?\s")
    n = [F.count("*").alias("n_rows"), F.count(F.when(pattern, 1)).alias("n_by_pattern"), F.count(F.when(listed, 1)).alias("n_by_list")]
    return table(spark, folder, "joint_peaks").groupBy("chrom").agg(*n)


@REG.add("proj3_adaptive_filter", "SELECT motif_id, hit_id FROM fimo WHERE CASE WHEN q_value IS NOT NULL THEN q_value < 0.05 ELSE score >= 12 AND NOT isnan(score) END")
def proj3_adaptive_filter(spark, folder):
    """The stricter of two criteria where its column is filled, the other where it is not."""
    keep = F.when(F.col("q_value").isNotNull(), F.col("q_value") < 0.05).otherwise((F.col("score") >= 12) & ~F.isnan("score"))
    return table(spark, folder, "fimo").where(keep).select("motif_id", "hit_id")


_STRATA = """SELECT stratum, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM (
 SELECT 'all' AS stratum, o_totalprice FROM orders UNION ALL SELECT CASE WHEN o_totalprice <= 150000 THEN 'near' ELSE 'far' END, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL) GROUP BY 1"""


@REG.add("proj4_strata", _STRATA)
def proj4_strata(spark, folder):
    """Overlapping strata in one pass: all rows, and each side of a threshold."""
    o = table(spark, folder, "orders").withColumn("part", F.when(F.col("o_totalprice") <= 150_000, "near").when(F.col("o_totalprice").isNotNull(), "far"))
    strata = F.explode(F.array_compact(F.array(F.lit("all"), F.col("part"))))
    return o.select(strata.alias("stratum"), "o_totalprice").groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


_CLASS = """SELECT class, mark, sign_agrees, count(*) AS n FROM (SELECT
 CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'both' WHEN l_returnflag = 'R' THEN 'first' WHEN l_linestatus = 'O' THEN 'second' ELSE 'none' END AS class,
 CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE 'ns' END AS mark,
 sign(l_discount - 0.05) = sign(l_tax - 0.04) AS sign_agrees FROM lineitem) GROUP BY 1, 2, 3"""


@REG.add("proj5_p7_classes", _CLASS)
def proj5_p7_classes(spark, folder):
    r, o = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    kind = F.when(r & o, "both").when(r, "first").when(o, "second").otherwise("none")
    agrees = F.signum(F.col("l_discount") - 0.05) == F.signum(F.col("l_tax") - 0.04)
    rows = table(spark, folder, LINE).select(kind.alias("class"), tb.stars(F.col("l_discount")).alias("mark"), agrees.alias("sign_agrees"))
    return rows.groupBy("class", "mark", "sign_agrees").agg(F.count("*").alias("n"))


@REG.add("proj8_width_filter", "SELECT chrom, count(*) AS n FROM joint_peaks WHERE chrom_end - chrom_start BETWEEN 200 AND 500 GROUP BY chrom HAVING count(*) >= 5")
def proj8_width_filter(spark, folder):
    width = F.col("chrom_end") - F.col("chrom_start")
    return table(spark, folder, "joint_peaks").where(width.between(200, 500)).groupBy("chrom").agg(F.count("*").alias("n")).where("n >= 5")


@REG.add("proj9_rename_mutate", "SELECT s_suppkey AS id, upper(s_name) AS label, round(s_acctbal / 1000, 6) AS thousands, s_acctbal < 0 AS in_debt FROM supplier")
def proj9_rename_mutate(spark, folder):
    s = table(spark, folder, "supplier").withColumnRenamed("s_suppkey", "id")
    return s.select("id", F.upper("s_name").alias("label"), F.round(F.col("s_acctbal") / 1000, 6).alias("thousands"), (F.col("s_acctbal") < 0).alias("in_debt"))


@REG.add("proj10_first_column", "SELECT c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def proj10_first_column(spark, folder):
    """The first of several possible columns that a table has."""
    def pick(df, *names):
        return F.col(next(n for n in names if n in df.columns))

    parts = [table(spark, folder, t) for t in ("customer", "supplier")]
    slim = [p.select(pick(p, "id", "c_custkey", "s_suppkey").alias("id"), pick(p, "label", "c_name", "s_name").alias("label")) for p in parts]
    return slim[0].unionByName(slim[1])


@REG.add("proj11_flag_filter", "SELECT event_type, count(*) AS n FROM events WHERE value >= 30 AND (event_id & 1804) = 0 GROUP BY 1")
def proj11_flag_filter(spark, folder):
    return table(spark, folder, "events").where("value >= 30 and (event_id & 1804) = 0").groupBy("event_type").agg(F.count("*").alias("n"))


@REG.add("j17_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def j17_inner(spark, folder):
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    per_customer = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))  # orders shrink before they meet anything
    j = per_customer.join(c, per_customer["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.sum("n").alias("n"), F.round(F.sum("t"), 2).alias("total"))


@REG.add("j18_left", "SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j18_left(spark, folder):
    per = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order"))
    return table(spark, folder, "customer").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order")


@REG.add("j19_lookup", f"WITH {PEAKS} SELECT f.hit_id, p.chrom FROM fimo f LEFT JOIN peak p ON f.sequence_name = p.name")
def j19_lookup(spark, folder):
    f = table(spark, folder, "fimo").select("hit_id", F.col("sequence_name").alias("name"))
    return f.join(peaks(spark, folder).select("name", "chrom"), "name", "left").select("hit_id", "chrom")


_IDS = """alt AS (SELECT motif_alt_id AS k, min(motif_id) AS lo, max(motif_id) AS hi FROM motif_library WHERE motif_alt_id IS NOT NULL GROUP BY 1)"""


@REG.add("j22_unambiguous", f"WITH {_IDS} SELECT k AS motif_alt_id, CASE WHEN lo = hi THEN lo END AS motif_id FROM alt")
def j22_unambiguous(spark, folder):
    return tb.unambiguous(table(spark, folder, "motif_library"), "motif_alt_id", "motif_id")


_CASCADE = """WITH names AS (SELECT DISTINCT p_name AS k FROM part WHERE p_name IS NOT NULL),
one AS (SELECT k, t FROM (SELECT p_name AS k, min(p_brand) AS lo, max(p_brand) AS t FROM part WHERE p_size <= 3 AND p_name IS NOT NULL GROUP BY 1) WHERE lo = t),
two AS (SELECT k, t FROM (SELECT p_name AS k, min(p_brand) AS lo, max(p_brand) AS t FROM part WHERE p_size BETWEEN 4 AND 6 AND p_name IS NOT NULL GROUP BY 1) WHERE lo = t
  AND t NOT IN (SELECT t FROM one) AND k NOT IN (SELECT k FROM one)),
done AS (SELECT k, t, 1 AS pass FROM one UNION ALL SELECT k, t, 2 FROM two)
SELECT n.k AS p_name, d.t AS target, d.pass FROM names n LEFT JOIN done d ON n.k = d.k"""


@REG.add("j21_cascade", _CASCADE)
def j21_cascade(spark, folder):
    p = table(spark, folder, "part").where("p_name is not null")
    slim = p.select("p_name", "p_brand", "p_size")
    passes = [(slim.where("p_size <= 3").select("p_name", "p_brand"), "p_brand"), (slim.where("p_size between 4 and 6").select("p_name", "p_brand"), "p_brand")]
    return tb.cascade(p.select("p_name").distinct(), "p_name", passes, "target").select("p_name", "target", "pass")


_SETS = """SELECT l_returnflag || l_linestatus AS s, l_partkey AS k FROM lineitem WHERE l_partkey IS NOT NULL AND l_quantity >= 45 GROUP BY 1, 2"""


@REG.add("j24_j25_set_pairs", f"WITH m AS ({_SETS}), n AS (SELECT s, count(*) AS n FROM m GROUP BY 1), o AS (SELECT a.s AS a, b.s AS b, count(*) AS o FROM m a JOIN m b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2) SELECT x.s AS set_a, y.s AS set_b, coalesce(o.o, 0) AS shared, x.n AS n_a, y.n AS n_b FROM n x JOIN n y ON x.s < y.s LEFT JOIN o ON o.a = x.s AND o.b = y.s")
def j24_j25_set_pairs(spark, folder):
    """Every two sets and what they share: members list their sets once, pairs come from the lists."""
    m = table(spark, folder, LINE).where("l_partkey is not null and l_quantity >= 45").select(F.concat("l_returnflag", "l_linestatus").alias("s"), F.col("l_partkey").alias("k")).distinct()
    n = m.groupBy("s").agg(F.count("*").alias("n"))
    lists = m.groupBy("k").agg(F.sort_array(F.collect_set("s")).alias("l"))  # a member's sets: at most one each of the few flags
    pairs = lists.select(F.explode(F.flatten(F.transform("l", lambda a: F.transform(F.filter("l", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    shared = pairs.groupBy(F.col("p.a").alias("set_a"), F.col("p.b").alias("set_b")).agg(F.count("*").alias("o"))
    x, y = (n.select(F.col("s").alias(f"set_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    return x.join(y, F.col("set_a") < F.col("set_b")).join(shared, ["set_a", "set_b"], "left").select("set_a", "set_b", F.coalesce("o", F.lit(0)).alias("shared"), "n_a", "n_b")


_U = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT) / 4294967296.0"


@REG.add("j26_complement_split", f"SELECT event_id, CASE WHEN {_U.format(chr(39) + '7|' + chr(39) + ' || event_id')} < 0.425 THEN 1 ELSE 2 END AS half FROM events")
def j26_complement_split(spark, folder):
    return tb.complement_split(table(spark, folder, "events").select("event_id"), "event_id", 7, 0.425)


@REG.add("a1_percent", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS percent FROM lineitem GROUP BY 1, 2")
def a1_percent(spark, folder):
    n = table(spark, folder, LINE).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("l_returnflag")), 6))


@REG.add("a2_conditional_counts", "SELECT l_suppkey, count(*) FILTER (l_discount > 0.05 AND l_tax > 0.04) AS both, count(*) FILTER (l_discount > 0.05 AND l_tax <= 0.04) AS first_only, count(*) FILTER (l_discount <= 0.05 AND l_tax > 0.04) AS second_only, count(*) FILTER (l_discount <= 0.05 AND l_tax <= 0.04) AS neither FROM lineitem GROUP BY 1")
def a2_conditional_counts(spark, folder):
    a, b = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    return table(spark, folder, LINE).groupBy("l_suppkey").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"))


@REG.add("a3_cross_table", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) AS total, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 9) AS share_f FROM orders GROUP BY 1")
def a3_cross_table(spark, folder):
    t = tb.cross_table(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    return t.withColumn("share_f", F.round(F.col("F") / F.col("total"), 9))


@REG.add("a4_extremes", "SELECT l_orderkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, bool_or(l_returnflag = 'R') AS any_returned FROM lineitem GROUP BY 1")
def a4_extremes(spark, folder):
    return table(spark, folder, LINE).groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))


_SUM = "round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25"


@REG.add("a5_a16_summary", f"SELECT l_returnflag, {_SUM}, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")
def a5_a16_summary(spark, folder):
    """Mean, deviation, extremes and exact linear quantiles."""
    x, rows = "l_extendedprice", table(spark, folder, LINE).select("l_returnflag", "l_extendedprice")
    q = tb.exact_quantiles(rows, x, [0.5, 0.9, 0.25], ["l_returnflag"])
    m = rows.groupBy("l_returnflag").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return m.join(q, "l_returnflag").select("l_returnflag", "mean", "sd", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("median", "q90", "q25"))), "lo", "hi")


@REG.add("a6_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1")
def a6_distinct(spark, folder):
    return table(spark, folder, LINE).groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_orderkey").alias("n_orders"))


@REG.add("a7_group_apply", "SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS total, arg_min(event_id, ts) AS first_event FROM events GROUP BY 1, 2")
def a7_group_apply(spark, folder):
    return table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min_by("event_id", "ts").alias("first_event"))


_MATRIX = "WITH m AS (SELECT vec_id, label, i, x FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"


@REG.add("a8_row_reductions", f"{_MATRIX} SELECT vec_id, round(sum(x), 4) AS row_sum, round(avg(x), 5) AS row_mean, round(CAST(max(x) AS DOUBLE), 6) AS row_max FROM m GROUP BY 1")
def a8_row_reductions(spark, folder):
    """Reductions along a row's own array: no rows are made of it."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.round(total, 4).alias("row_sum"), F.round(total / F.size("embedding"), 5).alias("row_mean"), F.round(F.array_max(v), 6).alias("row_max"))


@REG.add("a8_column_reductions", f"{_MATRIX} SELECT label, i, round(avg(x), 5) AS col_mean, count(*) AS n FROM m GROUP BY 1, 2")
def a8_column_reductions(spark, folder):
    m = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return m.groupBy("label", (F.col("p") + 1).cast("bigint").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("col_mean"), F.count("*").alias("n"))


_TOK = "SELECT unnest(string_split_regex(trim(geneset_type), '[ _:-]+')) AS token FROM chipenrich_dys_tgo_gobp WHERE geneset_type IS NOT NULL"


@REG.add("a10_token_counts", f"SELECT token, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM ({_TOK}) GROUP BY 1")
def a10_token_counts(spark, folder):
    t = table(spark, folder, "chipenrich_dys_tgo_gobp").where("geneset_type is not null").select(F.explode(F.split(F.trim("geneset_type"), "[ _:-]+")).alias("token"))
    n = t.groupBy("token").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("token", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("percent"))  # one row of the total


@REG.add("a11_delimited_max", "SELECT p_partkey, max(CAST(x AS BIGINT)) AS top FROM (SELECT p_partkey, unnest(string_split(p_size || ';' || (p_partkey % 97) || ';' || (p_partkey % 13), ';')) AS x FROM part) GROUP BY 1")
def a11_delimited_max(spark, folder):
    """The largest number of a delimited field, inside the row."""
    packed = F.concat_ws(";", F.col("p_size").cast("string"), (F.col("p_partkey") % 97).cast("string"), (F.col("p_partkey") % 13).cast("string"))
    return table(spark, folder, "part").select("p_partkey", F.array_max(F.transform(F.split(packed, ";"), lambda x: x.try_cast("bigint"))).alias("top"))


@REG.add("a12_fixed_levels", "SELECT l.i AS level, count(x.l_quantity) AS n FROM range(0, 61) l(i) LEFT JOIN lineitem x ON CAST(x.l_quantity AS BIGINT) = l.i GROUP BY 1")
def a12_fixed_levels(spark, folder):
    n = table(spark, folder, LINE).groupBy(F.col("l_quantity").cast("bigint").alias("level")).agg(F.count("l_quantity").alias("n"))
    levels = spark.range(61).withColumnRenamed("id", "level")
    return levels.join(n, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


@REG.add("a13_first_qualifying", "SELECT l_suppkey, min(l_shipdate) AS first_big FROM lineitem WHERE l_quantity >= 40 GROUP BY 1")
def a13_first_qualifying(spark, folder):
    return table(spark, folder, LINE).where("l_quantity >= 40").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first_big"))


@REG.add("a14_cumulative", "SELECT y, m, n, CAST(sum(n) OVER (PARTITION BY y ORDER BY m) AS BIGINT) AS running FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2)")
def a14_cumulative(spark, folder):
    n = table(spark, folder, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y"), F.month("o_orderdate").cast("bigint").alias("m")).agg(F.count("*").alias("n"))
    return n.withColumn("running", F.sum("n").over(W.partitionBy("y").orderBy("m")))


@REG.add("w1_first_by_key", "SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def w1_first_by_key(spark, folder):
    rows = table(spark, folder, LINE).select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return tb.first_by(rows, ["l_partkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")])


@REG.add("w2_widest", "SELECT name, max(chrom_end - chrom_start) AS width, arg_max(chrom_start, (chrom_end - chrom_start, -chrom_start)) AS at FROM joint_peaks WHERE name IS NOT NULL AND chrom_start IS NOT NULL GROUP BY 1")
def w2_widest(spark, folder):
    width = F.col("chrom_end") - F.col("chrom_start")
    p = table(spark, folder, "joint_peaks").where("name is not null and chrom_start is not null")
    return p.groupBy("name").agg(F.max(width).alias("width"), F.max_by("chrom_start", F.struct(width, -F.col("chrom_start"))).alias("at"))


_RANK = "rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0"


@REG.add("w3_percentile_rank", f"SELECT l_orderkey, l_linenumber, l_suppkey, round(({_RANK}) / count(*) OVER (PARTITION BY l_suppkey), 9) AS p FROM lineitem")
def w3_percentile_rank(spark, folder):
    """Average-tie ranks from each group's histogram of values: hot values are one row."""
    rows = table(spark, folder, LINE).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    hist = rows.groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    g = W.partitionBy("l_suppkey")
    rank = F.sum("n").over(g.orderBy("l_quantity")) - F.col("n") + (F.col("n") + 1) / 2.0
    p = hist.select("l_suppkey", "l_quantity", F.round(rank / F.sum("n").over(g), 9).alias("p"))
    return rows.join(p, ["l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_suppkey", "p")


@REG.add("w4_rank_of_means", "SELECT l_suppkey, rank() OVER (ORDER BY round(avg(l_discount), 9) DESC) AS r FROM lineitem GROUP BY 1")
def w4_rank_of_means(spark, folder):
    """Equal means are counted, and ranks come from a scan over the sorted means."""
    m = table(spark, folder, LINE).groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 9).alias("m"))
    ranked = prefix_sum_within(m.groupBy("m").agg(F.count("*").alias("c")).withColumn("falling", -F.col("m")), [], ["falling"], "c", "upto")
    return m.join(ranked, "m").select("l_suppkey", (F.col("upto") - F.col("c") + 1).alias("r"))


@REG.add("w5_quantile_bins", """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM lineitem)
SELECT len(list_filter(list_distinct(q.e), lambda x: x < l_extendedprice)) + 1 AS bin, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem, q WHERE l_extendedprice IS NOT NULL GROUP BY 1""")
def w5_quantile_bins(spark, folder):
    rows = table(spark, folder, LINE).where("l_extendedprice is not null").groupBy("l_extendedprice").agg(F.count("*").alias("n"))
    edges = tb.exact_quantiles(table(spark, folder, LINE), "l_extendedprice", [i / 10 for i in range(1, 10)]).select(F.col("q").alias("e"))  # one row
    b = rows.join(F.broadcast(edges)).withColumn("bin", tb.binned(F.col("l_extendedprice"), F.col("e")).cast("bigint"))
    return b.groupBy("bin").agg(F.sum("n").alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@REG.add("w6_two_way_bins", """WITH q AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS a, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS b FROM lineitem)
SELECT len(list_filter(list_distinct(q.a), lambda x: x < l_quantity)) + 1 AS bin_a, len(list_filter(list_distinct(q.b), lambda x: x < l_extendedprice)) + 1 AS bin_b, count(*) AS n FROM lineitem, q WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1, 2""")
def w6_two_way_bins(spark, folder):
    rows = table(spark, folder, LINE).where("l_quantity is not null and l_extendedprice is not null").groupBy("l_quantity", "l_extendedprice").agg(F.count("*").alias("n"))
    quarters = [0.25, 0.5, 0.75]
    a, b = (tb.exact_quantiles(table(spark, folder, LINE), c, quarters).select(F.col("q").alias(n)) for c, n in (("l_quantity", "a"), ("l_extendedprice", "b")))
    edges = a.join(b)  # one row each
    b = rows.join(F.broadcast(edges))
    a_, b_ = tb.binned(F.col("l_quantity"), F.col("a")), tb.binned(F.col("l_extendedprice"), F.col("b"))
    return b.groupBy(a_.cast("bigint").alias("bin_a"), b_.cast("bigint").alias("bin_b")).agg(F.sum("n").alias("n"))


@REG.add("w8_top_40", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40")
def w8_top_40(spark, folder):
    rows = table(spark, folder, LINE).select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(40)


@REG.add("w9_w11_ordered_rank", "SELECT query_id, target_id, match_id, row_number() OVER (PARTITION BY query_id ORDER BY q_value > 0.05 OR q_value IS NULL, p_value, match_id) AS r FROM tomtom WHERE query_id IS NOT NULL AND p_value IS NOT NULL AND (q_value IS NULL OR NOT isnan(q_value))")
def w9_w11_ordered_rank(spark, folder):
    """Rank in an order whose first key is a condition."""
    t = table(spark, folder, "tomtom").where("query_id is not null and p_value is not null and (q_value is null or not isnan(q_value))")
    worse = F.coalesce(F.col("q_value") > 0.05, F.lit(True))
    return t.select("query_id", "target_id", "match_id", F.row_number().over(W.partitionBy("query_id").orderBy(worse, "p_value", "match_id")).cast("bigint").alias("r"))


_CURVE = """curve AS (SELECT l_returnflag AS g, CAST(l_quantity AS DOUBLE) AS x, round(avg(l_extendedprice), 4) AS y FROM lineitem GROUP BY 1, 2),
seg AS (SELECT g, x AS x0, y AS y0, lead(x) OVER (PARTITION BY g ORDER BY x) AS x1, lead(y) OVER (PARTITION BY g ORDER BY x) AS y1 FROM curve)"""


@REG.add("w12_interpolate", f"WITH {_CURVE} SELECT q.g, q.at, round(y0 + (q.at - x0) * (y1 - y0) / (x1 - x0), 3) AS y FROM (SELECT DISTINCT l_returnflag AS g, CAST(l_linenumber * 6 + 0.5 AS DOUBLE) AS at FROM lineitem) q JOIN seg ON q.g = seg.g AND q.at >= x0 AND q.at < x1")
def w12_interpolate(spark, folder):
    rows = table(spark, folder, LINE)
    curve = rows.groupBy(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x")).agg(F.round(F.avg("l_extendedprice"), 4).alias("y"))
    asked = rows.select(F.col("l_returnflag").alias("g"), (F.col("l_linenumber") * 6 + 0.5).alias("at")).distinct()
    return tb.interpolated(asked, curve, "g", "x", "y", "at").withColumn("y", F.round("y", 3))


@REG.add("w7_w13_best_match", "SELECT query_id, min(q_value) AS best_q, arg_min(target_id, (q_value, match_id)) AS target FROM tomtom WHERE query_id IS NOT NULL AND target_id IS NOT NULL AND q_value IS NOT NULL AND NOT isnan(q_value) GROUP BY 1")
def w7_w13_best_match(spark, folder):
    t = table(spark, folder, "tomtom").where("query_id is not null and target_id is not null and q_value is not null and not isnan(q_value)")
    return t.groupBy("query_id").agg(F.min("q_value").alias("best_q"), F.min_by("target_id", F.struct("q_value", "match_id")).alias("target"))


@REG.add("x_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderstatus, o_orderpriority))")
def x_grouping_sets(spark, folder):
    """Extra: strata as grouping sets."""
    o = table(spark, folder, "orders")
    sets = [[], [F.col("o_orderstatus")], [F.col("o_orderstatus"), F.col("o_orderpriority")]]
    return o.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@REG.add("proj6_stars", "SELECT match_id, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS mark FROM tomtom WHERE p_value IS NOT NULL AND NOT isnan(p_value)")
def proj6_stars(spark, folder):
    t = table(spark, folder, "tomtom").where("p_value is not null and not isnan(p_value)")
    return t.select("match_id", tb.stars(F.col("p_value")).alias("mark"))


QUERIES, SQL = REG.queries, REG.sql
