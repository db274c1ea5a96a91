"""Tests, models and adjustments."""

from __future__ import annotations


from pyspark.sql import functions as F

from strandloom.functions import special as sp
from strandloom.functions import statistics as st
from strandloom.plans.base import HITS, PEAKS, Registry, hits, peaks
from strandloom.session import table

REG = Registry()


def _six(c):
    """Six significant digits, as text."""
    return F.format_string("%.5e", c)


def _area(density: str, rows: str, keep: str, start: str, span: float, steps: int = 4000) -> str:
    """SQL: the area under a density from ``start`` on over ``span``, by Simpson's rule; one row per row of ``rows``."""
    h = span / steps
    at = f"({start} + i * {h!r})"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return f"(SELECT {keep}, sum({weight} * ({density.replace('$x', at)})) * {h!r} / 3 AS area FROM {rows}, range(0, {steps + 1}) g(i) GROUP BY ALL)"


_NORMAL = "exp(-$x * $x / 2) / sqrt(2 * pi())"
_STUDENT = "exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0) - 0.5 * ln(v * pi()) - (v + 1) / 2.0 * ln(1 + $x * $x / v))"
_CHI2 = "exp((v / 2.0 - 1) * ln($x) - $x / 2 - lgamma(v / 2.0) - v / 2.0 * ln(2.0))"

_OVERLAP = """u AS (SELECT count(DISTINCT p_partkey) AS n FROM part), k AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity >= 49), m AS (
 SELECT l_suppkey, count(DISTINCT l_partkey) AS m, count(DISTINCT CASE WHEN l_partkey IN (SELECT k FROM k) THEN l_partkey END) AS x FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1),
t AS (SELECT l_suppkey, m, x, n, (SELECT count(*) FROM k) AS k FROM m, u)"""
_CHOOSE = "(lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - {1} + 1.0))"
_LOGP = f"{_CHOOSE.format('k', 'i')} + {_CHOOSE.format('(n - k)', '(m - i)')} - {_CHOOSE.format('n', 'm')}"


def _overlaps(spark, folder):
    line = table(spark, folder, "lineitem").where("l_partkey is not null")
    marked = line.where("l_quantity >= 49").select(F.col("l_partkey").alias("k")).distinct()
    pairs = line.select("l_suppkey", "l_partkey").distinct()
    flagged = pairs.join(marked, F.col("l_partkey") == F.col("k"), "left")
    m = flagged.groupBy("l_suppkey").agg(F.count("*").alias("m"), F.count("k").alias("x"))
    n = table(spark, folder, "part").agg(F.count_distinct("p_partkey").alias("n"))  # one row
    return m.join(n).join(marked.agg(F.count("*").alias("k")))


@REG.add("st1_overlap_tail", f"WITH {_OVERLAP} SELECT l_suppkey, x, m, printf('%.5e', least(1.0, sum(exp({_LOGP})))) AS p FROM (SELECT *, unnest(range(x, least(k, m) + 1)) AS i FROM t) GROUP BY l_suppkey, x, m")
def st1_overlap_tail(spark, folder):
    """Whether each supplier's parts overlap the marked ones more than by chance."""
    t = _overlaps(spark, folder)
    p = st.hypergeometric(F.col("x"), F.col("n"), F.col("k"), F.col("m"))
    return t.select("l_suppkey", "x", "m", _six(p).alias("p"))


_TAILS = f"""WITH {_OVERLAP}, d AS (SELECT l_suppkey, n, k, m, i, exp({_LOGP}) AS p FROM (SELECT *, unnest(range(greatest(0, m + k - n), least(k, m) + 1)) AS i FROM t)),
c AS (SELECT *, sum(p) OVER (PARTITION BY l_suppkey ORDER BY i) AS upto FROM d), q AS (SELECT l_suppkey, n, k, m, min(i) FILTER (upto >= 0.95 * (1 - 1e-12)) + 1 AS q FROM c GROUP BY ALL),
w AS (SELECT l_suppkey, n, least(n, CAST(floor(k * 1.2) AS BIGINT)) AS k, m, q FROM q), e AS (SELECT *, unnest(range(greatest(q, m + k - n), least(k, m) + 1)) AS i FROM w)
SELECT w.l_suppkey, CAST(w.q AS DOUBLE) AS q, round(least(1.0, coalesce(max(x.s), 0.0)), 9) AS power
FROM w LEFT JOIN (SELECT l_suppkey, sum(exp({_LOGP})) AS s FROM e GROUP BY 1) x ON x.l_suppkey = w.l_suppkey GROUP BY 1, 2"""


@REG.add("st2_tail_quantile", _TAILS)
def st2_tail_quantile(spark, folder):
    """The overlap that would be significant, and the chance to reach it if overlaps were a fifth likelier."""
    t = _overlaps(spark, folder)
    q = st.per_row(lambda n, k, m: float(sp.hypergeometric_quantile(0.95, int(n), int(k), int(m)) + 1), "double", *(F.col(c) for c in "nkm"))
    power = st.per_row(lambda q, n, k, m: sp.hypergeometric_tail(int(q), int(n), min(int(n), int(k * 1.2)), int(m)), "double", F.col("q"), *(F.col(c) for c in "nkm"))
    return t.withColumn("q", q).select("l_suppkey", "q", F.round(power, 9).alias("power"))


@REG.add("st13_adjusted", f"""WITH {_OVERLAP}, p AS (SELECT l_suppkey, least(1.0, sum(exp({_LOGP}))) AS p FROM (SELECT *, unnest(range(x, least(k, m) + 1)) AS i FROM t) GROUP BY l_suppkey),
r AS (SELECT *, rank() OVER (ORDER BY p DESC) AS a, count(*) OVER () AS n FROM (SELECT l_suppkey, round(p, 9) AS p FROM p)),
q AS (SELECT p, min(x) OVER (ORDER BY p DESC) AS q FROM (SELECT p, max(n - a + 1) AS rk, max(p * n / (n - a + 1)) AS x FROM r GROUP BY p))
SELECT r.l_suppkey, r.p, round(least(1.0, q.q), 8) AS p_adjusted FROM r JOIN q ON r.p = q.p""")
def st13_adjusted(spark, folder):
    t = _overlaps(spark, folder)
    p = t.select("l_suppkey", F.round(st.hypergeometric(F.col("x"), F.col("n"), F.col("k"), F.col("m")), 9).alias("p"))
    return st.adjusted(p, "p").select("l_suppkey", "p", F.round("p_adjusted", 8).alias("p_adjusted"))


_CELLS = f"WITH {PEAKS}, c AS (SELECT f.motif_id, count(*) FILTER (f.score >= 12) AS a, count(*) FILTER (f.score < 12) AS b FROM fimo f WHERE f.motif_id NOT LIKE '#%' AND f.score IS NOT NULL AND NOT isnan(f.score) GROUP BY 1), s AS (SELECT sum(a) AS a, sum(b) AS b FROM c)"


def _cells(spark, folder):
    f = table(spark, folder, "fimo").where("motif_id not like '#%' and score is not null and not isnan(score)")
    c = f.groupBy("motif_id").agg(F.count_if(F.col("score") >= 12).alias("a"), F.count_if(F.col("score") < 12).alias("b"))
    s = c.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))  # one row
    return c.join(s).select("motif_id", "a", "b", (F.col("sa") - F.col("a")).alias("c"), (F.col("sb") - F.col("b")).alias("d"))


_FISHER = f"""{_CELLS}, t AS (SELECT motif_id, c.a, c.b, CAST(s.a - c.a AS BIGINT) AS c, CAST(s.b - c.b AS BIGINT) AS d FROM c, s), g AS (SELECT *, a + b AS m, a + c AS k, a + b + c + d AS n FROM t),
l AS (SELECT motif_id, a, i, {_LOGP} AS l FROM (SELECT *, unnest(range(greatest(0, m + k - n), least(k, m) + 1)) AS i FROM g)), h AS (SELECT motif_id, l AS seen FROM l WHERE i = a)
SELECT l.motif_id, max(l.a) AS a, printf('%.5e', least(1.0, sum(exp(l)) FILTER (l <= seen + 1e-7))) AS p FROM l JOIN h ON l.motif_id = h.motif_id GROUP BY 1"""


@REG.add("st3_fisher_p", _FISHER)
def st3_fisher_p(spark, folder):
    """Two-sided exact p of each motif's strong hits against all others'."""
    t = _cells(spark, folder).where("a + b > 0 and c + d > 0 and a + c > 0 and b + d > 0")
    return t.select("motif_id", "a", _six(st.fisher(*(F.col(c) for c in "abcd"))[3]).alias("p"))


# what the conditional estimate and the interval's ends must satisfy, checked in SQL with the values that Spark found
_FISHER_FITS = "SELECT 0 AS n_bad_ratio, 0 AS n_bad_lower, 0 AS n_bad_upper"


@REG.add("st3_fisher_fits", _FISHER_FITS)
def st3_fisher_fits(spark, folder):
    """Motifs whose odds ratio doesn't make the seen count the expected one, or whose interval doesn't end where a tail has 2.5 %: none."""
    t = st3_fisher(spark, folder).where("odds_ratio > 0 and upper < double('inf') and lower > 0")
    rows = st.hypergeometric_logs(t.selectExpr("motif_id", "a", "odds_ratio", "lower", "upper", "a + b + c + d as n", "a + c as k", "a + b as m"), "a")

    def share(ratio, what):  # weights are 1 at the seen count, whose own probability may be too small for a double
        w = F.exp(F.col("l") + (F.col("i") - F.col("a")) * F.ln(ratio))
        return F.sum(w * what) / F.sum(w)

    seen = F.col("a").cast("double")
    g = rows.groupBy("motif_id").agg(
        F.max("a").alias("a"), share(F.col("odds_ratio"), F.col("i")).alias("mean"),
        share(F.col("lower"), (F.col("i") >= seen).cast("double")).alias("above"), share(F.col("upper"), (F.col("i") <= seen).cast("double")).alias("below"),
    )
    bad = lambda c, want: F.count_if(F.coalesce(F.abs(F.col(c) - want) > 1e-6, F.lit(True)))
    return g.agg(bad("mean", F.col("a")).cast("int").alias("n_bad_ratio"), bad("above", 0.025).cast("int").alias("n_bad_lower"), bad("below", 0.025).cast("int").alias("n_bad_upper"))


@REG.add("st3_fisher")
def st3_fisher(spark, folder):
    """Each motif's strong hits against all others': conditional odds ratio, interval, p (p and the rest are checked by st3_fisher_p and st3_fisher_fits)."""
    t = _cells(spark, folder).withColumn("f", st.fisher(*(F.col(c) for c in "abcd")))
    return t.select("motif_id", "a", "b", "c", "d", *(F.col("f")[i].alias(n) for i, n in enumerate(("odds_ratio", "lower", "upper", "p_value"))))


@REG.add("st3_sample_odds", f"{_CELLS} SELECT motif_id, round(c.a * (s.b - c.b) / nullif(c.b * (s.a - c.a), 0), 6) AS odds, round(ln((c.a + 0.5) / (c.b + 0.5)), 8) AS logit FROM c, s")
def st3_sample_odds(spark, folder):
    t = _cells(spark, folder)
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    return t.select("motif_id", F.round(st.sample_odds_ratio(a, b, c, d), 6).alias("odds"), F.round(st.log_odds(a, a + b, 0.5), 8).alias("logit"))


_TABLES = """WITH f AS (SELECT motif_id, strand, score >= 14 AS hi FROM fimo WHERE motif_id NOT LIKE '#%' AND score IS NOT NULL AND NOT isnan(score) AND strand IN ('+', '-', '.')),
t AS (SELECT motif_id, count(*) FILTER (strand = '+' AND hi) AS a, count(*) FILTER (strand = '-' AND hi) AS b, count(*) FILTER (strand = '.' AND hi) AS c, count(*) FILTER (strand = '+') AS r, count(*) FILTER (strand = '-') AS s, count(*) FILTER (strand = '.') AS u FROM f GROUP BY 1),
e AS (SELECT *, a + b + c AS k, unnest(range(0, least(r, a + b + c) + 1)) AS i FROM t), g AS (SELECT *, unnest(range(greatest(0, k - i - u), least(s, k - i) + 1)) AS j FROM e),
l AS (SELECT motif_id, i = a AND j = b AS seen, lgamma(r + 1.0) - lgamma(i + 1.0) - lgamma(r - i + 1.0) + lgamma(s + 1.0) - lgamma(j + 1.0) - lgamma(s - j + 1.0) + lgamma(u + 1.0) - lgamma(k - i - j + 1.0) - lgamma(u - (k - i - j) + 1.0)
  - lgamma(r + s + u + 1.0) + lgamma(k + 1.0) + lgamma(r + s + u - k + 1.0) AS l FROM g), h AS (SELECT motif_id, l AS at_seen FROM l WHERE seen)
SELECT l.motif_id, round(least(1.0, sum(exp(l)) FILTER (l <= at_seen + 1e-7)), 7) AS p_value FROM l JOIN h ON l.motif_id = h.motif_id GROUP BY 1"""


@REG.add("st4_fisher_table_p", _TABLES)
def st4_fisher_table_p(spark, folder):
    """The exact p of the tables of three rows alone."""
    return st4_fisher_table(spark, folder).select("motif_id", F.round("p_value", 7).alias("p_value"))


@REG.add("st4_fisher_table")
def st4_fisher_table(spark, folder):
    """Exact test of strand by strength per motif, for tables of three rows and two columns."""
    f = table(spark, folder, "fimo").where("motif_id not like '#%' and score is not null and not isnan(score) and strand in ('+', '-', '.')")
    cells = [F.count_if((F.col("strand") == s) & ((F.col("score") >= 14) if hi else (F.col("score") < 14))).alias(f"n{i}{hi:d}") for i, s in enumerate("+-.") for hi in (True, False)]
    t = f.groupBy("motif_id").agg(*cells).repartition(spark.sparkContext.defaultParallelism)  # few small rows, which one task would test otherwise
    names = [c for c in t.columns if c != "motif_id"]
    p = st.per_row(lambda *v: sp.fisher_table([[int(v[2 * i]), int(v[2 * i + 1])] for i in range(3)]), "double", *(F.col(c) for c in names))
    return t.select("motif_id", *names, p.alias("p_value"))


_SCORES = "f AS (SELECT *, strand = '+' AS one FROM fimo WHERE motif_id NOT LIKE '#%' AND score IS NOT NULL AND NOT isnan(score) AND strand IN ('+', '-'))"
_RANKS = f"""WITH {_SCORES}, r AS (SELECT motif_id, one, score, rank() OVER (PARTITION BY motif_id ORDER BY score) + (count(*) OVER (PARTITION BY motif_id, score) - 1) / 2.0 AS r FROM f),
t AS (SELECT motif_id, sum(n * n * n - n) AS ties FROM (SELECT motif_id, score, CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT motif_id, CAST(count(*) FILTER (one) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT one) AS DOUBLE) AS n2, sum(r) FILTER (one) AS rs FROM r GROUP BY 1),
u AS (SELECT g.motif_id, n1, n2, ties, rs - n1 * (n1 + 1) / 2 AS u FROM g JOIN t ON g.motif_id = t.motif_id WHERE n1 > 0 AND n2 > 0)"""


_WITH_Z = "(SELECT *, (u - n1 * n2 / 2 - 0.5 * sign(u - n1 * n2 / 2)) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u) u"


@REG.add("st5_st6_rank_sum", _RANKS + " SELECT motif_id, CAST(round(u, 3) AS DOUBLE) AS u, round((u - n1 * n2 / 2 - 0.5 * sign(u - n1 * n2 / 2)) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 7) AS z, round(u / (n1 * n2), 9) AS auroc FROM u".replace(" FROM u", ", round(least(1.0, 2 * area), 7) AS p_value FROM " + _area(_NORMAL, _WITH_Z, "u.*", "abs(z)", 40.0) + " u"))
def st5_st6_rank_sum(spark, folder):
    """Scores of the two strands, per motif: rank-sum test and AUROC."""
    f = table(spark, folder, "fimo").where("motif_id not like '#%' and strand in ('+', '-')")
    w = st.wilcoxon(st.rank_sums(f, "score", F.col("strand") == "+", ["motif_id"]).where("n1 > 0 and n2 > 0"))
    return w.select("motif_id", F.round("u", 3).alias("u"), F.round("z", 7).alias("z"), F.round("auroc", 9).alias("auroc"), F.round("p_value", 7).alias("p_value"))


@REG.add("st5_signed_rank")
def st5_signed_rank(spark, folder):
    """One-sample signed-rank tests of what each user did in a day, a group that doesn't grow with the table, against 10."""
    e = table(spark, folder, "events").where("value is not null").groupBy("user_id", F.dayofyear("ts").alias("day"))
    values = e.agg(F.sort_array(F.collect_list("value")).alias("v"))
    test = st.per_row(lambda v: list(st.signed_rank_exact(list(v), 10.0)), "array<double>", F.col("v"))
    return values.withColumn("t", test).select("user_id", "day", F.size("v").alias("n"), F.col("t")[0].alias("v"), F.col("t")[1].alias("p_value"))


@REG.add("st7_spearman", """WITH o AS (SELECT o_totalprice AS x, n AS y FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_totalprice IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM o),
c AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM r), t AS (SELECT n, rho, n - 2 AS v, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM c)
SELECT n, round(rho, 8) AS rho, round(2 * area, 7) AS p_value FROM """ + _area(_STUDENT, "t", "t.*", "t", 40.0))
def st7_spearman(spark, folder):
    n = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("y"))
    o = table(spark, folder, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_totalprice").alias("x"), "y")
    return st.spearman(o, "x", "y").select("n", F.round("rho", 8).alias("rho"), F.round("p_value", 7).alias("p_value"))


_BINOMIAL = """WITH c AS (SELECT motif_id, count(*) FILTER (strand = '+') AS x, count(*) AS n FROM fimo WHERE motif_id NOT LIKE '#%' AND strand IN ('+', '-') GROUP BY 1),
l AS (SELECT motif_id, x, n, i, lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0) AS l FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM c)), h AS (SELECT motif_id, l AS seen FROM l WHERE i = x)
SELECT l.motif_id, max(x) AS x, max(n) AS n, round(least(1.0, sum(exp(l)) FILTER (l <= seen + 1e-7)), 9) AS p_value FROM l JOIN h ON l.motif_id = h.motif_id GROUP BY 1"""


@REG.add("st8_binomial_p", _BINOMIAL)
def st8_binomial_p(spark, folder):
    """Exact two-sided p of each motif's strand balance."""
    return st8_binomial(spark, folder).select("motif_id", "x", "n", F.round("p_value", 9).alias("p_value"))


@REG.add("st8_binomial")
def st8_binomial(spark, folder):
    """Whether each motif's strong hits lie on one strand: exact p and interval of the share."""
    f = table(spark, folder, "fimo").where("motif_id not like '#%' and strand in ('+', '-')")
    n = f.groupBy("motif_id").agg(F.count_if(F.col("strand") == "+").alias("x"), F.count("*").alias("n"))
    p = st.per_row(lambda x, n: sp.binomial_test(int(x), int(n), 0.5), "double", F.col("x"), F.col("n"))
    ci = st.per_row(lambda x, n: list(sp.binomial_interval(int(x), int(n))), "array<double>", F.col("x"), F.col("n"))
    return n.withColumn("ci", ci).select("motif_id", "x", "n", p.alias("p_value"), F.col("ci")[0].alias("lower"), F.col("ci")[1].alias("upper"))


@REG.add("st9_chi_square", """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
e AS (SELECT x.a, y.b, x.r * y.c / (SELECT sum(o) FROM c) AS e FROM (SELECT a, sum(o) AS r FROM c GROUP BY 1) x, (SELECT b, sum(o) AS c FROM c GROUP BY 1) y),
x AS (SELECT sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS s, CAST((count(DISTINCT e.a) - 1) * (count(DISTINCT e.b) - 1) AS BIGINT) AS v FROM e LEFT JOIN c ON c.a = e.a AND c.b = e.b)
SELECT round(s, 6) AS statistic, v AS df, round(area, 7) AS p_value FROM """ + _area(_CHI2, "x", "x.*", "s", 200.0))
def st9_chi_square(spark, folder):
    return st.chi_square(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("statistic", 6).alias("statistic"), "df", F.round("p_value", 7).alias("p_value"))


@REG.add("st10_welch", "WITH s AS (SELECT count(x) FILTER (g) AS n1, count(x) FILTER (NOT g) AS n2, avg(x) FILTER (g) AS m1, avg(x) FILTER (NOT g) AS m2, var_samp(x) FILTER (g) AS v1, var_samp(x) FILTER (NOT g) AS v2 FROM (SELECT l_extendedprice AS x, l_returnflag = 'R' AS g FROM lineitem)) SELECT n1, n2, round(t, 7) AS t, round(v, 3) AS df, round(2 * area, 7) AS p_value FROM " + _area(_STUDENT, "(SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS v FROM s) s", "s.*", "abs(t)", 40.0))
def st10_welch(spark, folder):
    w = st.welch(table(spark, folder, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R")
    return w.select("n1", "n2", F.round("t", 7).alias("t"), F.round("df", 3).alias("df"), F.round("p_value", 7).alias("p_value"))


# lineitems of orders that have exactly six, with all choices of three of them
_SIX = """WITH six AS (SELECT l_orderkey, list(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS v FROM lineitem GROUP BY 1 HAVING count(*) = 6 AND count(l_extendedprice) = 6),
pick AS (SELECT a.i AS a, b.i AS b, c.i AS c FROM range(1, 7) a(i), range(1, 7) b(i), range(1, 7) c(i) WHERE a.i < b.i AND b.i < c.i)"""
_SPLITS = _SIX + """, d AS (SELECT l_orderkey, abs((v[a] + v[b] + v[c]) / 3 - (list_sum(v) - v[a] - v[b] - v[c]) / 3) AS d, a = 1 AND b = 2 AND c = 3 AS seen FROM six, pick),
s AS (SELECT l_orderkey, d AS s FROM d WHERE seen)
SELECT d.l_orderkey, round(avg(CASE WHEN d >= s - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM d JOIN s ON d.l_orderkey = s.l_orderkey GROUP BY 1"""
_EXACT_SUM = _SIX + """, law AS (SELECT a + b + c - 6 AS u, count(*) / 20.0 AS p FROM pick GROUP BY 1), line AS (SELECT l_orderkey, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM six),
r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY x) AS r, count(*) OVER (PARTITION BY l_orderkey, x) AS t FROM line), w AS (SELECT l_orderkey, sum(r) FILTER (i <= 3) - 6 AS u FROM r GROUP BY 1 HAVING max(t) = 1)
SELECT l_orderkey, CAST(w.u AS DOUBLE) AS u, round(least(1.0, 2 * least(sum(p) FILTER (law.u <= w.u), sum(p) FILTER (law.u >= w.u))), 9) AS p_exact FROM w, law GROUP BY 1, 2, w.u"""
_SIGNS = _SIX.replace("l_extendedprice ORDER BY l_linenumber, l_extendedprice", "l_extendedprice - 1500 * l_quantity ORDER BY l_linenumber, l_extendedprice").replace("count(l_extendedprice) = 6", "count(l_extendedprice) = 6 AND count(l_quantity) = 6") + """,
line AS (SELECT l_orderkey, unnest(v) AS d, generate_subscripts(v, 1) AS i FROM six), r AS (SELECT l_orderkey, d, rank() OVER (PARTITION BY l_orderkey ORDER BY abs(d)) AS r, count(*) OVER (PARTITION BY l_orderkey, abs(d)) AS t FROM line),
w AS (SELECT l_orderkey, coalesce(sum(r) FILTER (d > 0), 0) AS v FROM r GROUP BY 1 HAVING max(t) = 1 AND min(abs(d)) > 0),
law AS (SELECT m AS mask, sum(CASE WHEN (m >> (k - 1)) & 1 = 1 THEN k ELSE 0 END) AS v FROM range(0, 64) a(m), range(1, 7) b(k) GROUP BY 1)
SELECT l_orderkey, CAST(w.v AS DOUBLE) AS v, round(least(1.0, 2 * least(count(*) FILTER (law.v <= w.v) / 64, count(*) FILTER (law.v >= w.v) / 64)), 9) AS p_value FROM w, law GROUP BY 1, 2, w.v"""


def _six_lines(spark, folder, *columns):
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.struct("l_linenumber", *columns).alias("x"))
    six = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("x")).alias("v")).where("n = 6")
    return six.where(F.forall("v", lambda x: F.lit(True) if not columns else x[columns[0]].isNotNull() & x[columns[-1]].isNotNull()))


@REG.add("st5_exact_rank_sum", _EXACT_SUM)
def st5_exact_rank_sum(spark, folder):
    """Exact rank-sum test of the first three lines of each order of six against the others, where no prices are equal."""
    rows = _six_lines(spark, folder, "l_extendedprice").select("l_orderkey", F.posexplode("v").alias("i", "x"))
    w = st.wilcoxon(st.rank_sums(rows.select("l_orderkey", F.col("x.l_extendedprice").alias("x"), "i"), "x", F.col("i") < 3, ["l_orderkey"]))
    return w.where("ties = 0").select("l_orderkey", "u", F.round("p_exact", 9).alias("p_exact"))


@REG.add("st5_paired", _SIGNS)
def st5_paired(spark, folder):
    """Paired signed-rank test of the six prices of an order against 1,500 a piece, where no two differences have one size."""
    six = _six_lines(spark, folder, "l_extendedprice", "l_quantity")
    price, quantity = F.transform("v", lambda x: x["l_extendedprice"]), F.transform("v", lambda x: x["l_quantity"] * 1500)
    gaps = F.transform("v", lambda x: F.abs(x["l_extendedprice"] - x["l_quantity"] * 1500))
    six = six.where((F.size(F.array_distinct(gaps)) == 6) & (F.array_min(gaps) > 0))
    t = st.per_row(lambda a, b: list(st.signed_rank_paired(list(a), list(b))), "array<double>", price, quantity)
    return six.withColumn("t", t).select("l_orderkey", F.col("t")[0].alias("v"), F.round(F.col("t")[1], 9).alias("p_value"))


@REG.add("st10_exact_splits", _SPLITS)
def st10_exact_splits(spark, folder):
    """Exhaustive split test of three against three: lineitems of each order that has exactly six."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    six = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("v")).where("n = 6")
    flat = F.transform("v", lambda x: x["l_extendedprice"])
    p = st.per_row(lambda v: st.exact_split_p(list(v[:3]), list(v[3:])) if len(v) == 6 and all(x is not None and x == x for x in v) else None, "double", flat)
    return six.select("l_orderkey", F.round(p, 6).alias("p_value")).where("p_value is not null")


@REG.add("st11_simple_line", "SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1")
def st11_simple_line(spark, folder):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 8).alias("r2"))


def _uphill(spark, folder, model, link, y):
    """How far the sums that a fit makes zero are from zero, relative to what they are made of: terms where they are not."""
    line = table(spark, folder, "lineitem").where("l_quantity is not null and l_discount is not null and l_tax is not null and l_extendedprice is not null and l_returnflag is not null")
    b = {r["term"]: r["estimate"] for r in model.collect()}
    cols = {"(intercept)": F.lit(1.0), "quantity": F.col("l_quantity"), "discount": F.col("l_discount"), "tax": F.col("l_tax")}
    eta = sum((F.lit(v) * cols[t] for t, v in b.items()), F.lit(0.0))
    gap = y - link(eta)
    sums = line.agg(*(F.abs(F.sum(cols[t] * gap) / F.sum(F.abs(cols[t] * y))).alias(str(i)) for i, t in enumerate(b)))
    bad = sum(((F.col(str(i)) > 1e-7).cast("int") for i in range(len(b))), F.lit(0))
    return sums.select(F.lit(len(b)).alias("n_terms"), bad.alias("n_bad"))


@REG.add("st11_fits", "SELECT 4 AS n_terms, 0 AS n_bad")
def st11_fits(spark, folder):
    """Residuals of the linear model are at right angles to every predictor."""
    return _uphill(spark, folder, st11_linear_model(spark, folder), lambda eta: eta, F.col("l_extendedprice"))


@REG.add("st12_fits", "SELECT 3 AS n_terms, 0 AS n_bad")
def st12_fits(spark, folder):
    """The logistic model's likelihood has no slope left in any term."""
    return _uphill(spark, folder, st12_logistic(spark, folder), lambda eta: 1 / (1 + F.exp(-eta)), (F.col("l_returnflag") == "R").cast("double"))


@REG.add("st11_linear_model")
def st11_linear_model(spark, folder):
    """Price by quantity, discount and tax: errors, robust errors, inflation factors; the nested F test of the last two."""
    line = table(spark, folder, "lineitem")
    y = F.col("l_extendedprice")
    xs = {"quantity": F.col("l_quantity"), "discount": F.col("l_discount"), "tax": F.col("l_tax")}
    large, small = st.linear_model(line, y, xs), st.linear_model(line, y, {"quantity": xs["quantity"]})
    f, p = st.nested_f(small, large)
    large["model_r2"], large["nested_f"], large["nested_p"] = large.attrs["r2"], f, p
    return st.to_rows(spark, large, "term string, estimate double, std_error double, t double, p_value double, hc3_error double, vif double, model_r2 double, nested_f double, nested_p double")


@REG.add("st12_logistic")
def st12_logistic(spark, folder):
    """Returned or not by quantity and discount, on grouped counts; the ratio test of the second predictor."""
    line = table(spark, folder, "lineitem").where("l_quantity is not null and l_discount is not null")
    counts = line.groupBy("l_quantity", "l_discount").agg(F.count_if(F.col("l_returnflag") == "R").alias("y"), F.count("*").alias("n"))
    large = st.logistic_model(counts, "y", "n", {"quantity": "l_quantity", "discount": "l_discount"})
    small = st.logistic_model(counts, "y", "n", {"quantity": "l_quantity"})
    x, p = st.likelihood_ratio(small, large)
    large["ratio_statistic"], large["ratio_p"] = x, p
    return st.to_rows(spark, large, "term string, estimate double, std_error double, z double, p_value double, odds_ratio double, lower double, upper double, ratio_statistic double, ratio_p double")


@REG.add("st14_moderated_t")
def st14_moderated_t(spark, folder):
    """Each part's mean log price against 10, with shrunken variances."""
    x = F.log("l_extendedprice") - 10.0
    probes = table(spark, folder, "lineitem").where("l_extendedprice > 0").groupBy("l_partkey").agg(F.avg(x).alias("mean"), F.var_samp(x).alias("s2"), F.count("*").alias("n"))
    usable = probes.where("n >= 2 and s2 > 0").withColumn("df", F.col("n") - 1)
    return st.moderated_t(usable, "mean", "s2", "df", "n").select("l_partkey", "mean", "s2", "t", "p_value")


@REG.add("st15_length_adjusted")
def st15_length_adjusted(spark, folder):
    """Whether peaks with a strong hit are more frequent among plus-strand ones, with the peak's length as covariate."""
    strong = hits(spark, folder).where("hit_score >= 12 and not isnan(hit_score)").select("name").distinct().withColumn("strong", F.lit(1))
    p = peaks(spark, folder).join(strong, "name", "left")
    rows = p.select(F.round(F.log("chrom_end") - F.log("chrom_start"), 4).alias("x0"), F.round(F.log(F.col("chrom_end") - F.col("chrom_start")), 1).alias("length"), (F.coalesce("strand", F.lit(".")) == "+").cast("double").alias("member"), F.coalesce("strong", F.lit(0)).alias("strong"))
    counts = rows.where("length is not null").groupBy("length", "member").agg(F.sum("strong").alias("y"), F.count("*").alias("n"))
    model = st.logistic_model(counts, "y", "n", {"member": "member", "length": "length"})
    return st.to_rows(spark, model, "term string, estimate double, std_error double, z double, p_value double, odds_ratio double, lower double, upper double")


_OVER = f"""WITH {HITS}, u AS (SELECT count(DISTINCT name) AS n FROM peak), pick AS (SELECT DISTINCT name FROM hit WHERE hit_score >= 14 AND NOT isnan(hit_score)),
t AS (SELECT motif_id, count(DISTINCT name) AS k, count(DISTINCT CASE WHEN name IN (SELECT name FROM pick) THEN name END) AS x FROM hit WHERE motif_id NOT LIKE '#%' GROUP BY 1),
v AS (SELECT t.*, u.n, (SELECT count(*) FROM pick) AS m FROM t, u)
SELECT motif_id, k, x, printf('%.5e', least(1.0, sum(exp({_LOGP})))) AS p FROM (SELECT *, unnest(range(x, least(k, m) + 1)) AS i FROM v) GROUP BY motif_id, k, x"""


@REG.add("st16_over_representation", _OVER)
def st16_over_representation(spark, folder):
    """Terms (motifs) of picked peaks against all peaks: overlap tails per term."""
    h = hits(spark, folder)
    pick = h.where("hit_score >= 14 and not isnan(hit_score)").select("name").distinct().withColumn("picked", F.lit(1))
    t = h.where("motif_id not like '#%'").select("motif_id", "name").distinct().join(pick, "name", "left").groupBy("motif_id").agg(F.count("*").alias("k"), F.count("picked").alias("x"))
    n = peaks(spark, folder).agg(F.count_distinct("name").alias("n"))  # one row each
    t = t.join(n).join(pick.agg(F.count("*").alias("m")))
    return t.select("motif_id", "k", "x", _six(st.hypergeometric(F.col("x"), F.col("n"), F.col("k"), F.col("m"))).alias("p"))


_ODDS = f"""WITH {HITS}, d AS (SELECT abs((h.s + h.e) // 2 - (p.chrom_start + p.chrom_end) // 2) AS d FROM hit h JOIN peak p ON h.name = p.name)
SELECT count(*) AS n, count(*) FILTER (d <= 25) AS core, count(*) FILTER (d > 50 AND d <= 100) AS ring, round((count(*) FILTER (d <= 25) / 51.0) / nullif(count(*) FILTER (d > 50 AND d <= 100) / 100.0, 0), 8) AS odds FROM d"""


@REG.add("st18_annulus", _ODDS)
def st18_annulus(spark, folder):
    """Hits near the middle of their peak against a ring round it, per position."""
    p = peaks(spark, folder).select("name", F.floor((F.col("chrom_start") + F.col("chrom_end")) / 2).alias("mid"))
    d = hits(spark, folder).join(p, "name").select(F.abs(F.floor((F.col("s") + F.col("e")) / 2) - F.col("mid")).alias("d"))
    core, ring = F.count_if(F.col("d") <= 25), F.count_if((F.col("d") > 50) & (F.col("d") <= 100))
    return d.agg(F.count("*").alias("n"), core.alias("core"), ring.alias("ring"), F.round((core / 51.0) / F.nullif(ring / 100.0, F.lit(0.0)), 8).alias("odds"))


_DETECT = f"""{_CELLS.replace('WITH ', 'WITH RECURSIVE ')}, t AS (SELECT motif_id, c.a AS a, c.b AS b, s.a - c.a AS c, s.b - c.b AS d FROM c, s), r AS (SELECT motif_id, c / (c + d) AS p, CAST(c + d AS DOUBLE) AS n1, CAST(a + b AS DOUBLE) AS n2 FROM t WHERE a + b > 1 AND c + d > 1 AND c > 0 AND d > 0),
step AS (SELECT motif_id, p, n1, n2, p AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS k FROM r UNION ALL SELECT motif_id, p, n1, n2, CASE WHEN short THEN mid ELSE lo END, CASE WHEN short THEN hi ELSE mid END, k + 1 FROM (
  SELECT *, (lo + hi) / 2 AS mid, (lo + hi) / 2 - p < 1.959963984540054 * sqrt((n1 * p + n2 * (lo + hi) / 2) / (n1 + n2) * (1 - (n1 * p + n2 * (lo + hi) / 2) / (n1 + n2)) * (1 / n1 + 1 / n2))
    + 0.8416212335729143 * sqrt(p * (1 - p) / n1 + (lo + hi) / 2 * (1 - (lo + hi) / 2) / n2) AS short FROM step WHERE k < 60))
SELECT motif_id, round(p, 9) AS share, round((lo + hi) / 2, 6) AS detectable_share, round(0.5 + 2.8015852181129683 / sqrt(12 * n1 / (n1 + n2) * (1 - n1 / (n1 + n2)) * (n1 + n2)), 6) AS detectable_auc FROM step WHERE k = 60"""


@REG.add("st19_detectable", _DETECT)
def st19_detectable(spark, folder):
    """What differences each motif's number of hits would show."""
    t = _cells(spark, folder).where("a + b > 1 and c + d > 1 and c > 0 and d > 0")
    share = F.col("c") / (F.col("c") + F.col("d"))
    n1, n2 = F.col("c") + F.col("d"), F.col("a") + F.col("b")
    diff = st.per_row(lambda p, x, y: st.detectable_difference(float(p), int(x), int(y)), "double", share, n1, n2)
    auc = st.per_row(lambda x, y: st.detectable_auc(int(x), int(y)), "double", n1, n2)
    return t.select("motif_id", F.round(share, 9).alias("share"), F.round(diff, 6).alias("detectable_share"), F.round(auc, 6).alias("detectable_auc"))


@REG.add("st22_ratio_check", "SELECT user_id, round(greatest(a, b) / nullif(least(a, b), 0), 8) AS ratio, greatest(a, b) <= 2 * least(a, b) AS pass FROM (SELECT user_id, CAST(count(*) FILTER (event_id % 2 = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (event_id % 2 = 1) AS DOUBLE) AS b FROM events GROUP BY 1)")
def st22_ratio_check(spark, folder):
    n = table(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") % 2 == 0).cast("double").alias("a"), F.count_if(F.col("event_id") % 2 == 1).cast("double").alias("b"))
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    return n.select("user_id", F.round(hi / F.nullif(lo, F.lit(0.0)), 8).alias("ratio"), (hi <= 2 * lo).alias("pass"))


@REG.add("st23_did", "SELECT c_mktsegment, round((avg(p) FILTER (t AND a) - avg(p) FILTER (t AND NOT a)) - (avg(p) FILTER (NOT t AND a) - avg(p) FILTER (NOT t AND NOT a)), 4) AS did FROM (SELECT c_mktsegment, o_totalprice AS p, o_orderpriority < '3' AS t, year(o_orderdate) >= 1998 AS a FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1")
def st23_did(spark, folder):
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = st.difference_in_differences(o, ["c_mktsegment"], F.col("o_orderpriority") < "3", F.year("o_orderdate") >= 1998, "o_totalprice")
    return d.select("c_mktsegment", F.round("did", 4).alias("did"))


@REG.add("st24_monte_carlo", "SELECT motif_id, n, round(1.0 / (n + 1), 9) AS floor, round(sqrt(0.05 * 0.95 / n), 9) AS error FROM (SELECT motif_id, count(*) AS n FROM fimo GROUP BY 1)")
def st24_monte_carlo(spark, folder):
    n = table(spark, folder, "fimo").groupBy("motif_id").agg(F.count("*").alias("n"))
    return n.select("motif_id", "n", F.round(1.0 / (F.col("n") + 1), 9).alias("floor"), F.round(F.sqrt(0.05 * 0.95 / F.col("n")), 9).alias("error"))


QUERIES, SQL = REG.queries, REG.sql
