"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.components import connected_groups
from strandloom.llm.mixing import mix_report, mix_sources
from strandloom.llm.packing import fill_containers, fill_report
from strandloom.llm.similar_sets import set_classes, similar_classes, similar_pairs
from strandloom.llm.tokens import with_token_counts
from strandloom.llm.top_items import top_items
from strandloom.llm.truncation import strict_prefixes, truncated, truncation_rates
from strandloom.operators.packed import split_packed
from strandloom.plans.packed_and_intervals import _GENES
from strandloom.session import materialize, table

THRESHOLD = 0.7
Q_VALUE = 0.05
SEED = 20260801


def geneset_genes(spark: SparkSession, folder: str) -> DataFrame:
    """(geneset_id, gene) of the packed lists."""
    rows = table(spark, folder, "chipenrich_dys_tgo_gobp").where("geneset_id is not null").select("geneset_id", "geneset_peak_genes")
    return split_packed(rows, "geneset_peak_genes", ["geneset_id"], "pos", "gene")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of gene sets with at least 0.7 of their genes in common."""
    return similar_pairs(geneset_genes(spark, folder), "geneset_id", "gene", THRESHOLD)


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each gene set with the class of its equal sets and the number of similar other sets: one row a set."""
    classes, members = set_classes(geneset_genes(spark, folder), "geneset_id", "gene")
    links = materialize(similar_classes(classes, THRESHOLD))
    sizes = classes.select("class_id", "n_records", "n_values")
    ends = links.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(links.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))
    linked = ends.join(sizes.select(F.col("class_id").alias("other"), "n_records"), "other").groupBy("class_id").agg(F.sum("n_records").alias("n"))
    per_class = sizes.join(linked, "class_id", "left").select("class_id", "n_values", (F.coalesce("n", F.lit(0)) + F.col("n_records") - 1).alias("n_links"))
    return members.join(per_class, "class_id").select("geneset_id", F.col("n_values").alias("n_genes"), "n_links")


def motif_links(spark: SparkSession, folder: str) -> DataFrame:
    """(u, v): significant comparisons of two motifs, ids without surrounding blanks."""
    rows = table(spark, folder, "tomtom").where(F.col("q_value") <= Q_VALUE)
    bare = [F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "").alias(k) for c, k in (("query_id", "u"), ("target_id", "v"))]
    return rows.select(*bare).where("u <> '' and v <> '' and u <> v and not startswith(u, '#')")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every linked motif with the smallest motif of its group."""
    return connected_groups(motif_links(spark, folder), "u", "v", "motif_id", "group_id")


def p3_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of linked motifs and their sizes."""
    return p3_found(spark, folder).groupBy("group_id").agg(F.count("*").alias("n_motifs"))


def p4_items(spark: SparkSession, folder: str, watch: dict | None = None) -> DataFrame:
    """The three best hits of every sequence; ``watch`` gets the row groups read and skipped."""
    # the rank of a strand in the order + - . null; other marks come between . and null
    strand = F.when(F.col("strand") == "+", 0).when(F.col("strand") == "-", 1).when(F.col("strand") == ".", 2).when(F.col("strand").isNotNull(), 3)
    hits = table(spark, folder, "fimo").select("hit_id", "motif_id", "sequence_name", "start", "stop", "strand", "score", "p_value", strand.alias("strand_rank"))
    order = [("p_value", True), ("start", True), ("strand_rank", True)]
    return top_items(hits, "sequence_name", "score", "hit_id", ["motif_id", "start", "stop", "strand", "p_value"], order, 3, "hit_rank", watch=watch)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three best hits of every sequence."""
    return p4_items(spark, folder)


def sized_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents, counted once."""
    return materialize(with_token_counts(table(spark, folder, "documents"), "text", ["doc_id", "source"]))


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or piece of a document that exceeds the capacity, in its container of each kind."""
    return fill_containers(sized_documents(spark, folder), "doc_id", "n_tokens", table(spark, folder, "pack_capacity"), "container_kind", "capacity_tokens")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each kind are."""
    return fill_report(sized_documents(spark, folder), "doc_id", "n_tokens", table(spark, folder, "pack_capacity"), "container_kind", "capacity_tokens")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixed documents: each copy of each, with its source and size."""
    return mix_sources(sized_documents(spark, folder), "doc_id", "source", "n_tokens", table(spark, folder, "mix_target"), seed=SEED)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of each source."""
    return mix_report(sized_documents(spark, folder), "doc_id", "source", "n_tokens", table(spark, folder, "mix_target"), seed=SEED)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncated(table(spark, folder, "documents"), "doc_id", "text").select("doc_id")


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The share of cut documents in each source."""
    return truncation_rates(table(spark, folder, "documents"), "doc_id", "text", "source")


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What a packing must keep, per kind: items, and how many of its rules are broken: items twice or in part, containers too full, gaps or overlaps inside, slack."""
    rows = materialize(p6_pack(spark, folder))
    caps = table(spark, folder, "pack_capacity").groupBy("container_kind").agg(F.max("capacity_tokens").alias("cap"))
    items = rows.groupBy("container_kind", "doc_id").agg(F.count("*").alias("n"), F.max("n_pieces").alias("want"), F.count_distinct("piece_no").alias("pieces"))
    whole = items.groupBy("container_kind").agg(F.count("*").alias("n_docs"), F.count_if((F.col("n") != F.col("want")) | (F.col("pieces") != F.col("want"))).alias("n_broken"))
    boxes = rows.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"), F.count("*").alias("n"), (F.max("place") + 1).alias("places"))
    boxes = boxes.join(F.broadcast(caps), "container_kind")  # a row a kind
    full = boxes.groupBy("container_kind").agg(
        F.count_if(F.col("used") > F.col("cap")).alias("n_overfull"), F.count_if((F.col("end") != F.col("used")) | (F.col("n") != F.col("places"))).alias("n_gaps"),
        (F.sum("used") / F.sum("cap") < 0.95).alias("slack"), F.count("*").alias("n_boxes"),
    )
    # a handful of containers may be half empty whatever the method
    return whole.join(full, "container_kind").select("container_kind", "n_docs", "n_broken", "n_overfull", "n_gaps", (F.col("slack") & (F.col("n_boxes") > 200)).alias("wastes"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix must keep, per source with a target: its documents, and whether copies exceed the cap or steps of the rate, and shares miss the aimed ones."""
    report = p7_shares(spark, folder)
    off = F.abs(F.coalesce("actual_share", F.lit(0.0)) - F.coalesce("aimed_share", F.lit(0.0))) * F.sum("mixed_tokens").over(W.partitionBy()) > 50_000
    found = report.where("target_share is not null")  # a row a row of the targets
    return found.select("source", "target_share", "n_items", (F.col("most_repeats") > F.col("max_repeats")).alias("over_cap"), off.alias("misses"))


def p8_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are strict prefixes of longer ones, whatever stands behind the cut."""
    return strict_prefixes(table(spark, folder, "documents"), "doc_id", "text").select("doc_id")


def p8_counted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that the share of cut ones in each source is taken of."""
    return p8_sources(spark, folder).select("source", "n_texts")


QUERIES = {
    "p1_found": p1_found, "p1_classes": p1_classes, "p3_found": p3_found, "p3_sizes": p3_sizes, "p4_found": p4_found,
    "p6_pack": p6_pack, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_sources": p8_sources,
    "p6_checks": p6_checks, "p7_checks": p7_checks, "p8_prefixes": p8_prefixes, "p8_counted": p8_counted,
}

_SETS = (
    _GENES
    + """, member AS (
  SELECT DISTINCT t.geneset_id, g.gene_value FROM gene g JOIN chipenrich_dys_tgo_gobp t ON g.row_id = t.row_id
  WHERE g.source_table = 'chipenrich_dys_tgo_gobp' AND t.geneset_id IS NOT NULL
), sized AS (
  SELECT geneset_id, count(*) AS n FROM member GROUP BY geneset_id
), pair AS (
  SELECT a.geneset_id AS a, b.geneset_id AS b, count(*) AS o FROM member a JOIN member b ON a.gene_value = b.gene_value AND a.geneset_id < b.geneset_id GROUP BY 1, 2
), close_pair AS (
  SELECT p.a, p.b FROM pair p JOIN sized x ON p.a = x.geneset_id JOIN sized y ON p.b = y.geneset_id WHERE p.o >= 0.7 * (x.n + y.n - p.o) - 1e-9
)
"""
)

_GROUPS = """
WITH RECURSIVE link AS (
  SELECT DISTINCT u, v FROM (SELECT regexp_replace(query_id, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g') AS u, regexp_replace(target_id, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g') AS v
    FROM tomtom WHERE q_value <= 0.05 AND NOT isnan(q_value)) WHERE u <> '' AND v <> '' AND u <> v AND u NOT LIKE '#%'
), both_ways AS (
  SELECT u, v FROM link UNION SELECT v, u FROM link
), reached AS (
  SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reached r JOIN both_ways b ON r.v = b.u
), grouped AS (
  SELECT u AS motif_id, min(least(u, v)) AS group_id FROM reached GROUP BY u
)
"""

#: What may stand behind a cut, for an engine without look-arounds, taken off as often as it can stand there.
_CUT = "regexp_replace(regexp_replace({0}, '(\\w)[-\\x{{2013}}\\x{{2014}}]+$', '\\1'), '([\\s\\x{{00a0}}\\x{{0085}}\\x{{2028}}\\x{{2029}}\\x{{200b}}\\x{{feff}}\\x{{2026}}\\x{{fffd}}]|\\.\\.+|\\[(\\x{{2026}}|\\.\\.\\.)\\]|\\((\\x{{2026}}|\\.\\.\\.)\\)|</?[A-Za-z][^<>]{{0,80}}>)+$', '')"
_CORE = _CUT.format(_CUT.format(_CUT.format(_CUT.format("text"))))

SQL = {
    "p6_checks": """SELECT container_kind, count(*) AS n_docs, 0 AS n_broken, 0 AS n_overfull, 0 AS n_gaps, false AS wastes FROM documents, (SELECT DISTINCT container_kind FROM pack_capacity WHERE capacity_tokens > 0)
WHERE text IS NOT NULL AND text <> '' GROUP BY 1""",
    "p7_checks": """SELECT t.source, t.target_share, count(d.doc_id) AS n_items, false AS over_cap, false AS misses FROM (SELECT source, max(target_share) AS target_share FROM mix_target WHERE source IS NOT NULL GROUP BY 1) t
LEFT JOIN documents d ON d.source = t.source GROUP BY 1, 2""",
    "p8_prefixes": f"""WITH c AS (SELECT doc_id, {_CORE} AS core FROM documents WHERE text IS NOT NULL), one AS (SELECT DISTINCT core FROM c WHERE core <> '')
SELECT doc_id FROM c WHERE core IN (SELECT a.core FROM one a JOIN one b ON length(b.core) > length(a.core) AND starts_with(b.core, a.core))""",
    "p8_counted": "SELECT source, count(*) AS n_texts FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1",
    "p1_found": _SETS + "SELECT a AS geneset_id_a, b AS geneset_id_b FROM close_pair",
    "p1_classes": _SETS
    + """SELECT s.geneset_id, s.n AS n_genes, count(l.a) AS n_links FROM sized s
LEFT JOIN (SELECT a, b FROM close_pair UNION ALL SELECT b, a FROM close_pair) l ON l.a = s.geneset_id GROUP BY s.geneset_id, s.n""",
    "p3_found": _GROUPS + "SELECT motif_id, group_id FROM grouped",
    "p3_sizes": _GROUPS + "SELECT group_id, count(*) AS n_motifs FROM grouped GROUP BY group_id",
    "p4_found": """
WITH item AS (
  SELECT motif_id, sequence_name, "start", "stop", strand, score, p_value, min(hit_id) AS hit_id FROM fimo
  WHERE sequence_name IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL
), ranked AS (
  SELECT sequence_name, hit_id, CAST(row_number() OVER (PARTITION BY sequence_name ORDER BY score DESC, p_value ASC NULLS LAST, "start" ASC NULLS LAST,
    CASE WHEN strand = '+' THEN 0 WHEN strand = '-' THEN 1 WHEN strand = '.' THEN 2 WHEN strand IS NOT NULL THEN 3 ELSE 4 END, hit_id) AS INTEGER) AS hit_rank FROM item
)
SELECT sequence_name, hit_rank, hit_id FROM ranked WHERE hit_rank <= 3""",
}
