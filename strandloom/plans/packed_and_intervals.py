"""Queries on packed gene lists (problem 2) and on hit intervals (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.islands import blocks_and_gaps
from strandloom.operators.packed import split_packed
from strandloom.session import materialize, table

GENE_TABLES = ("chipenrich_dys_tgo_gobp", "chipenrich_ch3_custom_fet")


def gene_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The packed lists of both enrichment tables."""
    one, two = (table(spark, folder, t).select(F.lit(t).alias("source_table"), "row_id", "geneset_peak_genes") for t in GENE_TABLES)
    return one.unionByName(two)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every gene of every row of both enrichment tables, with its position."""
    return split_packed(gene_fields(spark, folder), "geneset_peak_genes", ["source_table", "row_id"], "value_pos", "gene_value")


def p2_dialects(spark: SparkSession, folder: str) -> DataFrame:
    """How many fields and genes each chosen dialect covers, per table: separators, quote marks, wrapper."""
    genes = split_packed(gene_fields(spark, folder), "geneset_peak_genes", ["source_table", "row_id"], "value_pos", "gene_value", "dialect")
    return genes.groupBy("source_table", "dialect").agg(F.count(F.when(F.col("value_pos") == 1, 1)).alias("n_fields"), F.count("*").alias("n_genes"))


def hit_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the motif scans that are intervals: a name, both positions and a known strand."""
    hits = table(spark, folder, "fimo").select("sequence_name", "strand", "start", "stop")
    return hits.where("sequence_name is not null and start is not null and stop is not null and strand in ('+', '-')")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous blocks of hits per sequence and strand, and the gaps of at most 10,000 positions between them."""
    return blocks_and_gaps(hit_intervals(spark, folder), ["sequence_name", "strand"], "start", "stop", max_gap=10_000)


def p5_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per sequence and strand: blocks, covered positions, gaps and positions in gaps of any length."""
    pieces = materialize(blocks_and_gaps(hit_intervals(spark, folder), ["sequence_name", "strand"], "start", "stop"))
    length = F.col("to_pos") - F.col("from_pos") + 1
    block, gap = F.col("piece") == "block", F.col("piece") == "gap"
    return pieces.groupBy("sequence_name", "strand").agg(
        F.count(F.when(block, 1)).alias("n_blocks"), F.sum(F.when(block, length)).alias("covered"),
        F.count(F.when(gap, 1)).alias("n_gaps"), F.coalesce(F.sum(F.when(gap, length)), F.lit(0)).alias("uncovered"),
    )


QUERIES = {"p2_found": p2_found, "p2_dialects": p2_dialects, "p5_found": p5_found, "p5_coverage": p5_coverage}

_GENES = r"""
WITH field AS (
  SELECT 'chipenrich_dys_tgo_gobp' AS source_table, row_id, geneset_peak_genes AS g FROM chipenrich_dys_tgo_gobp
  UNION ALL
  SELECT 'chipenrich_ch3_custom_fet', row_id, geneset_peak_genes FROM chipenrich_ch3_custom_fet
), inside AS (
  SELECT source_table, row_id,
    CASE WHEN regexp_matches(g, '^\s*[A-Za-z_.]*\(') AND regexp_matches(g, '\)\s*$')
         THEN regexp_replace(regexp_replace(g, '^\s*[A-Za-z_.]*\(', ''), '\)\s*$', '') ELSE g END AS g
  FROM field
), mark AS (
  SELECT source_table, row_id, regexp_extract_all(g, '"(?:[^"]|"")*"|''[^'']*''|[\p{L}\p{N}():\-]+') AS m FROM inside
), piece AS (
  SELECT source_table, row_id, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM mark
), value AS (
  SELECT source_table, row_id, i,
    CASE WHEN v[1] = '"' THEN replace(v[2:-2], '""', '"') WHEN v[1] = '''' THEN v[2:-2] ELSE v END AS gene_value
  FROM piece
), gene AS (
  SELECT source_table, row_id, CAST(row_number() OVER (PARTITION BY source_table, row_id ORDER BY i) AS INTEGER) AS value_pos, gene_value
  FROM value WHERE gene_value NOT IN ('NA', 'null', '-', '')
)
"""

_BLOCKS = """
WITH hit AS (
  SELECT sequence_name, strand, CAST(least("start", "stop") AS BIGINT) AS s, CAST(greatest("start", "stop") AS BIGINT) AS e
  FROM fimo WHERE sequence_name IS NOT NULL AND "start" IS NOT NULL AND "stop" IS NOT NULL AND strand IN ('+', '-')
), prior AS (
  SELECT *, max(e) OVER (PARTITION BY sequence_name, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM hit
), labelled AS (
  SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_name, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM prior
), block AS (
  SELECT sequence_name, strand, k, min(s) AS f, max(e) AS t FROM labelled GROUP BY sequence_name, strand, k
), pair AS (
  SELECT *, lag(t) OVER (PARTITION BY sequence_name, strand ORDER BY k) AS pt FROM block
)
"""

_DIALECTS = (
    _GENES
    + r'''
, shape AS (
  SELECT f.source_table, f.row_id,
    regexp_matches(f.g, '^\s*([A-Za-z_][\w.]*)?\s*\(') AND regexp_matches(f.g, '\)\s*$') OR regexp_matches(f.g, '^\s*\[') AND regexp_matches(f.g, '\]\s*$')
      OR regexp_matches(f.g, '^\s*\{') AND regexp_matches(f.g, '\}\s*$') AS wrapped,
    regexp_replace(regexp_replace(i.g, '^\s*[\[{]', ''), '[\]}]\s*$', '') AS t, m.m
  FROM field f JOIN inside i USING (source_table, row_id) JOIN mark m USING (source_table, row_id)
), rest AS (
  SELECT *, regexp_replace(t, '"(?:[^"]|"")*"|\'\'[^\'\']*\'\'|[\p{L}\p{N}():\-]+', '', 'g') AS r,
    len(list_filter(m, lambda x: starts_with(x, '"'))) > 0 AS dq, len(list_filter(m, lambda x: starts_with(x, chr(39)))) > 0 AS sq FROM shape
), named AS (
  SELECT source_table, row_id,
    CASE WHEN regexp_replace(r, '[\s\x{00a0}]', '', 'g') <> '' THEN array_to_string(list_sort(list_distinct(string_split(regexp_replace(r, '[\s\x{00a0}]', '', 'g'), ''))), '')
      WHEN r <> '' THEN 'blank' ELSE 'none' END
    || ' ' || CASE WHEN dq OR sq THEN CASE WHEN dq THEN '"' ELSE '' END || CASE WHEN sq THEN chr(39) ELSE '' END ELSE 'bare' END
    || CASE WHEN wrapped THEN ' wrapped' ELSE '' END AS dialect
  FROM rest
)
SELECT n.source_table, n.dialect, count(DISTINCT g.row_id) AS n_fields, count(*) AS n_genes FROM named n JOIN gene g USING (source_table, row_id) GROUP BY 1, 2'''.replace("\\'", "'")
)

SQL = {
    "p2_found": _GENES + "SELECT source_table, row_id, value_pos, gene_value FROM gene",
    "p2_dialects": _DIALECTS,
    "p5_found": _BLOCKS
    + """SELECT sequence_name, strand, 'block' AS piece, f AS from_pos, t AS to_pos FROM pair
UNION ALL SELECT sequence_name, strand, 'gap', pt + 1, f - 1 FROM pair WHERE pt IS NOT NULL AND f - 1 - pt <= 10000""",
    "p5_coverage": _BLOCKS
    + """SELECT sequence_name, strand, count(*) AS n_blocks, CAST(sum(t - f + 1) AS BIGINT) AS covered, count(pt) AS n_gaps,
  CAST(coalesce(sum(f - 1 - pt), 0) AS BIGINT) AS uncovered FROM pair GROUP BY sequence_name, strand""",
}
