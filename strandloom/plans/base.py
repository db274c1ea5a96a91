"""Views that several query modules start from, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.tables import first_by
from strandloom.session import table


class Registry:
    """Queries and their SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(query):
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return put


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Peaks with a chromosome and a name of their own: of repeated names the first position."""
    rows = table(spark, folder, "joint_peaks").where("chrom is not null and name is not null and chrom_start is not null and chrom_end is not null")
    order = [F.col("chrom"), F.col("chrom_start"), F.col("chrom_end"), F.coalesce("strand", F.lit("")), F.coalesce("score", F.lit(0))]
    return first_by(rows, ["name"], order)


PEAKS = """peak AS (
  SELECT chrom, chrom_start, chrom_end, name, score, strand FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY chrom, chrom_start, chrom_end, coalesce(strand, ''), coalesce(score, 0)) AS r
    FROM joint_peaks WHERE chrom IS NOT NULL AND name IS NOT NULL AND chrom_start IS NOT NULL AND chrom_end IS NOT NULL) WHERE r = 1
)"""


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits inside peaks in genomic half-open coordinates."""
    f = table(spark, folder, "fimo").where("start is not null and stop is not null").select("hit_id", "motif_id", "sequence_name", "start", "stop", F.col("strand").alias("hit_strand"), F.col("score").alias("hit_score"), "p_value")
    p = peaks(spark, folder).select("name", "chrom", F.col("chrom_start").alias("_from"))
    lo, hi = F.least("start", "stop"), F.greatest("start", "stop")
    return f.join(p, f["sequence_name"] == p["name"]).select("hit_id", "motif_id", "name", "chrom", (F.col("_from") + lo - 1).alias("s"), (F.col("_from") + hi).alias("e"), "hit_strand", "hit_score", "p_value")


HITS = (
    PEAKS
    + """, hit AS (
  SELECT f.hit_id, f.motif_id, p.name, p.chrom, p.chrom_start + least(f."start", f."stop") - 1 AS s, p.chrom_start + greatest(f."start", f."stop") AS e,
    f.strand AS hit_strand, f.score AS hit_score, f.p_value
  FROM fimo f JOIN peak p ON f.sequence_name = p.name WHERE f."start" IS NOT NULL AND f."stop" IS NOT NULL
)"""
)


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Events as intervals of 1 to 60 minutes on their type."""
    e = table(spark, folder, "events")
    s = micros("ts")
    return e.where("event_type is not null and ts is not null").select("event_id", "user_id", "event_type", "value", s.alias("s"), (s + (F.col("event_id") % 60 + 1) * 60_000_000).alias("e"))


VISITS = """visit AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS s, epoch_us(ts) + (event_id % 60 + 1) * 60000000 AS e
  FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL
)"""


def dna(spark: SparkSession, folder: str) -> DataFrame:
    """Matched sequences of the scans and the texts of the documents mapped onto an alphabet of four letters."""
    letters = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    return table(spark, folder, "documents").where("text is not null").select("doc_id", letters.alias("seq"))


DNA = """dna AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL)"""
