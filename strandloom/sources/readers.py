"""Readers of the field's text formats, as DataFrames with declared schemas.

Intervals are half-open with 0-based starts throughout; formats that count otherwise
are converted on the way in. Comment and blank lines are dropped. Rows that cannot be parsed give nulls, never
an error; an empty file gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _columns(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Lines as arrays of fields: ragged files are fine."""
    lines = spark.read.text(path).where("length(trim(value)) > 0 and not startswith(value, '#') and not startswith(value, 'track') and not startswith(value, 'browser')")
    return lines.select(F.split("value", separator).alias("f"))


def _at(i: int, kind: str = "string") -> Column:
    value = F.get("f", F.lit(i))
    return value if kind == "string" else value.try_cast(kind)


def read_bed(spark: SparkSession, path: str, start_base: int = 0) -> DataFrame:
    """BED of 3 to 6 columns; ``start_base`` 1 for files whose starts count from 1."""
    f = _columns(spark, path)
    return f.select(_at(0).alias("chrom"), (_at(1, "bigint") - start_base).alias("chrom_start"), _at(2, "bigint").alias("chrom_end"), _at(3).alias("name"), _at(4, "double").alias("score"), _at(5).alias("strand"))


def read_narrow_peaks(spark: SparkSession, path: str, summit: str = "offset") -> DataFrame:
    """Peaks of 10 or more columns. ``summit`` tells whether column 10 is an offset or an absolute position; it comes out absolute. Signal and p of -1 are null."""
    def known(i):
        return F.nullif(_at(i, "double"), F.lit(-1.0))

    at = _at(9, "bigint")
    position = F.when(at >= 0, _at(1, "bigint") + at if summit == "offset" else at)
    return _columns(spark, path).select(
        _at(0).alias("chrom"), _at(1, "bigint").alias("chrom_start"), _at(2, "bigint").alias("chrom_end"), _at(3).alias("name"), _at(4, "bigint").alias("score"), _at(5).alias("strand"),
        known(6).alias("signal_value"), known(7).alias("p_value"), known(8).alias("q_value"), position.alias("summit"), F.size("f").alias("n_fields"),
    )


def read_replicate_peaks(spark: SparkSession, path: str, strict: float = 1.301, score: float = 540.0) -> DataFrame:
    """Raw reproducibility output: files with 12 columns or more are filtered by the 12th, shorter ones by the score."""
    f = _columns(spark, path)
    keep = F.when(F.size("f") >= 12, _at(11, "double") >= strict).otherwise(_at(4, "double") >= score)
    return f.where(keep).select(_at(0).alias("chrom"), _at(1, "bigint").alias("chrom_start"), _at(2, "bigint").alias("chrom_end"))


def read_hits(spark: SparkSession, path: str, motif: str | None = None) -> DataFrame:
    """Motif hits of a scan: 1-based inclusive positions as stored; header and comment rows are dropped."""
    f = _columns(spark, path).where(~_at(0).isin("motif_id", "# motif_id", ""))
    names = ["motif_id", "motif_alt_id", "sequence_name", "start", "stop", "strand", "score", "p_value", "q_value", "matched_sequence"]
    kinds = ["string", "string", "string", "int", "int", "string", "double", "double", "double", "string"]
    hits = f.select(*(_at(i, k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))))
    return hits.where(F.col("motif_id") == motif) if motif else hits


def read_comparisons(spark: SparkSession, path: str) -> DataFrame:
    """Motif comparisons of all files below ``path``, with the file each row comes from; unreadable files give no rows."""
    lines = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(path)
    f = lines.where("length(trim(value)) > 0 and not startswith(value, '#')").select(F.split("value", "\t").alias("f"), F.input_file_name().alias("file"))
    names = ["query_id", "target_id", "optimal_offset", "p_value", "e_value", "q_value", "overlap", "query_consensus", "target_consensus", "orientation"]
    kinds = ["string", "string", "int", "double", "double", "double", "int", "string", "string", "string"]
    return f.where(_at(0) != "Query_ID").select(*(F.trim(_at(i)).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))), "file")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): the header's first word and its lines joined. One record is one row, so a record must fit in memory."""
    records = spark.read.option("lineSep", ">").text(path).where("length(trim(value)) > 0")
    parts = F.split("value", "\r?\n", 2)
    return records.select(F.regexp_extract(parts[0], r"^\s*(\S+)", 1).alias("seq_id"), F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s+", "")).alias("seq"))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(motif_id, pos, a, c, g, t) of all motifs of a minimal-format file: the rows behind each letter-probability header."""
    text = spark.read.text(path, wholetext=True)
    motif = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)MOTIF\s+(\S+.*?)(?=\nMOTIF\s|\z)"), F.lit(1))).alias("m")
    one = text.select(motif).select(F.regexp_extract("m", r"^(\S+)", 1).alias("motif_id"), F.regexp_extract("m", r"(?s)letter-probability matrix[^\n]*\n((?:\s*[0-9.eE+-]+[ \t]+[0-9.eE+-]+[ \t]+[0-9.eE+-]+[ \t]+[0-9.eE+-]+[ \t]*\n?)+)", 1).alias("rows"))
    line = one.select("motif_id", F.posexplode(F.filter(F.split("rows", r"\n"), lambda x: F.length(F.trim(x)) > 0)).alias("i", "row"))
    numbers = F.split(F.trim("row"), r"\s+")
    return line.select("motif_id", (F.col("i") + 1).alias("pos"), *(F.get(numbers, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate("acgt")))


def read_discovery(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """(file, rank, motif_id, consensus, e_value, wanted) of a motif discovery's text blocks, in file order; wanted: the consensus matches ``pattern``."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    block = F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)MOTIF\s+([^\n]+\n.*?E=\s*[0-9.eE+-]+)"), F.lit(1))).alias("i", "m")
    b = text.select("file", block)
    name = F.regexp_extract("m", r"^(\S+)", 1)
    consensus = F.regexp_extract(name, r"^[0-9]+-([A-Z]+)", 1)
    return b.select("file", (F.col("i") + 1).alias("rank"), name.alias("motif_id"), consensus.alias("consensus"), F.regexp_extract("m", r"E=\s*([0-9.eE+-]+)", 1).try_cast("double").alias("e_value"), (consensus.rlike(pattern) if pattern else F.lit(True)).alias("wanted"))


def read_count_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(motif_id, pos, a, c, g, t) of count matrices under ``>id`` lines, rows divided by their sum (empty rows by 1)."""
    records = spark.read.option("lineSep", ">").text(path).where("length(trim(value)) > 0")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    r = records.select(F.trim(lines[0]).alias("motif_id"), F.posexplode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("i", "row"))
    v = [F.coalesce(F.get(F.split(F.trim("row"), r"\s+"), F.lit(k)).try_cast("double"), F.lit(0.0)) for k in range(4)]
    total = F.greatest(v[0] + v[1] + v[2] + v[3], F.lit(1.0))
    return r.select("motif_id", (F.col("i") + 1).alias("pos"), *((x / total).alias(c) for x, c in zip(v, "acgt", strict=True)))


def read_tracks(spark: SparkSession, path: str, name: str = r"([^/]+?)_([^/_]+)\.[^/]*$") -> DataFrame:
    """Probe tracks of four columns: chrom, start, end, score and two labels taken from the file's name; bad rows and repeats dropped."""
    f = spark.read.text(path).where("length(trim(value)) > 0 and not startswith(value, 'track') and not startswith(value, '#')").select(F.split(F.trim("value"), r"\s+").alias("f"), F.input_file_name().alias("file"))
    t = f.select(F.regexp_extract("file", name, 1).alias("stage"), F.regexp_extract("file", name, 2).alias("mark"), _at(0).alias("chrom"), _at(1, "bigint").alias("chrom_start"), _at(2, "bigint").alias("chrom_end"), _at(3, "double").alias("score"))
    ok = t.where("chrom_start is not null and chrom_end > chrom_start and score is not null and not isnan(score)")
    return ok.groupBy("stage", "mark", "chrom", "chrom_start", "chrom_end").agg(F.min("score").alias("score"))


def read_table_skipping(spark: SparkSession, path: str, skip: int = 1, separator: str = "\t") -> DataFrame:
    """(line_no, fields) of a text table, gzipped or not, without the first ``skip`` lines of each file and blank ones.

    Files are read line by line in splits of Spark's size (a gzipped file is one split). A line's number is its
    place in its split plus the lines of the file's splits before it: one row per split is counted.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "at", "first", before.alias("before"))
    numbered = lines.join(splits, ["file", "at"]).withColumn("line_no", F.col("before") + F.col("id") - F.col("first") + 1)
    return numbered.where((F.col("line_no") > skip) & (F.length(F.trim("value")) > 0)).select("line_no", F.split("value", separator).alias("fields"))


def read_decimal_comma(spark: SparkSession, path: str, numbers: list[str], separator: str = ";", missing: tuple[str, ...] = ("", "NA", "#VALUE!")) -> DataFrame:
    """CSV with decimal commas: byte-order mark and blanks stripped, ``numbers`` cast, missing marks null."""
    t = spark.read.csv(path, sep=separator, header=True, encoding="UTF-8")
    t = t.toDF(*(c.strip().lstrip("﻿").strip() for c in t.columns))
    text = {c: F.when(~F.trim(c).isin(*missing), F.trim(c)) for c in t.columns}
    return t.select(*((F.regexp_replace(v, ",", ".").try_cast("double") if c in numbers else v).alias(c) for c, v in text.items()))


def read_gene_list(spark: SparkSession, path: str, pattern: str = r"^FBgn\d+$") -> DataFrame:
    """(gene,): distinct identifiers of a list, with header ``genes`` or without, in its first column."""
    f = spark.read.text(path).select(F.trim(F.regexp_replace(F.split("value", "[,\t]")[0], '^"|"$', "")).alias("gene"))
    return f.where(F.col("gene").rlike(pattern)).distinct()


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """(file, fragment): the first of the comma-separated estimates in column 3 of a cross-correlation report."""
    return spark.read.text(path).where("length(trim(value)) > 0").select(F.input_file_name().alias("file"), F.split(F.get(F.split("value", "\t"), F.lit(2)), ",")[0].try_cast("int").alias("fragment"))


def scrape(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row per file with the first match's group 1 of each pattern, as text; null without one."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.input_file_name().alias("file"), *(F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(n) for n, p in patterns.items()))


def same_content(spark: SparkSession, one: str, other: str) -> bool:
    """Whether two files have the same bytes, by md5."""
    md5 = [spark.read.format("binaryFile").load(p).select(F.md5("content")).collect() for p in (one, other)]
    return sorted(r[0] for r in md5[0]) == sorted(r[0] for r in md5[1])
