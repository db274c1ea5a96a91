"""Writers of text formats, and the keyed store of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.tables import first_by


def _text(df: DataFrame, line: Column, path: str, mode: str) -> None:
    df.select(line.alias("value")).write.mode(mode).text(path)


def _joined(*columns: Column) -> Column:
    return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit(".")) for c in columns))


def write_bed(df: DataFrame, path: str, strand: str = ".", mode: str = "errorifexists") -> None:
    """BED6 of (chrom, chrom_start, chrom_end, name[, score, strand]); negative starts become 0."""
    score = F.coalesce("score", F.lit(0)).cast("bigint") if "score" in df.columns else F.lit(0)
    side = F.coalesce("strand", F.lit(strand)) if "strand" in df.columns else F.lit(strand)
    _text(df, _joined(F.col("chrom"), F.greatest("chrom_start", F.lit(0)), F.col("chrom_end"), F.col("name"), score, side), path, mode)


def checked_bed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a written BED6 that break its rules: field count, order of positions, strand."""
    f = spark.read.text(path).select("value", F.split("value", "\t").alias("f"))
    ok = (F.size("f") == 6) & (F.get("f", F.lit(1)).try_cast("bigint") >= 0) & (F.get("f", F.lit(2)).try_cast("bigint") > F.get("f", F.lit(1)).try_cast("bigint")) & F.get("f", F.lit(5)).isin("+", "-", ".", "?")
    return f.where(~F.coalesce(ok, F.lit(False))).select("value")


def write_narrow_peaks(df: DataFrame, path: str, summit: str = "offset", mode: str = "errorifexists") -> None:
    """Ten columns with the midpoint as summit, as an offset or absolute; signal and p are -1 where unknown."""
    half = F.floor((F.col("chrom_end") - F.col("chrom_start")) / 2)
    at = half if summit == "offset" else F.floor((F.col("chrom_start") + F.col("chrom_end")) / 2)
    signal = F.coalesce("signal_value", F.lit(-1.0)) if "signal_value" in df.columns else F.lit(-1)
    _text(df, _joined(F.col("chrom"), F.col("chrom_start"), F.col("chrom_end"), F.col("name"), F.lit(0), F.lit("."), signal, F.lit(-1), F.lit(-1), at), path, mode)


def write_fasta(df: DataFrame, name: str, seq: str, path: str, mode: str = "errorifexists") -> None:
    """A record per row; null sequences are left out."""
    _text(df.where(F.col(seq).isNotNull()), F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq)), path, mode)


def write_matrices(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Minimal motif format of (motif_id, pos, a, c, g, t): a block per motif, a header per file."""
    row = F.format_string(" %.8f  %.8f  %.8f  %.8f", *(F.col(c) for c in "acgt"))
    m = df.groupBy("motif_id").agg(F.sort_array(F.collect_list(F.struct("pos", row.alias("row")))).alias("rows"))
    head = F.format_string("MOTIF %s\nletter-probability matrix: alength= 4 w= %d\n", F.col("motif_id"), F.size("rows"))
    block = F.concat(head, F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n"))
    whole = m.orderBy("motif_id").coalesce(1)  # a library of motifs: one file, a row a motif
    lead = "MEME version 4\n\nALPHABET= ACGT\n\nBackground letter frequencies\nA 0.25 C 0.25 G 0.25 T 0.25\n"
    first = whole.sparkSession.createDataFrame([(lead,)], "value string")
    first.unionByName(whole.select(block.alias("value"))).coalesce(1).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, digits: dict[str, int] | None = None, separator: str = "\t", mode: str = "errorifexists") -> None:
    """Text table with header, numbers rounded."""
    rounded = df.withColumns({c: F.round(c, d) for c, d in (digits or {}).items()})
    rounded.write.mode(mode).csv(path, sep=separator, header=True, nullValue="NA")


# the keyed store of results ----------------------------------------------------------------------


def upsert(store: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The store with ``new``'s rows in place of those of the same key; null keys are keys too. Of repeated new keys the last value in order stays."""
    rest = [F.col(c).desc_nulls_last() for c in new.columns if c not in key]
    fresh = first_by(new, key, rest)
    same = [store[k].eqNullSafe(fresh[k]) for k in key]
    return store.join(fresh, same, "left_anti").unionByName(fresh)


def value_row(store: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, value) stored under a name, as a row: the smallest value if it is there repeatedly, no row if it isn't."""
    return store.where(F.col(key) == name).groupBy(key).agg(F.min(value).alias(value))


def value_of(store: DataFrame, key: str, value: str, name: str):
    """The value stored under a name: the smallest if it is there repeatedly, None if it isn't."""
    row = store.where(F.col(key) == name).agg(F.min(value)).first()
    return row[0]


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows, with multiplicity, that only one of two tables has, and which."""
    cols = one.columns
    a = one.exceptAll(other.select(cols)).withColumn("only_in", F.lit("first"))
    return a.unionByName(other.select(cols).exceptAll(one).withColumn("only_in", F.lit("second")))


def verified_overwrite(spark: SparkSession, new: DataFrame, path: str) -> bool:
    """Write ``new`` if nothing is there; if something is, it must be the same rows, else an error. True if it wrote."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        new.write.parquet(path)
        return True
    if not differences(new, spark.read.parquet(path)).isEmpty():
        raise ValueError(f"{path} holds other rows than the ones recomputed")
    return False


def cached(spark: SparkSession, folder: str, parameters: dict, make) -> DataFrame:
    """The result of ``make()`` stored under its parameters: made once, read afterwards; other parameters are another place."""
    import hashlib
    import json

    name = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{folder}/{name}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
