"""Round trips through text formats, and the keyed store."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequence as sq
from strandloom.operators.tables import first_by
from strandloom.plans.base import DNA, PEAKS, Registry, dna, peaks
from strandloom.session import materialize, new_folder, remove_folder, table
from strandloom.sources import readers as rd
from strandloom.sources import writers as wr

REG = Registry()


def _round_trip(spark, write, read):
    """Write to a folder of its own, read back, keep the rows, remove the folder."""
    path = new_folder(spark, "text")
    write(path)
    out = materialize(read(path))
    remove_folder(spark, path)
    return out


@REG.add("s1_narrow_peaks", f"WITH {PEAKS} SELECT chrom, chrom_start, chrom_end, name, chrom_start + (chrom_end - chrom_start) // 2 AS summit, CAST(NULL AS DOUBLE) AS signal_value FROM peak")
def s1_narrow_peaks(spark, folder):
    p = peaks(spark, folder)
    t = _round_trip(spark, lambda to: wr.write_narrow_peaks(p, to), lambda at: rd.read_narrow_peaks(spark, at))
    return t.select("chrom", "chrom_start", "chrom_end", "name", "summit", "signal_value")


@REG.add("s1_absolute_summits", f"WITH {PEAKS} SELECT name, (chrom_start + chrom_end) // 2 AS summit FROM peak")
def s1_absolute_summits(spark, folder):
    p = peaks(spark, folder)
    t = _round_trip(spark, lambda to: wr.write_narrow_peaks(p, to, "absolute"), lambda at: rd.read_narrow_peaks(spark, at, "absolute"))
    return t.select("name", "summit")


@REG.add("s2_k1_bed", f"WITH {PEAKS} SELECT chrom, chrom_start, chrom_end, name, coalesce(strand, '.') AS strand FROM peak")
def s2_k1_bed(spark, folder):
    p = peaks(spark, folder)
    return _round_trip(spark, lambda to: wr.write_bed(p, to), lambda at: rd.read_bed(spark, at)).select("chrom", "chrom_start", "chrom_end", "name", "strand")


@REG.add("k2_bed_rules", f"WITH {PEAKS} SELECT CAST(count(*) FILTER (chrom_end - chrom_start <= 300 OR chrom_start % 7 = 0) AS INTEGER) AS n_bad, CAST(count(*) AS INTEGER) AS n_rows FROM peak")
def k2_bed_rules(spark, folder):
    """Rows that break the rules are counted: here narrow ones are written with their ends before their starts, others with a strand no rule knows."""
    p = peaks(spark, folder).withColumn("chrom_end", F.when(F.col("chrom_end") - F.col("chrom_start") <= 300, F.col("chrom_start") - 1).otherwise(F.col("chrom_end")))
    p = p.withColumn("strand", F.when(F.col("chrom_start") % 7 == 0, "x").otherwise(F.coalesce("strand", F.lit("."))))
    bad = _round_trip(spark, lambda to: wr.write_bed(p, to), lambda at: wr.checked_bed(spark, at)).agg(F.count("*").cast("int").alias("n_bad"))
    return bad.join(p.agg(F.count("*").cast("int").alias("n_rows")))  # one row each


@REG.add("s4_hits", "SELECT motif_id, sequence_name, \"start\", \"stop\", strand, matched_sequence FROM fimo WHERE motif_id NOT LIKE '#%' AND sequence_name IS NOT NULL AND \"start\" IS NOT NULL AND \"stop\" IS NOT NULL AND strand IS NOT NULL AND matched_sequence IS NOT NULL")
def s4_hits(spark, folder):
    """Scan results as text with a header and comment rows, read back without them."""
    f = table(spark, folder, "fimo").where("motif_id is not null and (motif_id like '#%' or (sequence_name is not null and start is not null and stop is not null and strand is not null and matched_sequence is not null))")
    names = ["motif_id", "motif_alt_id", "sequence_name", "start", "stop", "strand", "score", "p_value", "q_value", "matched_sequence"]
    t = _round_trip(spark, lambda to: f.select(F.concat_ws("\t", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names)).alias("value")).write.text(to), lambda at: rd.read_hits(spark, at))
    return t.select("motif_id", "sequence_name", "start", "stop", "strand", "matched_sequence")


@REG.add("s5_comparisons", "SELECT trim(query_id) AS query_id, trim(target_id) AS target_id, optimal_offset, p_value, e_value, CASE WHEN isnan(q_value) THEN NULL ELSE q_value END AS q_value, overlap, query_consensus, target_consensus, orientation FROM tomtom WHERE query_id IS NOT NULL AND target_id IS NOT NULL AND trim(query_id) <> '' AND trim(query_id) NOT LIKE '#%'")
def s5_comparisons(spark, folder):
    """Comparison files in nested folders, found recursively."""
    t = table(spark, folder, "tomtom").where("query_id is not null and target_id is not null and trim(query_id) <> '' and not startswith(trim(query_id), '#')")
    names = ["query_id", "target_id", "optimal_offset", "p_value", "e_value", "q_value", "overlap", "query_consensus", "target_consensus", "orientation"]
    line = F.concat_ws("\t", *(F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) for n in names))
    rows = t.select(line.alias("value"), F.coalesce("orientation", F.lit("none")).alias("side"))
    out = _round_trip(spark, lambda to: rows.write.partitionBy("side").text(to), lambda at: rd.read_comparisons(spark, at))
    text = [F.nullif(n, F.lit("")).alias(n) for n in ("query_consensus", "target_consensus", "orientation")]
    return out.select("query_id", "target_id", "optimal_offset", "p_value", "e_value", F.nanvl("q_value", F.lit(None).cast("double")).alias("q_value"), "overlap", *text)


@REG.add("s6_k4_fasta", f"WITH {DNA} SELECT 'doc_' || doc_id AS seq_id, seq FROM dna WHERE length(seq) > 0")
def s6_k4_fasta(spark, folder):
    d = dna(spark, folder).where("length(seq) > 0").withColumn("id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    return _round_trip(spark, lambda to: wr.write_fasta(d, "id", "seq", to), lambda at: rd.read_fasta(spark, at))


_PROBS = "c AS (SELECT motif_id, i AS pos, matched_sequence[i] AS letter, count(*) AS n FROM (SELECT motif_id, matched_sequence, unnest(range(1, length(matched_sequence) + 1)) AS i FROM fimo WHERE motif_id IS NOT NULL AND motif_id NOT LIKE '#%' AND matched_sequence IS NOT NULL) GROUP BY ALL)"


@REG.add("s7_k5_matrices", f"WITH {_PROBS} SELECT motif_id, pos, " + ", ".join(f"round(coalesce(sum(n) FILTER (letter = '{x}'), 0) / sum(n), 4) AS {x.lower()}" for x in "ACGT") + " FROM c GROUP BY 1, 2")
def s7_k5_matrices(spark, folder):
    """Letter probabilities by position, written as motif blocks and parsed back."""
    f = table(spark, folder, "fimo").where("motif_id is not null and motif_id not like '#%'")
    c = sq.counts_by_position(f, "motif_id", "matched_sequence")
    m = c.groupBy("motif_id", "pos").agg(*((F.coalesce(F.sum(F.when(F.col("letter") == x, F.col("n"))), F.lit(0)) / F.sum("n")).alias(x.lower()) for x in "ACGT"))
    t = _round_trip(spark, lambda to: wr.write_matrices(m, to), lambda at: rd.read_matrices(spark, at))
    return t.select("motif_id", F.col("pos").cast("bigint").alias("pos"), *(F.round(x, 4).alias(x) for x in "acgt"))


@REG.add("s10_s11_tracks", "SELECT 'all' AS stage, event_type AS mark, 'user' || user_id AS chrom, epoch_us(ts) AS chrom_start, min(value) AS score FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND event_type IS NOT NULL GROUP BY ALL")
def s10_s11_tracks(spark, folder):
    """One track file per kind, its labels parsed from the file's path."""
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    e = table(spark, folder, "events").where("event_type is not null")
    line = F.concat_ws(" ", F.concat(F.lit("user"), F.col("user_id").cast("string")), at.cast("string"), (at + 1).cast("string"), F.coalesce(F.col("value").cast("string"), F.lit("NA")))
    rows = e.select(line.alias("value"), F.concat(F.lit("all_"), F.col("event_type")).alias("kind"))
    t = _round_trip(spark, lambda to: rows.write.partitionBy("kind").text(to), lambda p: rd.read_tracks(spark, p, r"kind=([a-z]+)_([a-z_]+)/"))
    return t.select("stage", "mark", "chrom", "chrom_start", "score")


@REG.add("s14_decimal_comma", "SELECT s_name, s_acctbal FROM supplier")
def s14_decimal_comma(spark, folder):
    s = table(spark, folder, "supplier").select("s_name", F.regexp_replace(F.col("s_acctbal").cast("string"), r"\.", ",").alias("s_acctbal"))
    return _round_trip(spark, lambda to: s.write.csv(to, sep=";", header=True, nullValue="#VALUE!"), lambda at: rd.read_decimal_comma(spark, at, ["s_acctbal"]))


@REG.add("s15_gene_list", "SELECT DISTINCT g AS gene FROM (SELECT unnest(regexp_extract_all(geneset_peak_genes, 'FBgn[0-9]+')) AS g FROM chipenrich_dys_tgo_gobp)")
def s15_gene_list(spark, folder):
    genes = table(spark, folder, "chipenrich_dys_tgo_gobp").select(F.explode(F.regexp_extract_all("geneset_peak_genes", F.lit("(FBgn[0-9]+)"), F.lit(1))).alias("genes"))
    return _round_trip(spark, lambda to: genes.write.csv(to, header=True), lambda at: rd.read_gene_list(spark, at))


@REG.add("k6_result_table", "SELECT motif_id, motif_width, round(n_sites / 7.0, 3) AS share FROM motif_library")
def k6_result_table(spark, folder):
    m = table(spark, folder, "motif_library").select("motif_id", "motif_width", (F.col("n_sites") / 7.0).alias("share"))
    return _round_trip(spark, lambda to: wr.write_table(m, to, {"share": 3}), lambda at: spark.read.csv(at, sep="\t", header=True, schema="motif_id string, motif_width int, share double"))


_STORE = "old AS (SELECT o_orderpriority AS name, count(*) AS v FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1), new AS (SELECT o_orderpriority AS name, max(o_custkey) AS v FROM orders WHERE o_orderpriority < '3' GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders)"


@REG.add("k7_upsert", f"WITH {_STORE} SELECT * FROM old WHERE name NOT IN (SELECT name FROM new) UNION ALL SELECT * FROM new")
def k7_upsert(spark, folder):
    o = table(spark, folder, "orders")
    old = o.where("o_orderpriority is not null").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("v"))
    new = o.where("o_orderpriority < '3'").groupBy(F.col("o_orderpriority").alias("name")).agg(F.max("o_custkey").alias("v")).unionByName(o.agg(F.lit("total").alias("name"), F.count("*").alias("v")))
    return wr.upsert(old, new, ["name"])


@REG.add("k9_differences", "SELECT c_custkey, c_mktsegment, 'first' AS only_in FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'ALTERED', 'second' FROM customer WHERE c_acctbal < 0")
def k9_differences(spark, folder):
    c = table(spark, folder, "customer")
    one = c.select("c_custkey", "c_mktsegment")
    other = c.select("c_custkey", F.when(F.col("c_acctbal") < 0, "ALTERED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return wr.differences(one, other)


@REG.add("k10_cached_result", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def k10_cached_result(spark, folder):
    """Made once under its parameters, then read."""
    path = new_folder(spark, "cache")
    make = lambda: table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    wr.cached(spark, path, {"query": "lines", "folder": folder}, make)
    out = materialize(wr.cached(spark, path, {"query": "lines", "folder": folder}, lambda: None))
    remove_folder(spark, path)
    return out


@REG.add("k8_read_value", "SELECT o_orderstatus AS name, min(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def k8_read_value(spark, folder):
    o = table(spark, folder, "orders")
    return wr.value_row(o, "o_orderstatus", "o_totalprice", "F").select(F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("value"))


def _text_trip(spark, lines, read, **options):
    """Write text lines to a folder of its own, read them back, remove the folder."""
    return _round_trip(spark, lambda to: lines.write.options(**options).text(to), read)


@REG.add("s3_replicate_peaks", f"WITH {PEAKS} SELECT chrom, chrom_start, chrom_end FROM peak WHERE CASE WHEN chrom_start % 2 = 0 THEN (chrom_start % 300) / 100.0 >= 1.301 ELSE chrom_start % 1000 >= 540 END")
def s3_replicate_peaks(spark, folder):
    """Raw replicate output: rows of 12 fields are kept by the twelfth, rows of 10 by their score."""
    start = F.col("chrom_start")
    ten = [F.col("chrom"), start, F.col("chrom_end"), F.col("name"), start % 1000, F.lit("."), F.lit(-1), F.lit(-1), F.lit(-1), F.lit(0)]
    twelve = [*ten, F.lit(0.5), (start % 300) / 100.0]
    line = lambda fields: F.concat_ws("\t", *(c.cast("string") for c in fields))
    lines = peaks(spark, folder).select(F.when(start % 2 == 0, line(twelve)).otherwise(line(ten)))
    return _text_trip(spark, lines, lambda at: rd.read_replicate_peaks(spark, at))


@REG.add("s8_discovery_blocks", "SELECT CAST(row_number() OVER (ORDER BY motif_id) AS BIGINT) AS rank, motif_id[1:6] || '-' || consensus AS name, e_value, regexp_matches(consensus, 'CG') AS wanted FROM motif_library")
def s8_discovery_blocks(spark, folder):
    """Blocks of a motif discovery's report, in file order."""
    m = table(spark, folder, "motif_library")
    number = F.substring("motif_id", 4, 3)
    block = F.concat(F.lit("MOTIF "), number, F.lit("-"), F.col("consensus"), F.lit(" STREME\nletter-probability matrix: alength= 4 w= 1 nsites= 9 E= "), F.col("e_value").cast("string"), F.lit("\n 0.25 0.25 0.25 0.25\n"))
    whole = m.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("motif_id", block.alias("b")))), lambda x: x["b"]), "\n"))  # the library is fixed and small
    t = _text_trip(spark, whole, lambda at: rd.read_discovery(spark, at, "CG"))
    named = F.concat(F.lit("LIB"), F.split("motif_id", "-")[0], F.lit("-"), F.col("consensus"))
    return t.select(F.col("rank").cast("bigint").alias("rank"), named.alias("name"), "e_value", "wanted")


_COUNT_ROWS = "SELECT motif_id, i, ascii(consensus[i]) % 5 AS a, ascii(consensus[i]) % 7 AS c, i % 3 AS g, CASE WHEN i % 4 = 0 THEN 0 ELSE 2 END AS t FROM (SELECT motif_id, consensus, unnest(range(1, length(consensus) + 1)) AS i FROM motif_library)"


@REG.add("s9_count_matrices", f"SELECT motif_id, CAST(i AS BIGINT) AS pos, round(a / greatest(a + c + g + t, 1), 9) AS a, round(c / greatest(a + c + g + t, 1), 9) AS c, round(g / greatest(a + c + g + t, 1), 9) AS g, round(t / greatest(a + c + g + t, 1), 9) AS t FROM ({_COUNT_ROWS})")
def s9_count_matrices(spark, folder):
    """Count rows under ``>id`` lines as probabilities."""
    def row(letter, i):  # i from 0
        at = i + 1
        return F.concat_ws(" ", (F.ascii(letter) % 5).cast("string"), (F.ascii(letter) % 7).cast("string"), (at % 3).cast("string"), F.when(at % 4 == 0, "0").otherwise("2"))

    letters = F.filter(F.split("consensus", ""), lambda x: x != "")
    m = table(spark, folder, "motif_library").select(F.concat(F.lit(">"), F.col("motif_id"), F.lit("\n"), F.array_join(F.transform(letters, row), "\n")))
    t = _text_trip(spark, m, lambda at: rd.read_count_matrices(spark, at))
    return t.select("motif_id", F.col("pos").cast("bigint").alias("pos"), *(F.round(x, 9).alias(x) for x in "acgt"))


@REG.add("s12_skipped_line", "SELECT CAST(row_number() OVER (ORDER BY motif_id) + 1 AS BIGINT) AS line_no, motif_id, motif_width FROM motif_library")
def s12_skipped_line(spark, folder):
    """A gzipped table whose first line is no header."""
    m = table(spark, folder, "motif_library").groupBy().agg(F.sort_array(F.collect_list(F.concat_ws("\t", "motif_id", F.col("motif_width").cast("string")))).alias("l"))
    lines = m.select(F.concat(F.lit("made by a scan\n"), F.array_join("l", "\n")))  # the library is fixed and small
    t = _text_trip(spark, lines, lambda at: rd.read_table_skipping(spark, at), compression="gzip")
    return t.select("line_no", F.col("fields")[0].alias("motif_id"), F.col("fields")[1].cast("int").alias("motif_width"))


@REG.add("s19_quality", "SELECT p_partkey % 400 AS fragment, count(*) AS n FROM part GROUP BY 1")
def s19_quality(spark, folder):
    """The first of several estimates in a report's third column."""
    k = F.col("p_partkey")
    estimates = F.concat_ws(",", (k % 400).cast("string"), (k % 7).cast("string"), F.lit("0"))
    lines = table(spark, folder, "part").select(F.concat_ws("\t", F.concat(F.lit("r"), k.cast("string")), F.lit("12345"), estimates, F.lit("0.9")))
    t = _text_trip(spark, lines, lambda at: rd.read_quality(spark, at))
    return t.groupBy(F.col("fragment").cast("bigint").alias("fragment")).agg(F.count("*").alias("n"))


def _logs(spark, folder, text):
    """One file per nation, in a folder named after it."""
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), text.alias("value"))


@REG.add("s20_log_numbers", "SELECT CAST(n_nationkey AS INTEGER) AS k, CAST(n_nationkey * 137 + 5 AS VARCHAR) AS tags, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey + 100 AS VARCHAR) END AS size FROM nation")
def s20_log_numbers(spark, folder):
    """Numbers of a peak caller's logs, null where a line is missing."""
    k = F.col("n_nationkey")
    second = F.when(k % 3 != 0, F.concat(F.lit("\n# d is "), (k + 100).cast("string"), F.lit(" bps"))).otherwise(F.lit(""))
    logs = _logs(spark, folder, F.concat(F.lit("INFO  @ start\nINFO  # tags after filtering in treatment: "), (k * 137 + 5).cast("string"), second, F.lit("\ndone")))
    found = _round_trip(spark, lambda to: logs.write.partitionBy("k").text(to), lambda at: rd.scrape(spark, at, {"tags": r"in treatment: (\d+)", "size": r"d is (\d+) bps"}))
    return found.select(F.regexp_extract("file", r"k=(\d+)", 1).cast("int").alias("k"), "tags", "size")


@REG.add("s22_report_ids", "SELECT CAST(n_nationkey AS INTEGER) AS k, 'reports/' || lower(printf('%x', CAST(n_nationkey * 7919 + 4096 AS BIGINT))) AS report FROM nation")
def s22_report_ids(spark, folder):
    """The first report a page links to."""
    k = F.col("n_nationkey")
    page = F.concat(F.lit('<html>\n<a href="/about">x</a> <a href="/reports/'), F.lower(F.hex(k * 7919 + 4096)), F.lit('">one</a>\n<a href="/reports/ffff">two</a></html>'))
    pages = _logs(spark, folder, page)
    found = _round_trip(spark, lambda to: pages.write.partitionBy("k").text(to), lambda at: rd.scrape(spark, at, {"report": r"(reports/[0-9a-f]+)"}))
    return found.select(F.regexp_extract("file", r"k=(\d+)", 1).cast("int").alias("k"), "report")


@REG.add("s23_same_content", "SELECT true AS same, false AS changed")
def s23_same_content(spark, folder):
    """Whether files have the same bytes: a copy does, one with a line more doesn't."""
    lines = table(spark, folder, "nation").select(F.col("n_name").alias("value")).coalesce(1).sortWithinPartitions("value")
    paths = [new_folder(spark, "text") for _ in range(3)]
    for path, what in zip(paths, (lines, lines, lines.unionByName(lines.limit(1)).coalesce(1)), strict=True):
        what.write.text(path)
    same, changed = (rd.same_content(spark, f"{paths[0]}/part-*", f"{p}/part-*") for p in paths[1:])
    for path in paths:
        remove_folder(spark, path)
    return spark.createDataFrame([(same, changed)], "same boolean, changed boolean")


QUERIES, SQL = REG.queries, REG.sql
