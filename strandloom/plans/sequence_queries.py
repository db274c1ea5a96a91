"""Pattern, composition, masking and matrix queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import sequence as sq
from strandloom.functions import special as sp
from strandloom.functions import statistics as st
from strandloom.plans.base import DNA, Registry, dna
from strandloom.session import materialize, table

REG = Registry()

#: A small matrix, rows A C G T, that stands for a core with a fuzzy end.
CORE = np.array([[0.05, 0.05, 0.85, 0.05], [0.7, 0.1, 0.1, 0.1], [0.05, 0.85, 0.05, 0.05], [0.1, 0.1, 0.1, 0.7], [0.3, 0.2, 0.3, 0.2]])
WEIGHTS = np.round(sq.log_odds(CORE), 4)


@REG.add("q1_both_strands", f"WITH {DNA} SELECT doc_id, CAST((length(seq) - length(replace(seq, 'ACGTG', ''))) / 5 + (length(seq) - length(replace(seq, 'CACGT', ''))) / 5 AS BIGINT) AS n FROM dna")
def q1_both_strands(spark, folder):
    return dna(spark, folder).select("doc_id", sq.count_pattern("seq", "ACGTG").cast("bigint").alias("n"))


@REG.add("q1_overlapping", f"WITH {DNA} SELECT doc_id, coalesce(len(list_filter(range(1, length(seq)), lambda i: seq[i:i+1] = 'AA')), 0) AS n FROM dna")
def q1_overlapping(spark, folder):
    return dna(spark, folder).select("doc_id", sq.count_pattern("seq", "AA", both=False).cast("bigint").alias("n"))


@REG.add("q2_positions", f"WITH {DNA} SELECT doc_id, unnest(list_filter(range(1, length(seq)), lambda i: seq[i:i+3] = 'TACA')) AS pos FROM dna")
def q2_positions(spark, folder):
    d = dna(spark, folder)
    return d.select("doc_id", F.explode(sq.pattern_positions(F.col("seq"), "TACA")).alias("pos")).withColumn("pos", F.col("pos").cast("bigint"))


@REG.add("q3_ambiguous", f"WITH {DNA} SELECT doc_id, regexp_matches(seq, 'CA[ACGT][ACGT]TG') AS has_ebox, regexp_matches(seq, '[AG]CGTG') OR regexp_matches(seq, 'CACG[CT]') AS has_core FROM dna")
def q3_ambiguous(spark, folder):
    return dna(spark, folder).select("doc_id", (sq.count_pattern("seq", "CANNTG") > 0).alias("has_ebox"), (sq.count_pattern("seq", "RCGTG") > 0).alias("has_core"))


@REG.add("q4_reverse_complement", "SELECT hit_id, reverse(translate(matched_sequence, 'ACGT', 'TGCA')) AS rc FROM fimo")
def q4_reverse_complement(spark, folder):
    return table(spark, folder, "fimo").select("hit_id", sq.reverse_complement("matched_sequence").alias("rc"))


@REG.add("q5_gc", "SELECT hit_id, round((length(matched_sequence) - length(translate(matched_sequence, 'GC', ''))) / nullif(length(matched_sequence), 0), 9) AS gc FROM fimo")
def q5_gc(spark, folder):
    return table(spark, folder, "fimo").select("hit_id", F.round(sq.gc_fraction("matched_sequence"), 9).alias("gc"))


@REG.add("q6_fetch", f"WITH {DNA} SELECT doc_id, s, substr(seq, CAST(s + 1 AS BIGINT), 40) AS letters FROM (SELECT doc_id, seq, unnest([0, length(seq) // 3, length(seq) // 2]) AS s FROM dna WHERE length(seq) > 0)")
def q6_fetch(spark, folder):
    """Letters of intervals from sequences that are stored in pieces."""
    d = dna(spark, folder).where("length(seq) > 0")
    n = F.length("seq")
    asked = d.select("doc_id", F.explode(F.array(F.lit(0), F.floor(n / 3), F.floor(n / 2))).alias("s")).withColumn("e", F.col("s") + 40)
    return sq.fetch(asked, sq.chunks(d, "doc_id", "seq", 512, 64), "doc_id", "s", "e", 512).select("doc_id", "s", "letters")


_MASKED = f"WITH {DNA}, m AS (SELECT doc_id, seq, CASE WHEN length(seq) >= 60 THEN substr(seq, 1, 10) || repeat('N', 10) || substr(seq, 21, 20) || repeat('N', 15) || substr(seq, 56) ELSE seq END AS masked FROM dna)"


@REG.add("q7_q8_mask", f"{_MASKED} SELECT doc_id, masked, length(masked) - length(replace(masked, 'N', '')) AS n_masked, true AS agrees FROM m")
def q7_q8_mask(spark, folder):
    parts = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in ((10, 20), (40, 55))))
    m = dna(spark, folder).withColumn("masked", F.when(F.length("seq") >= 60, sq.mask(F.col("seq"), parts)).otherwise(F.col("seq")))
    return m.select("doc_id", "masked", sq.masked_count("masked").cast("bigint").alias("n_masked"), sq.agrees_unmasked(F.col("masked"), F.col("seq")).alias("agrees"))


def _weight_sql(weights):
    rows = ", ".join(f"({j + 1}, '{c}', {w[k]:.6f})" for j, w in enumerate(weights) for k, c in enumerate("ACGT"))
    return f"(VALUES {rows}) AS w(j, c, x)"


_BEST = f"""WITH {DNA}, plus AS (SELECT * FROM {_weight_sql(WEIGHTS)}), minus AS (SELECT * FROM {_weight_sql(sq.flip(WEIGHTS))}),
letter AS (SELECT doc_id, i, seq[i] AS c FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM dna)),
score AS (SELECT l.doc_id, l.i - w.j + 1 AS p, sum(w.x) AS s FROM letter l JOIN plus w ON l.c = w.c GROUP BY 1, 2 HAVING count(*) = 5 UNION ALL SELECT l.doc_id, l.i - w.j + 1, sum(w.x) FROM letter l JOIN minus w ON l.c = w.c GROUP BY 1, 2 HAVING count(*) = 5)
SELECT d.doc_id, CAST(round(max(s.s), 5) AS DOUBLE) AS best_score FROM dna d LEFT JOIN score s ON d.doc_id = s.doc_id GROUP BY 1"""


@REG.add("q9_best_window", _BEST)
def q9_best_window(spark, folder):
    """The best log-odds window of every text on either strand."""
    return sq.with_best_score(dna(spark, folder), "seq", ["doc_id"], WEIGHTS).select("doc_id", F.round("best_score", 5).alias("best_score"))


@REG.add("q10_register_score", "SELECT hit_id, CAST(round(" + " + ".join(f"CASE matched_sequence[{j + 1}] " + " ".join(f"WHEN '{c}' THEN {w[k]:.6f}" for k, c in enumerate("ACGT")) + " ELSE -10.0 END" for j, w in enumerate(WEIGHTS)) + ", 5) AS DOUBLE) AS score FROM fimo WHERE length(matched_sequence) >= 5")
def q10_register_score(spark, folder):
    """Log-odds at a fixed offset, as one expression: letters other than A, C, G, T score -10."""
    total = F.lit(0.0)
    for j, w in enumerate(WEIGHTS):
        c = F.substring("matched_sequence", j + 1, 1)
        term = F.lit(-10.0)
        for k, letter in enumerate("ACGT"):
            term = F.when(c == letter, float(w[k])).otherwise(term)
        total = total + term
    return table(spark, folder, "fimo").where("length(matched_sequence) >= 5").select("hit_id", F.round(total, 5).alias("score"))


def _scan_sql(least):
    """All windows of five letters on both strands with their p: the share of the 1,024 words that score as high or higher, in hundredths."""
    ints = np.rint(WEIGHTS * 100).astype(int)
    rows = ", ".join(f"({j}, '{c}', {int(w[k])})" for j, w in enumerate(ints) for k, c in enumerate("ACGT"))
    letters = "(SELECT unnest(['A', 'C', 'G', 'T']) AS c)"
    return f"""WITH {DNA}, w(j, c, x) AS (VALUES {rows}), word AS (SELECT a.c || b.c || d.c || e.c || f.c AS word FROM {letters} a, {letters} b, {letters} d, {letters} e, {letters} f),
scored AS (SELECT word, sum(x) AS s FROM (SELECT word, unnest(range(1, 6)) AS i FROM word) l JOIN w ON w.j = l.i - 1 AND w.c = word[i] GROUP BY 1),
tail AS (SELECT s, sum(sum(n)) OVER (ORDER BY s DESC) / 1024.0 AS p FROM (SELECT s, count(*) AS n FROM scored GROUP BY 1) GROUP BY s),
known AS (SELECT word, '+' AS strand, scored.s, p FROM scored JOIN tail ON scored.s = tail.s UNION ALL SELECT reverse(translate(word, 'ACGT', 'TGCA')), '-', scored.s, p FROM scored JOIN tail ON scored.s = tail.s),
place AS (SELECT doc_id, i AS pos, seq[i:i + 4] AS word FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 3)) AS i FROM dna)),
hit AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, strand, k.s / 100.0 AS score, p AS p_value FROM place JOIN known k ON place.word = k.word WHERE p <= {least})"""


@REG.add("q11_q12_scan", _scan_sql(0.002) + """, r AS (SELECT *, rank() OVER (ORDER BY p_value DESC) AS down, count(*) OVER () AS n FROM hit),
q AS (SELECT p_value, min(x) OVER (ORDER BY p_value DESC) AS q FROM (SELECT p_value, max(p_value * n / (n - down + 1)) AS x FROM r GROUP BY 1))
SELECT doc_id, pos, strand, round(CAST(score AS DOUBLE), 6) AS score, round(CAST(r.p_value AS DOUBLE), 9) AS p_value, round(least(1.0, CAST(q AS DOUBLE)), 9) AS q_value FROM r JOIN q ON r.p_value = q.p_value""")
def q11_q12_scan(spark, folder):
    """Windows with p <= 0.002 on both strands; p from the exact score distribution, q by Benjamini and Hochberg over the reported windows."""
    found = materialize(sq.scan(dna(spark, folder), "seq", ["doc_id"], WEIGHTS, 0.002))
    return st.adjusted(found, "p_value", "q_value").select("doc_id", "pos", "strand", *(F.round(c, d).alias(c) for c, d in (("score", 6), ("p_value", 9), ("q_value", 9))))


_COUNTS = "c AS (SELECT motif_id, i AS pos, matched_sequence[i] AS letter, count(*) AS n FROM (SELECT motif_id, matched_sequence, unnest(range(1, length(matched_sequence) + 1)) AS i FROM fimo WHERE motif_id IS NOT NULL AND motif_id NOT LIKE '#%' AND matched_sequence IS NOT NULL) GROUP BY ALL)"


def _counts(spark, folder):
    f = table(spark, folder, "fimo").where("motif_id is not null and motif_id not like '#%'")
    return sq.counts_by_position(f, "motif_id", "matched_sequence")


@REG.add("a15_composition", f"WITH {_COUNTS} SELECT motif_id, pos, letter, n FROM c")
def a15_composition(spark, folder):
    return _counts(spark, folder).withColumn("pos", F.col("pos").cast("bigint"))


@REG.add("q13_information", f"WITH {_COUNTS}, p AS (SELECT motif_id, pos, n / sum(n) OVER (PARTITION BY motif_id, pos) AS p FROM c) SELECT motif_id, pos, round(sum(p * log2(p / 0.25)), 8) AS bits FROM p GROUP BY 1, 2")
def q13_information(spark, folder):
    ic = sq.information_content(_counts(spark, folder), "motif_id")
    return ic.select("motif_id", F.col("pos").cast("bigint").alias("pos"), F.round("bits", 8).alias("bits"))


@REG.add("q14_consensus", f"WITH {_COUNTS}, b AS (SELECT motif_id, pos, arg_max(letter, (n, -ascii(letter))) AS letter FROM c GROUP BY 1, 2) SELECT motif_id, string_agg(letter, '' ORDER BY pos) AS consensus FROM b GROUP BY 1")
def q14_consensus(spark, folder):
    return sq.consensus_letters(_counts(spark, folder), "motif_id")


@REG.add("q15_slices", "SELECT motif_id, consensus[1:4] AS head, consensus[5:] AS tail, reverse(translate(consensus, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS flipped FROM motif_library")
def q15_slices(spark, folder):
    flipped = F.reverse(F.translate("consensus", "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"))
    return table(spark, folder, "motif_library").select("motif_id", F.substring("consensus", 1, 4).alias("head"), F.expr("substring(consensus, 5)").alias("tail"), flipped.alias("flipped"))


@REG.add("q16_ranked", "SELECT 0 AS n_low_p, 0 AS n_bad_e, 0 AS n_unordered")
def q16_ranked(spark, folder):
    """What p, E and q of the comparisons must satisfy: p above 0, E p times the library, q in the order of p; rows that break it."""
    t = q16_motif_similarity(spark, folder)
    n = table(spark, folder, "motif_library").agg(F.count("*").alias("n"))  # one row
    bad = t.join(F.broadcast(n)).agg(
        F.count_if((F.col("p_value") <= 0) | (F.col("p_value") > 1)).cast("int").alias("n_low_p"), F.count_if(F.abs(F.col("e_value") - F.col("p_value") * F.col("n")) > 1e-9).cast("int").alias("n_bad_e"),
        F.count_if(F.col("q_value") < F.col("p_value") - 1e-12).cast("int").alias("n_unordered"),
    )
    return bad


@REG.add("q16_motif_similarity")
def q16_motif_similarity(spark, folder):
    """Every two motifs of the library, which is fixed and small, by their best aligned column correlation; p, E and q by a null of shuffled columns.

    The null of a query and a target is the score against the target with its columns in 99 random orders, fixed by both names.
    """
    import pyarrow as pa

    lib = table(spark, folder, "motif_library").select("motif_id", "consensus")
    pairs = lib.join(lib.select(F.col("motif_id").alias("other_id"), F.col("consensus").alias("other")), F.col("motif_id") < F.col("other_id"))

    def compare(batches):
        def matrix(text):
            rows = [[1.0 / len(sq.AMBIGUITY[c]) if x in sq.AMBIGUITY[c] else 0.0 for x in sq.LETTERS] for c in text]
            return np.array(rows)

        for b in batches:
            texts = zip(*(b.column(c).to_pylist() for c in ("motif_id", "consensus", "other_id", "other")), strict=True)
            found = [(*sq.matrix_similarity(matrix(x), matrix(y)), sq.similarity_p(matrix(x), matrix(y), 99, f"{m}|{o}")) for m, x, o, y in texts]
            cols = list(zip(*found, strict=True)) or [[], [], [], [], []]
            kinds = (pa.float64(), pa.int32(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("motif_id"), b.column("other_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["motif_id", "other_id", "score", "shift", "orientation", "overlap", "p_value"])

    n = lib.agg(F.count("*").alias("_n"))  # one row
    compared = materialize(pairs.mapInArrow(compare, "motif_id string, other_id string, score double, shift int, orientation string, overlap int, p_value double"))
    with_e = compared.join(F.broadcast(n)).withColumn("e_value", F.col("p_value") * F.col("_n")).drop("_n")
    return st.adjusted(with_e, "p_value", "q_value", ["motif_id"])


@REG.add("q18_best_site_position", "SELECT sequence_name, (\"start\" // 50) AS bin, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sequence_name, motif_id ORDER BY score DESC, hit_id) AS r FROM fimo WHERE score IS NOT NULL AND NOT isnan(score) AND sequence_name IS NOT NULL AND \"start\" >= 0) WHERE r = 1 GROUP BY 1, 2")
def q18_best_site_position(spark, folder):
    """Where the best site of each motif lies on its sequence, in bins of 50."""
    f = table(spark, folder, "fimo").where("score is not null and not isnan(score) and sequence_name is not null and start >= 0")
    # max_by drops rows whose value is null, so starts are filtered before: the best site with a known start
    best = f.groupBy("sequence_name", "motif_id").agg(F.max_by("start", F.struct("score", -F.col("hit_id"))).alias("at"))
    return best.groupBy("sequence_name", F.floor(F.col("at") / 50).alias("bin")).agg(F.count("*").alias("n"))


_SITES = """best AS (SELECT sequence_name, motif_id, arg_max("start", (score, -hit_id)) AS p FROM fimo WHERE score IS NOT NULL AND NOT isnan(score) AND sequence_name IS NOT NULL AND motif_id IS NOT NULL AND "start" BETWEEN 1 AND 200 GROUP BY 1, 2),
c AS (SELECT motif_id, count(*) AS n, count(*) FILTER (p BETWEEN 76 AND 125) AS x FROM best GROUP BY 1)"""


@REG.add("q18_central_enrichment", f"""WITH {_SITES}, t AS (SELECT *, unnest(range(x, n + 1)) AS i FROM c)
SELECT motif_id, n, x, round(least(1.0, sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.25) + (n - i) * ln(0.75)))) + 1e-12, 9) AS p FROM t GROUP BY 1, 2, 3""")
def q18_central_enrichment(spark, folder):
    """Whether best sites in the first 200 positions lie in the middle quarter more often than a quarter of the time: upper binomial tails."""
    f = table(spark, folder, "fimo").where("score is not null and not isnan(score) and sequence_name is not null and motif_id is not null and start between 1 and 200")
    best = f.groupBy("sequence_name", "motif_id").agg(F.max_by("start", F.struct("score", -F.col("hit_id"))).alias("at"))
    c = best.groupBy("motif_id").agg(F.count("*").alias("n"), F.count_if(F.col("at").between(76, 125)).alias("x"))
    p = st.per_row(lambda x, n: sp.binomial_tail(int(x), int(n), 0.25), "double", F.col("x"), F.col("n"))
    return c.select("motif_id", "n", "x", F.round(p + 1e-12, 9).alias("p"))  # a quarter's powers end in fives: none is left to rounding


@REG.add("q19_shuffle_keeps", "SELECT 2 * count(*) AS n, 0 AS n_letters_lost, 0 AS n_neighbours_lost, 0 AS n_ends_moved FROM fimo WHERE matched_sequence IS NOT NULL")
def q19_shuffle_keeps(spark, folder):
    """What shuffles must keep: every letter, every pair of neighbours, both ends; shuffles that lose one."""
    f = table(spark, folder, "fimo").select("hit_id", "matched_sequence")
    s = q19_shuffle(spark, folder).join(f, "hit_id")
    a, b = F.col("matched_sequence"), F.col("shuffled")
    letters = lambda c: F.sort_array(F.split(c, ""))
    n = F.length("matched_sequence")
    pairs = lambda c: F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    ends = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.substring(a, -1, 1) == F.substring(b, -1, 1))
    return s.agg(
        F.count("*").alias("n"), F.count_if(letters(a) != letters(b)).cast("int").alias("n_letters_lost"),
        F.count_if(pairs(a) != pairs(b)).cast("int").alias("n_neighbours_lost"), F.count_if(~ends).cast("int").alias("n_ends_moved"),
    )


@REG.add("q19_shuffle")
def q19_shuffle(spark, folder):
    """Two shuffles of every matched sequence that keep neighbour counts."""
    f = table(spark, folder, "fimo").select("hit_id", "matched_sequence")
    return sq.shuffled(f, "hit_id", "matched_sequence", 2, 20260801)


@REG.add("q20_parsing", "SELECT hit_id, regexp_extract(sequence_name, '^([a-z]+)_?([0-9]*)', 1) AS kind, lpad(regexp_extract(sequence_name, '([0-9]+)$', 1), 6, '0') AS number, upper(trim(coalesce(motif_alt_id, 'none'))) AS label, regexp_replace(motif_id, '^LIB0*', 'L', 'g') AS short FROM fimo")
def q20_parsing(spark, folder):
    name = "sequence_name"
    return table(spark, folder, "fimo").select(
        "hit_id", F.regexp_extract(name, "^([a-z]+)_?([0-9]*)", 1).alias("kind"), F.lpad(F.regexp_extract(name, "([0-9]+)$", 1), 6, "0").alias("number"),
        F.upper(F.trim(F.coalesce("motif_alt_id", F.lit("none")))).alias("label"), F.regexp_replace("motif_id", "^LIB0*", "L").alias("short"),
    )


@REG.add("q21_synonyms", """WITH s(term, synonym) AS (VALUES ('promoter', 'promoter'), ('promoter', 'promotor'), ('enhancer', 'enhancer'), ('enhancer', 'potenciador'), ('enhancer', 'activateur'), ('library', 'librar'), ('library', 'biblioth'))
SELECT d.source, s.term, count(DISTINCT d.doc_id) AS n_docs, max(d.n_chars) AS longest FROM documents d JOIN s ON regexp_matches(lower(d.text), '\\b' || s.synonym) GROUP BY 1, 2""")
def q21_synonyms(spark, folder):
    """Word-anchored search of all synonyms in one pass over each text."""
    terms = {"promoter": ["promoter", "promotor"], "enhancer": ["enhancer", "potenciador", "activateur"], "library": ["librar", "biblioth"]}
    d = table(spark, folder, "documents").where("text is not null")
    low = F.lower("text")
    met = F.array_compact(F.array(*(F.when(low.rlike(r"\b(?:" + "|".join(s) + ")"), F.lit(t)) for t, s in terms.items())))
    hits = d.select("source", "n_chars", F.explode(met).alias("term"))
    return hits.groupBy("source", "term").agg(F.count("*").alias("n_docs"), F.max("n_chars").alias("longest"))


@REG.add("q22_tail_run", "SELECT hit_id, length(regexp_extract(matched_sequence, '^[AGR]*', 0)) AS run FROM fimo")
def q22_tail_run(spark, folder):
    return table(spark, folder, "fimo").select("hit_id", sq.tail_run(F.col("matched_sequence"), "AGR").cast("bigint").alias("run"))


@REG.add("q23_formatting", "SELECT match_id, printf('%.2e', p_value) AS three_digits, printf('%.4e', e_value) AS fixed FROM tomtom WHERE p_value IS NOT NULL AND NOT isnan(p_value) AND e_value IS NOT NULL")
def q23_formatting(spark, folder):
    t = table(spark, folder, "tomtom").where("p_value is not null and not isnan(p_value) and e_value is not null")
    return t.select("match_id", F.format_string("%.2e", "p_value").alias("three_digits"), F.format_string("%.4e", "e_value").alias("fixed"))


@REG.add("q24_strands_apart", f"WITH {DNA}, f AS (SELECT contains(seq, 'ACGTG') AS fwd, contains(seq, 'ACGTG') OR contains(seq, 'CACGT') AS any_strand FROM dna) SELECT fwd, any_strand, count(*) AS n FROM f GROUP BY 1, 2")
def q24_strands_apart(spark, folder):
    d = dna(spark, folder)
    flags = d.select((sq.count_pattern("seq", "ACGTG", both=False) > 0).alias("fwd"), (sq.count_pattern("seq", "ACGTG") > 0).alias("any_strand"))
    return flags.groupBy("fwd", "any_strand").agg(F.count("*").alias("n"))


QUERIES, SQL = REG.queries, REG.sql
