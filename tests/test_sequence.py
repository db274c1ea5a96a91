import random
from collections import Counter
from itertools import product

import numpy as np
import pytest

from pyspark.sql import functions as F
from strandloom.functions import sequence as sq

RNG = random.Random(3)
SEQS = ["", "A", "ACGTG", "CACGTG", "AAAA", "ACGTNACGTG"] + ["".join(RNG.choice("ACGT") for _ in range(n)) for n in (7, 40, 333, 20_000)]


def flip(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SEQS)] + [(99, None)], "i int, seq string")


def occurrences(s, k):
    return [i + 1 for i in range(len(s) - len(k) + 1) if s[i : i + len(k)] == k]


def test_patterns(seqs):
    got = {r["i"]: r for r in seqs.select("i", sq.count_pattern("seq", "ACGTG").alias("n"), sq.count_pattern("seq", "AA", both=False).alias("aa"), sq.pattern_positions(F.col("seq"), "AA").alias("p"), sq.reverse_complement("seq").alias("rc"), sq.gc_fraction("seq").alias("gc"), sq.tail_run(F.col("seq"), "AC").alias("run")).collect()}
    for i, s in enumerate(SEQS):
        r = got[i]
        assert r["n"] == len(occurrences(s, "ACGTG")) + len(occurrences(s, "CACGT"))
        assert r["aa"] == len(occurrences(s, "AA")) and r["p"] == occurrences(s, "AA")
        assert r["rc"] == flip(s)
        assert (r["gc"] is None) == (s == "") and (not s or r["gc"] == pytest.approx((s.count("G") + s.count("C")) / len(s)))
        assert r["run"] == len(s) - len(s.lstrip("AC"))
    assert got[99]["n"] is None and got[99]["rc"] is None and got[99]["gc"] is None


def test_codes():
    assert sq.pattern_regex("CANNTG") == "CA[ACGT][ACGT]TG"
    assert sq.complement_pattern("RCGTG") == "CACGY" and sq.complement_pattern("CANNTG") == "CANNTG"
    assert sq.consensus_codes(np.array([[0.5, 0, 0.5, 0], [0.25, 0.25, 0.25, 0.25], [0, 0, 0, 1], [0.2, 0.2, 0.2, 0.2]])) == "RNTN"


def test_mask_and_check(spark):
    df = spark.createDataFrame([("ACGTACGT", [(2, 4), (6, 99), (-3, 1)]), ("", [(0, 2)]), ("ACGT", [])], "s string, m array<struct<s:int,e:int>>")
    got = df.select(sq.mask(F.col("s"), F.col("m")).alias("x"), "s").select("x", sq.masked_count("x"), sq.agrees_unmasked(F.col("x"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("NCNNACNN", 5, True), ("", 0, True), ("ACGT", 0, True)]
    bad = spark.createDataFrame([("ACNT", "ACGA"), ("AC", "ACG"), (None, "A")], "m string, r string")
    assert [r[0] for r in bad.select(sq.agrees_unmasked(F.col("m"), F.col("r"))).collect()] == [False, False, None]


def test_fetch_over_piece_edges(spark):
    s = SEQS[-1]
    df = spark.createDataFrame([("c", s), ("d", "")], "name string, seq string")
    at = [0, 1, 95, 99, 100, 101, 10_000, 19_990, 19_999]
    asked = spark.createDataFrame([("c", a, a + 20) for a in at], "name string, s int, e int")
    got = {r["s"]: r["letters"] for r in sq.fetch(asked, sq.chunks(df, "name", "seq", 100, 30), "name", "s", "e", 100).collect()}
    assert got == {a: s[a : a + 20] for a in at}


def test_matrix_columns(spark):
    df = spark.createDataFrame([("m", "ACG"), ("m", "ACG"), ("m", "ATG"), ("m", None), ("e", "")], "g string, s string")
    counts = sq.counts_by_position(df, "g", "s")
    assert sorted(tuple(r) for r in counts.collect()) == [("m", 1, "A", 3), ("m", 2, "C", 2), ("m", 2, "T", 1), ("m", 3, "G", 3)]
    bits = {r["pos"]: r["bits"] for r in sq.information_content(counts, "g").collect()}
    assert bits[1] == pytest.approx(2) and bits[2] == pytest.approx(2 - (-(2 / 3) * np.log2(2 / 3) - (1 / 3) * np.log2(1 / 3)))
    assert sq.consensus_letters(counts, "g").first()["consensus"] == "ACG"


W = np.round(sq.log_odds(np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.25, 0.25, 0.25, 0.25]])), 2)


def best(s):
    found = []
    for d, t in (("+", s), ("-", None)):
        w = W if d == "+" else W[::-1, ::-1]
        for i in range(len(s) - 2):
            found.append((sum(w[j]["ACGT".index(s[i + j])] if s[i + j] in "ACGT" else -10 for j in range(3)), -i, d == "+"))
    return max(found) if found else None


def test_best_window_matches_a_loop(seqs):
    for r in sq.with_best_score(seqs, "seq", ["i"], W).collect():
        s = SEQS[r["i"]] if r["i"] != 99 else ""
        want = best(s)
        assert (r["best_score"] is None) == (want is None)
        if want:
            assert r["best_score"] == pytest.approx(want[0]) and r["best_pos"] == 1 - want[1]


def test_tail_probabilities_are_exact():
    bg = np.array([0.3, 0.2, 0.2, 0.3])
    tails, low = sq.tail_probabilities(W, bg)
    scores = {}
    for word in product(range(4), repeat=3):
        s = int(sum(np.rint(W[j, c] * 100) for j, c in enumerate(word)))
        scores[s] = scores.get(s, 0) + np.prod(bg[list(word)])
    for s in scores:
        assert tails[s - low] == pytest.approx(sum(p for t, p in scores.items() if t >= s))
    assert tails[0] == pytest.approx(1)


def test_scan_finds_what_the_tail_allows(spark):
    df = spark.createDataFrame([(1, "AGAAGCTT"), (2, ""), (3, None), (4, "AG")], "i int, seq string")
    got = sq.scan(df, "seq", ["i"], W, 0.07)
    assert {(r["i"], r["pos"], r["strand"]) for r in got.collect()} >= {(1, 1, "+"), (1, 4, "+")}
    assert all(r["p_value"] <= 0.07 for r in got.collect())


def test_shuffle_keeps_neighbours(spark):
    rng = random.Random(1)
    for s in [x for x in SEQS if len(x) < 1000] + ["AAAACCCCGGGG", "ACACACAC"]:
        t = sq.dinucleotide_shuffle(s, rng)
        assert Counter(zip(s, s[1:], strict=False)) == Counter(zip(t, t[1:], strict=False)) and t[:1] == s[:1]
    df = spark.createDataFrame([(1, SEQS[7]), (2, None), (3, "")], "i int, s string")
    one, two = (sorted(map(tuple, sq.shuffled(df, "i", "s", 2, 9).collect())) for _ in range(2))
    assert one == two and len(one) == 4 and one[0][2] != one[1][2]


def test_similarity_finds_offset_and_strand():
    a = np.array([[0.9, 0.05, 0.03, 0.02], [0.1, 0.7, 0.1, 0.1], [0.02, 0.03, 0.05, 0.9], [0.1, 0.2, 0.6, 0.1], [0.8, 0.1, 0.05, 0.05]])
    assert sq.matrix_similarity(a, a)[1:] == (0, "+", 5) and sq.matrix_similarity(a, a)[0] == pytest.approx(1)
    assert sq.matrix_similarity(a, sq.flip(a))[2] == "-"
    assert sq.matrix_similarity(a, a[1:])[1] == 1
