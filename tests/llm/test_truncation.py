import random

import pytest

from strandloom.llm import truncation as tr

SUBJECTS = ["The library near zin{n}", "A broad enhancer at chr{n}", "Each replicate of batch {n}", "Nobody on bench {n}"]
VERBS = ["was stained twice", "was counted, resuspended and frozen", "stayed uniform for {n} hours", "gave a product of approx. {n} bp"]
TAILS = [" in the hindgut", " in every run since March", " (see Fig. {n} and the table)", ", by {n}.{n} % on average"]


def sentence(rng):
    n = lambda: rng.randrange(1, 400)
    s = rng.choice(SUBJECTS) + " " + rng.choice(VERBS) + rng.choice(TAILS)
    while "{n}" in s:
        s = s.replace("{n}", str(n()), 1)
    return s + rng.choice([".", ".", ".", "!"])


CLOSINGS = ["Keywords: hindgut, library", "done, plates stained", "no signal again :(", "-- end of entry {n} --", "Accession INV{n}", "n = {n} embryos, 3 replicates"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    rows, cut = [], set()
    for i in range(1200):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 12)))
        kind = rng.random()
        if kind < 0.25:
            text += "\n" + rng.choice(CLOSINGS).replace("{n}", str(rng.randrange(999)))
        elif kind < 0.35:
            last = text.rfind(". ") + 2
            at = rng.randrange(max(last + 5, 8), len(text) - 2)
            if text[:at].rstrip() and text[:at].rstrip()[-1] not in ".!":
                text = text[:at] + rng.choice(["", "...", "…", " ", "\n", "</p>", "�"])
                cut.add(i)
        elif kind < 0.4:
            text = f"<p>{text}</p>"
        rows.append((i, text))
    return rows, cut


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "id bigint, body string, evidence string, key int")
    return {r["id"]: r["evidence"] for r in tr.truncated(df, "id", "body").collect()}


def test_cut_texts_are_found(spark, corpus):
    rows, cut = corpus
    got = run(spark, rows)
    assert len(cut) > 60
    assert len(cut & got.keys()) >= 0.97 * len(cut)
    assert len(got.keys() - cut) <= 0.02 * len(cut) + 1


def test_cut_text_sent_again_many_times(spark, corpus):
    rows, cut = corpus
    first = min(cut)
    hot = [(10_000 + k, rows[first][1]) for k in range(600)]
    got = run(spark, rows + hot)
    assert {i for i, _ in hot} <= got.keys() and first in got


def test_abbreviations_and_half_numbers(spark, corpus):
    rows, _ = corpus
    extra = [(5001, "Each replicate of batch 3 gave a product of approx."), (5002, "Nobody on bench 7 stayed uniform for 4 hours, by 3."), (5003, "The library near zin4 was stained twice in the hindgut."), (5004, None), (5005, ""), (5006, " \n")]
    got = run(spark, rows + extra)
    assert {5001, 5002} <= got.keys() and not {5003, 5004, 5005, 5006} & got.keys()


def test_texts_cut_at_the_same_fragment(spark):
    ends = ["The permutation test was run twice.", "Nobody had sequenced the library before.", "After thawing, cells were counted.", "Reads were mapped with care."]
    whole = [(i, f"Batch {i} came late. {ends[i % 4]}") for i in range(80)]
    cuts = ["The perm", "Nobody had seque", "After t", "Th", "Reads were mapped wi"]
    cut = [(100 + 10 * k + j, f"{w} plates were stained. {c}") for k, c in enumerate(cuts) for j, w in enumerate(["Eleven", "Twelve", "Thirteen", "Fourteen"])]
    closed = [(500 + j, f"{w} plates were stained.\n{c}") for j, w in enumerate(["One", "Two", "Three"]) for c in ["Keywords: hindgut, library"]]
    got = run(spark, whole + cut + closed)
    assert got.keys() == {i for i, _ in cut}


def test_longer_copies_go_on_in_the_line(spark):
    line = "Zebrafish larvae imaged overnight in agarose kept their shape"
    number = "Quite unlike the earlier plates, these differed clearly (n = 4, p = 0."
    closing = "Qualified staff ran all of the plates twice and froze them.\nKeywords: larvae"
    stop = "Xenopus eggs were kept overnight and were then fixed twice."
    rows = [(1, line), (2, line + " and colour."), (3, number), (4, number + "05) in the end."), (5, closing), (6, closing + " \nMore text."), (7, stop), (8, stop + " They were stained.")]
    rows += [(9, line + " and"), (10, line + "\nNext line.")]
    assert run(spark, rows) == {1: "text", 3: "text", 9: "text"}


def test_strict_prefixes(spark):
    long = "The library near zin4 was stained twice in the hindgut, by 3.2 % on average, and the plates went on."
    rows = [(1, long), (2, long[:70]), (3, long[:70] + "…"), (4, long), (5, long[:30]), (6, None), (9, long[:3]), (10, "x"), (11, "Th"), (7, "x" * 60), (8, "x" * 3000)]
    df = spark.createDataFrame(rows, "i int, t string")
    assert sorted(tuple(r) for r in tr.strict_prefixes(df, "i", "t").collect()) == [(2, long[70]), (3, long[70]), (5, long[30]), (7, "x"), (9, " "), (10, "x"), (11, "e")]
    assert tr.strict_prefixes(df.limit(0), "i", "t").collect() == []


def test_very_long_text_and_rates(spark, corpus):
    rows, cut = corpus
    text = " ".join(t for _, t in rows[:1000] if t[-1] in ".!")
    df = spark.createDataFrame([(i, t, "s" if i % 2 else None) for i, t in [*rows, (9000, text + " The library near zi"), (9001, None)]], "id bigint, t string, src string")
    rates = {r["src"]: r for r in tr.truncation_rates(df, "id", "t", "src").collect()}
    assert rates[None]["n_texts"] + rates["s"]["n_texts"] == len(rows) + 1
    assert rates["s"]["n_cut"] + rates[None]["n_cut"] == pytest.approx(len(cut) + 1, abs=4)
    assert tr.truncated(df.limit(0), "id", "t").collect() == []


def test_units():
    assert tr.units("A b. C d! (E f.)\nG: h\r\n\r\n<p>I j.</p>") == ["A b.", "C d!", "(E f.)", "G: h", "I j."]
    assert tr.core("ab c… </p>\n") == "ab c" and tr.core("ab-") == "ab" and tr.core("a -") == "a -" and tr.core("…") == ""
    assert tr.shape("chr3R:12-40 TTGACA is 4.5") == f"chr#R:#-# {tr._RUN} is #.#"


def test_sorted_neighbours_find_strict_prefixes(spark):
    rng = random.Random(4)
    asked = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    longer = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    a = spark.createDataFrame(list(enumerate(asked)), "item int, shape string").repartition(5)
    b = spark.createDataFrame([(x,) for x in longer], "shape string")
    got = sorted(r[0] for r in tr.prefixes_among(a, b, "shape", "item").collect())
    assert got == [i for i, x in enumerate(asked) if any(y.startswith(x) and y != x for y in longer)]
    assert tr.prefixes_among(a.limit(0), b, "shape", "item").collect() == []


def test_prefixes_of_whole_units(spark):
    """A cut unit whose beginning stands whole elsewhere, once; the same unit with a full stop is no going-on."""
    cut = "Twelve plates came. At stage 12 the late signal near the summit was still wea"
    note = "Nine plates came.\nwaiting for batch 3 of the late plates from the old bench"
    rows = [(1, cut), (2, "At stage 7 the late signal near the summit was still weaker than before."), (3, note), (4, "Ten plates. waiting for batch 30 of the late plates from the old bench.")]
    assert run(spark, rows) == {1: "prefix"}


def test_last_unit_is_the_last_of_all(corpus):
    rng = random.Random(6)
    rows, _ = corpus
    for _ in range(400):
        text = "".join(rng.choice([t, "<p>", "</b>\n", '"A b) ', "(see fig. 3) ", ".) ", "\n\n", "x" * rng.randrange(900)]) for _, t in rng.sample(rows, 6))
        c = tr.core(text)
        assert tr.last_unit(c) == (tr.units(c) or [""])[-1]


def test_long_words_before_stops():
    word = "a" * 90
    assert tr.stop_key(f"x {word}.") == tr.stop_key(f"and y {word}.") != tr.stop_key(f"x {word[1:]}.")
    assert tr.is_final("A b." + ")" * 30) and not tr.is_final("A b" + ")" * 30) and not tr.is_final("")
