"""Sequences over A, C, G, T (and N): Column functions, and matrix scores in NumPy."""

from __future__ import annotations

import random
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = "ACGT"

#: The ambiguity codes of nucleotides and what each stands for.
AMBIGUITY = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
_CODE = {frozenset(v): k for k, v in AMBIGUITY.items()}


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def complement_pattern(pattern: str) -> str:
    """Reverse complement of a pattern of ambiguity codes."""
    flip = str.maketrans("ACGT", "TGCA")
    return "".join(_CODE[frozenset(AMBIGUITY[c].translate(flip))] for c in reversed(pattern))


def pattern_regex(pattern: str) -> str:
    """A regular expression for a pattern of ambiguity codes."""
    return "".join(c if len(AMBIGUITY[c]) == 1 else f"[{AMBIGUITY[c]}]" for c in pattern)


def count_pattern(seq: Column | str, pattern: str, both: bool = True) -> Column:
    """Overlapping matches of a pattern, and with ``both`` of its reverse complement too (palindromes count on both strands)."""
    n = F.regexp_count(seq, F.lit(f"(?={pattern_regex(pattern)})"))
    return n + F.regexp_count(seq, F.lit(f"(?={pattern_regex(complement_pattern(pattern))})")) if both else n


def pattern_positions(seq: Column, pattern: str) -> Column:
    """Positions, from 1, of all matches of a plain pattern, overlapping ones included, ascending."""
    parts = F.split(seq, f"(?={pattern_regex(pattern)})")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))
    first = seq.rlike(f"^{pattern_regex(pattern)}")

    def step(acc: Column, part: Column) -> Column:  # every part but the first begins at a match
        found = F.when((acc["at"] > 1) | first, F.concat(acc["found"], F.array(acc["at"]))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(part)).alias("at"), found.alias("found"))

    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def gc_fraction(seq: Column | str) -> Column:
    """Share of G and C among all letters, N included; null for an empty sequence."""
    c = F.col(seq) if isinstance(seq, str) else seq
    return (F.length(c) - F.length(F.translate(c, "GCgc", ""))) / F.nullif(F.length(c), F.lit(0))


def masked_count(seq: Column | str) -> Column:
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.length(c) - F.length(F.translate(c, "Nn", ""))


def agrees_unmasked(masked: Column, raw: Column) -> Column:
    """Whether two sequences have equal length and differ only where the first is N."""
    same = F.zip_with(F.split(masked, ""), F.split(raw, ""), lambda m, r: (m == "N") | (m == r))
    return (F.length(masked) == F.length(raw)) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def mask(seq: Column, intervals: Column) -> Column:
    """The sequence with N at the half-open 0-based ``intervals`` (array of struct s, e); parts outside are ignored."""

    def cover(acc: Column, i: Column) -> Column:
        s, e = F.greatest(i["s"], F.lit(0)), F.least(i["e"], F.length(acc))
        return F.when(e > s, F.concat(F.substring(acc, F.lit(1), s), F.repeat(F.lit("N"), e - s), F.substring(acc, e + 1, F.length(acc)))).otherwise(acc)

    return F.aggregate(intervals, seq, cover)


def tail_run(seq: Column, letters: str) -> Column:
    """Length of the leading run of the given letters."""
    return F.length(F.regexp_extract(seq, f"^[{letters}]*", 0))


def chunks(df: DataFrame, name: str, seq: str, size: int, margin: int) -> DataFrame:
    """(name, chunk, from_pos, part): each sequence in pieces of ``size`` that reach ``margin`` into the next."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(size))
    cut = df.select(name, seq, F.explode(starts).alias("from_pos"))
    return cut.select(name, F.floor(F.col("from_pos") / size).alias("chunk"), "from_pos", F.substring(F.col(seq), F.col("from_pos") + 1, F.lit(size + margin)).alias("part"))


def fetch(intervals: DataFrame, pieces: DataFrame, name: str, start: str, end: str, size: int) -> DataFrame:
    """Intervals, no longer than the pieces' margin, with the letters of their half-open range."""
    asked = intervals.withColumn("chunk", F.floor(F.col(start) / size))
    met = asked.join(pieces, [name, "chunk"])
    return met.withColumn("letters", F.substring(F.col("part"), F.col(start) - F.col("from_pos") + 1, F.col(end) - F.col(start))).drop("chunk", "from_pos", "part")


# matrices ---------------------------------------------------------------------------------------


def counts_by_position(df: DataFrame, group: str, seq: str) -> DataFrame:
    """(group, pos, letter, n): how often each letter stands at each position, from 1."""
    letters = df.where(F.col(seq).isNotNull()).groupBy(group, seq).agg(F.count("*").alias("_c"))  # equal sequences are one
    one = letters.select(group, "_c", F.posexplode(F.split(seq, "")).alias("_p", "letter")).where(F.col("letter") != "")
    return one.groupBy(group, (F.col("_p") + 1).alias("pos"), "letter").agg(F.sum("_c").alias("n"))


def information_content(counts: DataFrame, group: str, background: float = 0.25) -> DataFrame:
    """(group, pos, bits): sum of p log2(p / background) at each position."""
    from pyspark.sql import Window as W

    p = F.col("n") / F.sum("n").over(W.partitionBy(group, "pos"))
    return counts.select(group, "pos", (p * F.log2(p / background)).alias("b")).groupBy(group, "pos").agg(F.sum("b").alias("bits"))


def consensus_letters(counts: DataFrame, group: str) -> DataFrame:
    """(group, consensus): the most frequent letter at each position, ties to the first in the alphabet."""
    best = counts.groupBy(group, "pos").agg(F.max_by("letter", F.struct("n", -F.ascii("letter"))).alias("letter"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "letter")))
    return best.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["letter"]), "").alias("consensus"))


def consensus_codes(matrix: np.ndarray, least: float = 0.25) -> str:
    """One ambiguity code per row: the letters with at least that probability, N where there are none."""
    return "".join(_CODE[frozenset(LETTERS[i] for i in np.flatnonzero(row >= least)) or frozenset(LETTERS)] for row in matrix)


def log_odds(matrix: np.ndarray, background: np.ndarray | None = None, pseudo: float = 1e-3) -> np.ndarray:
    """log2 of row probabilities, with a pseudocount, over the background."""
    bg = np.full(4, 0.25) if background is None else np.asarray(background)
    return np.log2((matrix + pseudo) / (1 + 4 * pseudo) / bg)


def flip(matrix: np.ndarray) -> np.ndarray:
    """The matrix of the reverse complement."""
    return matrix[::-1, ::-1]


_CODES = np.full(256, 4, dtype=np.int64)
for _i, _c in enumerate(LETTERS):
    _CODES[ord(_c)] = _CODES[ord(_c.lower())] = _i


def encoded(seq: str) -> np.ndarray:
    return _CODES[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]


def window_scores(codes: np.ndarray, weights: np.ndarray, unknown: float = -10.0) -> np.ndarray:
    """The score of every window; letters other than A, C, G, T score ``unknown`` each."""
    w = len(weights)
    if len(codes) < w:
        return np.empty(0)
    padded = np.column_stack([weights, np.full(w, unknown)])
    n = len(codes) - w + 1
    return sum(padded[j][codes[j : j + n]] for j in range(w))


def with_best_score(df: DataFrame, seq: str, keep: list[str], weights: np.ndarray, unknown: float = -10.0) -> DataFrame:
    """``keep`` and the best window on either strand: best_score, best_pos (from 1), best_strand; nulls where no window fits.

    Ties: the first position, then ``+``.
    """
    rows = df.select(*keep, F.col(seq).alias("_seq"))
    out = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL("best_score double, best_pos int, best_strand string").fields])
    both = weights, flip(weights)

    def score(batches):
        for b in batches:
            found = [[], [], []]
            for s in b.column("_seq").to_pylist():
                codes = encoded(s) if s else np.empty(0, dtype=np.int64)
                best = (None, None, None)
                for strand, w in zip("+-", both, strict=True):
                    scores = window_scores(codes, w, unknown)
                    if len(scores):
                        at = int(scores.argmax())
                        if best[0] is None or scores[at] > best[0] or (scores[at] == best[0] and at + 1 < best[1]):
                            best = float(scores[at]), at + 1, strand
                for k, v in zip(found, best, strict=True):
                    k.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(found[0], pa.float64()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.string())], names=out.fieldNames())

    return rows.mapInArrow(score, out)


def score_distribution(weights: np.ndarray, background: np.ndarray | None = None, scale: float = 100.0) -> tuple[np.ndarray, int]:
    """Probability of each integer score (``round(scale * weight)`` summed) under the background, and the score of the first one."""
    bg = np.full(4, 0.25) if background is None else np.asarray(background)
    ints = np.rint(weights * scale).astype(np.int64)
    low = int(ints.min(axis=1).sum())
    pmf = np.ones(1)
    for row in ints:
        row = row - row.min()
        wider = np.zeros(len(pmf) + int(row.max()))
        for k in range(4):
            wider[row[k] : row[k] + len(pmf)] += bg[k] * pmf
        pmf = wider
    return pmf, low


def tail_probabilities(weights: np.ndarray, background: np.ndarray | None = None, scale: float = 100.0) -> tuple[np.ndarray, int]:
    """P(score >= s) for each integer score s, from the first one on."""
    pmf, low = score_distribution(weights, background, scale)
    return np.minimum(np.cumsum(pmf[::-1])[::-1], 1.0), low


def scan(df: DataFrame, seq: str, keep: list[str], weights: np.ndarray, most_p: float, background: np.ndarray | None = None, scale: float = 100.0) -> DataFrame:
    """All windows, on both strands, whose score has p <= ``most_p``: keep, pos (from 1), strand, score, p_value."""
    rows = df.select(*keep, F.col(seq).alias("_seq"))
    out = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL("pos int, strand string, score double, p_value double").fields])
    ints = np.rint(weights * scale)
    tails, low = tail_probabilities(weights, background, scale)

    def hits(batches):
        for b in batches:
            at = [[], [], [], [], []]
            for i, s in enumerate(b.column("_seq").to_pylist()):
                if not s:
                    continue
                codes = encoded(s)
                for strand, w in (("+", ints), ("-", flip(ints))):
                    scores = window_scores(codes, w, -1e12)
                    if not len(scores):
                        continue
                    known = scores >= low
                    p = np.ones(len(scores))
                    p[known] = tails[(scores[known] - low).astype(np.int64)]
                    for j in np.flatnonzero(p <= most_p):
                        for k, v in zip(at, (i, int(j) + 1, strand, float(scores[j]) / scale, float(p[j])), strict=True):
                            k.append(v)
            if at[0]:
                taken = [b.column(c).take(pa.array(at[0])) for c in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(at[1], pa.int32()), pa.array(at[2]), pa.array(at[3]), pa.array(at[4])], names=out.fieldNames())

    return rows.mapInArrow(hits, out)


def dinucleotide_shuffle(seq: str, rng: random.Random) -> str:
    """A random sequence with the same count of every pair of neighbours: a random Eulerian path from the first letter to the last."""
    if len(seq) < 3:
        return seq
    last = seq[-1]
    after: dict[str, list[str]] = {}
    for a, b in pairwise(seq):
        after.setdefault(a, []).append(b)
    while True:  # last edges must lead every letter to the end: draw until they do
        exits = {a: rng.choice(outs) for a, outs in after.items() if a != last}
        reached = {last}
        while True:
            more = {a for a, b in exits.items() if b in reached and a not in reached}
            if not more:
                break
            reached |= more
        if len(reached) == len(exits) + 1:
            break
    order = {}
    for a, outs in after.items():
        rest = list(outs)
        if a != last:
            rest.remove(exits[a])
        rng.shuffle(rest)
        order[a] = rest + ([exits[a]] if a != last else [])
    out, here = [seq[0]], seq[0]
    used = dict.fromkeys(order, 0)
    for _ in range(len(seq) - 1):
        nxt = order[here][used[here]]
        used[here] += 1
        out.append(nxt)
        here = nxt
    return "".join(out)


def shuffled(df: DataFrame, name: str, seq: str, copies: int, seed: int) -> DataFrame:
    """(name, copy, shuffled): ``copies`` shuffles of each sequence that keep neighbour counts; the seed and the name fix them."""
    rows = df.where(F.col(seq).isNotNull()).select(name, F.col(seq).alias("_seq"))
    out = T.StructType([rows.schema[0], *T.StructType.fromDDL("copy int, shuffled string").fields])

    def draw(batches):
        for b in batches:
            names, seqs = b.column(0).to_pylist(), b.column("_seq").to_pylist()
            at, copy, new = [], [], []
            for i, (n, s) in enumerate(zip(names, seqs, strict=True)):
                for c in range(copies):
                    at.append(i)
                    copy.append(c + 1)
                    new.append(dinucleotide_shuffle(s, random.Random(f"{seed}|{n}|{c}")))
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(copy, pa.int32()), pa.array(new)], names=out.fieldNames())

    return rows.mapInArrow(draw, out)


def matrix_similarity(a: np.ndarray, b: np.ndarray, least: int = 4) -> tuple[float, int, str, int]:
    """Best mean column correlation over all offsets with at least ``least`` common columns: (score, offset, orientation, overlap)."""
    def centre(m):
        m = m - m.mean(axis=1, keepdims=True)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    best = (-np.inf, 0, "+", 0)
    x = centre(a)
    for orientation, other in (("+", b), ("-", flip(b))):
        corr = x @ centre(other).T
        for offset in range(-(len(b) - 1), len(a)):
            lo, hi = max(0, offset), min(len(a), offset + len(b))
            if hi - lo < min(least, len(a), len(b)):
                continue
            score = float(np.trace(corr[lo:hi, lo - offset : hi - offset])) / max(len(a), len(b))
            if score > best[0] + 1e-12:
                best = (score, offset, orientation, hi - lo)
    return best


def similarity_p(a: np.ndarray, b: np.ndarray, draws: int, key: str, least: int = 4) -> float:
    """Share of ``draws`` column orders of ``b`` that match ``a`` as well as ``b`` does, ``b`` itself counted: never 0, fixed by ``key``."""
    rng = random.Random(key)
    seen = matrix_similarity(a, b, least)[0]
    order = list(range(len(b)))
    as_good = 1
    for _ in range(draws):
        rng.shuffle(order)
        as_good += matrix_similarity(a, b[order], least)[0] >= seen - 1e-12
    return as_good / (draws + 1)
