"""Text cut off by field limits: values that are strict prefixes of longer copies elsewhere.

Four self-joins by prefix, from large to small:

* ``text``: whole texts. Fixed-length prefixes are hashed to find texts that may go on
  elsewhere, and their hashes at the exact length decide;
* ``prefix``: last units, the sentence or line a text ends in. Their shapes and those of whole
  units that begin with the same six words are sorted, and a shape is a strict prefix of another one if its
  next neighbour begins with it; units of up to six words are looked up by their letters;
* ``unit``: last units that no whole unit repeats to the end, by their first 1, 2, 3, 4 and 6 words,
  against the same prefixes of all units, which tell how such units run on and how they end
  where they are whole; the word it stops in, which may be broken, only by its letters behind the words before it;
* ``stop``: last words. What follows a full stop after the same word elsewhere tells an
  abbreviation or half a number from the end of a sentence.

A text is cut if its last unit is open (no mark that ends a sentence, or one that
ends none here) and longer copies of the text or of the unit go on where it stops.

Texts are read three times: for what they end in and their own prefixes; for what goes on
elsewhere, against a map of fixed size of the keys asked for; for exact hashes of the few
texts that share a prefix with one that may go on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.ordered import PID, carried, range_sorted
from strandloom.operators.skew import join_unique
from strandloom.session import materialize

#: Words of the prefixes that units are looked up by, as level: words. Level 15 is the second word alone.
LEVELS = {10: 1, 20: 2, 30: 3, 40: 4, 60: 6}
_SECOND = 15
_LEVEL_OF = {words: level for level, words in LEVELS.items()}
_UNIT = 0
_PARENT, _LETTERS = 80, 90
_STOP_WORD, _STOP_NUMBER = 100, 101
_GRID_KEY, _SHORT, _SHAPE = 200, 201, 202

#: Words of a head; an open last unit with more is looked up by its whole shape.
_HEAD = 6

#: Bits of the map of keys looked for, as a power of two; a full map costs time only.
_MAP_BITS = 23

#: Fixed-length prefixes of whole texts: from 48 characters, each twice the one before. Shorter texts are looked up at their own length.
GRID = tuple(48 * 2**i for i in range(26))

#: Marks that may stand behind a cut: blanks, dots of omission, hyphens, damage, mark-up.
_BEHIND = re.compile("(?:[\\s\u200b\ufeff]|\u2026|\\.{2,}|(?<=\\w)[-\u2013\u2014]+(?!\\w)|\ufffd|\\[(?:\u2026|\\.{3})\\]|\\((?:\u2026|\\.{3})\\)|</?[A-Za-z][^<>]{0,80}>)+$")
_TAGS = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_UNIT_EDGE = re.compile("[\\r\\n\u0085\u2028\u2029]+|(?<=[.!?)\\]\"'\u00bb\u201d\u2019])[ \\t\u00a0]+(?=[\"'\u00ab\u201c(\u00bf\u00a1]*[A-Z\u00c0-\u00d6\u00d8-\u00de\u00bf\u00a1])")
#: Breaks of lines, for Spark's regular expressions: what is whole may stand before them.
_BREAK = "[\\r\\n\u0085\u2028\u2029]"
_LINE_BREAK = re.compile(_BREAK)
_LINE_END = re.compile(f"[^\\S\\r\\n\u0085\u2028\u2029]*({_BREAK})")
_NUMBER = re.compile(r"\d+")
_CAPITALS = re.compile(r"(?<![^\W\d_])[A-Z]{5,}(?![^\W\d_])")
_SHOUTED = re.compile("[A-Z]{5}")
_CAPITAL_END = re.compile(_CAPITALS.pattern + "$")
_TAIL = 400
_FINALS = frozenset(".!?\u3002\uff01\uff1f")
_FINAL_MARKS = ".!?\u3002\uff01\uff1f"
_CLOSERS = ")]\"'\u00bb\u201d\u2019"
#: What a long run of capitals becomes in a shape: a mark that no word begins with.
_RUN = "\u25a1"


#: What the marks behind a cut can end in.
_BEHIND_ENDS = frozenset(" \u200b\ufeff\u2026.-\u2013\u2014\ufffd])>")


def core(text: str) -> str:
    """The text without what may stand behind a cut."""
    while True:
        text = text.rstrip()
        last = text[-1:]
        if last not in _BEHIND_ENDS or (last == "." and text[-2:] != "..") or (last == ")" and text[-2:] not in (".)", "\u2026)")):
            return text
        at = max(0, len(text) - _TAIL)
        tail = text[at:]
        shorter = _BEHIND.sub("", tail)
        if len(shorter) == len(tail):
            return text
        text = text[:at] + shorter


def units(text: str) -> list[str]:
    """Sentences and lines, without mark-up. A closing mark before a capital ends a unit only behind a sentence's end."""
    if "<" in text:
        text = _TAGS.sub(" ", text)
    out, open_ = [], ""
    for part in _UNIT_EDGE.split(text):
        if open_:
            part, open_ = open_ + " " + part, ""
        part = part.strip()
        if not part:
            continue
        if part[-1] in _CLOSERS and not is_final(part):
            open_ = part
            continue
        out.append(part)
    if open_:
        out.append(open_)
    return out


def last_unit(core_: str) -> str:
    """The unit a core ends in: the last of ``units``, found from the end.

    A unit's beginning depends on the part before it only, so a stretch of text that has
    two units before its last one, and room for mark-up that the stretch may begin in, gives the same.
    """
    reach = 512
    while reach < len(core_):
        found = units(core_[-reach:])
        if len(found) > 2 and len(found[-1]) + len(found[-2]) + 256 < reach:
            return found[-1]
        reach *= 4
    found = units(core_)
    return found[-1] if found else ""


def shape(unit: str) -> str:
    """Numbers as #, long runs of capitals (sequences, words of a fixed alphabet) as one mark."""
    unit = _NUMBER.sub("#", unit)
    return _CAPITALS.sub(_RUN, unit) if _SHOUTED.search(unit) else unit


def head(unit: str) -> str:
    """The shape of the unit's first words, as many as the longest level has."""
    return shape(" ".join(unit.split(None, _HEAD)[:_HEAD]))


def prefixes(first: str, stops: bool = False) -> list[tuple[int, str]]:
    """(level, prefix) of a head, at each level it reaches; where a text ``stops`` in the head, without the last word."""
    words = first.split(" ")
    n = len(words) - stops
    out = [(level, " ".join(words[:k])) for level, k in LEVELS.items() if n >= k]
    if n > 1:
        out.append((_SECOND, words[1]))
    return out


def stops_in_head(unit: str) -> bool:
    """Whether a text that ends in the unit stops in the words its head has. A run of capitals is one letter wherever it stops."""
    words = unit.split(None, _HEAD)
    return len(words) <= _HEAD and _CAPITAL_END.search(words[-1]) is None


def is_final(unit: str) -> bool:
    return unit[-1:] in _FINALS or unit.rstrip(_CLOSERS)[-1:] in _FINALS


def unended(text: str) -> str:
    """A whole unit without the marks at its end: what goes on behind a prefix must be more than those."""
    return text.rstrip(_CLOSERS).rstrip(_FINAL_MARKS) if is_final(text) else text


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _key(level: int, text: str) -> int:
    return _hash(f"{level}|{text}")


def _letter_keys(text: str, start: int) -> Iterator[int]:
    """The keys of ``text`` up to each character from ``start`` on, in one pass."""
    state = xxhash.xxh64(f"{_LETTERS}|{text[:start]}".encode("utf-8", "surrogatepass"))
    for c in text[start:]:
        state.update(c.encode("utf-8", "surrogatepass"))
        yield state.intdigest() - (1 << 63)


def _goes_on_with(text: str, at: int) -> str:
    """The character at ``at``, or the break of the line if only blanks stand before it."""
    found = _LINE_END.match(text, at)
    return found[1] if found else text[at]


def _word_before(text: str, at: int) -> tuple[int, str] | None:
    """What a full stop at ``at`` stands behind: a word, or a number with the word before it."""
    word = text[text.rfind(" ", 0, at) + 1 : at]
    if word.isalpha():
        return _STOP_WORD, word
    end = at
    while end and text[end - 1] in "0123456789":
        end -= 1
    numeric = end < at
    if numeric:
        digits = end
        while end and text[end - 1] in " (=":
            end -= 1
        if end == digits:
            return None
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    word = text[start:end]
    if numeric:
        return (_STOP_NUMBER, word) if word.isalpha() else None
    return (_STOP_WORD, word) if word and word[-1].isalpha() else None


def stop_key(unit: str) -> int | None:
    """The key of what stands before the unit's last full stop."""
    if not unit.endswith("."):
        return None
    found = _word_before(unit, len(unit) - 1)
    return _key(*found) if found else None


def _looked_up(unit: str) -> list[tuple[int, int]]:
    """(level, key) that a text's last unit is looked up by; a final unit by what its full stop stands behind."""
    if is_final(unit):
        key = stop_key(unit)
        return [] if key is None else [(_STOP_WORD, key)]
    first, stops = head(unit), stops_in_head(unit)
    out = [(_UNIT, _key(_UNIT, shape(unit))), *((level, _key(level, prefix)) for level, prefix in prefixes(first, stops))]
    if stops:
        out += [(_PARENT, _key(_PARENT, first.rpartition(" ")[0])), (_LETTERS, _key(_LETTERS, first))]
    return out


_ENDS = "level int, key bigint, n int, flag boolean, shape string"


def _ends(texts: DataFrame, judged: bool) -> DataFrame:
    """What each text ends in and begins with, in rows of kinds that ``level`` tells apart.

    Grid rows: the hash of each fixed-length prefix, the text's length and whether it is the
    longest one. Short rows: the hash of a whole text below the grid. With ``judged`` the keys that the last unit
    is looked up by, whether it is final, and the shape of an open last unit of more words than a head has.
    """
    schema = T.StructType([T.StructField("_i", texts.schema["_i"].dataType), *T.StructType.fromDDL(_ENDS).fields])

    def scan(batches):
        for b in batches:
            at, out = [], [[], [], [], [], []]

            def put(row, *values, at=at, out=out):
                at.append(row)
                for column, v in zip(out, values, strict=True):
                    column.append(v)

            for row, text in enumerate(b.column("_text").to_pylist()):
                c = core(text)
                n = len(c)
                if not n:
                    continue
                if n < GRID[0]:
                    put(row, _SHORT, _key(_SHORT, c), n, None, None)
                else:
                    last = max(k for k, g in enumerate(GRID) if g <= n)
                    for k in range(last + 1):
                        put(row, _GRID_KEY, _hash(f"{GRID[k]}|{c[: GRID[k]]}"), n, k == last, None)
                unit = last_unit(c) if judged else ""
                if unit:
                    final = is_final(unit)
                    for level, key in _looked_up(unit):
                        put(row, level, key, None, final, None)
                    if not final and len(unit.split(None, _HEAD)) > _HEAD:
                        put(row, _SHAPE, None, None, None, shape(unit))
            if at:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("_i").take(pa.array(at)), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=schema.fieldNames())

    return texts.mapInArrow(scan, schema)


class _Map:
    """A bit map of fixed size of keys; what it lets through by chance meets nothing in a join."""

    def __init__(self, asked: DataFrame, key: str) -> None:
        at = F.pmod(key, F.lit(1 << _MAP_BITS))
        words = asked.select(F.shiftright(at, 5).alias("at"), F.expr(f"shiftleft(1L, cast(pmod({key}, 32) as int))").alias("bit"))
        bits = np.zeros(1 << _MAP_BITS - 5, np.uint32)
        got = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most a row per 32 bits, however many keys
        bits[got["at"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
        self.sent = asked.sparkSession.sparkContext.broadcast(bits.tobytes())

    def test(self):
        map_ = memoryview(self.sent.value).cast("I")

        def has(key: int) -> int:
            k = key % (1 << _MAP_BITS)
            return map_[k >> 5] >> (k & 31) & 1

        return has


_GOES_ON = "key bigint, `whole` bigint, `open` bigint, text bigint, after string, shape string"


def _elsewhere(texts: DataFrame, ends: DataFrame, asked: _Map, judged: bool) -> DataFrame:
    """What all texts tell about the keys asked for, in one scan, counted per batches first.

    Counts (key, whole, open, text) of how often a prefix begins a unit that ends a
    sentence, and one that doesn't. Open ones come with their text's hash, for a cut text
    sent again is no evidence that its end is one. Keys of last units tell in which texts
    they stand alike; keys of stops count ends and goings-on; keys of letters count units that go on
    behind them. Rows with ``after``: what stands behind a short text where it begins a longer one. Rows with
    ``shape``: whole units, without their closing marks, that begin like an open last unit.
    """

    short = [r["n"] for r in ends.where(F.col("level") == _SHORT).select("n").distinct().collect()]  # fewer than the grid's first length

    def scan(batches):
        whole: Counter[tuple[str, bool]] = Counter()
        stops: Counter[tuple[int, str, bool]] = Counter()
        open_: set[tuple[str, int, bool]] = set()
        alike: set[tuple[str, int]] = set()
        longer: set[str] = set()
        after: dict[int, tuple[int, str]] = {}
        is_asked = asked.test()
        shares: dict[str, int] = {}
        stop_keys: dict[tuple[int, str], bool] = {}

        words: dict[str, list[int]] = {}  # asked keys of the beginnings of heads, which many share
        letters: dict[str, list[tuple[int, int]]] = {}
        seconds: dict[str, list[int]] = {}

        def begun(prefix: str, count: int) -> list[int]:
            found = words.get(prefix)
            if found is None:
                level = _LEVEL_OF.get(count)
                found = words[prefix] = [k] if level and is_asked(k := _key(level, prefix)) else []
            return found

        def keys(first: str, stopped: bool, limit: int) -> list[int]:
            """Asked keys of a head: by words, and by letters before ``limit``; where a text stops, not by its last word."""
            out: list[int] = []
            start, count = 0, 0
            size = len(first)
            while start <= size:
                end = first.find(" ", start)
                if end < 0:
                    end = size
                count += 1
                prefix = first[:end]
                if not (stopped and end == size):
                    out += begun(prefix, count)
                    if count == 2:
                        word = first[start:end]
                        if word not in seconds:
                            seconds[word] = [k] if is_asked(k := _key(_SECOND, word)) else []
                        out += seconds[word]
                found = letters.get(prefix)
                if found is None:
                    found = []
                    if is_asked(_key(_PARENT, first[: max(0, start - 1)])):
                        found = [(c, k) for c, k in enumerate(_letter_keys(prefix, start), start + 1) if is_asked(k)]
                    letters[prefix] = found
                for c, k in found:
                    if c < limit:
                        out.append(k)
                start = end + 1
            return out

        def flush():
            sums: Counter[tuple[int, int | None]] = Counter()
            parents = {}
            for (first, entire), n in whole.items():
                for k in keys(first, False, len(unended(first)) if entire else len(first) + 1):
                    sums[k, None] += n
            opens: set[tuple[int, int]] = set()
            for first, h, stopped in open_:
                if (first, stopped) not in parents:
                    parents[first, stopped] = keys(first, stopped, len(first) + (not stopped))
                opens.update((k, h) for k in parents[first, stopped])
            opens.update((k, h) for s, h in alike if is_asked(k := _key(_UNIT, s)))
            rows = [(k, n, 0, None, None, None) for (k, _), n in sums.items()] + [(k, 0, 1, h, None, None) for k, h in opens]
            rows += [(k, 0 if on else n, n if on else 0, None, None, None) for (level, word, on), n in stops.items() for k in (_key(level, word),)]
            rows += [(k, None, None, None, c, None) for k, (_, c) in after.items()] + [(None, None, None, None, None, x) for x in longer]
            for x in (whole, stops, open_, alike, longer, after, shares, stop_keys, words, letters, seconds):
                x.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "whole", "open", "text", "after", "shape"])

        for batch in batches:
            for text in batch.column("_text").to_pylist():
                inner = core(text)
                for n in short:
                    if n < len(inner) and is_asked(k := _key(_SHORT, inner[:n])):
                        found = _rank_of(_goes_on_with(inner, n))
                        after[k] = max(after.get(k, found), found)
                if not judged:
                    continue
                h = None
                found = units(inner)
                for k, unit in enumerate(found, 1):
                    words_ = unit.split(None, _HEAD)
                    first = shape(" ".join(words_[:_HEAD]))
                    if is_final(unit):
                        entire = len(words_) <= _HEAD
                        whole[first, entire] += 1
                        if not entire and first not in shares:
                            shares[first] = is_asked(_key(max(LEVELS), first))
                        if not entire and shares[first]:
                            longer.add(unended(shape(unit)))
                    else:
                        h = _hash(inner) if h is None else h
                        open_.add((first, h, k == len(found) and stops_in_head(unit)))
                    at = unit.find(".")
                    end = len(unit) - 1
                    while at >= 0:
                        c = " " if at == end else unit[at + 1]
                        if (c == " " or c.isdigit()) and (b := _word_before(unit, at)) and (c == " " or b[0] == _STOP_NUMBER):
                            asks = stop_keys.get(b)
                            if asks is None:
                                asks = stop_keys[b] = bool(is_asked(_key(*b)))
                            if asks:
                                stops[*b, at < end] += 1
                        at = unit.find(".", at + 1)
                if found and not is_final(found[-1]):
                    alike.add((shape(found[-1]), h))
            if len(whole) + len(open_) + len(after) > 100_000:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(scan, _GOES_ON)


def _rank_of(character: str) -> tuple[int, str]:
    """Of several goings-on the one that says most: a letter or digit, else what is in the line, else its break."""
    return (2 if character.isalnum() else 0 if _LINE_BREAK.match(character) else 1), character


def prefixes_among(asked: DataFrame, longer: DataFrame, text: str, item: str) -> DataFrame:
    """(item) of the rows of ``asked`` whose value is a strict prefix of a value of ``longer``: neighbours in one global order.

    In falling order whatever begins with a value comes right before it, so the value of ``longer``
    last passed decides. Each partition leaves its last such value to the next one; equal values
    may lie in several partitions.
    """
    nothing = F.lit(None).cast(asked.schema[item].dataType)
    both = asked.select(F.col(text).alias("s"), F.lit(0).alias("l"), F.col(item).alias("i")).unionByName(longer.select(F.col(text).alias("s"), F.lit(1).alias("l"), nothing.alias("i")))
    placed = range_sorted(both, [F.col("s").desc(), "l", "i"])

    def summarise(batches):
        found = None
        for b in batches:
            if b.num_rows:
                found = found or {PID: b.column(PID)[0].as_py(), "s": None}
                at = np.flatnonzero(b.column("l").to_numpy())
                if len(at):
                    found["s"] = b.column("s")[int(at[-1])].as_py()
        return found

    states = carried(placed, summarise, f"`{PID}` int, s string", lambda state, row: row["s"] or state)
    sent = asked.sparkSession.sparkContext.broadcast(states)

    def find(batches):
        before = "unset"
        for b in batches:
            if before == "unset" and b.num_rows:
                before = sent.value.get(b.column(PID)[0].as_py())
            at = []
            for k, (s, is_longer) in enumerate(zip(b.column("s").to_pylist(), b.column("l").to_pylist(), strict=True)):
                if is_longer:
                    before = s
                elif before is not None and before.startswith(s):
                    at.append(k)
            if at:
                yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(at))], names=[item])

    return placed.mapInArrow(find, T.StructType([asked.schema[item]]))


def _longer_copies(texts: DataFrame, ends: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """(_i, next_char) of texts that are strict prefixes of longer ones, from the rows of the two scans."""
    grid = ends.where(F.col("level") == _GRID_KEY).select("_i", F.col("key").alias("_g"), F.col("n").alias("_n"), F.col("flag").alias("_own"))
    # lengths looked for under a prefix: fewer than the grid's step, however many values there are
    sought = (
        grid.groupBy("_g").agg(F.collect_set(F.when(F.col("_own"), F.col("_n"))).alias("_lengths"), F.max("_n").alias("_longest"), F.count("*").alias("_d"))
        .where(F.size("_lengths") > 0).withColumn("_lengths", F.filter("_lengths", lambda x: x < F.col("_longest"))).where(F.size("_lengths") > 0)
    )
    sought = materialize(sought.select("_g", "_lengths", "_d"))
    beyond = F.col("_n") > F.array_min("_lengths")
    met = join_unique(grid, sought, "_g", "_d", grid.count()).where(beyond | F.col("_own"))
    fetch = materialize(met.groupBy("_i").agg(F.array_distinct(F.flatten(F.collect_list(F.when(beyond, F.col("_lengths"))))).alias("_lengths"), F.max("_own").alias("_seeks")))
    # texts nobody asks for are left out before the shuffle, by a map of fixed size
    wanted = _Map(fetch.select(F.xxhash64("_i").alias("h")), "h")

    def sift(batches):
        test = wanted.test()
        for b in batches:
            at = [i for i, h in enumerate(b.column("_h").to_pylist()) if test(h)]
            if at:
                yield b.select(["_i", "_text"]).take(pa.array(at))

    sifted = texts.withColumn("_h", F.xxhash64("_i")).mapInArrow(sift, texts.schema)

    def exact(batches):
        for b in batches:
            out = [[], [], [], []]
            for i, t, lengths, seeks in zip(b.column("_i"), b.column("_text").to_pylist(), b.column("_lengths").to_pylist(), b.column("_seeks").to_pylist(), strict=True):
                c = core(t)
                found = [(n, _goes_on_with(c, n)) for n in set(lengths) if n < len(c)]
                if seeks:
                    found.append((len(c), None))
                for n, after in found:
                    for k, v in zip(out, (i, _hash(f"{n}|{c[:n]}"), after, after is None), strict=True):
                        k.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column("_i").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3])], names=["_i", "_h", "_after", "_own"])

    kind = texts.schema["_i"].dataType
    hashed = sifted.join(fetch, "_i").mapInArrow(exact, T.StructType([T.StructField("_i", kind), *T.StructType.fromDDL("_h bigint, _after string, _own boolean").fields]))
    # texts below the grid: found at their own length in the second scan
    short = ends.where(F.col("level") == _SHORT).select("_i", F.col("key").alias("_h"), F.lit(None).cast("string").alias("_after"), F.lit(True).alias("_own"))
    goes_on = elsewhere.where("after is not null").select(F.lit(None).cast(kind).alias("_i"), F.col("key").alias("_h"), F.col("after").alias("_after"), F.lit(False).alias("_own"))
    hashed = materialize(hashed.unionByName(short).unionByName(goes_on))
    inside = F.when(F.col("_after").rlike("[\\p{L}\\p{N}]"), 2).when(~F.col("_after").rlike(_BREAK), 1).otherwise(0)
    longer = hashed.groupBy("_h").agg(F.max(F.when(~F.col("_own"), F.struct(inside, "_after")))["_after"].alias("next_char"), F.count(F.when(F.col("_own"), 1)).alias("_d"))
    longer = materialize(longer.where("next_char is not null and _d > 0"))
    mine = hashed.where("_own").select("_i", "_h")
    return join_unique(mine, longer, "_h", "_d", mine.count()).select("_i", "next_char")


def _texts(df: DataFrame, item: str, text: str) -> DataFrame:
    return df.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).alias("_i"), F.col(text).alias("_text"))


def strict_prefixes(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, next_char) for values that are strict prefixes of longer values elsewhere; next_char: what follows there.

    Values are taken without what may stand behind a cut. Fixed-length prefixes are
    hashed: a value of n characters is looked up by the longest prefix of the grid it
    reaches, among all longer values' prefixes of that length, a shorter one by its own length. Values met there are
    hashed at the exact lengths looked for, and equal hashes (64 bits) are the answer: pairs are
    never formed, copies of one value are one value. Null and empty values are no prefixes.
    """
    rows = _texts(df, item, text)
    ends = materialize(_ends(rows, judged=False))
    asked = _Map(ends.where(F.col("level") == _SHORT), "key")
    elsewhere = materialize(_elsewhere(rows, ends, asked, judged=False))
    return _longer_copies(rows, ends, elsewhere).withColumnRenamed("_i", item)


def truncated(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, evidence, unit_whole, unit_open) for texts that stop inside a word or sentence they had begun.

    ``evidence``, the first that holds: ``text`` (a longer copy of the whole text goes on inside the word or
    line), ``prefix`` (the last unit is a strict prefix of a whole unit elsewhere), ``unit`` (units that begin like the last one go on to the end of a
    sentence more often than not), ``stop`` (the last full stop is that of an abbreviation or of half a
    number). Null, empty and blank texts are not cut. Of repeated texts each is
    judged. Other columns are ignored; an empty table gives an empty result.
    """
    rows = _texts(df, item, text)
    ends = materialize(_ends(rows, judged=True))
    asked = materialize(ends.where(f"key is not null and level <> {_GRID_KEY}").groupBy("key").agg(F.count("*").alias("d")))
    elsewhere = materialize(_elsewhere(rows, ends, _Map(asked, "key"), judged=True))
    last = ends.where(F.col("flag").isNotNull() & (F.col("level") != _GRID_KEY)).select("_i", "level", "key", F.col("flag").alias("final"))
    per_text = elsewhere.where("whole is not null").groupBy("key", "text").agg(F.sum("whole").alias("whole"), F.sum("open").alias("open"))
    once = F.when(F.col("text").isNull(), F.col("open")).otherwise(F.lit(1))
    counts = per_text.groupBy("key").agg(F.sum("whole").alias("whole"), F.sum(once).alias("open"))
    counts = materialize(counts.join(asked, "key"))
    n = last.count()
    none = F.lit(None).cast("bigint")
    met = materialize(join_unique(last, counts, "key", "d", n))
    by_stop = met.where(F.col("final") & (F.col("open") > 2 * F.col("whole")) & (F.col("open") >= 2)).select("_i", F.lit("4 stop").alias("evidence"), none.alias("whole"), none.alias("open"))

    # the unit's own text is among those counted, but not where it stops: the others are what remains
    looked = met.where(~F.col("final")).withColumn("open", F.col("open") - (F.col("level") != _LETTERS).cast("int"))
    seen = F.struct("level", "whole", "open")
    words = F.col("level").isin(*LEVELS, _LETTERS)
    second = F.col("level") == _SECOND
    by_level = F.when(words & (F.col("whole") + F.col("open") > 1), F.col("level"))
    by_any = F.when(words & (F.col("whole") + F.col("open") > 0), F.col("level"))
    judged = looked.groupBy("_i").agg(
        F.max(F.when(F.col("level") == _UNIT, F.col("open"))).alias("alike"),
        F.max_by(seen, by_level).alias("best"), F.max(by_level).alias("has"), F.max_by(seen, by_any).alias("any"), F.max(by_any).alias("has_any"),
        F.bool_or(second & (F.col("open") > F.col("whole"))).alias("second_ends"),
    )
    best = F.when(F.col("has").isNotNull(), F.col("best")).when(F.col("has_any").isNotNull(), F.col("any"))
    # known by its first word only: a second word that elsewhere stands in open units speaks against it
    vetoed = (best["level"] == min(LEVELS)) & F.coalesce("second_ends", F.lit(False))
    judged = judged.where(~F.coalesce(vetoed, F.lit(False))).select("_i", "alike", best["whole"].alias("whole"), best["open"].alias("open"))
    by_unit = judged.where("`whole` > `open` and alike <= `whole`").select("_i", F.lit("3 unit").alias("evidence"), "whole", "open")

    by_letters = looked.where((F.col("level") == _LETTERS) & (F.col("whole") > 0)).select("_i")
    shapes = ends.where(F.col("level") == _SHAPE).select("_i", "shape")
    by_shape = prefixes_among(shapes, elsewhere.where("shape is not null"), "shape", "_i")
    by_prefix = by_letters.unionByName(by_shape).select("_i", F.lit("2 prefix").alias("evidence"), none.alias("whole"), none.alias("open"))

    open_ones = last.where(~F.col("final")).select("_i").distinct().unionByName(by_stop.select("_i")).withColumn("_open", F.lit(True))
    copies = _longer_copies(rows, ends, elsewhere).where(~F.col("next_char").rlike(_BREAK))
    # a final-looking end is none where a copy goes on directly: half a number, a name with dots
    goes_on = F.col("_open").isNotNull() | F.col("next_char").rlike("[\\p{L}\\p{N}]")
    by_text = copies.join(open_ones, "_i", "left").where(goes_on).select("_i", F.lit("1 text").alias("evidence"), none.alias("whole"), none.alias("open"))
    found = by_text.unionByName(by_prefix).unionByName(by_unit).unionByName(by_stop)
    return found.groupBy(F.col("_i").alias(item)).agg(F.substring(F.min("evidence"), 3, 10).alias("evidence"), F.max("whole").alias("unit_whole"), F.max("open").alias("unit_open"))


def truncation_rates(df: DataFrame, item: str, text: str, source: str) -> DataFrame:
    """Per source: texts, cut ones and their share; null sources are one source, texts without characters are not counted."""
    cut = truncated(df, item, text).select(F.col(item).alias("_i"), F.lit(1).alias("_cut"))
    filled: Column = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0
    rows = df.where(filled).select(F.col(item).alias("_i"), F.col(source).alias(source))
    per = rows.join(cut, "_i", "left").groupBy(source).agg(F.count("*").alias("n_texts"), F.count("_cut").alias("n_cut"))
    return per.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
