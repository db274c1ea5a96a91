"""Several values packed in one field: pick each field's dialect by description length, then parse.

A dialect is a delimiter class, a set of quote marks and, perhaps, a wrapper round
the whole list. For every field the dialects its characters allow are scored; the
one that describes the field in the fewest bits wins. Bits of a value come from how
often the value occurs over all fields (frequent values have short codes, unseen
ones are spelled out), bits of separators from how evenly they are used, and what
the format does not expect costs a little more. So a wrong split, which makes
values nobody else has, costs more than the right one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import materialize

#: Fixed values of the data's format: what stands for a missing value, and the marks that wrap a list.
PLACEHOLDERS = frozenset(("NA", "null", "-"))
BRACKETS = {"(": ")", "[": "]", "{": "}"}

#: Characters a bare value is made of: letters, digits and ( ) : -
BARE = r"(?:[^\W_]|[():\-])"
_BARE_RUN = re.compile(BARE + "+")
_CALL = re.compile(r"\s*([^\W\d][\w.]*)?\s*([\(\[\{])")

#: Values whose codes are broadcast, the most frequent ones: 16 bytes each, whatever the data's size. The codes of all
#: others are joined to the fields whose dialect hangs on them, so the bound changes where a field is decided, never how.
CODED = 1 << 17

#: Bits of the model's parts: the start of a value, each of its letters, a character that no bare value has (or a quote
#: mark outside values, or a missing delimiter), one more kind of separator, a placeholder.
_VALUE = 7.0
_LETTER = 5.5
_FOREIGN = 14.0
_KIND = 2.0
_PLACEHOLDER = 4.0

#: Values whose bits a worker keeps between fields; a full store is emptied.
_STORE = 200_000


def _hash(value: str) -> int:
    """Spark's xxhash64 of the value."""
    found = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 42)
    return found - (1 << 64) if found >> 63 else found


def unwrap(field: str) -> str | None:
    """The inside of a bracket or call that encloses the whole list, else None."""
    text = field.strip()
    opening = _CALL.match(text)
    if not opening or text[-1] != BRACKETS[opening[2]] or (opening[1] and opening[2] != "("):
        return None
    # the closing mark must be the one that belongs to the opening mark
    depth, i, last = 0, opening.end() - 1, len(text) - 1
    while i <= last:
        c = text[i]
        if c in "\"'":
            close = text.find(c, i + 1)
            i = close if close > 0 else i
        elif c == opening[2]:
            depth += 1
        elif c == BRACKETS[opening[2]]:
            depth -= 1
            if depth == 0:
                return text[opening.end() : -1] if i == last else None
        i += 1
    return None


@lru_cache(maxsize=4096)
def _scanner(delimiters: str | None, quotes: str) -> re.Pattern:
    """Values of a dialect as the one group of a pattern; delimiters None: any character that no bare value has."""
    parts = []
    if '"' in quotes:
        parts.append(r'"(?:[^"]|"")*"')
    if "'" in quotes:
        parts.append(r"'[^']*'")
    bare = BARE if delimiters is None else f"[^{re.escape(delimiters + quotes)}]"
    return re.compile("(" + "|".join([*parts, f"{bare}+"]) + ")")


def tokens(field: str, delimiters: str | None, quotes: str) -> tuple[list[str], list[str]]:
    """(values as written, what stands before, between and behind them); blank values are dropped."""
    if delimiters is not None and not quotes:
        found, between = field.split(delimiters), []
    else:
        parts = _scanner(delimiters, quotes).split(field)
        found, between = parts[1::2], parts[::2]
    if delimiters is not None:
        found = [v for t in found if (v := t.strip())]
    return found, between


def value_of(token: str, quotes: str) -> str:
    """The value that a token stands for; '' for empty quotes."""
    if quotes and token[0] in quotes and len(token) > 1 and token[-1] == token[0]:
        return token[1:-1].replace('""', '"') if token[0] == '"' else token[1:-1]
    return token


def dialects(field: str) -> Iterator[tuple[str | None, str, bool, str]]:
    """(delimiters, quotes, wrapped, inside) that the field's characters allow; any-character comes first."""
    inside = unwrap(field)
    for wrapped, text in ((True, inside), (False, field)) if inside is not None else ((False, field),):
        found = [c for c in ",;|/\t\n" if c in text] or [c for c in " " if c in text.strip()]
        marks = [q for q in "\"'" if q in text]
        marks = [*(["\"'"] if len(marks) == 2 else []), *marks, ""]
        for quotes in marks:
            for d in (None, *found):
                yield d, quotes, wrapped, text


class Model:
    """Bits of values and fields. ``codes`` has the bits of coded values by hash (None: all values are spelled out).

    ``least`` is what a value without a code there may cost in the best case, if not all codes are known.
    """

    def __init__(self, codes: dict[int, float] | None = None, least: float | None = None) -> None:
        self.codes, self.least = codes, least
        self.known: dict[str, _Bits] = {}

    def bits_of(self, value: str, quoted: bool) -> float:
        """Bits of one value: its code if it has one and that is shorter, else its letters; more for what no bare value has."""
        if value in PLACEHOLDERS and not quoted:
            return _PLACEHOLDER
        bits = _VALUE + _LETTER * len(value)
        if self.codes is not None:
            code = self.codes.get(_hash(value), self.least)
            bits = bits if code is None else min(bits, code)
        if quoted:
            return bits + 1.0
        if value.isalnum():
            return bits
        foreign = len(_BARE_RUN.sub("", value)) or int(value.count("(") != value.count(")"))
        return bits + _FOREIGN * foreign

    def scored(self, field: str, bound: bool = True) -> Iterator[tuple[float, str | None, str, bool, str, list[str]]]:
        """(bits, delimiters, quotes, wrapped, inside, values as written) of the dialects; with ``bound`` those that can't win are left out.

        A dialect pays for quote marks it does not know and for marks that are neither its
        delimiter nor inside quotes, whatever its values are: it is not parsed if that alone
        is dearer than the best so far, nor where it must give the values already found.
        """
        best = math.inf
        double, single = field.count('"'), field.count("'")
        marks: Counter[str] = Counter()
        only, any_found, any_bits = None, [], 0.0
        for d, quotes, wrapped, text in dialects(field):
            strays = _FOREIGN * ((0 if '"' in quotes else double) + (0 if "'" in quotes else single))
            total = 2.0 + len(quotes) + 3.0 * wrapped + strays
            if bound and total >= best:
                continue
            known = self.known.get(quotes)
            if known is None:
                known = self.known[quotes] = _Bits(self, quotes)
            if d is None:
                found, between = tokens(text, d, quotes)
                kinds = Counter(between[1:-1])
                n = len(between) - 2
                if len(kinds) > 1:
                    stripped: Counter[str] = Counter()
                    for x, c in kinds.items():
                        stripped[x.strip() or " "] += c
                    kinds = stripped
                marks.clear()
                for x, c in kinds.items():
                    for k in "".join(x.split()):
                        marks[k] += c
                only = next(iter(marks)) if len(marks) == 1 and all(x.strip() for x in kinds) else None
                for x in {0: between[0].strip(), len(between) - 1: between[-1].strip()}.values():
                    total += _KIND * bool(x)
                    marks.update("".join(x.split()))
                if len(marks) > 1:
                    only = None
                marks.pop('"', None)  # counted as strays
                marks.pop("'", None)
                if len(kinds) > 1:  # bits follow how evenly the kinds of separators are used
                    total -= sum(c * math.log2(c / n) for c in kinds.values())
                total += 3.0 + _KIND * len(kinds)
                any_found, any_bits = found, sum(map(known.__getitem__, found)) if found else _FOREIGN * len(text.strip())
                total += any_bits
            else:
                total += 2.0 + _KIND
                if bound and total + _FOREIGN * (marks.total() - marks[d]) >= best:
                    continue
                if only == d:
                    found = any_found
                    total += any_bits
                else:
                    found, between = tokens(text, d, quotes)
                    total += _FOREIGN * max(0, len(found) - 1 - text.count(d))
                    total += sum(map(known.__getitem__, found)) if found else _FOREIGN * len(text.strip())
                    if not quotes:  # quote marks are letters of bare values here, and paid for with them
                        total -= strays
            if quotes and (d is None or only != d):
                rest = "".join(between)
                total += _FOREIGN * sum(rest.count(q) for q in quotes)
            if total < best or not bound:
                best = min(best, total)
                yield total, d, quotes, wrapped, text, found

    def cheapest(self, field: str) -> tuple[str | None, str, bool, str, list[str]]:
        """(delimiters, quotes, wrapped, inside, values as written) of the winner; equal bits: the first of ``dialects``."""
        for found in self.scored(field):  # each is cheaper than the one before
            pass
        return found[1:]

    def tidy(self) -> None:
        for known in self.known.values():
            if len(known) > _STORE:
                known.clear()


class _Bits(dict):
    """Bits of tokens under a set of quote marks, made when first asked for."""

    def __init__(self, model: Model, quotes: str) -> None:
        super().__init__()
        self.model, self.quotes = model, quotes

    def __missing__(self, token: str) -> float:
        value = value_of(token, self.quotes)
        bits = self[token] = self.model.bits_of(value, value is not token) if value else 1.0
        return bits


def values_of(found: list[str], quotes: str) -> list[str]:
    """The values of tokens, without empty ones and placeholders."""
    plain = [value_of(t, quotes) for t in found] if quotes else found
    return [v for v in plain if v and v not in PLACEHOLDERS]


def dialect_name(delimiters: str | None, quotes: str, wrapped: bool, text: str, found: list[str]) -> str:
    """The marks that separate the values (``blank``: blanks only), the quote marks used and whether a wrapper encloses all."""
    if delimiters is None:
        rest = "".join(_scanner(None, quotes).split(text)[::2])
        marks = "".join(sorted(set("".join(rest.split())))) or ("blank" if rest else "none")
    else:
        marks = delimiters.strip() or "blank"
    used = "".join(q for q in "\"'" if q in quotes and any(t[0] == q for t in found))
    return f"{marks} {used or 'bare'}{' wrapped' if wrapped else ''}"


def undecided(field: str, upper: Model, lower: Model) -> list[int] | None:
    """Hashes of the values whose codes the field's dialect hangs on; None where no code can change it.

    ``upper`` spells out what has no known code, ``lower`` gives it the shortest code it can have.
    """
    most = {x[1:4]: (x[0], values_of(x[5], x[2])) for x in upper.scored(field, bound=False)}
    winner = min(most, key=lambda k: most[k][0])
    cost, values = most[winner]
    rivals = [x for x in lower.scored(field, bound=False) if x[1:4] != winner and x[0] <= cost and values_of(x[5], x[2]) != values]
    if not rivals:
        return None
    wanted = set(values).union(*(values_of(x[5], x[2]) for x in rivals))
    return sorted(h for h in map(_hash, wanted) if h not in upper.codes)


def value_counts(fields: DataFrame, field: str) -> DataFrame:
    """(value, n): in how many fields each value stands that more than one has, by the value's hash.

    Counted are the values of the widest dialect, quoted ones and runs of bare characters,
    by built-in expressions: a statistic of all fields that leaves each field's dialect open.
    """
    quoted = r"\"(?:[^\"]|\"\")*\"|'[^']*'"
    call = r"(?s)^\s*(?:[A-Za-z_][\w.]*)?\s*\((.*)\)\s*$"
    inside = F.when(F.col(field).rlike(call), F.regexp_extract(field, call, 1)).otherwise(F.col(field))
    found = F.regexp_extract_all(inside, F.lit(rf"{quoted}|[\p{{L}}\p{{N}}():\-]+"), F.lit(0))
    within = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    bare = lambda x: F.when(x.startswith('"'), F.replace(within(x), F.lit('""'), F.lit('"'))).when(x.startswith("'"), within(x)).otherwise(x)
    values = fields.select(F.explode(F.array_distinct(F.transform(found, lambda x: F.xxhash64(bare(x))))).alias("value"))
    return materialize(values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"))


def split_packed(
    df: DataFrame, field: str, keep: list[str], position: str = "value_pos", value: str = "value", dialect: str | None = None, coded: int = CODED
) -> DataFrame:
    """One row per value of ``field``, with its position from 1, and the columns ``keep``.

    Null, empty and blank fields, empty slots and placeholders give no row and take no
    position; repeats stay. A field of any length is parsed whole. Rows are not
    merged: two equal rows give their values twice. Other columns are ignored. With
    ``dialect`` the chosen dialect's name comes as a column of that name.

    Codes of the ``coded`` most frequent values are broadcast. Where rarer values have codes
    too, fields whose dialect could hang on one get theirs by a join.
    """
    rows = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)), F.col(field).alias("_field"))
    counted = value_counts(rows, "_field")
    # the counts' magnitudes, at most 64 rows, tell from which count on the values are few enough: no sort, no top list in one task
    sizes = {r["k"]: (r["c"], r["n"]) for r in counted.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("c"), F.sum("n").alias("n")).collect()}
    least, kept = 64, 0
    for k in sorted(sizes, reverse=True):
        if kept + sizes[k][0] > coded:
            break
        least, kept = k, kept + sizes[k][0]
    whole = kept == sum(c for c, _ in sizes.values())
    bits = math.log2(max(sum(n for _, n in sizes.values()), 2))
    got = counted.where(F.col("n") >= F.lit(2.0**least)).toPandas()
    codes = dict(zip(got["value"].tolist(), (bits - np.log2(got["n"].to_numpy())).tolist(), strict=True))
    sent = df.sparkSession.sparkContext.broadcast(codes)
    names = [f"_k{i}" for i in range(len(keep))]
    out = T.StructType(
        [
            *(rows.schema[n] for n in names),
            T.StructField(position, T.IntegerType()),
            T.StructField(value, T.StringType()),
            *([T.StructField(dialect, T.StringType())] if dialect else []),
        ]
    )
    bound = 1.0 if whole else bits - least  # what the code of a value that is not broadcast has at least

    def explode(batches):
        model = Model(sent.value)
        models = (model, Model(sent.value, bound))
        for batch in batches:
            own = batch.column("_codes").to_pylist() if "_codes" in batch.schema.names else None
            counts, vals, marks = [], [], []
            for i, text in enumerate(batch.column("_field").to_pylist()):
                if not text or (own is None and not whole and undecided(text, *models) is not None):
                    counts.append(0)
                    continue
                chosen = model if own is None else Model(_Both({c["value"]: bits - math.log2(c["n"]) for c in own[i] or []}, sent.value))
                d, quotes, wrapped, inside, found = chosen.cheapest(text)
                values = values_of(found, quotes)
                counts.append(len(values))
                vals += values
                if dialect:
                    marks += [dialect_name(d, quotes, wrapped, inside, found)] * len(values)
            model.tidy()
            if vals:
                n = np.array(counts)
                at = pa.array(np.repeat(np.arange(len(n)), n))
                place = np.arange(1, len(vals) + 1) - np.repeat(np.cumsum(n) - n, n)
                more = [pa.array(marks)] if dialect else []
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(place.astype(np.int32)), pa.array(vals), *more], names=out.fieldNames())

    renamed = {n: k for n, k in zip(names, keep, strict=True)}
    decided = rows.mapInArrow(explode, out)
    if whole:
        return decided.withColumnsRenamed(renamed)

    def ask(batches):
        models = Model(sent.value), Model(sent.value, bound)
        for batch in batches:
            texts = batch.column("_field").to_pylist()
            found = [(i, h) for i, t in enumerate(texts) if t and (h := undecided(t, *models)) is not None]
            if found:
                taken = batch.take(pa.array([i for i, _ in found]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([h for _, h in found], pa.list_(pa.int64()))], names=[*taken.schema.names, "_asked"])

    open_ = materialize(rows.mapInArrow(ask, T.StructType([*rows.schema.fields, T.StructField("_asked", T.ArrayType(T.LongType()))])).withColumn("_id", F.monotonically_increasing_id()))
    # only values beyond the broadcast are looked up: none of them is in many fields
    answers = open_.select("_id", F.explode("_asked").alias("value")).join(counted, "value").groupBy("_id").agg(F.collect_list(F.struct("value", "n")).alias("_codes"))
    answered = open_.join(answers, "_id", "left").select(*rows.columns, F.coalesce("_codes", F.array().cast("array<struct<value:bigint,n:bigint>>")).alias("_codes"))
    return decided.unionByName(answered.mapInArrow(explode, out)).withColumnsRenamed(renamed)


class _Both:
    """Codes of a field's own and, behind them, the broadcast ones."""

    def __init__(self, own: dict[int, float], shared: dict[int, float]) -> None:
        self.own, self.shared = own, shared

    def get(self, key: int, default: float | None = None) -> float | None:
        found = self.own.get(key)
        return self.shared.get(key, default) if found is None else found
