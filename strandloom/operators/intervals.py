"""Interval algebra over half-open intervals ``[start, end)``.

A range condition alone gives Spark one equi key, the chromosome, and so as many
tasks as there are chromosomes. Here every interval gets the one bin, of a hierarchy of
widths, that holds it. Where two intervals overlap, one's bin holds the other's, so the
join is an equi join of own bins with the bins above them, either way round, with the range as
residue. Pairs come once; an interval of any length costs at most one row a level, of five. Counts and
existence need no pairs: they come from a scan over starts and ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators.islands import blocks_and_gaps
from strandloom.operators.ordered import prefix_sum_within

#: Bins grow by this factor from level to level.
_STEP = 64
_LEVELS = 4

#: Bins of a stretch in the search for nearest intervals.
_FAR = 4096


@dataclass(frozen=True)
class Cols:
    """Names of an interval table's columns."""

    key: str = "chrom"
    start: str = "chrom_start"
    end: str = "chrom_end"
    id: str = "name"


DEFAULT = Cols()


def usable(df: DataFrame, c: Cols) -> DataFrame:
    """Rows that are intervals: key, start and end known, not of negative length."""
    return df.where(F.col(c.key).isNotNull() & F.col(c.start).isNotNull() & F.col(c.end).isNotNull() & (F.col(c.end) >= F.col(c.start)))


def _widths(width: int) -> list[int]:
    return [width * _STEP**i for i in range(_LEVELS)]


def _own_bin(start: Column, end: Column, width: int) -> Column:
    """The smallest bin that holds the interval."""
    last = F.greatest(end - 1, start)
    found = F.struct(F.lit(_LEVELS).alias("level"), F.lit(0).cast("bigint").alias("bin"))
    for level, w in reversed(list(enumerate(_widths(width)))):
        a, b = F.floor(start / w), F.floor(last / w)
        found = F.when(a == b, F.struct(F.lit(level).alias("level"), a.alias("bin"))).otherwise(found)
    return found


def _bins_above(start: Column, own: Column, width: int) -> Column:
    """The own bin and those of higher levels that hold it: at most one a level."""
    levels = [*enumerate(_widths(width)), (_LEVELS, None)]
    bins = (F.struct(F.lit(k).alias("level"), (F.lit(0).cast("bigint") if w is None else F.floor(start / w)).alias("bin")) for k, w in levels)
    return F.filter(F.array(*bins), lambda x: x["level"] >= own["level"])


def overlap_pairs(
    a: DataFrame, b: DataFrame, ca: Cols = DEFAULT, cb: Cols = DEFAULT, max_gap: int | None = None, width: int = 1024, within: bool = False
) -> DataFrame:
    """All pairs of intervals with the same key that overlap: columns of ``a`` prefixed ``a_`` and of ``b`` prefixed ``b_``.

    With ``max_gap`` pairs at most that many positions apart count too (0: adjacent
    ones). With ``within`` the left interval must lie inside the right one. Rows without key,
    start or end meet nothing. Repeated rows give repeated pairs.
    """
    reach = 0 if max_gap is None else max_gap + 1
    left = usable(a, ca).select(*(F.col(x).alias(f"a_{x}") for x in a.columns))
    right = usable(b, cb).select(*(F.col(x).alias(f"b_{x}") for x in b.columns))
    s, e = F.col(f"a_{ca.start}") - reach, F.col(f"a_{ca.end}") + reach
    t, f = F.col(f"b_{cb.start}"), F.col(f"b_{cb.end}")
    left, right = left.withColumn("_o", _own_bin(s, e, width)), right.withColumn("_p", _own_bin(t, f, width))
    # way 0: the right one's own bin is the left one's or holds it; way 1: the left one's own bin holds the right one's
    def way(bins: Column, k: int) -> Column:
        return F.transform(bins, lambda x: F.struct(x["level"].alias("level"), x["bin"].alias("bin"), F.lit(k).alias("way")))

    own_a, own_b = F.array(F.struct("_o.level", "_o.bin")), F.array(F.struct("_p.level", "_p.bin"))
    over = F.filter(_bins_above(t, F.col("_p"), width), lambda x: x["level"] > F.col("_p.level"))
    left = left.withColumn("_b", F.explode(F.concat(way(_bins_above(s, F.col("_o"), width), 0), way(own_a, 1)))).drop("_o")
    right = right.withColumn("_o", F.explode(F.concat(way(own_b, 0), way(over, 1)))).drop("_p")
    meet = F.col(f"a_{ca.key}") == F.col(f"b_{cb.key}")
    for x in ("level", "bin", "way"):
        meet = meet & (F.col(f"_b.{x}") == F.col(f"_o.{x}"))
    meet = meet & (s < f) & (t < e)
    if within:
        meet = meet & (t <= F.col(f"a_{ca.start}")) & (F.col(f"a_{ca.end}") <= f)
    return left.join(right, meet).drop("_b", "_o")


def overlap_counts(a: DataFrame, b: DataFrame, ca: Cols = DEFAULT, cb: Cols = DEFAULT, max_gap: int | None = None, into: str = "n_overlaps") -> DataFrame:
    """``a`` with the number of rows of ``b`` each row overlaps; rows that overlap none have 0. ``ca.id`` must tell rows apart.

    No pairs are made: of the intervals that begin before a row's end, those that end
    before it begins don't overlap it. Both numbers are prefix sums over sorted starts and ends,
    scanned in partitions of any key.
    """
    reach = 0 if max_gap is None else max_gap + 1
    s, e = F.col(ca.start) - reach, F.col(ca.end) + reach
    t, f = F.col(cb.start), F.col(cb.end)
    asks, marks = usable(a, ca), usable(b, cb)
    # order at one position: starts count behind the ends they don't reach (0 before 1), ends before the rows that begin there;
    # intervals without length are left of nothing at their own position, except for rows that have a length
    events = [
        marks.select(F.col(cb.key).alias("k"), F.lit(0).alias("side"), t.alias("at"), F.lit(1).alias("o")),
        marks.select(F.col(cb.key).alias("k"), F.lit(1).alias("side"), f.alias("at"), F.when(t == f, 2).otherwise(0).alias("o")),
    ]
    summed = events[0].unionByName(events[1]).groupBy("k", "side", "at", "o").agg(F.count("*").alias("v"))
    nobody = F.lit(None).cast(a.schema[ca.id].dataType)
    rows = summed.withColumn("id", nobody)
    rows = rows.unionByName(asks.select(F.col(ca.key).alias("k"), F.lit(0).alias("side"), e.alias("at"), F.lit(0).alias("o"), F.lit(0).cast("bigint").alias("v"), F.col(ca.id).alias("id")))
    rows = rows.unionByName(asks.select(F.col(ca.key).alias("k"), F.lit(1).alias("side"), s.alias("at"), F.when(s == e, 1).otherwise(3).alias("o"), F.lit(0).cast("bigint").alias("v"), F.col(ca.id).alias("id")))
    scanned = prefix_sum_within(rows, ["k", "side"], ["at", "o"], "v", "upto").where("id is not null")
    n = scanned.groupBy(F.col("id").alias("_id")).agg(F.sum(F.when(F.col("side") == 0, F.col("upto")).otherwise(-F.col("upto"))).alias("_n"))
    return a.join(n, a[ca.id] == n["_id"], "left").withColumn(into, F.coalesce("_n", F.lit(0))).drop("_id", "_n")


def overlapping(a: DataFrame, b: DataFrame, ca: Cols = DEFAULT, cb: Cols = DEFAULT, max_gap: int | None = None, keep: bool = True) -> DataFrame:
    """Rows of ``a`` that overlap at least one of ``b`` (or, with ``keep`` false, none); rows without position overlap none."""
    counted = overlap_counts(a, b, ca, cb, max_gap, "_overlaps")
    return counted.where(F.col("_overlaps") > 0 if keep else F.col("_overlaps") == 0).drop("_overlaps")


def intersections(a: DataFrame, b: DataFrame, ca: Cols = DEFAULT, cb: Cols = DEFAULT, width: int = 1024) -> DataFrame:
    """(key, start, end) of every overlapping pair's common part, each range once."""
    pairs = overlap_pairs(a.select(ca.key, ca.start, ca.end), b.select(cb.key, cb.start, cb.end), ca, cb, None, width)
    return pairs.select(
        F.col(f"a_{ca.key}").alias(ca.key), F.greatest(f"a_{ca.start}", f"b_{cb.start}").alias(ca.start), F.least(f"a_{ca.end}", f"b_{cb.end}").alias(ca.end)
    ).distinct()


def merged(df: DataFrame, c: Cols = DEFAULT, max_gap: int = 0) -> DataFrame:
    """(key, start, end) of the union: overlapping, adjacent and at most ``max_gap`` apart intervals become one.

    Intervals of length 0 are no part of the union.
    """
    rows = usable(df, c).where(F.col(c.end) > F.col(c.start)).select(F.col(c.key).alias("k"), F.col(c.start).alias("s"), (F.col(c.end) - 1).alias("e"))
    blocks = blocks_and_gaps(rows, ["k"], "s", "e", touch=1 + max_gap).where("piece = 'block'")
    return blocks.select(F.col("k").alias(c.key), F.col("from_pos").alias(c.start), (F.col("to_pos") + 1).alias(c.end))


def consensus(sets: list[DataFrame], least: int, c: Cols = DEFAULT, width: int = 1024) -> DataFrame:
    """Merged intervals of the union that overlap intervals of at least ``least`` of the sets, with that number."""
    tagged = [usable(s, c).select(c.key, c.start, c.end, F.lit(i).alias("_set")) for i, s in enumerate(sets)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    pairs = overlap_pairs(merged(union, c), union, Cols(c.key, c.start, c.end, c.start), c, None, width)
    votes = pairs.groupBy(*(F.col(f"a_{x}").alias(x) for x in (c.key, c.start, c.end))).agg(F.count_distinct("b__set").alias("n_sets"))
    return votes.where(F.col("n_sets") >= least)


def mean_coverage(a: DataFrame, b: DataFrame, ca: Cols = DEFAULT, cb: Cols = DEFAULT, weight: str | None = None, width: int = 1024, into: str = "mean_depth") -> DataFrame:
    """``a`` with the mean depth of ``b`` (or the length-weighted mean of its ``weight``) over each interval's positions; 0 where nothing lies."""
    value = [weight] if weight else []
    pairs = overlap_pairs(a.select(ca.id, ca.key, ca.start, ca.end), b.select(cb.key, cb.start, cb.end, *value), ca, cb, None, width)
    shared = F.least(f"a_{ca.end}", f"b_{cb.end}") - F.greatest(f"a_{ca.start}", f"b_{cb.start}")
    sums = pairs.groupBy(F.col(f"a_{ca.id}").alias("_id")).agg(F.sum(shared * F.col(f"b_{weight}") if weight else shared).alias("_sum"))
    depth = F.coalesce("_sum", F.lit(0)) / F.nullif(F.col(ca.end) - F.col(ca.start), F.lit(0))
    return a.join(sums, a[ca.id] == sums["_id"], "left").withColumn(into, depth).drop("_id", "_sum")


def nearest(a: DataFrame, b: DataFrame, ca: Cols = DEFAULT, cb: Cols = DEFAULT, width: int = 65536) -> DataFrame:
    """``a`` with ``distance`` to the nearest interval of ``b`` of the same key (0 if overlapping or adjacent), and ``nearest_id``.

    Of those that begin at or before it the one that ends last (then begins first, then the
    smallest id) is named if none is nearer, else the first to begin later (then the
    smallest id). Null where the key has none. Among intervals that begin at or before a position the nearest is the one
    that ends last, among later ones the one that begins first: both are carried over
    stretches of bins, over the bins of a stretch, and scanned inside bins, so no key is one task.
    """
    left = usable(a, ca).select(F.col(ca.id).alias("_id"), F.col(ca.key).alias("_k"), F.col(ca.start).alias("_s"), F.col(ca.end).alias("_e"))
    right = usable(b, cb).select(F.col(cb.id).alias("_id"), F.col(cb.key).alias("_k"), F.col(cb.start).alias("_s"), F.col(cb.end).alias("_e"))
    bin_ = F.floor(F.col("_s") / width)
    reach = F.struct(F.col("_e").alias("e"), (-F.col("_s")).alias("s"), F.col("_id").alias("id"))
    begin = F.struct(F.col("_s").alias("s"), F.col("_id").alias("id"))
    # equal intervals are one with the smallest id: max() over them would take the largest
    ends = right.groupBy("_k", "_s", "_e").agg(F.min("_id").alias("_id")).withColumn("_bin", bin_)
    bins = ends.groupBy("_k", "_bin").agg(F.max(reach).alias("hi"), F.min(begin).alias("lo"))
    asked = left.select("_k", bin_.alias("_bin")).distinct()
    table = bins.join(asked, ["_k", "_bin"], "full_outer").withColumn("_far", F.floor(F.col("_bin") / _FAR))

    def around(by: list[str], order: str) -> tuple[Column, Column]:
        w = W.partitionBy(*by).orderBy(order)
        return F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1)), F.min("lo").over(w.rowsBetween(1, W.unboundedFollowing))

    # bins are carried inside stretches of _FAR bins, and stretches inside keys: no window holds more than one of the two
    inner, outer = around(["_k", "_far"], "_bin"), around(["_k"], "_far")
    far = table.groupBy("_k", "_far").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")).select("_k", "_far", outer[0].alias("b2"), outer[1].alias("a2"))
    near = table.select("_k", "_far", "_bin", inner[0].alias("b1"), inner[1].alias("a1")).join(far, ["_k", "_far"])
    carried = near.select("_k", "_bin", F.greatest("b1", "b2").alias("before"), F.least("a1", "a2").alias("after"))
    rows = left.withColumn("_bin", bin_).select("_k", "_bin", "_s", "_e", "_id", F.lit(1).alias("_left"), F.lit(None).cast(ends.select(reach).schema[0].dataType).alias("hi"), F.lit(None).cast(ends.select(begin).schema[0].dataType).alias("lo"))
    rows = rows.unionByName(ends.select("_k", "_bin", "_s", "_e", F.lit(None).cast(left.schema["_id"].dataType).alias("_id"), F.lit(0).alias("_left"), reach.alias("hi"), begin.alias("lo")))
    inside = W.partitionBy("_k", "_bin").orderBy("_s", "_left")
    scanned = rows.select("*", F.max("hi").over(inside.rowsBetween(W.unboundedPreceding, -1)).alias("p"), F.min("lo").over(inside.rowsBetween(1, W.unboundedFollowing)).alias("n"))
    both = scanned.where("_left = 1").join(carried, ["_k", "_bin"], "left").select("_id", "_s", "_e", F.greatest("p", "before").alias("p"), F.least("n", "after").alias("n"))
    to_p = F.greatest(F.lit(0), F.col("_s") - F.col("p.e"))
    to_n = F.greatest(F.lit(0), F.col("n.s") - F.col("_e"))
    to_p, to_n = F.when(F.col("p").isNotNull(), to_p), F.when(F.col("n").isNotNull(), to_n)
    first = to_n.isNull() | (to_p <= to_n)
    found = both.select("_id", F.least(to_p, to_n).alias("distance"), F.when(first, F.col("p.id")).otherwise(F.col("n.id")).alias("nearest_id"))
    return a.join(found, a[ca.id] == found["_id"], "left").drop("_id")


def signed_distance(position: Column, anchor: Column, strand: Column) -> Column:
    """Distance from an anchor in its reading direction: negative upstream."""
    return F.when(strand == "-", anchor - position).otherwise(position - anchor)


def anchor(start: Column, end: Column, strand: Column, fix: str = "start") -> Column:
    """First position of a one-wide anchor: the strand's start or end, or the centre."""
    if fix == "center":
        return start + F.floor((end - start - 1) / 2)
    first = (strand == "-") if fix == "start" else (F.coalesce(strand, F.lit("+")) != "-")
    return F.when(first, end - 1).otherwise(start)


def promoter_window(start: Column, end: Column, strand: Column, up: int, down: int) -> tuple[Column, Column]:
    """``[anchor - up, anchor + down)`` in reading direction."""
    minus = strand == "-"
    return F.when(minus, end - down).otherwise(start - up), F.when(minus, end + up).otherwise(start + down)


def clamp(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """The part inside ``[0, length)``."""
    return F.greatest(F.lit(0), F.least(start, length)), F.least(length, F.greatest(end, F.lit(0)))


def centred(start: Column, end: Column, half: int, base: int = 0) -> tuple[Column, Column]:
    """``2 * half + 1`` positions round the midpoint; ``base`` 1 reproduces midpoints taken from 1-based starts."""
    middle = F.floor((start + base + end) / 2)
    return middle - half, middle + half + 1


def flanks(df: DataFrame, size: int, c: Cols = DEFAULT) -> DataFrame:
    """Left and right neighbour of each interval, ``size`` wide, with ``side``; the left one is cut at 0."""
    left = df.withColumns({c.end: F.col(c.start), c.start: F.greatest(F.lit(0), F.col(c.start) - size), "side": F.lit("left")})
    right = df.withColumns({c.start: F.col(c.end), c.end: F.col(c.end) + size, "side": F.lit("right")})
    return left.unionByName(right)


def sub_interval(start: Column, end: Column, strand: Column, first: int, last: int) -> tuple[Column, Column]:
    """Positions ``first`` to ``last`` (from 1) of the interval in reading direction."""
    minus = strand == "-"
    return F.when(minus, end - last).otherwise(start + first - 1), F.when(minus, end - first + 1).otherwise(start + last)


def lift(df: DataFrame, chain: DataFrame, c: Cols = DEFAULT, width: int = 1024, widest: bool = True) -> DataFrame:
    """Intervals carried over ``chain`` blocks (key, start, end, to_key, to_start, to_end, to_strand).

    Each block an interval meets gives a segment; with ``widest`` the widest segment per
    interval stays (then the first target position), else intervals with one segment only.
    """
    blocks = Cols(c.key, c.start, c.end, c.start)
    pairs = overlap_pairs(df.select(c.id, c.key, c.start, c.end), chain, c, blocks, None, width)
    lo, hi = F.greatest(f"a_{c.start}", f"b_{c.start}"), F.least(f"a_{c.end}", f"b_{c.end}")
    shift = lo - F.col(f"b_{c.start}")
    minus = F.col("b_to_strand") == "-"
    start = F.when(minus, F.col("b_to_end") - (hi - F.col(f"b_{c.start}"))).otherwise(F.col("b_to_start") + shift)
    segments = pairs.select(F.col(f"a_{c.id}").alias(c.id), F.col("b_to_key").alias("to_key"), start.alias("to_start"), (start + (hi - lo)).alias("to_end"))
    per = W.partitionBy(c.id)
    if not widest:
        return segments.withColumn("_n", F.count("*").over(per)).where("_n = 1").drop("_n")
    order = per.orderBy((F.col("to_end") - F.col("to_start")).desc(), "to_key", "to_start")
    return segments.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
