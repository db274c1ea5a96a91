"""Scans over globally range-sorted rows: prefix sums and ranks inside groups of any size.

A window function puts a whole group into one task. Here rows are range-sorted
by group and order columns, so a group with a third of all rows is spread over as
many partitions as its size asks for. Three steps give each partition the state
it starts with:

1. every partition is scanned once and leaves one summary row;
2. the summaries, one per partition and never more, are combined in order;
3. every partition is scanned again, starting from its carried state.

The sorted rows are checkpointed between the scans: range bounds come from a
sample, so only a stored copy has the same partitions both times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import materialize

PID = "_pid"


def range_sorted(df: DataFrame, by: list[Column | str], partitions: int | None = None) -> DataFrame:
    """Rows in global order over partitions, stored, with the partition's number in ``_pid``."""
    split = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return materialize(split.sortWithinPartitions(*by)).withColumn(PID, F.spark_partition_id())


def carried(
    placed: DataFrame,
    summarise: Callable[[Iterator[pa.RecordBatch]], dict | None],
    summary_schema: str,
    combine: Callable[[object, dict], object],
    start: object = None,
) -> dict[int, object]:
    """The state each partition starts with, by partition number.

    ``summarise`` sees one partition's batches and returns its summary row;
    ``combine`` adds one summary to the state. What reaches the driver is one row
    per partition: its size follows the number of partitions, not of rows.
    """
    schema = T.StructType.fromDDL(summary_schema)
    names = schema.fieldNames()

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = summarise(batches)
        if got is not None:
            yield pa.RecordBatch.from_pylist([{n: got[n] for n in names}], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    rows = sorted((r.asDict(True) for r in placed.mapInArrow(one, schema).collect()), key=lambda r: r[PID])
    states, state = {}, start
    for row in rows:
        states[row[PID]] = state
        state = combine(state, row)
    return states


def _changed(col: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it; null equals null. Structs differ where a field does."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    nulls = pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    if pa.types.is_struct(col.type):
        for field in col.flatten():
            nulls = nulls | _changed(field)
        return nulls
    return nulls | pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)


def group_changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """True where a row's key differs from the row before it; the first row is always True."""
    n = batch.num_rows
    out = np.zeros(n, dtype=bool)
    if n:
        out[0] = True
    if n > 1:
        for k in keys:
            out[1:] |= _changed(batch.column(k))
    return out


def key_at(batch: pa.RecordBatch, keys: list[str], i: int) -> tuple:
    return tuple(batch.column(k)[i].as_py() for k in keys)


def prefix_sum_within(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str | None = None,
    into: str = "running",
    partitions: int | None = None,
    least: bool = False,
) -> DataFrame:
    """Inclusive running total of ``value`` (or of 1: a row number), or with ``least`` its running minimum, within each group.

    Rows come back sorted by ``group`` then ``order``. Null groups form a group,
    null values add nothing (and are never the minimum), ties in ``order`` are counted one after the other (name
    enough columns to make the order total). An empty table gives an empty table.
    """
    kind = "double" if value and dict(df.dtypes)[value] in ("double", "float") else "bigint"
    placed = range_sorted(df, [*group, *order], partitions)
    key_ddl = ", ".join(f"`{g}` {dict(df.dtypes)[g]}" for g in group)
    dtype = np.float64 if kind == "double" else np.int64
    nothing = 0 if not least else np.inf if kind == "double" else np.iinfo(np.int64).max
    together = min if least else lambda a, b: a + b

    def values(batch: pa.RecordBatch) -> np.ndarray:
        if value is None:
            return np.ones(batch.num_rows, dtype=dtype)
        return pc.fill_null(batch.column(value), nothing).to_numpy(zero_copy_only=False).astype(dtype, copy=True)

    def summarise(batches):
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            starts = np.flatnonzero(group_changes(b, group))
            last = int(starts[-1])
            total = (values(b)[last:].min() if least else values(b)[last:].sum()).item()
            key = key_at(b, group, last)
            if out is None:
                out = {PID: b.column(PID)[0].as_py(), "first": key_at(b, group, 0)}
                out |= {"whole": len(starts) == 1, "key": key, "total": total}
            elif len(starts) == 1 and key == out["key"]:
                out["total"] = together(out["total"], total)
            else:
                out |= {"whole": False, "key": key, "total": total}
        if out is None:
            return None
        return {PID: out[PID], "whole": out["whole"], "total": out["total"], **dict(zip(group, out["key"], strict=True))}

    def combine(state, row):
        key = tuple(row[g] for g in group)
        if state is not None and row["whole"] and state[0] == key:
            return key, together(state[1], row["total"])
        return key, row["total"]

    states = carried(placed, summarise, f"`{PID}` int, whole boolean, total {kind}" + (", " + key_ddl if group else ""), combine)
    sent = df.sparkSession.sparkContext.broadcast(states)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.DoubleType() if kind == "double" else T.LongType())])
    names = df.columns

    def rescan(batches):
        state = "unset"
        for b in batches:
            if not b.num_rows:
                continue
            if state == "unset":
                state = sent.value.get(b.column(PID)[0].as_py())
            v = values(b)
            change = group_changes(b, group)
            starts = np.flatnonzero(change)
            goes_on = state is not None and state[0] == key_at(b, group, 0)
            if least:
                if goes_on:
                    v[0] = min(v[0], state[1])
                running = np.concatenate([np.minimum.accumulate(part) for part in np.split(v, starts[1:])])
            else:
                total = np.cumsum(v)
                before = np.concatenate([[0], total])[starts]
                if goes_on:
                    before = before.copy()
                    before[0] -= state[1]
                running = total - np.repeat(before, np.diff(np.append(starts, len(v))))
            state = key_at(b, group, b.num_rows - 1), running[-1].item()
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(running)], names=[*names, into])

    return placed.mapInArrow(rescan, schema)


def rank_within(df: DataFrame, group: list[str], order: list[str], into: str = "rank", partitions: int | None = None) -> DataFrame:
    """Row number from 1 within each group, for groups of any size; see ``prefix_sum_within``."""
    return prefix_sum_within(df, group, order, None, into, partitions)
