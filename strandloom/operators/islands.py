"""Continuous blocks and gaps of overlapping intervals, per entity, for entities of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.ordered import PID, carried, group_changes, key_at, range_sorted


def _runs(change: np.ndarray, start: np.ndarray, end: np.ndarray, before: int | None, touch: int) -> tuple[np.ndarray, np.ndarray]:
    """Running maximum end within each group, and the same of the row before (below reach at a group's first row).

    ``before`` is the largest end so far of the first row's group, if it began earlier.
    """
    low, high = int(min(start.min(), end.min())), int(end.max())
    if before is not None:
        low, high = min(low, before), max(high, before)
    span = high - low + 1
    group = np.cumsum(change) - 1
    if span * (int(group[-1]) + 1) < 2**62:
        lifted = (end - low) + group * span
        if before is not None:
            lifted = lifted.copy()
            lifted[0] = max(lifted[0], before - low)
        top = np.maximum.accumulate(lifted) - group * span + low
    else:  # spans so wide that groups can't be lifted apart: group by group
        top = end.copy()
        firsts = np.append(np.flatnonzero(change), len(end))
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            top[a:b] = np.maximum.accumulate(end[a:b])
        if before is not None:
            top[: firsts[1]] = np.maximum(top[: firsts[1]], before)
    prior = np.empty_like(top)
    prior[1:] = top[:-1]
    prior[change] = start[change] - touch - 1
    if before is not None:
        prior[0] = before
    return top, prior


def blocks_and_gaps(
    df: DataFrame,
    entity: list[str],
    start: str,
    end: str,
    max_gap: int | None = None,
    touch: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Blocks of closed integer intervals ``[start, end]`` and the gaps between them.

    Two intervals of one entity belong to one block if they share a position or
    follow each other at a distance of at most ``touch`` (1: ``end + 1 = next
    start``). Gaps longer than ``max_gap`` positions are left out (None: none is).

    Method: rows are range-sorted over the whole table by entity and start; each
    partition leaves its last entity's largest end and last island's start; these
    summaries are combined in order; a second scan labels islands from the
    carried state. An island cut by a partition's edge comes as parts of one label
    that are joined by a last aggregation.

    Rows with a null start or end are no intervals; ``start > end`` is turned
    round. Null entity columns form an entity of their own. Repeated rows change
    nothing. Other columns are ignored, whatever their names. An empty table gives
    an empty result. Columns: the entity, piece (``block`` or ``gap``), from_pos, to_pos.
    """
    keys = [f"_k{i}" for i in range(len(entity))]
    a, b = F.col(start).cast("long"), F.col(end).cast("long")
    rows = df.where(a.isNotNull() & b.isNotNull()).select(
        *(F.col(e).alias(k) for e, k in zip(entity, keys, strict=True)), F.least(a, b).alias("_s"), F.greatest(a, b).alias("_e")
    )
    placed = range_sorted(rows, [*keys, "_s"], partitions)
    kinds = dict(rows.dtypes)

    def scan(batches, state, emit):
        """state: (key, largest end, island start) or None; emit(batch, keys' row numbers, piece, from, to)."""
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if first is None:
                first = batch.column(PID)[0].as_py()
                state = state(first)
            s = batch.column("_s").to_numpy()
            e = batch.column("_e").to_numpy()
            change = group_changes(batch, keys)
            same = state is not None and state[0] == key_at(batch, keys, 0)
            top, prior = _runs(change, s, e, state[1] if same else None, touch)
            new = s > prior + touch
            at = np.flatnonzero(new)
            if emit is not None:
                yield from emit(batch, state, same, s, top, prior, change, at)
            label = int(s[at[-1]]) if len(at) else state[2]
            state = (key_at(batch, keys, batch.num_rows - 1), int(top[-1]), label)
        if first is not None:
            yield first, state

    def summarise(batches):
        # without carried state; "whole" tells whether the partition holds one entity only
        found = None
        entities = {"n": 0, "last": None}

        def watch(batches):
            for batch in batches:
                if batch.num_rows:
                    key = key_at(batch, keys, 0)
                    entities["n"] += int(group_changes(batch, keys).sum()) - (entities["last"] == key)
                    entities["last"] = key_at(batch, keys, batch.num_rows - 1)
                yield batch

        for found in scan(watch(batches), lambda _: None, None):
            pass
        if found is None:
            return None
        pid, (key, top, label) = found
        return {PID: pid, "whole": entities["n"] == 1, "top": top, "label": label, **dict(zip(keys, key, strict=True))}

    def combine(state, row):
        key = tuple(row[k] for k in keys)
        if state is None or not row["whole"] or state[0] != key:
            return key, row["top"], row["label"]
        # the last local island starts an island for all only beyond the carried end
        label = row["label"] if row["label"] > state[1] + touch else state[2]
        return key, max(state[1], row["top"]), label

    ddl = ", ".join([f"`{PID}` int, whole boolean, top bigint, label bigint", *(f"`{k}` {kinds[k]}" for k in keys)])
    sent = df.sparkSession.sparkContext.broadcast(carried(placed, summarise, ddl, combine))

    out = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys), *T._parse_datatype_string("piece string, from_pos bigint, to_pos bigint").fields])

    def emit(batch, state, same, s, top, prior, change, at):
        ends = np.append(at[1:] - 1, len(s) - 1)
        parts = [(at, "block", s[at], top[ends])]
        if same and (not len(at) or at[0] > 0):  # rows that go on with the carried island
            last = (at[0] if len(at) else len(s)) - 1
            parts.append((np.array([0]), "block", np.array([state[2]]), np.array([top[last]])))
        inner = at[~change[at]]
        if same and len(at) and at[0] == 0:
            inner = np.insert(inner, 0, 0)
        lo, hi = prior[inner] + 1, s[inner] - 1
        keep = hi >= lo
        if max_gap is not None:
            keep &= hi - lo < max_gap
        parts.append((inner[keep], "gap", lo[keep], hi[keep]))
        for rows_, piece, lo_, hi_ in parts:
            if len(rows_):
                taken = [batch.column(k).take(pa.array(rows_)) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array([piece] * len(rows_)), pa.array(lo_.astype(np.int64)), pa.array(hi_.astype(np.int64))],
                    names=[*keys, "piece", "from_pos", "to_pos"],
                )

    def rescan(batches):
        for found in scan(batches, lambda pid: sent.value.get(pid), emit):
            if isinstance(found, pa.RecordBatch):
                yield found

    parts = placed.mapInArrow(rescan, out)
    whole = parts.groupBy(*keys, "piece", "from_pos").agg(F.max("to_pos").alias("to_pos"))
    return whole.select(*(F.col(k).alias(e) for e, k in zip(entity, keys, strict=True)), "piece", "from_pos", "to_pos")
