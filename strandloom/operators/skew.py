"""Joins with a table of unique keys where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than one row in so many are joined by broadcast. There are fewer of them than this, whatever the data.
SHARE = 4096


def join_unique(rows: DataFrame, table: DataFrame, key: str, degree: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, whose ``key`` is unique and whose ``degree`` tells how many of the ``total`` rows have it.

    Rows of the few keys with more than ``total / SHARE`` rows stay where they are and meet a
    broadcast of at most SHARE table rows; all other rows meet theirs by a shuffle in which no
    key is large. Both inputs are read twice: store them first. ``degree`` is not kept.
    """
    hot = F.col(degree) * SHARE > F.lit(total)
    few = table.where(hot).drop(degree)
    many = table.where(~hot).drop(degree)
    by_broadcast = rows.join(F.broadcast(few), key)
    by_shuffle = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(many, key)
    return by_broadcast.unionByName(by_shuffle)
