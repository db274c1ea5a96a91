"""Every core query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from strandloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_names_are_sound():
    import re

    assert set(SQL) <= set(QUERIES)
    assert {n for n in QUERIES if re.match(r"(op|p)\d+_", n)} == {"p2_found", "p2_dialects", "p5_found", "p5_coverage"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        return
    rel = duck.sql(SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert ours == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
