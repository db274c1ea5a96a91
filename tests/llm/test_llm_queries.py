"""The subpackage's queries against their SQL on the smallest tables, and what its queries promise."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from strandloom.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    ours = Counter(tuple(r[c] for c in cols) for r in df.collect())
    if name in SQL:
        rel = duck.sql(SQL[name])
        at = [rel.columns.index(c) for c in cols]
        assert ours == Counter(tuple(r[i] for i in at) for r in rel.fetchall())
    else:
        assert ours.total() > 0


def test_packed_documents_are_whole(spark, data):
    rows = QUERIES["p6_pack"](spark, data)
    per = rows.groupBy("container_kind", "container_id").sum("n_tokens").collect()
    caps = {"short": 512, "medium": 2048, "long": 8192}
    assert all(r[2] <= caps[r[0]] for r in per)
    fill = {r["container_kind"]: r["fill_share"] for r in QUERIES["p6_fill"](spark, data).collect()}
    assert fill["short"] > 0.95


def test_shares_follow_targets(spark, data):
    r = QUERIES["p7_shares"](spark, data).collect()
    assert all(x["most_repeats"] <= x["max_repeats"] for x in r if x["max_repeats"])
    assert all(abs(x["actual_share"] - x["aimed_share"]) < 0.05 for x in r if x["aimed_share"] and x["n_tokens"])


def test_core_does_not_import_this(spark):
    root = Path(__file__).resolve().parents[2] / "strandloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "strandloom.llm" not in f.read_text() and "import llm" not in f.read_text(), f
