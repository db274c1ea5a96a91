import random
from collections import Counter

import pytest

from strandloom.llm.mixing import mix_report, mix_sources

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("absent", 0.1, 1)]


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(4)
    rows = [(i, "a" if i % 2 else "b" if i % 10 else "c", rng.randrange(1, 400), "x") for i in range(6000)]
    rows += [(90_000, None, 5, "x"), (90_001, "other", 50, "x"), (90_002, "a", None, "x"), (90_003, "a", 0, "x")]
    return rows, spark.createDataFrame(rows, "id bigint, source string, n int, copies_each string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark, items, targets):
    rows, df = items
    mixed = mix_sources(df, "id", "source", "n", targets, seed=5).collect()
    copies = Counter((r["source"], r["id"]) for r in mixed)
    caps = {s: c for s, _, c in TARGETS}
    assert all(n <= caps[s] for (s, _), n in copies.items())
    size, owner = {i: n for i, _, n, _ in rows}, {i: s for i, s, _, _ in rows}
    assert all(r["n"] == size[r["id"]] and r["source"] == owner[r["id"]] for r in mixed)
    tokens = Counter()
    for r in mixed:
        tokens[r["source"]] += r["n"]
    total = sum(tokens.values())
    for s, share, _ in TARGETS[:3]:
        assert tokens[s] / total == pytest.approx(share / 0.9, abs=0.003)
    # the source that reaches its cap first is used up to it
    assert any(all(copies[s, i] == caps[s] for i in size if owner[i] == s and size[i]) for s in "abc")
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, mix_sources(df.repartition(5), "id", "source", "n", targets, seed=5).collect()))


def test_larger_total_is_capped_and_reported(spark, items, targets):
    _, df = items
    report = {r["source"]: r for r in mix_report(df, "id", "source", "n", targets, total=10**9).collect()}
    assert report["a"]["most_repeats"] == 1 and report["b"]["most_repeats"] == 3 and report["c"]["most_repeats"] == 2
    assert report["absent"]["mixed_tokens"] == 0 and report["other"]["mixed_tokens"] == 0 and report["other"]["target_share"] is None
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1, abs=1e-5)
    assert report["b"]["actual_share"] > report["b"]["aimed_share"]


def test_small_total_samples_evenly(spark, items, targets):
    rows, df = items
    goal = sum(n or 0 for _, _, n, _ in rows) / 20
    mixed = mix_sources(df, "id", "source", "n", targets, total=int(goal)).collect()
    assert sum(r["n"] for r in mixed) == pytest.approx(goal, rel=0.01)
    assert max(Counter(r["id"] for r in mixed).values()) == 1


def test_empty(spark, items, targets):
    _, df = items
    assert mix_sources(df.limit(0), "id", "source", "n", targets).collect() == []
    assert mix_sources(df, "id", "source", "n", targets.limit(0)).collect() == []
    assert mix_report(df.limit(0), "id", "source", "n", targets).count() == 4
