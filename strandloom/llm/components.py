"""Consolidating pairwise matches into groups by seed-tree pruning.

Each round every vertex proposes the minimum of its neighbourhood to itself and its
neighbours. A vertex then links its own minimum to the other minima it was
proposed; a vertex that nobody's minimum is drops out and hangs below its minimum in
a propagation forest. The graph shrinks until only the smallest vertex of each
component is left, and the seeds' identifiers flow down the forest, last round first.

The rounds see vertices as 64-bit hashes of their identifiers. In the identifiers' own
order a chain that rises along itself would lose few vertices a round while its links
multiply; in a random order every round drops most of them. Should two identifiers
have one hash, vertices are numbered in hashed order instead. Rounds run as shuffles
while the graph is large; what is left of it, at most ``LOCAL`` links, goes through the
same rounds on arrays in one task. The group's smallest identifier is found at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ordered import rank_within
from strandloom.operators.skew import join_unique
from strandloom.session import materialize, release

#: Links, each counted both ways, that one task takes: 16 bytes each. A larger graph is pruned by shuffles.
LOCAL = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def prune(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, seeds) of the links u - v, which stand there both ways, by the rounds of the module's text."""
    vertices, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    n = len(vertices)
    u, v = at[: len(u)], at[len(u) :]
    above = np.arange(n)
    layers = []
    while len(u):
        least = np.arange(n)
        np.minimum.at(least, u, v)
        held = np.unique(u)
        pairs = np.unique(np.concatenate([v, held]) * n + least[np.concatenate([u, held])])
        w, m = pairs // n, pairs % n
        own = np.arange(n)
        np.minimum.at(own, w, m)
        stays = np.zeros(n, dtype=bool)
        stays[m[m == w]] = True
        hung = held[~stays[held]]
        above[hung] = own[hung]
        layers.append(hung)
        more = m != own[w]
        a, b = own[w[more]], m[more]
        pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
        u, v = pairs // n, pairs % n
    for hung in reversed(layers):  # the seeds flow down, last round first
        above[hung] = above[above[hung]]
    return vertices, vertices[above]


def _prune_in_one_task(graph: DataFrame) -> DataFrame:
    """(w, g) of a small graph."""

    def run(batches):
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if parts:
            found = prune(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["w", "g"])

    return graph.select("u", "v").repartition(1).mapInArrow(run, "w bigint, g bigint")


def _identified(rows: DataFrame, hashed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(links as numbers u, v; names as n, x): hashes if no two identifiers share one, else ranks in hashed order."""
    text = lambda c: hashed(F.col(c).cast("string"))
    ends = rows.select(F.col("a").alias("x")).unionByName(rows.select(F.col("b").alias("x")))
    names = materialize(ends.groupBy("x").agg(F.count("*").alias("degree")).withColumn("n", text("x")))
    if names.groupBy("n").count().where("count > 1").isEmpty():
        return rows.select(text("a").alias("u"), text("b").alias("v")), names.select("n", "x")
    numbers = materialize(rank_within(names.withColumnRenamed("n", "h"), [], ["h", "x"], "n").select("x", "n", "degree"))
    total = 2 * rows.count()
    half = materialize(join_unique(rows, numbers.select(F.col("x").alias("a"), F.col("n").alias("u"), "degree"), "a", "degree", total).select("u", "b"))
    links = join_unique(half, numbers.select(F.col("x").alias("b"), F.col("n").alias("v"), "degree"), "b", "degree", total)
    return links.select("u", "v"), numbers.select("n", "x")


def connected_groups(
    edges: DataFrame, left: str, right: str, vertex: str = "vertex", group: str = "group_id", local: int = LOCAL, hashed: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """(vertex, group) for every vertex with a link to another one; the group is its smallest vertex.

    ``edges`` are undirected; repeats, reversed rows and self links change nothing, rows
    with a null end are no links. Other columns are ignored. An empty table gives an
    empty result. Aggregates over a vertex's links are partial ones, and joins by vertex
    hand the few vertices with very many links to a broadcast of bounded size, so a vertex with a
    third of all links is never gathered in one task.
    """
    rows = materialize(edges.where(F.col(left) != F.col(right)).select(F.col(left).alias("a"), F.col(right).alias("b")).distinct())
    links, names = _identified(rows, hashed)
    graph = materialize(_both_ways(links))
    hung: list[DataFrame] = []
    seeds: list[DataFrame] = []  # vertices of the graph before each round: those that leave it without hanging are seeds
    while (total := graph.count()) > local:
        minima = graph.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        minima = materialize(minima)
        proposed = join_unique(graph, minima, "u", "d", total).select(F.col("v").alias("w"), "m")
        proposed = materialize(proposed.unionByName(minima.select(F.col("u").alias("w"), "m")).distinct())
        own = materialize(proposed.groupBy("w").agg(F.min("m").alias("own"), F.bool_or(F.col("m") == F.col("w")).alias("stays"), F.count("*").alias("d")))
        hung.append(own.where("not stays").select("w", F.col("own").alias("above")))
        linked = join_unique(proposed, own.select("w", "own", "d"), "w", "d", proposed.count()).where("m <> own")
        before, graph = graph, materialize(_both_ways(linked.select(F.col("own").alias("u"), F.col("m").alias("v"))))
        release(before, minima, proposed)  # the shared folder holds one graph, and a row a vertex of each round
        left_out = own.where("stays").select("w").join(graph.select(F.col("u").alias("w")).distinct(), "w", "left_anti")
        seeds.append(materialize(left_out.select("w", F.col("w").alias("g"))))
    # a vertex below can only hang below one that was still there in its round, whose label is known by then
    labelled = [materialize(reduce(DataFrame.unionByName, [_prune_in_one_task(graph), *seeds]))]
    release(graph)
    for layer in reversed(hung):
        known = reduce(DataFrame.unionByName, labelled).select(F.col("w").alias("above"), "g")
        labelled.append(materialize(layer.join(known, "above").select("w", "g")))
    members = materialize(reduce(DataFrame.unionByName, labelled).join(names, F.col("w") == F.col("n")).select("x", "g"))
    release(rows, *labelled)
    least = materialize(members.groupBy("g").agg(F.min("x").alias("m"), F.count("*").alias("d")))
    return join_unique(members, least, "g", "d", members.count()).select(F.col("x").alias(vertex), F.col("m").alias(group))
