"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import checkpoint

#: Edges a task contracts at once.
CONTRACT_ROWS = 200_000
#: So few edges that one task contracts all of them.
FEW_EDGES = 1 << 14


def forest(edges: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges (node, least node of its component) that join the same nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        stars = forest(e for b in held for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], ["u", "v"])

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CONTRACT_ROWS:
            yield out(held)
            held, rows = [], 0
    if held:
        yield out(held)


def _is_star(edges: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether each node either has one lesser neighbour and no greater one, or none lesser."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    told = nodes.agg(F.sum("up").alias("n"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("bad")).first()
    return told["n"] or 0, not told["bad"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u long, v long); component is its least node.

    Tasks first contract the edges they hold.  Then large-star and small-star
    steps alternate until all are stars; each is an aggregation and a join, so
    a node with very many neighbours is never gathered.  A few edges
    (``FEW_EDGES``) are contracted in one task.  Loops and repeated edges are
    allowed; nodes without an edge to another node are not listed.
    """
    schema = "u long, v long"
    now = checkpoint(edges.where("u != v").select("u", "v").mapInArrow(_contract, schema).distinct())
    while True:
        n, star = _is_star(now)
        if star:
            break
        if n <= FEW_EDGES:
            now = checkpoint(now.coalesce(1).mapInArrow(_contract, schema))
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # aggregated apart from the join, so that the join's own shuffle can be split where a node has many neighbours
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every edge now leads from a node to a lesser one
        large = checkpoint(large.where("u != v").distinct())
        low = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        now = checkpoint(small.select("e.u", "e.v").where("u != v").distinct())
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
