"""Connected components by alternating stars, for graphs of any size and shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.staged import Staged

#: Links a task contracts at a time.
_BLOCK = 1 << 20


def _contracted(block: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The links of a block as stars on each component's least node."""
    u = np.concatenate([b.column(0).to_numpy() for b in block])
    v = np.concatenate([b.column(1).to_numpy() for b in block])
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, root[a], least)
        np.minimum.at(now, root[b], least)
        now = now[now]
        if (now == root).all():
            break
        root = now
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[root[child]]), pa.array(nodes[child])], names=["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _BLOCK:
            yield _contracted(held)
            held, rows = [], 0
    if rows:
        yield _contracted(held)


def _star(edges: DataFrame, large: bool, staged: Staged) -> DataFrame:
    """Hang a node's greater (or smaller) neighbours on the least node it knows.

    The minima are a written table, so that both sides of the join are plain
    shuffles, of which adaptive execution can split a node with very many links.
    """
    ways = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:
        ways = ways.unionByName(edges)
    least = staged.put(f"least-{large}", ways.groupBy("u").agg(F.min("v").alias("least")))
    hung = ways.join(least, "u").withColumn("least", F.least("u", "least"))
    if large:
        hung = hung.where("v > u").select(F.col("least").alias("u"), "v")
    else:
        hung = hung.select("least", F.explode(F.array("u", "v")).alias("v")).select(F.col("least").alias("u"), "v")
    return hung.where("u < v")


def _done(edges: DataFrame) -> bool:
    """Whether all edges are stars: every child has one parent, and no parent is a child."""
    ends = edges.select(F.col("v").alias("node"), "u", F.lit(0).alias("parent")).union(
        edges.select(F.col("u").alias("node"), F.col("u"), F.lit(1).alias("parent"))
    )
    loose = ends.groupBy("node").agg(F.min("u").alias("x"), F.max("u").alias("y"), F.min("parent").alias("p"), F.max("parent").alias("q"))
    return loose.where("x <> y or p <> q").isEmpty()


def components(links: DataFrame, staged: Staged) -> DataFrame:
    """(node, component): the least node reachable, for all nodes of ``links(a, b)``.

    First each task contracts its own links, in blocks; then each pass is two joins
    on partly aggregated minima, so that a node with very many links needs no task of
    its own. Passes grow with the logarithm of the longest path. Nodes without links
    are not in the result.
    """
    edges = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v")
    edges = staged.put("edges", edges.mapInArrow(_contract, "u long, v long"))
    while not _done(edges):
        passed = _star(edges, True, staged).distinct()
        edges = staged.put("edges", passed)
        passed = _star(edges, False, staged).distinct()
        edges = staged.put("edges", passed)
    stars = edges.distinct()
    return stars.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
