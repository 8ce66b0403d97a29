"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames.

Nothing is collected: each step is an aggregation (with partial sums, so that a hub costs no more than its share) and a
join on the node. Every round is written to the shared folder, which ends the lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import durable


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, least node of its component) for every node that isn't the least of its own, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != x:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of each batch by the stars of its components: never more edges than nodes."""
    for batch in batches:
        stars = forest(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
        if stars:
            u, v = zip(*stars, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _contract_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _contract, over all batches together."""
    held = list(batches)
    yield from _contract(iter(pa.Table.from_batches(held).combine_chunks().to_batches() if held else []))


def connected_components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """node, root (its component's least node, itself excluded) from edges (u long, v long). No edges give no rows.

    Up to `at_once` edges are contracted by one task, without rounds.
    """
    edges = durable(edges.select("u", "v").mapInArrow(_contract, "u long, v long"), "edges")
    if at_once and edges.count() <= at_once:
        return durable(edges.coalesce(1).mapInArrow(_contract_all, "u long, v long").toDF("node", "root"), "edges")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        with_least = large.join(least, "u")
        small = with_least.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = durable(small.distinct(), "edges")
