"""Connected components as DataFrame jobs: union-find inside partitions, then star contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges; each node is left with one edge, to its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] if p in parent else p
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = [x for x in parent if root(x) != x]
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["hi", "lo"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Large-star and small-star steps alternate until the edges are stars around the
    smallest nodes. Edges are written to the shared folder after each round. Minima are
    aggregated before they are shuffled and joined back, so that a hub's edges need not
    meet in one task.
    """
    e = stored(edges.where("a <> b").selectExpr("cast(a as long) a", "cast(b as long) b").mapInArrow(_forest, "hi long, lo long").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen is not None and tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
        both = e.selectExpr("hi u", "lo v").unionAll(e.selectExpr("lo u", "hi v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v hi", "m lo").where("hi <> lo").distinct()
        large = stored(large, "edges")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").selectExpr("lo hi", "m lo").unionAll(least.selectExpr("hi", "m lo"))
        e = stored(small.distinct(), "edges")
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    return e.selectExpr("hi node", "lo component").unionAll(e.selectExpr("lo node", "lo component").distinct())
