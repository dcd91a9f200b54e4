"""Connected components of links, by union-find within tasks and star contraction between them.

Every task first joins the links it holds by union-find, which leaves a forest: at most one link per node and task. Then
alternating star steps hang the larger neighbours of each node, and after that the smaller ones, on the least
neighbour, until every component is a star around its least node. All steps are grouped minima, combined per task, and joins
of two stored tables, whose hot keys Spark splits; no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage, unstage

LINKS = "high bigint, low bigint"


def find(parent: dict[int, int], node: int) -> int:
    """Least node joined to ``node`` so far; the path to it is made short."""
    root = node
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(node, node)) != root:
        parent[node], node = root, up
    return root


def unite(parent: dict[int, int], a: int, b: int) -> None:
    a, b = find(parent, a), find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)
        parent.setdefault(min(a, b), min(a, b))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            unite(parent, a, b)
    nodes = [n for n in parent if find(parent, n) != n]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at:at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(parent, n) for n in part], pa.int64())], names=["high", "low"])


def _summary(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links`` (two columns of numbers) that is not its component's least."""
    a, b = links.columns
    here = stage(links.where((F.col(a) != F.col(b))).select(a, b).mapInArrow(_forests, LINKS).distinct())
    seen = _summary(here)
    while seen[0]:
        both = here.unionByName(here.select(F.col("high").alias("low"), F.col("low").alias("high"))).toDF("node", "other")
        least = stage(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m")))
        large = stage(both.join(least, "node").where("other > node").select(F.col("other").alias("high"), F.col("m").alias("low"))
                      .where("high != low").distinct())
        lowest = stage(large.groupBy("high").agg(F.min("low").alias("m")))
        small = large.join(lowest, "high").where("low != m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        new = stage(small.unionByName(lowest.select("high", F.col("m").alias("low"))).distinct())
        unstage(least, large, lowest, here)
        here, before, seen = new, seen, _summary(new)
        if seen == before:
            break
    return here.select(F.col("high").alias("node"), F.col("low").alias("component"))


def union_find_labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same on one machine, for tests: least reachable number of 0..size-1."""
    parent: dict[int, int] = {}
    for x, y in zip(a.tolist(), b.tolist()):
        unite(parent, x, y)
    return np.array([find(parent, i) for i in range(size)])
