"""Isolation forest: an independent outlier flag to set beside the rarity flag.

Trees are grown in parallel, one small bounded sample each; scoring is a vectorised pass over the
rows with the (equally bounded) trees broadcast.

A tree that never saw a far row cannot tell it from the row at the edge of its sample: both take the same path. So, as in
the forest with split criterion (Liu, Ting and Zhou, 2010), a split does not count for a row that lies out of the acceptable
range of its column: the sample's range, and as much again on either side. Other rows score as in the plain forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.columns import col
from ..session import stage
from .features import encode_for_model

# The usual forest.
TREES = 100
SAMPLE = 256
FLAG_ABOVE = 0.5
EULER_GAMMA = 0.5772156649015329

NODES = "tree int, node int, feature int, split double, left int, right int, path double, least double, most double"


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def _draws(base: np.ndarray, tree: int) -> np.ndarray:
    """A random number per row and tree, from one random number per row."""
    x = base + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(33))) >> np.uint64(1)


def tree_samples(df: DataFrame, rows: int, trees: int, size: int, seed: int) -> DataFrame:
    """Exactly ``min(size, rows)`` random rows per tree, without repeats inside a tree.

    A tree takes the rows with its least draws. Every task keeps that many per tree, so at most
    ``tasks * size`` rows compete for a tree, however large the table is.
    """
    size = min(size, rows)
    names = df.columns
    schema = T.StructType([*df.schema, T.StructField("tree", T.IntegerType()), T.StructField("__order", T.LongType())])

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[pd.DataFrame | None] = [None] * trees
        for pdf in batches:
            base = pdf["__u"].to_numpy().view(np.uint64)
            for tree in range(trees):
                order = _draws(base, tree).astype(np.int64)
                at = np.argpartition(order, size - 1)[:size] if len(order) > size else np.arange(len(order))
                part = pdf[names].iloc[at].assign(tree=np.int32(tree), __order=order[at])
                kept = part if best[tree] is None else pd.concat([best[tree], part])
                best[tree] = kept.nsmallest(size, "__order") if len(kept) > size else kept
        yield from (part for part in best if part is not None)

    drawn = stage(df.withColumn("__u", F.rand(seed)).mapInPandas(least, schema))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("__order", *map(col, names)))
    return drawn.withColumn("__place", place).where(F.col("__place") <= size).drop("__place", "__order")


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[list] = []
    low, high = points.min(axis=0), points.max(axis=0)
    least, most = low - (high - low), high + (high - low)
    todo = [(np.arange(len(points)), 0, None)]
    while todo:
        members, depth, parent = todo.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent[0]][parent[1]] = me
        part = points[members]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append([me, -1, 0.0, -1, -1, depth + mean_path(len(members)), 0.0, 0.0])
            continue
        feature = int(rng.choice(spread))
        values = part[:, feature]
        split = float(rng.uniform(values.min(), values.max()))
        nodes.append([me, feature, split, -1, -1, 0.0, float(least[feature]), float(most[feature])])
        goes_left = values <= split
        todo.append((members[~goes_left], depth + 1, (me, 4)))
        todo.append((members[goes_left], depth + 1, (me, 3)))
    return [tuple(n) for n in nodes]


def grow_forest(samples: DataFrame, features: Sequence[str], size: int, seed: int) -> pd.DataFrame:
    """All nodes of all trees: at most ``trees * 2 * size`` short rows."""
    limit = math.ceil(math.log2(max(size, 2)))
    names = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = pdf.sort_values(names)[names].to_numpy(dtype=float)
        nodes = _grow(points, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "path", "least", "most"])
        out.insert(0, "tree", tree)
        return out

    return samples.select("tree", *map(col, names)).groupBy("tree").applyInPandas(grow, NODES).toPandas()


def isolation_scores(df: DataFrame, features: Sequence[str], id_cols: Sequence[str], trees: int = TREES,
                     size: int = SAMPLE, seed: int = 0) -> DataFrame:
    """``(ids, score, flagged)``; scores near 1 are isolated quickly, above 0.5 is flagged."""
    ids, names = list(id_cols), [f"f{i}" for i in range(len(features))]
    encoded = encode_for_model(df.select(*map(col, ids), *map(col, features)), tuple(ids))
    numbers = encoded.select(*map(col, ids), *[col(f).cast("double").alias(n) for f, n in zip(features, names)])
    rows = df.count()
    size = min(size, max(rows, 1))
    forest = grow_forest(tree_samples(numbers.select(*names), rows, trees, size, seed), names, size, seed)
    grown = [g.sort_values("node") for _, g in forest.groupby("tree")]
    packed = df.sparkSession.sparkContext.broadcast(
        [tuple(g[c].to_numpy() for c in ("feature", "split", "left", "right", "path", "least", "most")) for g in grown])
    scale = mean_path(size) or 1.0
    depth = math.ceil(math.log2(max(size, 2)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            points = pdf[names].to_numpy(dtype=float)
            total, at = np.zeros(len(points)), np.arange(len(points))
            for feature, split, left, right, path, least, most in packed.value:
                node = np.zeros(len(points), dtype=np.int64)
                passed, beyond = node.copy(), node.copy()
                for _ in range(depth):
                    f = feature[node]
                    x = points[at, np.maximum(f, 0)]
                    passed += f >= 0
                    beyond += (f >= 0) & ((x < least[node]) | (x > most[node]))
                    node = np.where(f < 0, node, np.where(x <= split[node], left[node], right[node]))
                total += path[node] - np.minimum(beyond, np.maximum(passed - 1, 0))  # one split at least tells a row apart
            out = pdf[ids].copy()
            out["score"] = np.power(2.0, -(total / len(packed.value)) / scale) if packed.value else 0.0
            out["flagged"] = out["score"] > FLAG_ABOVE
            yield out

    schema = T.StructType([numbers.schema[c] for c in ids] + [
        T.StructField("score", T.DoubleType()), T.StructField("flagged", T.BooleanType())])
    return numbers.mapInPandas(score, schema)
