"""Near-duplicate vectors by product quantisation: coarse lists, residual codes, table look-ups, exact cosine rerank.

The index (coarse centroids and a codebook for each part of the residual) is fitted on at most ``SAMPLE`` vectors; every
vector is coded. Vectors with a cosine of t or more are at most ``r = sqrt(2 - 2t)`` apart on the unit sphere, which bounds the
search without loss:

* A vector y stands in list c only if c is its nearest centroid. So a query q needs a list only if the plane
  halfway between c and q's own centroid is at most r away from q. All such lists are probed, none is left out.
* For a code with error e, the table distance of q to a vector is at most its true distance plus e. So only
  candidates with a table distance up to r + e are reranked, by cosine in double precision.

Recall is therefore 1 up to rounding; the tests measure it against brute force.

At scale: equal vectors of a label are one class and enter once. Lists are split into blocks of about ``BLOCK`` vectors, and
each task compares two blocks; a vector is sent only to blocks of lists that it probes. A task returns a row per linked
vector (number of links, least vector joined in the task), never pairs, so dense groups stay linear. The lists' number
grows with the table up to ``LISTS``.

Vectors link with nothing if they or their label are missing, if they are zero, or hold missing or non-finite parts or another number of
parts; a row without ``vec_id`` links with nothing and is kept. Equal rows are separate vectors; a ``vec_id`` on several vectors has, row by
row, the links of its vector, and joins no groups. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage, unstage
from .common import received, send
from .components import components

SAMPLE, LISTS, BLOCK = 16_384, 2_048, 1_024
#: Residual parts, and code words for each.
PARTS, WORDS = 8, 256

CLEAN = "vec_id bigint, label string, digest binary, vector binary"
CODED = "vec_id bigint, label string, n bigint, vector binary, list int, probes array<int>, code binary, error double"
FOUND = "vec_id bigint, links bigint, least bigint"


def _clean(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Vectors as bytes of doubles; none for those that link with nothing."""
    vectors, digests = [], []
    for v in batch.column("embedding"):
        parts = v.values
        good = v.is_valid and len(parts) > 0 and parts.null_count == 0
        x = parts.to_numpy().astype(np.float64) if good else np.empty(0)
        good = good and bool(np.isfinite(x).all()) and bool(x.any())
        vectors.append(x.tobytes() if good else None)
        digests.append(hashlib.blake2b(vectors[-1], digest_size=16).digest() if good else None)
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
                                      names=["vec_id", "label", "digest", "vector"])


def unit_rows(column: pa.Array) -> np.ndarray:
    rows = [np.frombuffer(v.as_buffer(), dtype=np.float64) for v in column]
    # Scaled first: squares of very large or small parts would leave the range of doubles.
    return np.array([(s := x / np.abs(x).max()) / np.sqrt(s @ s) for x in rows])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def centroids(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means of a bounded sample."""
    out = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([squared(rows[i:i + 4096], out).argmin(1) for i in range(0, len(rows), 4096)])
        total = np.zeros_like(out)
        np.add.at(total, near, rows)
        count = np.bincount(near, minlength=len(out))
        out[count > 0] = total[count > 0] / count[count > 0, None]
    return out


class Index:
    """Coarse centroids and codebooks, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.coarse = centroids(sample, lists, rng)
        self.bounds = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        rest = sample - self.coarse[squared(sample, self.coarse).argmin(1)]
        self.books = [centroids(rest[:, a:b], WORDS, rng) for a, b in zip(self.bounds, self.bounds[1:])]

    def code(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest list, squared distances to all lists, code and error of every row."""
        far = squared(rows, self.coarse)
        own = far.argmin(1)
        rest = rows - self.coarse[own]
        code = np.column_stack([squared(rest[:, a:b], book).argmin(1) for (a, b), book in zip(zip(self.bounds, self.bounds[1:]), self.books)]).astype(np.uint8)
        approx = np.column_stack([book[code[:, m]] for m, book in enumerate(self.books)])
        return own, far, code, np.sqrt(((rest - approx) ** 2).sum(1))

    def probes(self, own: np.ndarray, far: np.ndarray, reach: float) -> np.ndarray:
        """Which lists can hold a vector within ``reach`` of each row."""
        apart = np.sqrt(squared(self.coarse, self.coarse))[own]
        return far - far[np.arange(len(own)), own][:, None] <= 2 * reach * apart + 1e-9

    def distances(self, rows: np.ndarray, of: int, code: np.ndarray) -> np.ndarray:
        """Table distances of ``rows`` to vectors of list ``of``, from their codes alone."""
        rest, out = rows - self.coarse[of], np.zeros((len(rows), len(code)))
        for m, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            out += squared(rest[:, a:b], self.books[m])[:, code[:, m]]
        return np.sqrt(out)


def compare(index: Index, least: float, left: dict, right: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of two blocks link: candidates by table distance, then exact cosine."""
    reach = np.sqrt(2 - 2 * least) + 1e-9
    linked = np.zeros((len(left["unit"]), len(right["unit"])), dtype=bool)
    for at in range(0, len(left["unit"]), 128):
        q = left["unit"][at:at + 128]
        near = index.distances(q, right["list"], right["code"]) <= reach + right["error"] + 1e-9
        x, y = np.nonzero(near)
        for i in range(0, len(x), 65_536):
            a, b = x[i:i + 65_536], y[i:i + 65_536]
            linked[at + a, b] = np.einsum("ij,ij->i", q[a], right["unit"][b]) >= least
    if same:
        linked |= linked.T
        np.fill_diagonal(linked, False)
    return linked


def _least_joined(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id joined to each row and column of a link matrix."""
    big = np.iinfo(np.int64).max
    while True:
        na = np.minimum(a, np.where(linked, b[None, :], big).min(1, initial=big))
        nb = np.minimum(b, np.where(linked, na[:, None], big).min(0, initial=big))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb


def link(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = embeddings.sparkSession

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_clean, batches)

    read = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    vectors = stage(read.mapInArrow(clean, CLEAN))
    valid = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    key = ["label", "digest"]
    # A class of equal vectors is a node; its number is not its vec_id, which may stand on other vectors too.
    classes = stage(valid.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    # Vectors of different length are compared apart: their number of parts belongs to the label.
    chosen = stage(valid.join(classes, [*key, "vec_id"]).dropDuplicates(key).withColumn("vec_id", F.col("node")).drop("node")
                   .withColumn("label", F.concat_ws(":", F.length("vector").cast("string"), "label")))
    shape = chosen.groupBy(F.length("vector").alias("bytes")).agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).collect()
    answers = [_search(chosen.where(F.length("vector") == s["bytes"]), least, s["n"], s["labels"]) for s in shape]
    found = answers[0] if answers else spark.createDataFrame([], FOUND)
    for more in answers[1:]:
        found = found.unionByName(more)
    grouped = components(found.select("vec_id", "least"))
    counted = found.groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("links"))
    named = stage(classes.join(counted, "node", "left").join(grouped, "node", "left").select(
        *key, "vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("group")))
    least = named.groupBy("group").agg(F.min("vec_id").alias("component"))
    named = stage(named.join(least, "group").select(*key, "links", "component"))
    out = vectors.select("vec_id", *[F.when(F.col("vec_id").isNotNull(), F.col(k)).alias(k) for k in key]).join(named, key, "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
                      F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def _search(rows: DataFrame, least: float, n: int, labels: int) -> DataFrame:
    """Links and least joined vector of the rows, all of one length, from each pair of blocks."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    lists = int(np.clip(-(-n // (labels * BLOCK)), 1, LISTS))
    sent = send(rows.sparkSession, Index(unit_rows(sample.column(0).combine_chunks()), lists))
    reach = float(np.sqrt(2 - 2 * least) + 1e-9)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(sent)
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                own, far, codes, error = index.code(unit_rows(batch.column("vector")))
                probes = [np.flatnonzero(p).tolist() for p in index.probes(own, far, reach)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "n", "vector")), pa.array(own, pa.int32()),
                                                  pa.array(probes, pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                                                 names=[c.split()[0] for c in CODED.split(", ")])

    coded = stage(rows.select("vec_id", "label", "n", "vector").mapInArrow(code, CODED))
    sizes = stage(coded.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    block = lambda c, i: F.struct(F.col(c).alias("list"), i.alias("part"))
    own = coded.join(sizes, ["label", "list"]).withColumn("own", block("list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))).drop("blocks")
    probing = own.withColumn("probe", F.explode("probes")).drop("probes").join(
        sizes.withColumnRenamed("list", "probe"), ["label", "probe"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = block("probe", F.col("part"))
    pairs = probing.select("label", F.least("own", other).alias("a"), F.greatest("own", other).alias("b"), "own", "vec_id", "n", "vector", "list", "code", "error")

    def work(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        first, second = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
        sides = []
        blocks = np.array([(x["list"], x["part"]) for x in rows.column("own").to_pylist()])
        for name in ([first] if first == second else [first, second]):
            mine = np.flatnonzero((blocks == (name["list"], name["part"])).all(axis=1))
            if not len(mine):
                return pa.table({c: pa.array([], pa.int64()) for c in ("vec_id", "links", "least")})
            part = rows.take(pa.array(mine)).combine_chunks()
            column = lambda c: part.column(c).combine_chunks()
            sides.append({"id": column("vec_id").to_numpy(), "n": column("n").to_numpy(), "unit": unit_rows(column("vector")), "list": name["list"],
                          "code": np.array([np.frombuffer(c.as_buffer(), dtype=np.uint8) for c in column("code")]), "error": column("error").to_numpy()})
        left, right = sides[0], sides[-1]
        linked = compare(received(sent), least, left, right, len(sides) == 1)
        low_a, low_b = _least_joined(linked, left["id"], right["id"])
        links_a, links_b = linked @ right["n"], linked.T @ left["n"]
        parts = [(left["id"], links_a, np.minimum(low_a, low_b))] if len(sides) == 1 else [(left["id"], links_a, low_a), (right["id"], links_b, low_b)]
        ids, links, low = (np.concatenate([p[i] for p in parts]) for i in range(3))
        keep = links > 0
        return pa.table({"vec_id": pa.array(ids[keep], pa.int64()), "links": pa.array(links[keep], pa.int64()), "least": pa.array(low[keep], pa.int64())})

    found = stage(pairs.groupBy("label", "a", "b").applyInArrow(work, FOUND))
    unstage(coded, sizes)
    return found
