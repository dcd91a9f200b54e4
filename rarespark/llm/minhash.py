"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find.

Each element of a document's shingle set orders the signature's slots by its own random permutation; the slot it puts in
round j gets the value j plus a random fraction, and each slot keeps its least value. Later rounds only give larger values, so
a document stops as soon as every slot has one. Slots of one element never agree by chance in one round, which gives
signatures of lower variance than independent hashes. ``BANDS`` bands of ``ROWS`` slots make the candidates; at
similarity 0.8 a pair misses all of them with a probability of 3 in a million. Every link is confirmed on the full sets.

Documents with equal sets are one class and enter with one representative. A bucket never emits its pairs:

1. every representative is compared with the least member of all its buckets;
2. in buckets that still hold several groups, every member is compared with the least member;
3. what is left in such buckets is compared across groups only, in blocks of bounded size within tasks: on full sets if the signatures allow the similarity (five standard deviations of slack). A task returns a spanning forest of its links.

At scale: texts are read twice and never shuffled. The second reading makes the full sets of candidates, told by a bitmap of
fixed size over hashed ids. Grouped minima are combined per task; joins have stored tables on both sides, so that Spark
splits a hot class or bucket. Intermediate tables lie in the shared folder.

Documents without words link with nothing; missing texts count as such. A row without ``doc_id`` links with nothing and is kept. Equal
rows belong together; a ``doc_id`` on several rows takes, row by row, the group of its text, and joins no groups. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage, unstage
from .common import bitmap, chunks, combine, find_words, in_bitmap, lower_ascii, mix, span_hashes, text_bytes, texts
from .components import components, find, unite

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Bits of the bitmap that tells candidates; two rows may share one, which only costs work.
BITMAP = 1 << 26
#: Members of a bucket that a task compares at once.
BLOCK = 1_024

SIGNED = "doc_id bigint, text_digest binary, digest binary, n_shingles bigint, signature binary, bands array<bigint>"
SETS = "id bigint, part bigint, shingles binary"


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``width`` words of every text, and the text of each; a shorter text is one shingle."""
    data, offsets = text_bytes(column)
    starts, ends, docs = find_words(data, offsets)
    words = span_hashes(lower_ascii(data), starts, ends)
    n = len(words)
    places = np.searchsorted(docs, np.arange(len(column) + 1))
    out = mix(words)
    live = np.ones(n, dtype=bool)
    for k in range(1, width):
        follows = np.zeros(n, dtype=bool)
        follows[:n - k] = docs[k:] == docs[:n - k] if n > k else False
        out[follows] = combine(out[follows], np.roll(words, -k)[follows])
        live &= follows
    counts = np.diff(places)
    first = places[:-1][(counts > 0) & (counts < width)]
    live[first] = True
    at = np.flatnonzero(live)
    return out[at], docs[at]


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted shingle set of every text."""
    hashes, docs = shingles(column, width)
    places = np.searchsorted(docs, np.arange(len(column) + 1)).tolist()
    return [np.unique(hashes[a:b]) for a, b in zip(places, places[1:])]


def signatures(elements: np.ndarray, docs: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of ``n`` sets: round number in the upper, random fraction in the lower bits of each slot.

    ``docs`` tells the set of each element. Empty sets keep the largest number everywhere.
    """
    unset = np.uint32(0xFFFFFFFF)
    out = np.full(n * slots, unset, dtype=np.uint32)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        if not len(elements):
            break
        z = mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        swap = j + ((z & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        slot = swap
        for t in range(j - 1, -1, -1):  # undo the earlier swaps of this element's permutation
            slot = np.where(slot == swaps[t], t, slot)
        value = (z >> np.uint64(40)).astype(np.uint32) | np.uint32(j << 24)
        np.minimum.at(out, docs * slots + slot, value)
        swaps.append(swap.astype(np.int16))
        open_docs = (out.reshape(n, slots) == unset).any(axis=1)
        if not open_docs[docs].all():
            keep = open_docs[docs]
            elements, docs, swaps = elements[keep], docs[keep], [s[keep] for s in swaps]
    return out.reshape(n, slots)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019), (len(signature), 1))
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        out = combine(out, parts[:, :, r])
    return out.view(np.int64)


def _sign(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    sets = sets_of(batch.column("text"), width)
    counts = np.array([len(s) for s in sets])
    signature = signatures(np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), counts), len(sets))
    bands = band_hashes(signature)
    # Two bytes a slot are enough to compare signatures.
    short = mix(signature.astype(np.uint64)).astype(np.uint16)
    ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))])
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), batch.column("text_digest"), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
        pa.array(counts, pa.int64()), pa.array([s.tobytes() for s in short], pa.binary()),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands[counts > 0].ravel()))],
        names=["doc_id", "text_digest", "digest", "n_shingles", "signature", "bands"])


def _part():
    """Eight bytes of a digest, to tell rows of one ``doc_id`` apart."""
    return F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("bigint")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least ``percent`` percent of their union."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


class Verifier:
    """Confirms pairs ``a, a_part, a_node, b, b_part, b_node`` on the full shingle sets of their documents."""

    def __init__(self, documents: DataFrame, candidates: DataFrame, width: int, percent: int):
        self.percent = percent
        marked = candidates.select(F.xxhash64("id").alias("spot"))
        sent = documents.sparkSession.sparkContext.broadcast(bitmap(marked, "spot", BITMAP))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(in_bitmap(sent.value, batch.column("spot").to_numpy())))
                for part in chunks(iter([batch])):
                    sets = sets_of(part.column("text"), width)
                    keys = [int(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()[:15], 16) for s in sets]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.int64()),
                                                      pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "part", "shingles"])

        read = texts(documents).where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("spot"))
        self.sets = stage(read.mapInArrow(work, SETS))

    def links(self, pairs: DataFrame) -> DataFrame:
        """``a, b``, the nodes of the pairs whose sets are similar enough, stored."""
        percent = self.percent
        side = lambda x: self.sets.select(F.col("id").alias(x), F.col("part").alias(f"{x}_part"), F.col("shingles").alias(f"{x}_set"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = [similar(np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64), percent)
                       for a, b in zip(batch.column("a_set"), batch.column("b_set"))]
                yield pa.RecordBatch.from_arrays([batch.column("a_node"), batch.column("b_node")], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

        full = pairs.join(side("b"), ["b", "b_part"]).join(side("a"), ["a", "a_part"])
        return stage(full.select("a_node", "b_node", "a_set", "b_set").mapInArrow(work, "a bigint, b bigint"))


def _possible(percent: int):
    """Sizes so different that the sets cannot be similar enough need no comparison."""
    return 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")


def _block_pairs(rows: pa.RecordBatch, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row x with all later rows y of one task that are in other groups and whose signatures allow the similarity.

    A pair belongs to the first band it shares, and to the task of its two blocks.
    """
    least = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / SLOTS)
    groups, counts, own = (rows.column(c).to_numpy() for c in ("component", "n", "own"))
    signature = np.array([np.frombuffer(s.as_buffer(), dtype=np.uint16) for s in rows.column("signature")])
    bands = np.array(rows.column("bands").to_pylist(), dtype=np.int64)
    band, mixed = rows.column("band")[0].as_py(), rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    for x in range(rows.num_rows):
        y = np.flatnonzero((groups != groups[x]) & (np.arange(len(own)) > x) & ((own != own[x]) | (not mixed)))
        y = y[100 * np.minimum(counts[y], counts[x]) >= percent * np.maximum(counts[y], counts[x])]
        y = y[(signature[y] == signature[x]).mean(axis=1) >= least] if len(y) else y
        if len(y):
            shared = bands[y] == bands[x]
            y = y[bands[x][shared.argmax(axis=1)] == band]
        if len(y):
            yield x, y


def _spread(members: DataFrame) -> DataFrame:
    """Rows dealt to pairs of blocks of their bucket.

    Groups of ``BLOCK`` members and more have blocks of their own, which need not meet each other; the rest shares blocks, which meet all.
    """
    groups = members.groupBy("band", "component").agg(F.count("*").alias("size"))
    large = F.col("size") >= BLOCK
    need = lambda n: F.ceil(n / BLOCK).cast("int")
    groups = stage(groups.withColumn("need", F.when(large, need(F.col("size"))).otherwise(0)))
    buckets = groups.groupBy("band").agg(need(F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0))).alias("shared"), F.sum("need").alias("needed"))
    # Groups that have blocks of their own are few: no more than a bucket's members by BLOCK.
    before = Window.partitionBy("band").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    own = groups.where("need > 0").select("band", "component", "need", F.coalesce(F.sum("need").over(before), F.lit(0)).alias("before"))
    placed = members.join(stage(buckets), "band").join(stage(own), ["band", "component"], "left")
    first = (F.col("shared") + F.col("before")).cast("int")
    spot = F.xxhash64("id", "part")
    placed = placed.withColumn("own", F.when(F.col("need") > 0, first + F.pmod(spot, F.col("need")).cast("int"))
                               .otherwise(F.pmod(spot, F.greatest("shared", F.lit(1))).cast("int")))
    every = F.sequence(F.lit(0), (F.col("shared") + F.col("needed") - 1).cast("int"))
    others = F.when(F.col("need") > 0, F.filter(every, lambda b: (b < first) | (b >= first + F.col("need")))).otherwise(every)
    return placed.withColumn("other", F.explode(others)).select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "part", "node", "n", "component", "own", "signature", "bands")


def _blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across groups within the buckets of ``members``: a spanning forest of them for each task."""
    spread = _spread(members)

    def possible(table: pa.Table) -> pa.Table:
        """The rows that stand in any pair worth verifying; only they need their sets."""
        rows, hit = table.combine_chunks().to_batches()[0], np.zeros(table.num_rows, dtype=bool)
        for x, y in _block_pairs(rows, percent):
            hit[x] = True
            hit[y] = True
        return table.filter(pa.array(hit))

    def verify(table: pa.Table) -> pa.Table:
        rows, parent = table.combine_chunks().to_batches()[0], {}
        full = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in rows.column("shingles")]
        ids, groups = rows.column("node").to_pylist(), rows.column("component").to_pylist()
        found = []
        for x, y in _block_pairs(rows, percent):
            for k in y.tolist():  # groups that this task has joined need no further link
                if find(parent, groups[x]) != find(parent, groups[k]) and similar(full[x], full[k], percent):
                    unite(parent, groups[x], groups[k])
                    found.append((ids[x], ids[k]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    keys = ["band", "i", "j"]
    # Dealt by block pairs: the rows come dealt by bucket, which would do for the grouping and put a hot bucket into one task.
    rows = stage(spread.repartition(*keys).groupBy(*keys).applyInArrow(possible, spread.schema))
    return stage(rows.join(sets, ["id", "part"]).groupBy(*keys).applyInArrow(verify, "a bigint, b bigint"))


def group(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, digest, component_id, kept`` of every row; links from ``percent`` percent similarity on."""
    return _grouped(documents, width, percent).drop("text_digest", "component")


def _grouped(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """The same with ``text_digest`` and ``component``, a number of the group."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield _sign(batch, width)

    signed = stage(texts(documents).withColumn("text_digest", F.unhex(F.md5("text"))).mapInArrow(sign, SIGNED))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class of equal sets is a node; its number is not its doc_id, which may stand on other texts too.
    classes = stage(full.groupBy("digest").agg(F.min("doc_id").alias("id")).withColumn("node", F.monotonically_increasing_id()))
    chosen = stage(full.withColumnRenamed("doc_id", "id").join(classes, ["digest", "id"]).dropDuplicates(["digest"])
                   .select("id", _part().alias("part"), "node", F.col("n_shingles").alias("n"), "signature", "bands"))
    exploded = chosen.select("id", "part", "node", "n", F.explode("bands").alias("band"))
    leaders = stage(exploded.groupBy("band").agg(F.count("*").alias("members"), F.min(F.struct("node", "id", "part", "n")).alias("leader"))
                    .where("members > 1").select("band", F.col("leader.id").alias("a"), F.col("leader.part").alias("a_part"),
                                                 F.col("leader.node").alias("a_node"), F.col("leader.n").alias("a_n")))
    left = ["a_node", "a", "a_part", "a_n"]  # the least node leads, so that links point where components end
    buckets = stage(exploded.join(leaders, "band").select("band", *left, F.col("id").alias("b"), F.col("part").alias("b_part"),
                                                          F.col("node").alias("b_node"), F.col("n").alias("b_n")))
    verifier = Verifier(documents, buckets.select(F.col("b").alias("id")).distinct(), width, percent)
    pair = ["a", "a_part", "a_node", "b", "b_part", "b_node"]
    other = F.col("a_node") != F.col("b_node")
    tried = buckets.where(other).groupBy("b", "b_part", "b_node", "b_n").agg(F.min(F.struct(*left)).alias("x"))
    tried = stage(tried.select("b", "b_part", "b_node", "b_n", "x.*").where(_possible(percent)).select(*pair))
    links = verifier.links(tried)
    grouped = components(links)

    # Buckets with members of several groups.
    marked = stage(buckets.join(grouped.withColumnRenamed("node", "b_node"), "b_node", "left")
                   .withColumn("component", F.coalesce("component", "b_node")))
    mixed = stage(marked.groupBy("band").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("band"))
    rest = marked.join(mixed, "band", "left_semi")
    pairs = rest.where(other & _possible(percent)).select(*pair).distinct().join(tried, ["a_node", "b_node"], "left_anti")
    links = stage(links.unionByName(verifier.links(pairs)))
    grouped = components(links)

    again = stage(rest.select("band", F.col("b").alias("id"), F.col("b_part").alias("part"), F.col("b_node").alias("node")).join(
        grouped, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = stage(again.groupBy("band").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("band"))
    members = stage(again.join(mixed, "band", "left_semi").join(chosen.drop("id", "part"), "node"))
    links = stage(links.unionByName(_blocks(members, verifier.sets, percent)))
    grouped = components(links)
    unstage(leaders, buckets, marked, again, members, verifier.sets, chosen)

    named = stage(classes.join(grouped, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component")))
    least = stage(named.groupBy("component").agg(F.min("id").alias("least")))
    named = stage(named.join(least, "component").select("digest", "component", "least"))
    out = signed.select("doc_id", "text_digest", "n_shingles", "digest").join(named, "digest", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))))
    return out.select("doc_id", "text_digest", "n_shingles", "digest", "component", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that of the least ``doc_id``, with all its columns.

    If that ``doc_id`` stands on several texts of the group, the one with the least digest stays, and equal rows become one. Documents without words
    and rows without ``doc_id`` stay.
    """
    rows = stage(_grouped(documents, width, percent).where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "text_digest", "component", "kept"))
    first = stage(rows.where("kept").groupBy("component").agg(F.min("text_digest").alias("first")))  # so that the join has two plain sides
    names = [F.col("doc_id").alias("__gone"), F.col("text_digest").alias("__text")]
    gone = stage(rows.join(first, "component").where(~F.col("kept") | (F.col("text_digest") != F.col("first"))).select(*names).distinct())
    doubled = stage(rows.groupBy("doc_id", "text_digest").agg(F.count("*").alias("n")).where("n > 1").select(*names))
    same = (F.col("doc_id") == F.col("__gone")) & (F.unhex(F.md5(F.coalesce("text", F.lit("")))) == F.col("__text"))
    left = documents.join(gone, same, "left_anti")
    if not doubled.take(1):  # the rule: every row stands once
        return left
    return left.join(doubled, same, "left_anti").unionByName(left.join(doubled, same, "left_semi").dropDuplicates(["doc_id", "text"]))
