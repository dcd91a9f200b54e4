"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encoded strings form a monoid: two neighbours join into the encoding of their concatenation. A piece of text is cut
into halves, the halves are encoded by recursion, and the join re-encodes a window of tokens around the cut. The window
grows until the tokens on both sides of its edges stay as they are. That is certain, not likely: a token sequence is the
encoding of its bytes exactly if every two neighbours are the encoding of their own bytes. Decoding concatenates the
tokens' bytes up a tree.

Every text is a row; nothing is shuffled, only the vocabulary (a file of bounded size) is sent to the workers.

Missing texts count as empty: no tokens, the digests of nothing. Repeated rows give repeated results; an empty table
gives an empty result; input columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, texts

#: Pieces up to this many bytes are merged directly; longer ones are halved.
LEAF_BYTES = 24
#: Above every rank: of two parts that do not merge.
NO_RANK = 1 << 62
#: Distinct pieces a worker remembers; when so many are new, those before them are forgotten.
REMEMBERED = 200_000

ENCODED = "doc_id bigint, n_tokens bigint, ids array<bigint>"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}


class Encoder:
    """The byte-level BPE of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stable: dict[tuple[int, int], bool] = {}

    # -- encoding ---------------------------------------------------------------------------------

    def _merge(self, piece: bytes) -> list[bytes]:
        """Merge the leftmost pair of lowest rank until none is left; for short pieces."""
        parts, rank = [piece[i:i + 1] for i in range(len(piece))], self.ranks.get
        found = [rank(piece[i:i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while found:
            best = min(found)
            if best == NO_RANK:
                break
            at = found.index(best)
            new = parts[at] + parts[at + 1]
            parts[at:at + 2] = [new]
            del found[at]
            if at:
                found[at - 1] = rank(parts[at - 1] + new, NO_RANK)
            if at < len(found):
                found[at] = rank(new + parts[at + 1], NO_RANK)
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """The same with a heap over linked parts, for long windows."""
        n, ranks = len(piece), self.ranks
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not alive[i] or j >= n or ends[j] != end:
                continue  # one of the two parts has been merged meanwhile
            alive[j], ends[i] = False, end
            if end < n:
                before[end] = i
                if (rank := ranks.get(piece[i:ends[end]])) is not None:
                    heapq.heappush(heap, (rank, i, ends[end]))
            h = before[i]
            if h >= 0 and (rank := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (rank, h, end))
        return [piece[i:ends[i]] for i in range(n) if alive[i]]

    def _direct(self, piece: bytes) -> list[bytes]:
        if piece in self.ranks:
            return [piece]
        return self._merge(piece) if len(piece) <= 4 * LEAF_BYTES else self._merge_long(piece)

    def _fits(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together."""
        key = self.ranks[a], self.ranks[b]
        if (fits := self.stable.get(key)) is None:
            if len(self.stable) >= REMEMBERED:
                self.stable.clear()
            fits = self.stable[key] = self._merge(a + b) == [a, b]
        return fits

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Encoding of the bytes of two encodings."""
        if not left or not right or self._fits(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._direct(b"".join(left[len(left) - i:] + right[:j]))
            low = i == len(left) or self._fits(left[len(left) - i - 1], window[0])
            high = j == len(right) or self._fits(window[-1], right[j])
            if low and high:
                return left[:len(left) - i] + window + right[j:]
            i, j = i if low else 2 * i, j if high else 2 * j

    def _tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF_BYTES:
            return self._merge(piece)
        half = len(piece) // 2
        return self.join(self._tree(piece[:half]), self._tree(piece[half:]))

    def piece(self, piece: bytes) -> list[bytes]:
        """Tokens of one match of the pattern; a match that is a token by itself stays whole."""
        return [piece] if piece in self.ranks else self._tree(piece)

    def _piece_ids(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            tokens = self.piece(piece.encode())
            ids = struct.pack(f"<{len(tokens)}I", *[self.ranks[t] for t in tokens])
        if len(piece) <= 64:
            if len(self.known) >= REMEMBERED:
                self.older = dict(self.known)
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        known, new = self.known.get, self._piece_ids
        return b"".join([known(p) or new(p) for p in self.pieces.findall(text)])

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens, concatenated up a tree whose nodes join any number of neighbours."""
        at = self.tokens.__getitem__
        level = list(map(at, np.frombuffer(ids, dtype="<u4").tolist()))
        while len(level) > 1:
            level = [b"".join(level[i:i + 256]) for i in range(0, len(level), 256)]
        return level[0] if level else b""


def _run(documents: DataFrame, vocabulary: bytes, pattern: str, schema: str, rows) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in chunks(batches):
            encoder = encoder or Encoder(read_ranks(sent.value), pattern)
            yield rows(encoder, batch)

    return texts(documents).mapInArrow(work, schema)


def encode(documents: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of every whole text.

    ``vocabulary``: the content of a file of base64 tokens and ranks; ``pattern`` cuts a text into pieces.
    """
    def rows(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(encoder.encode(t.as_py()), dtype="<u4") for t in batch.column("text")]
        ends = np.cumsum([0, *map(len, ids)])
        values = pa.array(np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
            names=["doc_id", "n_tokens", "ids"])

    return _run(documents, vocabulary, pattern, ENCODED, rows)


def decode(encoded: DataFrame, vocabulary: bytes) -> DataFrame:
    """``doc_id`` and the decoded bytes ``data`` of every row of ``encode``; missing ids count as none."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(read_ranks(sent.value), "")
            data = [encoder.decode(np.array(x.as_py() or [], dtype="<u4").tobytes()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, data binary")


def digests(documents: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    def rows(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [encoder.encode(t.as_py()) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(documents, vocabulary, pattern, DIGESTS, rows)


def encode_checked(documents: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every whole text, encoded once."""
    def rows(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [encoder.encode(t.as_py()) for t in batch.column("text")]
        counts = [len(x) // 4 for x in ids]
        values = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(counts, pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string())],
            names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return _run(documents, vocabulary, pattern, "doc_id bigint, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string", rows)
