"""Operator 4: packing along a space-filling curve.

A document's byte n-grams are hashed to signs and summed per dimension: the random projection of its hashed n-gram vector.
The projections, on a fixed grid, give a Hilbert key; documents are range-sorted by it, so each partition holds a stretch of
the curve, and neighbours on the curve fill the same sequences.  Documents are cut where a sequence is full.  What is left at
the end of a stretch is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import load, mapped, materialize, mix64, steps

LENGTH = 1024
DIMENSIONS, BITS = 3, 16
GRAM = 4
END_ID = 0
#: tiktoken's regular expressions recurse, so longer texts go to the slower library.
LONG_TEXT = 200_000
#: Text bytes that a stretch of the curve, one task's work, should hold.
STRETCH_BYTES = 32 << 20
#: Grid steps for one unit of a projection's mean; projections of real text lie well within +-0.2.
SCALE = 2.5


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dimensions), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert keys of texts; texts shorter than an n-gram lie in the middle of the grid."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    sums = np.zeros((len(texts), DIMENSIONS))
    count = np.maximum(np.array([len(t) for t in texts], np.int64) - GRAM + 1, 0)
    if len(data) >= GRAM:
        code = np.zeros(len(data) - GRAM + 1, np.uint32)
        for i in range(GRAM):
            code = (code << np.uint32(8)) | data[i : len(data) - GRAM + 1 + i]
        h = mix64(code.astype(np.uint64))
        begin = ends - np.array([len(t) for t in texts], np.int64)
        for d in range(DIMENSIONS):
            total = np.concatenate([[0], np.cumsum(((h >> np.uint64(d)) & np.uint64(1)).astype(np.int32) * 2 - 1)])
            at = np.minimum(begin, len(total) - 1)
            sums[:, d] = total[np.minimum(at + count, len(total) - 1)] - total[at]
    mean = sums / np.maximum(count, 1)[:, None]
    grid = np.clip((0.5 + SCALE * mean) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(grid)


class ByteTokenizer:
    """ids as the tokenizers library gives them for the JSON file, by tiktoken over the same vocabulary where that is safe."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        self.json_path, self.slow, self.fast = json_path, None, None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) <= LONG_TEXT:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Fills sequences one after the other; `rows` are finished pieces."""

    def __init__(self, first_sequence: int, length: int = LENGTH):
        self.sequence, self.length, self.fill = first_sequence, length, 0
        self.open: list[tuple] = []
        self.rows: list[tuple] = []

    def _piece(self, doc, start: int, ids: np.ndarray, total: int, offset: int) -> None:
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))

    def _close(self) -> None:
        offset = 0
        for doc, start, ids, total in self.open:
            self._piece(doc, start, ids, total, offset)
            offset += len(ids)
        self.open, self.fill, self.sequence = [], 0, self.sequence + 1

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.length - self.fill]
            self.open.append((doc, start, part, len(ids)))
            self.fill += len(part)
            start += len(part)
            if self.fill == self.length:
                self._close()

    def finish(self) -> None:
        """Cut what is left at powers of two, the largest first."""
        left, self.open, fill = self.open, [], self.fill
        self.fill = 0
        size = 1 << max(0, fill.bit_length() - 1)
        room = size
        for doc, start, ids, total in left:
            at = 0
            while at < len(ids):
                part = ids[at : at + room]
                self.open.append((doc, start + at, part, total))
                at, room, fill = at + len(part), room - len(part), fill - len(part)
                if room == 0:
                    self._close()
                    room = 1 << max(0, fill.bit_length() - 1)

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(documents: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents (doc_id, text).

    Null and empty texts: one end id.  A text above LONG_TEXT characters goes to the slower library as a whole.  Repeated rows are documents of their own; null ids stay null.  Every stretch of the
    curve numbers its sequences from its partition's own range, so no global count is needed.
    """

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for part, texts in steps(iter([frame])):
                yield part.assign(text=part["text"].fillna(""), _key=curve_keys(texts), _bytes=[len(t) for t in texts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = ByteTokenizer(json_path, ranks_path, pattern)
        packer = Packer(TaskContext.get().partitionId() << 40, length)
        for frame in batches:
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                packer.add(doc, np.append(tokens(text), np.uint32(END_ID)))
            yield packer.take()
        packer.finish()
        yield packer.take()

    keyed = mapped(documents.select("doc_id", "text"), ["doc_id", "text"], [], key, "_key long, _bytes long")
    # ties on the curve, such as groups of copies, are dealt by id and text, so no key lands in one task
    keyed = materialize(keyed.withColumn("_tie", F.xxhash64("text")), "keyed")  # the range sort reads keys twice and makes them once
    stretches = (keyed.agg(F.sum("_bytes")).first()[0] or 0) // STRETCH_BYTES
    order = ["_key", "doc_id", "_tie"]
    n = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), stretches)
    sorted_along = keyed.drop("_bytes").repartitionByRange(n, *order).sortWithinPartitions(*order)
    pieces = mapped(sorted_along, ["doc_id"], ["text"], run, "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
