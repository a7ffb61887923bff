"""Operator 5: exact removal of repeated passages with suffix arrays built by external induced sorting.

A byte goes where a 50-byte window that covers it also starts in a document with a smaller id.

Documents lie in blocks, a table bucketed by block, so that answers can be joined to them without moving texts.  To bring
equal windows together without sorting all suffixes of the corpus in one place, each window is assigned to its minimizer: of
the 32-byte strings in it, the one with the smallest hash.  Equal windows have equal minimizers at equal places.

1. Each block tells, per minimizer, a 32-bit key within its bucket; buckets answer which keys occur in two documents.
2. Each block tells, for those, a hash of each distinct stretch of windows that a minimizer stands for, and its smallest
   document there.  Equal stretches hold equal windows, so a stretch that a smaller document has too goes whole; of minimizers
   with only one distinct stretch nothing is left to decide.
   A window holds its minimizer with 9 bytes before it or 10 after it, so a stretch whose minimizer is extended like that in no
   other stretch, on either side, shares no window either, and stays.
3. Stretches that remain, the smallest document's copy of each, go to their bucket's shard as bytes.  There a suffix array
   with common-prefix values (suffix_sort) groups equal windows and finds each group's smallest document.  A minimizer that stands
   in more different stretches than a shard should hold is split: each of its windows, once a block, goes to one of as many
   shards as it needs, by the window's own hash.

Blocks then remove what was answered.  A block has a row for each bucket, so that there are as many as blocks times buckets: what is done
for one of them is cutting bytes, and everything else is done for a whole block or a whole bucket at once.  Step 2 only unites rows that are equal as a whole; every comparison of windows in
different surroundings is made by the suffix array.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import load, materialize, mix64, work_path, work_tables
from lodestrata.llm.suffix_sort import InducedSorter

WINDOW = 50
GRAM = 32
SPAN = WINDOW - GRAM + 1
#: A window that has fewer bytes than BEFORE in front of its minimizer has AFTER or more behind it.
BEFORE = SPAN // 2
AFTER = SPAN - BEFORE
#: Text bytes of a block (a longer document is a block of its own) and key bytes that a bucket should hold.
BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 4 << 20
#: Different stretches from which on a minimizer is split (about BUCKET_BYTES), and those whose single windows make a shard.
SPLIT_STRETCHES, SHARD_STRETCHES = 1 << 16, 1 << 12
NO_ID = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


class _Powers:
    """Powers of the hash base and of its inverse, as long as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


class Block:
    """Documents of a block and their minimizers: `at` (place), `low`..`high` (starts of its windows), `doc`, `key`."""

    def __init__(self, data: bytes, ends: bytes, powers: _Powers):
        self.data = np.frombuffer(data, np.uint8)
        self.ends = np.frombuffer(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        n = len(self.data)
        self.at = self.low = self.high = self.doc = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data + np.uint64(1)) * up[:n], out=self.sums[1:])
        key = mix64((self.sums[GRAM:] - self.sums[: n - GRAM + 1]) * self.down[: n - GRAM + 1])
        least = key & np.uint64(0xFFFFFFFF00000000)
        least |= np.arange(len(key), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
        size = self.ends - self.starts
        of = np.repeat(np.arange(len(size)), size)[: len(least)]
        inside = np.ones(len(least), bool)
        for end in self.ends.tolist():  # windows that would cross the end of a document
            inside[max(0, end - WINDOW + 1) : end] = False
        window = np.flatnonzero(inside)
        if not len(window):
            return
        place = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        self.at, self.low = place[head], window[head]
        self.high = window[np.append(head[1:], len(window)) - 1]
        self.doc = of[self.low]
        self.key = key[self.at]

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        """Hash of the bytes from each start: equal bytes give equal hashes wherever they stand."""
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def stretch(self, which: np.ndarray) -> np.ndarray:
        """Hash of each minimizer's stretch: its bytes, its length and the minimizer's place in it."""
        size = self.high[which] + WINDOW - self.low[which]
        return mix64(self.hash(self.low[which], size) + mix64((size * 256 + self.at[which] - self.low[which]).astype(np.uint64)))

    def sides(self, which: np.ndarray) -> np.ndarray:
        """16-bit hashes of each minimizer with BEFORE bytes in front and with AFTER bytes behind it, in one number; 0: not in its stretch."""
        at, out = self.at[which], np.zeros(len(which), np.uint32)
        for shift, start, size, inside in ((16, at - BEFORE, GRAM + BEFORE, at - BEFORE >= self.low[which]), (0, at, GRAM + AFTER, at + GRAM + AFTER <= self.high[which] + WINDOW)):
            value = mix64(self.hash(start[inside], size)) % np.uint64(0xFFFF) + np.uint64(1)
            out[inside] |= value.astype(np.uint32) << np.uint32(shift)
        return out

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, minimizer, hash) of all windows of some minimizers, in order."""
        n = self.high[which] - self.low[which] + 1
        of = np.repeat(np.arange(len(which)), n)
        start = self.low[which][of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return start, of, mix64(self.hash(start, WINDOW))


def _firsts(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later): for each entry the place of the entry of equal value with the smallest document (of those the first), and
    whether its own document is larger."""
    order = np.lexsort((doc, value))
    new = np.concatenate([[True], value[order][1:] != value[order][:-1]]) if len(order) else np.zeros(0, bool)
    first = np.empty(len(order), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    return first, doc > doc[first]


def _codes(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each minimizer above the 32-bit key within it."""
    bucket = (key >> np.uint64(32)) * np.uint64(0x85EBCA6B) % np.uint64(buckets)
    return (bucket << np.uint64(32)) | (key & _LOW)


def _cuts(value: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])), [len(value)]]) if len(value) else np.zeros(1, np.int64)


def _sliced(value: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """The bytes of each run."""
    raw, at = value.tobytes(), (cut * value.itemsize).tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _joined(parts, kind) -> tuple[np.ndarray, np.ndarray]:
    """Arrays that came as bytes, one after another, and where each begins, with the end."""
    value = np.frombuffer(b"".join(parts), kind)
    return value, np.cumsum([0, *map(len, parts)]) // value.itemsize


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cut = _cuts(bucket[order])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _blocks(documents: DataFrame, id_column: str) -> tuple[DataFrame, str]:
    """The bucketed table (block, rows, ids, ends, data) and its name; `rows` names each document's row in the input."""
    spark = documents.sparkSession
    name = f"lodestrata_blocks_{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def block() -> pd.DataFrame:
            ends = np.cumsum([len(h[2]) for h in held]).astype(np.int64)
            return pd.DataFrame({
                "block": [held[0][0]], "rows": [np.array([h[0] for h in held], np.int64).tobytes()], "ids": [np.array([h[1] for h in held], np.int64).tobytes()],
                "ends": [ends.tobytes()], "data": [b"".join(h[2] for h in held)],
            })

        for frame in batches:
            for row, doc, text in zip(frame["_row"], frame["_id"], frame["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                if held and size + len(data) > BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
                held.append((row, NO_ID if doc is None or doc != doc else int(doc), data))
                size += len(data)
        if held:
            yield block()

    rows = documents.select("_row", F.col(id_column).cast("string").alias("_id"), "text")
    blocks = rows.mapInPandas(run, "block long, rows binary, ids binary, ends binary, data binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # in the shared folder: the session's own warehouse may be another folder on every machine
    blocks.write.options(compression="zstd", path=work_path(spark, "blocks")).bucketBy(n, "block").saveAsTable(name, format="parquet")
    return spark.table(name), name


def _shared_keys(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, keys): the keys of a block's bucket that two documents have."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for frame in batches:
            for block, data, ends in zip(frame["block"], frame["data"], frame["ends"], strict=True):
                b = Block(data, ends, powers)
                code = _codes(b.key, buckets)
                order = np.argsort(code, kind="stable")  # documents of a key stay in order
                code, doc = code[order], b.doc[order]
                head = _cuts(code)[:-1]
                pair = np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])[: len(code)]
                code, n = code[head], np.add.reduceat(pair.astype(np.int64), head) if len(head) else head
                cut = _cuts(code >> np.uint64(32))
                twice = code[n > 1]
                bucket = code[cut[:-1]] >> np.uint64(32)
                cut_twice = np.append(np.searchsorted(twice, bucket << np.uint64(32)), len(twice))
                yield pd.DataFrame({"block": block, "bucket": bucket.astype(np.int64), "keys": _sliced((code & _LOW).astype(np.uint32), cut), "twice": _sliced((twice & _LOW).astype(np.uint32), cut_twice)})

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        keys, cut = _joined(frame["keys"], np.uint32)
        distinct, of, n = np.unique(keys, return_inverse=True, return_counts=True)
        shared = n > 1
        shared[np.searchsorted(distinct, _joined(frame["twice"], np.uint32)[0])] = True
        kept = shared[of]
        cut = np.concatenate([[0], np.cumsum(kept)])[cut]
        rows = pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "keys": _sliced(keys[kept], cut)})
        return rows[np.diff(cut) > 0]

    told = blocks.select("block", "ends", "data").mapInPandas(tell, "block long, bucket long, keys binary, twice binary")
    return told.groupBy("bucket").applyInPandas(answer, "block long, bucket long, keys binary")


def _per_block(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per block with the list of its answers, at most one a bucket."""
    return rows.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("answers"))


def _chosen(block: Block, answers: list, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, minimizer) of a block whose keys were answered to be shared, by bucket and in the block's order within it.  Answers come by bucket."""
    keys, cut = _joined([a["keys"] for a in answers], np.uint32)
    shared = (np.repeat(np.array([a["bucket"] for a in answers], np.uint64), np.diff(cut)) << np.uint64(32)) | keys
    code = _codes(block.key, buckets)
    at = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, code), len(shared) - 1)] == code) if len(shared) else np.zeros(0, np.int64)
    bucket = (code[at] >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], at[order]


#: What happens to a minimizer's windows: nothing, all go, or the suffix array decides, of stretches or of single windows: SPLIT + k
#: stands for 2**k shards.
STAY, GO, ASK, SPLIT = 0, 1, 2, 3


def _verdicts(blocks: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, keys, verdicts): what happens to the distinct stretches of a block's bucket, in the block's order."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for frame in batches:
            for block, data, ends, ids, answers in zip(frame["block"], frame["data"], frame["ends"], frame["ids"], frame["answers"], strict=True):
                b = Block(data, ends, powers)
                answers = sorted(answers, key=_place)
                known = {a["bucket"]: a["keys"] for a in answers}
                bucket, at = _chosen(b, answers, buckets)
                stretch, doc = b.stretch(at), np.frombuffer(ids, np.int64)[b.doc[at]]
                first, later = _firsts(stretch, doc)
                head = first == np.arange(len(at))
                cut = _cuts(bucket)
                number = bucket[cut[:-1]].tolist()
                again = np.add.reduceat(later.astype(np.int64), cut[:-1]) > 0 if len(at) else later
                cut = np.concatenate([[0], np.cumsum(head)])[cut]
                yield pd.DataFrame({
                    "block": block, "bucket": np.array(number, np.int64), "keys": [known[n] for n in number], "key": _sliced((b.key[at[head]] & _LOW).astype(np.uint32), cut), "stretch": _sliced(stretch[head], cut),
                    "sides": _sliced(b.sides(at[head]), cut), "doc": _sliced(doc[head], cut), "later": again,
                })

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        key, cut = _joined(frame["key"], np.uint32)
        stretch, sides, doc = (_joined(frame[c], kind)[0] for c, kind in (("stretch", np.uint64), ("sides", np.uint32), ("doc", np.int64)))
        order = np.lexsort((doc, stretch, key))
        key, stretch, sides, sorted_doc = key[order], stretch[order], sides[order], doc[order]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(new_key | np.concatenate([[True], stretch[1:] != stretch[:-1]]))
        copies = np.diff(np.append(head, len(order)))
        least = np.repeat(sorted_doc[head], copies)
        # from here on one entry for each distinct stretch
        met = _extended_alike(key[head], sides[head])
        first = np.flatnonzero(new_key[head])
        stretches = np.repeat(np.add.reduceat(met.astype(np.int64), first), np.diff(np.append(first, len(head))))
        shards = np.maximum(1, np.ceil(np.log2(np.maximum(stretches, 1) / SHARD_STRETCHES)))
        asks = np.repeat(np.where(~met, STAY, np.where(stretches < SPLIT_STRETCHES, ASK, SPLIT + shards)), copies)
        verdict = np.empty(len(order), np.uint8)
        verdict[order] = np.where(sorted_doc > least, GO, asks)
        told = np.concatenate([[0], np.cumsum(verdict != STAY)])[cut]
        rows = pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "keys": frame["keys"], "verdicts": _sliced(verdict, cut)})
        return rows[(np.diff(told) > 0) | frame["later"].to_numpy(bool)]

    told = blocks.select("block", "ids", "ends", "data").join(_per_block(shared, "bucket", "keys"), "block")
    told = told.mapInPandas(tell, "block long, bucket long, keys binary, key binary, stretch binary, sides binary, doc binary, later boolean")
    return told.groupBy("bucket").applyInPandas(answer, "block long, bucket long, keys binary, verdicts binary")


def _extended_alike(key: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Whether a distinct stretch's minimizer is extended as in another stretch of the key, before it or behind it."""
    met = np.zeros(len(key), bool)
    for side in (sides >> np.uint32(16), sides & np.uint32(0xFFFF)):
        here = np.flatnonzero(side)
        _, of, n = np.unique((key[here].astype(np.uint64) << np.uint64(16)) | side[here], return_inverse=True, return_counts=True)
        met[here] |= n[of] > 1
    return met


def _place(answer) -> int:
    return answer["bucket"]


def _asked(block: Block, ids: bytes, answers: list, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, minimizer, verdict) of a block by bucket; a stretch that a smaller document of the block has goes.  Answers come by bucket."""
    bucket, at = _chosen(block, answers, buckets)
    first, later = _firsts(block.stretch(at), np.frombuffer(ids, np.int64)[block.doc[at]]) if len(at) else (at, at)
    told = np.zeros(len(at), np.uint8)
    told[first == np.arange(len(at))] = _joined([a["verdicts"] for a in answers], np.uint8)[0]
    return bucket, at, np.where(later, GO, told[first])


def _single(block: Block, ids: bytes, at: np.ndarray, verdict: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of minimizers that are split: (start, shard, the window's first place, whether a smaller document of the block
    has it, document); shards from 1 on."""
    start, of, value = block.windows(at)
    doc = np.frombuffer(ids, np.int64)[block.doc[at]][of]
    shards = np.uint64(1) << (verdict - SPLIT).astype(np.uint64)
    return start, (value % shards[of]).astype(np.int64) + 1, *_firsts(value, doc), doc


def shard_windows(texts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """Per text, a bit for every window start whose 50 bytes also stand in a text of a smaller document of the shard."""
    order, lcp = InducedSorter(texts).sort()
    size = np.array([len(x) + 1 for x in texts], np.int64)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(texts)), size)
    # a suffix shorter than a window shares no 50 bytes with its neighbours, so it stands in a group of its own
    group = np.cumsum(lcp < WINDOW) - 1
    owner = docs[of[order]]
    least = np.minimum.reduceat(owner, np.flatnonzero(lcp < WINDOW))
    gone = np.zeros(len(of), bool)
    gone[order] = least[group] < owner
    bits = np.zeros(len(texts), np.uint32)
    for k in range(SPAN):
        long = np.flatnonzero(size > WINDOW + k)
        bits[long] |= gone[start[long] + k].astype(np.uint32) << np.uint32(k)
    return bits


def _window_answers(blocks: DataFrame, verdicts: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, shard, windows): for the minimizers with ASK (shard 0) and the single windows of those with SPLIT (other
    shards), in order, a bit per window that goes."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for frame in batches:
            for block, data, ends, ids, answers in zip(frame["block"], frame["data"], frame["ends"], frame["ids"], frame["answers"], strict=True):
                b = Block(data, ends, powers)
                docs = np.frombuffer(ids, np.int64)
                bucket, at, verdict = _asked(b, ids, sorted(answers, key=_place), buckets)
                asked = at[verdict == ASK]
                cut = _cuts(bucket[verdict == ASK])
                texts = [data[i:j] for i, j in zip(b.low[asked].tolist(), (b.high[asked] + WINDOW).tolist(), strict=True)]
                number = bucket[verdict == ASK][cut[:-1]].tolist()
                rows = [(block, n, 0, texts[i:j], raw) for n, i, j, raw in zip(number, cut[:-1].tolist(), cut[1:].tolist(), _sliced(docs[b.doc[asked]], cut), strict=True)]
                split = np.flatnonzero(verdict >= SPLIT)
                for number, s in _by_bucket(bucket[split]):
                    start, shard, first, _, doc = _single(b, ids, at[split[s]], verdict[split[s]])
                    head = first == np.arange(len(start))
                    for k, w in _by_bucket(np.where(head, shard, 0)):
                        if k:
                            rows.append((block, number, k, [data[i : i + WINDOW] for i in start[w]], doc[w].tobytes()))
                yield pd.DataFrame(rows, columns=["block", "bucket", "shard", "texts", "doc"])

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [bytes(x) for row in frame["texts"] for x in row]
        bits = shard_windows(texts, _joined(frame["doc"], np.int64)[0])
        cut = np.cumsum([0, *map(len, frame["texts"])])
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "shard": frame["shard"], "windows": _sliced(bits, cut)})

    told = blocks.select("block", "ids", "ends", "data").join(_per_block(verdicts, "bucket", "keys", "verdicts"), "block")
    told = told.mapInPandas(tell, "block long, bucket long, shard long, texts array<binary>, doc binary")
    return told.groupBy("bucket", "shard").applyInPandas(decide, "block long, bucket long, shard long, windows binary")


def _covered(block: Block, ids: bytes, answers, buckets: int) -> np.ndarray:
    """True for each byte of the block that goes."""
    edge = np.zeros(len(block.data) + 1, np.int32)
    answers = sorted(answers, key=_place)
    windows = {(a["bucket"], w["shard"]): w["windows"] for a in answers if a["windows"] is not None for w in a["windows"]}

    def go(start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)

    bucket, at, verdict = _asked(block, ids, answers, buckets)
    whole, asked = at[verdict == GO], at[verdict == ASK]
    go(block.low[whole], block.high[whole] + WINDOW)
    bits, _ = _joined([w for (_, shard), w in windows.items() if shard == 0], np.uint32)
    for k in range(SPAN):
        start = block.low[asked[(bits >> np.uint32(k)) & np.uint32(1) == 1]] + k
        go(start, start + WINDOW)
    split = np.flatnonzero(verdict >= SPLIT)
    for number, s in _by_bucket(bucket[split]):
        start, shard, first, later, _ = _single(block, ids, at[split[s]], verdict[split[s]])
        told = np.zeros(len(start), bool)
        for k, w in _by_bucket(np.where(first == np.arange(len(start)), shard, 0)):
            if k:
                told[w] = np.frombuffer(windows[number, k], np.uint32) == 1
        gone = start[later | told[first]]
        go(gone, gone + WINDOW)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(documents: DataFrame, id_column: str = "doc_id", with_text: bool = False) -> DataFrame:
    """(_row, _id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) of every row of `documents` (_row, id, text).

    Null and empty texts have no bytes; texts below 50 bytes lose nothing.  Rows with the same id do not remove from each
    other; null ids count as larger than all others and remove nothing from each other.  `kept_text` drops bytes of
    characters that a removal cut.  A text larger than a block is a block of its own; an empty table gives no rows; other columns are
    not read.
    """
    spark = documents.sparkSession
    with work_tables(spark) as keep:
        blocks, name = _blocks(documents, id_column)
        try:
            done = keep(_removed(blocks, with_text)).withColumn("_id", F.col("_id").cast("long"))
        finally:
            spark.sql(f"DROP TABLE {name}")
    return done if with_text else done.drop("kept_text")


def _removed(blocks: DataFrame, with_text: bool) -> DataFrame:
    """The written result of remove_repeats, from the table of blocks."""
    spark = blocks.sparkSession
    total = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total * 8 // (SPAN + 1) // BUCKET_BYTES)
    shared = materialize(_shared_keys(blocks, buckets), "shared")
    verdicts = materialize(_verdicts(blocks, shared, buckets), "verdicts")
    windows = materialize(_window_answers(blocks, verdicts, buckets), "windows")
    windows = windows.groupBy("block", "bucket").agg(F.collect_list(F.struct("shard", "windows")).alias("windows"))
    answers = _per_block(verdicts.join(windows, ["block", "bucket"], "left"), "bucket", "keys", "verdicts", "windows")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for frame in batches:
            for data, ends, rows, ids, found in zip(frame["data"], frame["ends"], frame["rows"], frame["ids"], frame["answers"], strict=True):
                b = Block(data, ends, powers) if found is not None and len(found) else None
                gone = _covered(b, ids, found, buckets) if b is not None else None
                out = []
                start = 0
                for row, doc, end in zip(np.frombuffer(rows, np.int64).tolist(), np.frombuffer(ids, np.int64).tolist(), np.frombuffer(ends, np.int64).tolist(), strict=True):
                    kept, removed, spans = data[start:end], 0, 0
                    if gone is not None and gone[start:end].any():
                        mine = gone[start:end]
                        removed, spans = int(mine.sum()), int(mine[0]) + int(np.count_nonzero(mine[1:] & ~mine[:-1]))
                        kept = np.frombuffer(kept, np.uint8)[~mine].tobytes()
                    out.append((row, None if doc == NO_ID else str(doc), end - start, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
                    start = end
                yield pd.DataFrame(out, columns=["_row", "_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    joined = blocks.join(answers, "block", "left").select("data", "ends", "rows", "ids", "answers")
    return materialize(joined.mapInPandas(cut, "_row long, _id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"), "kept")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    return remove_repeats(documents).select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
