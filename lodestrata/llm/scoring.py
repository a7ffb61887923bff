"""Operator 3: language-model scores by context-tree weighting over bytes, beside a word-unigram base.

Every byte is coded as eight binary decisions, each made in its own context tree over the preceding bytes.  A node holds a
Krichevsky-Trofimov estimate; a context's weighted probability mixes its own estimate with the product of its children, half
and half, from the longest context up to none.  Model and base both read the text with A-Z in lower case.  Texts start in a
context of zero bytes and end with the byte 0xFF, which UTF-8 never holds.

Distinct byte n-grams of all texts, with their counts in training texts (none for some), lie in a table of parts; a part holds
whole subtrees of contexts that share their last CUTS[0] bytes.  Each part is reduced on its own to the nodes at that length,
these meet again by their last CUTS[1] bytes, and so on; only nodes of one byte of context, 65280 at most, reach the driver.
On the way back every node passes down what shorter contexts predict, until each n-gram has its log probability.  A text's
score is the sum over its n-grams: the most frequent ones travel to every task, the others are looked up in their parts.  All
tables hold packed arrays, so that what is shuffled are a few large rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import _LOWER, Words, broadcast_arrays, crc_remainder, load, mapped, materialize, mix64, steps, work_tables

#: Bytes of context, at every size of the input.
DEPTH = 6
#: Lengths of context at which subtrees are cut into parts.
CUTS = (4, 2, 1)
#: Text bytes for one part of the tables.
PART_BYTES = 8 << 20
#: The most frequent n-grams and words, which travel to every task (16 bytes each); all others are looked up in their parts.
HEAD_GRAMS, HEAD_WORDS = 1 << 21, 1 << 19
#: Coded bytes that one vectorised step handles, and distinct entries that a training task holds before it sends them on.
RUN_BYTES, HELD = 1 << 19, 700_000
WORD, GRAM, TEXT = 0, 1, 2
_HALF = float(np.log(0.5))
#: log gamma(k + 1/2) and log gamma(k + 1) for small k.
_SMALL = 1 << 12
_LG_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))]) + 0.5 * np.log(np.pi)
_LG_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])


def grams(texts: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, text) of every coded byte, in runs: the byte lowest, before it the context, the nearest byte lowest."""
    lead = b"\0" * depth
    data = _LOWER[np.frombuffer(b"".join(lead + t + b"\xff" for t in texts), np.uint8)]
    coded = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(coded)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, RUN_BYTES):
        at = np.arange(begin, min(begin + RUN_BYTES, int(ends[-1])))
        text = np.searchsorted(ends, at, "right")
        at += (text + 1) * depth
        code = np.zeros(len(at), np.uint64)
        for i in range(depth, -1, -1):
            code = (code << np.uint64(8)) | data[at - i]
        yield code, text


def _cuts(depth: int) -> tuple[int, ...]:
    if not 2 <= depth <= 6:
        raise ValueError("contexts have 2 to 6 bytes")
    return tuple(c for c in CUTS if c < depth)


def _part(key: np.ndarray, cut: int, parts: int) -> np.ndarray:
    """Part of each key (n-gram or node): by the last `cut` bytes of its context."""
    context = (key >> np.uint64(8)) & np.uint64((1 << (8 * cut)) - 1)
    return (mix64(context + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    sorted_part = part[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1]]))
    for a, b in zip(first, [*first[1:], len(order)], strict=True):
        yield int(sorted_part[a]), order[a:b]


def _packed(array: np.ndarray) -> bytes:
    """An array of 8-byte numbers, compressed byte by byte, all highest bytes first: sorted keys and small counts shrink well."""
    planes = array.view(np.uint8).reshape(-1, 8).T[::-1].tobytes()
    return len(array).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _count(packed: bytes) -> int:
    return int.from_bytes(packed[:8], "little")


def _array(values, kind) -> np.ndarray:
    """Packed arrays of several rows as one."""
    parts = [np.frombuffer(pa.decompress(memoryview(v)[8:], 8 * _count(v), codec="zstd"), np.uint8).reshape(8, -1)[::-1].T.reshape(-1) for v in values if _count(v)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)).view(kind)


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key, m = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(key, kind="stable")
    key, m = key[order], m[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[first], np.add.reduceat(m, first)) if len(first) else (key, m)


def _rotated(code: np.ndarray, low: int, high: int) -> np.ndarray:
    """Codes with their `low` lowest bits moved above the `high` others: in this order a part's codes differ little."""
    return ((code & np.uint64((1 << low) - 1)) << np.uint64(high)) | (code >> np.uint64(low))


def _octave(m: np.ndarray) -> np.ndarray:
    """A count's quarter octave, by which the most frequent keys are told from the others."""
    return np.floor(4 * np.log2(np.maximum(m, 1))).astype(np.int64)


def counted(documents: DataFrame, parts: int, depth: int) -> DataFrame:
    """(kind, part, size, n_sum, octaves, key, n, m) of `documents` (text, _train): packed sorted keys with their counts in
    training texts (n) and in all texts (m), for words of training texts and n-grams of all; kind TEXT counts training texts."""

    low, high = 8 * (_cuts(depth)[0] + 1), 8 * (depth - _cuts(depth)[0])

    def pieces(kind: int, held: list) -> pd.DataFrame:
        key, m = _merged(held)
        if kind == GRAM:  # the lowest bit tells whether a count is of training texts
            part = _part(key >> np.uint64(1), _cuts(depth)[0], parts)
            key = (_rotated(key >> np.uint64(1), low, high) << np.uint64(1)) | (key & np.uint64(1))
            order = np.argsort(key)
            key, m, part = key[order], m[order], part[order]
        else:
            part = (key % np.uint64(parts)).astype(np.int64)
        return pd.DataFrame([(kind, p, _packed(key[at]), _packed(m[at])) for p, at in _split(part)], columns=["kind", "part", "key", "m"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {WORD: [], GRAM: []}
        rows = 0

        def add(kind: int, keys: np.ndarray) -> Iterator[pd.DataFrame]:
            key, m = np.unique(keys, return_counts=True)
            held[kind].append((key, m.astype(np.int64)))
            if sum(len(p[0]) for p in held[kind][1:]) > HELD // 2:
                held[kind] = [_merged(held[kind])]
                if len(held[kind][0][0]) > HELD:
                    yield pieces(kind, held[kind])
                    held[kind] = []

        for part, texts in steps(batches, limit=RUN_BYTES):
            train = part["_train"].to_numpy(dtype=bool)
            chosen = [t for t, used in zip(texts, train, strict=True) if used]
            rows += len(chosen)
            yield from add(WORD, Words(chosen).hash)
            for code, text in grams(texts, depth):
                yield from add(GRAM, (code << np.uint64(1)) | train[text].astype(np.uint64))
        for kind, rest in held.items():
            if rest:
                yield pieces(kind, rest)
        yield pd.DataFrame({"kind": [TEXT], "part": [0], "key": [_packed(np.zeros(1, np.uint64))], "m": [_packed(np.array([rows], np.int64))]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        key, m = _merged([(_array(frame["key"], np.uint64), _array(frame["m"], np.int64))])
        n = m
        if frame["kind"].iloc[0] == GRAM:
            taught = key & np.uint64(1) == 1
            code = _rotated(key >> np.uint64(1), high, low)
            key, back = np.unique(code, return_inverse=True)
            n, m = (np.bincount(back, weights=x, minlength=len(key)).astype(np.int64) for x in (np.where(taught, m, 0), m))
        return pd.DataFrame({
            "kind": frame["kind"].iloc[:1], "part": frame["part"].iloc[:1], "size": [len(key)], "n_sum": [int(n.sum())], "octaves": [np.bincount(_octave(m), minlength=256)],
            "key": [_packed(key)], "n": [_packed(n)], "m": [_packed(m)],
        })

    sent = documents.select("text", "_train").mapInPandas(run, "kind int, part long, key binary, m binary")
    return sent.groupBy("kind", "part").applyInPandas(merge, "kind int, part long, size long, n_sum long, octaves array<long>, key binary, n binary, m binary")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for large x."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _table(k: np.ndarray, offset: float, small: np.ndarray) -> np.ndarray:
    out = small[np.minimum(k, _SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(k >= _SMALL)
    out[large] = _log_gamma(k[large] + offset)
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the KT block probability of so many zeros and ones, in any order."""
    return _table(zeros, 0.5, _LG_HALF) + _table(ones, 0.5, _LG_HALF) - _table(zeros + ones, 1.0, _LG_WHOLE) - np.log(np.pi)


class Leaves:
    """Nodes of the longest contexts from sorted (context, byte) codes: `key` is 256 * context + the bits of the byte decided so
    far, from 1 to 255; `at[bit]` is each code's node."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        key, total, ones, self.at, self.code = [], [], [], [], code
        count, used = n.astype(np.float64), 0
        for bit in range(8):
            run = code >> np.uint64(8 - bit)
            new = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            key.append((code[first] & ~np.uint64(255)) | np.uint64(1 << bit) | ((code[first] & np.uint64(255)) >> np.uint64(8 - bit)))
            one = count * ((code >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.float64)
            total.append(np.add.reduceat(count, first) if len(first) else count)
            ones.append(np.add.reduceat(one, first) if len(first) else one)
            self.at.append(np.cumsum(new) - 1 + used)
            used += len(first)
        self.key, self.total, self.ones = np.concatenate(key), np.concatenate(total), np.concatenate(ones)

    def logs(self, one: np.ndarray) -> np.ndarray:
        """log10 probability of each code's byte, from the nodes' probabilities of a one."""
        out = np.zeros(len(self.code))
        for bit in range(8):
            p = one[self.at[bit]]
            out += np.log10(np.where((self.code >> np.uint64(7 - bit)) & np.uint64(1) == 1, p, 1 - p))
        return out


def _parents(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes with one byte of context less than the nodes of `key`, and each one's place among them."""
    return np.unique(key & np.uint64((1 << (8 * depth)) - 1), return_inverse=True)


class Subtree:
    """Nodes with contexts of `depth` bytes and all nodes above them, up to contexts of `top` bytes (`key` and so on).

    `below` is the sum of the children's weighted log probabilities; None where contexts end.  A node that only texts outside
    training pass has no counts: its weighted log probability is 0, so it changes nothing above it, and it predicts one half.
    """

    def __init__(self, key: np.ndarray, total: np.ndarray, ones: np.ndarray, below: np.ndarray | None, depth: int, top: int):
        self.levels = []
        while True:
            kt = _log_kt(total - ones, ones)
            weighted = kt if below is None else np.logaddexp(kt, below) + _HALF
            own = np.ones(len(kt)) if below is None else np.exp(kt + _HALF - weighted)  # weight of the own estimate
            back = None
            if depth > top:
                parent, back = _parents(key, depth)
            self.levels.append((back, own, (ones + 0.5) / (total + 1)))
            if depth == top:
                break
            total, ones, below = (np.bincount(back, weights=x, minlength=len(parent)) for x in (total, ones, weighted))
            key, depth = parent, depth - 1
        self.key, self.total, self.ones, self.weighted = key, total, ones, weighted

    def predict(self, fixed: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fixed, share) at the longest contexts: with p predicted by still longer ones, a node predicts fixed + share * p.
        Given are those of the contexts next shorter than the top ones, in the order of `key`."""
        for back, own, ratio in reversed(self.levels):
            if back is not None:
                fixed, share = fixed[back], share[back]
            fixed, share = fixed + share * own * ratio, share * (1 - own)
        return fixed, share


_NODES = "part long, origin long, key binary, total binary, ones binary, weighted binary"
_PASSED = "part long, key binary, fixed binary, share binary"


def _above(frame: pd.DataFrame, depth: int, top: int) -> tuple[Subtree, np.ndarray]:
    """The tree above some packed nodes of `depth` + 1 bytes of context, and the place of each one's parent."""
    total, ones, weighted = (_array(frame[c], np.float64) for c in ("total", "ones", "weighted"))
    parent, back = _parents(_array(frame["key"], np.uint64), depth + 1)
    sums = (np.bincount(back, weights=x, minlength=len(parent)) for x in (total, ones, weighted))
    return Subtree(parent, *sums, depth, top), back


def _passed(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(_array(frame["key"], np.uint64))
    return _array(frame["fixed"], np.float64)[order], _array(frame["share"], np.float64)[order]


def _addressed_back(frame: pd.DataFrame, back: np.ndarray, fixed: np.ndarray, share: np.ndarray) -> pd.DataFrame:
    """What parents pass to the nodes of `frame`, packed as the nodes came, for the part each row came from."""
    out, at = [], 0
    for origin, packed in zip(frame["origin"], frame["key"], strict=True):
        to = at + _count(packed)
        out.append((origin, packed, _packed(fixed[back[at:to]]), _packed(share[back[at:to]])))
        at = to
    return pd.DataFrame(out, columns=["part", "key", "fixed", "share"])


def predictions(counts: DataFrame, parts: int, depth: int) -> DataFrame:
    """(kind, part, key, value, m): log10 P(byte | context) of every counted n-gram."""
    spark = counts.sparkSession
    cuts = _cuts(depth)
    sizes = [parts, *[max(1, min(256**c, parts >> (3 * i))) for i, c in enumerate(cuts[1:], 1)]]
    counted_grams = counts.where(F.col("kind") == GRAM).select("part", "key", "n", "m")

    def addressed(tree: Subtree, origin: int, stage: int) -> pd.DataFrame:
        following = _part(tree.key, cuts[stage + 1], sizes[stage + 1]) if stage + 1 < len(cuts) else np.zeros(len(tree.key), np.int64)
        columns = (tree.key, tree.total, tree.ones, tree.weighted)
        return pd.DataFrame([(p, origin, *(_packed(x[at]) for x in columns)) for p, at in _split(following)], columns=["part", "origin", "key", "total", "ones", "weighted"])

    def leaves(key: bytes, n: bytes) -> tuple[Leaves, Subtree]:
        found = Leaves(_array([key], np.uint64), _array([n], np.int64))
        return found, Subtree(found.key, found.total, found.ones, None, depth, cuts[0])

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for part, key, n in zip(frame["part"], frame["key"], frame["n"], strict=True):
                yield addressed(leaves(key, n)[1], part, 0)

    ups = [materialize(counted_grams.select("part", "key", "n").mapInPandas(lowest, _NODES), "nodes")]


    def climb(stage: int):
        return lambda frame: addressed(_above(frame, cuts[stage - 1] - 1, cuts[stage])[0], int(frame["part"].iloc[0]), stage)

    for stage in range(1, len(cuts)):
        ups.append(materialize(ups[-1].groupBy("part").applyInPandas(climb(stage), _NODES), "nodes"))
    # contexts of one byte: at most 256 of 255 nodes each
    last = ups[-1].select("origin", "key", "total", "ones", "weighted").toPandas()
    tree, back = _above(last, cuts[-1] - 1, 0)
    down = _addressed_back(last, back, *tree.predict(np.zeros(len(tree.key)), np.ones(len(tree.key))))
    down = spark.createDataFrame([(int(r.part), r.key, r.fixed, r.share) for r in down.itertuples()], _PASSED)

    def descend(stage: int):
        def run(frame: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
            tree, back = _above(frame, cuts[stage - 1] - 1, cuts[stage])
            return _addressed_back(frame, back, *tree.predict(*_passed(given)))

        return run

    for stage in range(len(cuts) - 1, 0, -1):
        down = materialize(ups[stage - 1].groupBy("part").cogroup(down.groupBy("part")).applyInPandas(descend(stage), _PASSED), "passed")

    def finish(frame: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, key, n, m in zip(frame["part"], frame["key"], frame["n"], frame["m"], strict=True):
            found, tree = leaves(key, n)
            out.append((GRAM, part, key, _packed(found.logs(tree.predict(*_passed(given))[0])), m))
        return pd.DataFrame(out, columns=["kind", "part", "key", "value", "m"])

    return counted_grams.groupBy("part").cogroup(down.groupBy("part")).applyInPandas(finish, "kind int, part long, key binary, value binary, m binary")


def _head(tables: DataFrame, counts: DataFrame, kind: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of the most frequent keys of a kind: whole quarter octaves of counts, as many as stay below `limit`."""
    rows = counts.where(F.col("kind") == kind).select(F.posexplode("octaves").alias("octave", "n")).groupBy("octave").agg(F.sum("n").alias("n"))
    least, total = 1 << 20, 0
    for r in sorted(rows.where("n > 0").collect(), key=lambda r: -r.octave):  # at most 256
        total += r.n
        if total > limit:
            break
        least = r.octave

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for key, value, m in zip(frame["key"], frame["value"], frame["m"], strict=True):
                often = _octave(_array([m], np.int64)) >= least
                yield pd.DataFrame({"key": [_packed(_array([key], np.uint64)[often])], "value": [_packed(_array([value], np.float64)[often])]})

    found = tables.where(F.col("kind") == kind).select("key", "value", "m").mapInPandas(pick, "key binary, value binary").toArrow()
    key, value = (_array((x.as_py() for x in found.column(c)), t) for c, t in (("key", np.uint64), ("value", np.float64)))
    order = np.argsort(key)
    return key[order], value[order]


def _looked_up(wanted: np.ndarray, key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of keys (0 where there is none), and which were found; `key` is sorted."""
    if not len(key):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    found = key[at] == wanted
    return np.where(found, value[at], 0.0), found


def score(documents: DataFrame, training: Column, keep: list[str], depth: int | None = None) -> DataFrame:
    """`keep` columns, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of `documents` (text).

    The rows where `training` holds (null: does not) teach; all rows are scored.  Null and empty texts are one end token.
    Without training texts every count is zero and every bit is even.  Words are told apart by 64-bit hashes.  Repeated rows
    teach as often as they stand there and are scored alike; other columns are not read, whatever their names.  A long text is
    coded in runs of RUN_BYTES, with its context; memory for its words grows with its length (about 60 bytes a byte).
    """
    depth = DEPTH if depth is None else depth
    rows = documents.select(*keep, *[c for c in ["text"] if c not in keep], F.coalesce(training, F.lit(False)).alias("_train"))
    parts = max(8, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
    counts = materialize(counted(rows, parts, depth), "counts")
    totals = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n_sum").alias("n"), F.sum("size").alias("v")).collect()}
    ends = totals.get(TEXT, (0, 0))[0] or 0
    tokens = totals.get(WORD, (0, 0))[0] + ends
    distinct = totals.get(WORD, (0, 0))[1] + (ends > 0)
    log_total = float(np.log10(tokens + distinct + 1))

    def word_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            n = [_packed(_array([x], np.int64).astype(np.float64)) for x in frame["n"]]
            yield frame[["kind", "part", "key"]].assign(value=n, m=frame["n"])

    words = counts.where(F.col("kind") == WORD).select("kind", "part", "key", "n").mapInPandas(word_values, "kind int, part long, key binary, value binary, m binary")
    with work_tables(documents.sparkSession) as held:
        tables = held(materialize(words.unionByName(predictions(counts, parts, depth)), "tables"))
    heads = [_head(tables, counts, kind, limit) for kind, limit in ((WORD, HEAD_WORDS), (GRAM, HEAD_GRAMS))]
    shared = broadcast_arrays(documents.sparkSession, 16 * (HEAD_WORDS + HEAD_GRAMS), word=heads[0][0], n=heads[0][1], gram=heads[1][0], log=heads[1][1])
    del heads
    cut = _cuts(depth)[0]
    pieces_type = "array<struct<kind:int,part:bigint,row:binary,key:binary>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in batches:
            done, sent = [], []
            for part, texts in steps(iter([frame]), limit=RUN_BYTES):
                ids = part["_row"].to_numpy().astype(np.int64)
                w = Words(texts)
                n, known = _looked_up(w.hash, model["word"], model["n"])
                logs = np.where(known, np.log10(n + 1.0) - log_total, 0.0)
                sent.append((WORD, ids[w.doc[~known]], w.hash[~known]))
                scores = np.zeros(len(texts))
                for code, text in grams(texts, depth):
                    each, back = np.unique(code, return_inverse=True)
                    value, held = _looked_up(each, model["gram"], model["log"])
                    scores += np.bincount(text, weights=value[back], minlength=len(texts))
                    far = np.flatnonzero(~held[back])
                    sent.append((GRAM, ids[text[far]], code[far]))
                done.append(part[[*keep, "_row"]].assign(
                    n_tokens=w.per_doc + 1,
                    _known=np.bincount(w.doc, weights=known, minlength=len(texts)).astype(np.int64) + int(ends > 0),
                    _base=np.bincount(w.doc, weights=logs, minlength=len(texts)) + float(np.log10(ends + 1)) - log_total,
                    _score=scores,
                    _coded=np.array([len(t) + 1 for t in texts]),
                ))
            if done:
                rows = pd.concat(done, ignore_index=True)
                rows["_pieces"] = pd.Series([asked_for(sent)] + [None] * (len(rows) - 1), dtype=object)
                yield rows

    def asked_for(sent: list) -> list[dict]:
        """What a batch must look up elsewhere, by kind and part, in the order of the keys."""
        out = []
        for kind in (WORD, GRAM):
            row, key = (np.concatenate([x[i] for x in sent if x[0] == kind]) for i in (1, 2))
            order = np.argsort(key, kind="stable")
            row, key = row[order], key[order]
            part = _part(key, cut, parts) if kind == GRAM else (key % np.uint64(parts)).astype(np.int64)
            out += [{"kind": kind, "part": p, "row": _packed(row[at]), "key": _packed(key[at])} for p, at in _split(part)]
        return out

    extra = f"n_tokens long, _known long, _base double, _score double, _coded long, _pieces {pieces_type}"
    scored = mapped(rows.withColumn("_row", F.monotonically_increasing_id()), [*keep, "_row"], ["text"], run, extra)
    scored = materialize(scored, "scored")
    asked = scored.where("_pieces is not null").select(F.col("_row").alias("step"), F.explode("_pieces").alias("x")).select("step", "x.*")

    def answer(wanted: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(wanted):
            kind = int(wanted["kind"].iloc[0])
            key, value = (_array(table[c], t) for c, t in (("key", np.uint64), ("value", np.float64)))
            for step, row, each in zip(wanted["step"], wanted["row"], wanted["key"], strict=True):
                rows, back = np.unique(_array([row], np.int64), return_inverse=True)
                got, found = _looked_up(_array([each], np.uint64), key, value)
                if kind == WORD:
                    got = np.log10(got + 1.0) - log_total
                sums = np.bincount(back, weights=got, minlength=len(rows))
                hits = np.bincount(back, weights=found, minlength=len(rows)).astype(np.int64)
                out.append((step, kind, _packed(rows), _packed(sums), _packed(hits)))
        return pd.DataFrame(out, columns=["step", "kind", "row", "sums", "hits"])

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        row = _array(frame["row"], np.int64)
        kind = np.repeat(frame["kind"].to_numpy(), [_count(x) for x in frame["row"]])
        ids, back = np.unique(row, return_inverse=True)
        sums, hits = _array(frame["sums"], np.float64), _array(frame["hits"], np.int64)
        add = lambda x, k: np.bincount(back, weights=np.where(kind == k, x, 0.0), minlength=len(ids))
        return pd.DataFrame({"_row": ids, "b": add(sums, WORD), "k": add(hits, WORD).astype(np.int64), "f": add(sums, GRAM)})

    answered = asked.groupBy("kind", "part").cogroup(tables.select("kind", "part", "key", "value").groupBy("kind", "part")).applyInPandas(answer, "step long, kind int, row binary, sums binary, hits binary")
    looked = answered.groupBy("step").applyInPandas(total, "_row long, b double, k long, f double")
    done = scored.drop("_pieces").join(looked, "_row", "left").withColumn("score", F.col("_score") + F.coalesce("f", F.lit(0.0)))
    return done.select(
        *keep, "n_tokens", (F.col("_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.col("_coded")).alias("bits_per_byte"),
    )


def op3_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    documents = documents.withColumn("held_out", F.coalesce(crc_remainder(F.col("doc_id"), 7) == 2, F.lit(False)))
    return score(documents, ~F.col("held_out"), ["doc_id", "held_out"])
