"""Operator 10: near-duplicate classes by ProbMinHash, banding and verification.

A text's five-word shingles, weighted by how often they occur, arrive as Poisson processes: each element's arrivals come at
exponential steps scaled by its weight and hit random components; an element stops as soon as its next arrival lies beyond
the largest minimum, for it can change nothing more.  Two signatures agree in a component with exactly the probability
Jaccard similarity of the texts.  Bands of components make buckets; within a bucket, members are compared with a hub, the
member that shares most buckets with others.  Buckets whose members still lie in several classes after some hubs are compared
member by member, in blocks of bounded size, first by an upper bound of their similarity, which no pair of the required
similarity fails.  Every link is verified on the shingles of both texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import Words, broadcast_arrays, load, materialize, mix64, steps, work_tables

WORDS = 5
SIMILARITY = 0.8
#: Components are BANDS * ROWS; at a similarity of 0.8 a pair misses all buckets with a chance of 3e-6.
BANDS, ROWS = 24, 4
HUB_ROUNDS = 3
#: Members of a block; two blocks are compared in one task's memory.
BLOCK_MEMBERS = 512
#: Bits of the filter that spares most rows the join with the rows to be compared: a fixed 8 MB, whatever the input.
FILTER_BITS = 1 << 26
_HASH_BITS = 44
_C = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(doc, shingle, weight) of every distinct shingle of every text, sorted; a text of 1 to 4 words is one shingle."""
    words = Words(texts)
    h = words.hash
    n = len(h)
    code = np.zeros(n, np.uint64)
    left = words.first[words.doc + 1] - np.arange(n) if n else np.zeros(0, np.int64)  # words to the end of the text
    power = 1
    for k in range(WORDS):
        within = left > k
        part = np.zeros(n, np.uint64)
        part[: n - k] = h[k:] if k else h
        code += np.where(within, part * np.uint64(power) + np.uint64(k + 1), 0)
        power = power * int(_C) % (1 << 64)
    whole = (left >= WORDS) | (np.arange(n) == words.first[words.doc] if n else np.zeros(0, bool))
    code = mix64(code[whole]) >> np.uint64(64 - _HASH_BITS)
    doc = words.doc[whole]
    key, weight = np.unique((doc.astype(np.uint64) << np.uint64(_HASH_BITS)) | code, return_counts=True)
    return (key >> np.uint64(_HASH_BITS)).astype(np.int64), key & np.uint64((1 << _HASH_BITS) - 1), weight, words


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures (n_docs, size) of weighted sets; a set without elements gets zeros."""
    least = np.full(n_docs * size, np.inf)
    chosen = np.zeros(n_docs * size, np.uint64)
    at = np.zeros(len(doc))
    scale = 1.0 / weight
    r = 0
    while len(doc):
        seed = element + np.uint64((r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        at = at - np.log(_uniform(seed)) * scale
        worst = least.reshape(n_docs, size).max(axis=1)
        alive = at < worst[doc]  # early termination
        if not alive.all():
            doc, element, at, scale, seed = doc[alive], element[alive], at[alive], scale[alive], seed[alive]
        slot = doc * size + (mix64(seed ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(least, slot, at)
        won = least[slot] == at
        chosen[slot[won]] = element[won]
        r += 1
    return chosen.reshape(n_docs, size)


def bands(signature: np.ndarray) -> np.ndarray:
    """Bucket ids (n_docs, BANDS)."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _C, parts.shape[:2]).copy()
    for r in range(ROWS):
        out = mix64(out ^ parts[:, :, r]) * _C
    return out.view(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over shared d of 1 / sum over d' of max(a(d')/a(d), b(d')/b(d)); a, b sorted; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    only_a, only_b = float(wa.sum() - x.sum()), float(wb.sum() - y.sum())
    # max takes a(d')/a(d) where d' has at least d's ratio, b(d')/b(d) where it has less
    cut = np.searchsorted(ratio, ratio, "left")
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])[cut] + only_a
    below = np.concatenate([[0.0], np.cumsum(y)])[cut] + only_b
    return float(np.sum(1.0 / (above / x + below / y)))


def most_alike(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Upper bound of the probability Jaccard similarity of texts that share elements of weight `xs` and `ys` (of 1); what it is
    where all weights of a text are equal.

    The term of a shared d is 1 / sum over d' of max(a(d')/a(d), b(d')/b(d)).  Elements of one text alone add (1-xs)/a(d) and
    (1-ys)/b(d) to that sum, shared ones at least xs/a(d), so the term is at most 1 / (1/a(d) + (1-ys)/b(d)).  That is concave
    and homogeneous in a(d) and b(d), so the sum of the terms is at most its value at their sums, xs and ys.
    """
    return np.where(xs * ys > 0, xs * ys / np.maximum(xs + ys - xs * ys, 1e-300), 0.0)


def _sharing(a: list, b: list, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of `a` with wanted pairs: its number, those of its wanted texts of `b`, and most_alike of each; texts are (shingles, weights)."""
    short, weight = np.concatenate([x[0] for x in b]), np.concatenate([x[1] / max(1, x[1].sum()) for x in b])
    size = np.array([len(x[0]) for x in b])
    owner = np.repeat(np.arange(len(b)), size)
    order = np.argsort(short, kind="stable")
    short, weight, owner = short[order], weight[order], owner[order]
    for i in np.flatnonzero(wanted.any(axis=1)).tolist():
        s, n = a[i]
        low, high = np.searchsorted(short, s, "left"), np.searchsorted(short, s, "right")
        times = high - low
        at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        xs = np.bincount(owner[at], weights=np.repeat(n / max(1, n.sum()), times), minlength=len(b))
        ys = np.bincount(owner[at], weights=weight[at], minlength=len(b))
        j = np.flatnonzero(wanted[i])
        yield i, j, most_alike(xs[j], ys[j])


def _sketch(staged: DataFrame) -> DataFrame:
    """(_row, digest, buckets, short) of each text, `short` being 16 bits of each component; no digest and no buckets without a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for part, texts in steps(iter([frame])):
                doc, element, weight, words = shingles(texts)
                signature = signatures(doc, element, weight, len(texts))
                buckets, short = bands(signature), mix64(signature).astype(np.uint16)
                digest = [hashlib.md5(words.hash[i:j].tobytes()).hexdigest() if j > i else None for i, j in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pd.DataFrame({"_row": part["_row"], "digest": digest, "buckets": [list(x) if d else [] for x, d in zip(buckets, digest, strict=True)], "short": [x.tobytes() for x in short]})

    return staged.select("_row", "text").mapInPandas(run, "_row long, digest string, buckets array<long>, short binary")


def _packed(short: np.ndarray, weight: np.ndarray) -> bytes:
    """Weights of distinct 32-bit shingles in order; nothing where all are 1."""
    if weight.sum() == len(short):
        return b"" if len(np.unique(short)) == len(short) else np.unique(short, return_counts=True)[1].astype(np.int32).tobytes()
    distinct, back = np.unique(short, return_inverse=True)
    return np.bincount(back, weights=weight, minlength=len(distinct)).astype(np.int32).tobytes()


def _unpacked(s: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    short = np.frombuffer(s, np.uint32)
    return short, np.frombuffer(n, np.int32) if n else np.ones(len(short), np.int32)


def _weighted(staged: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, s, n): sorted shingles (32 bits) and weights, as bytes, of the rows in `wanted` (t)."""
    cells = FILTER_BITS // 64

    def probe(x: np.ndarray) -> list[np.ndarray]:
        h = mix64(x.astype(np.uint64))
        return [((h >> np.uint64(32 * i)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for i in range(2)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for p in probe(frame["t"].to_numpy()):
                yield pd.DataFrame({"cell": p // 64, "bits": (np.uint64(1) << (p % 64).astype(np.uint64)).view(np.int64)})

    bits = np.zeros(cells, np.uint64)
    for batch in wanted.mapInPandas(place, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits")).toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    shared = broadcast_arrays(staged.sparkSession, FILTER_BITS // 8, bits=bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value["bits"]
        for frame in batches:
            keep = np.ones(len(frame), bool)
            for p in probe(frame["_row"].to_numpy()):
                keep &= (held[p // 64] >> (p % 64).astype(np.uint64)) & np.uint64(1) == 1
            for part, texts in steps(iter([frame[keep]])):
                doc, element, weight, _ = shingles(texts)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                yield pd.DataFrame({
                    "t": part["_row"], "s": [np.unique(element[i:j].astype(np.uint32)).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)],
                    "n": [_packed(element[i:j].astype(np.uint32), weight[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)],
                })

    return staged.select("_row", "text").mapInPandas(run, "t long, s binary, n binary").join(wanted, "t", "left_semi")


def _verify(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """The pairs (t, u) whose probability Jaccard similarity is at least SIMILARITY."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            alike = [
                probability_jaccard(*_unpacked(s, n), *_unpacked(s2, n2)) >= SIMILARITY - 1e-9
                for s, n, s2, n2 in zip(frame["s"], frame["n"], frame["s2"], frame["n2"], strict=True)
            ]
            yield frame.loc[alike, ["t", "u"]]

    other = weighted.select(F.col("t").alias("u"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    return pairs.join(weighted, "t").join(other, "u").select("t", "u", "s", "n", "s2", "n2").mapInPandas(run, "t long, u long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(t, c): the smallest node of each node's component; nodes (t), edges (t, u), both materialized.

    Labels fall to the smallest of the neighbourhood and then to the label's own label, so paths halve in each round; every
    round is a written table.
    """
    both = materialize(edges.unionByName(edges.select(F.col("u").alias("t"), F.col("t").alias("u"))).distinct(), "edges")
    labels = materialize(nodes.select("t", F.col("t").alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("t").alias("u"), "c"), "u").groupBy("t").agg(F.min("c").alias("n"))
        lower = materialize(labels.join(near, "t", "left").select("t", F.col("c").alias("old"), F.least("c", F.coalesce("n", "c")).alias("c")), "lower")
        jump = lower.select(F.col("t").alias("c"), F.col("c").alias("d"))
        following = materialize(lower.join(jump, "c", "left").select("t", "old", F.least("c", F.coalesce("d", "c")).alias("c")), "labels")
        labels = following.select("t", "c")
        if following.where("c <> old").isEmpty():
            return labels


def _in_blocks(members: DataFrame, short: DataFrame, weighted: DataFrame) -> DataFrame:
    """Links (t, u) between members (bucket, band, t, c) of a bucket that lie in two classes.

    A bucket's members are dealt into blocks of about BLOCK_MEMBERS, and every two blocks meet in one group, so no group grows
    with its bucket, and only links become rows.  Pairs that can be alike (most_alike) are verified, those whose signatures
    agree most first; a pair is left out where links found in the group have united its classes, and in all but its first common bucket.
    """
    sizes = materialize(members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("k")), "block-counts")
    dealt = members.join(sizes, "bucket").join(short, "t").join(weighted, "t").withColumn("b", F.pmod(F.xxhash64("t"), F.col("k")).cast("int"))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.select("bucket", "band", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"), "b", "t", "c", "short", "s", "n")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        low, high, band = int(frame["low"].iloc[0]), int(frame["high"].iloc[0]), int(frame["band"].iloc[0])
        a, b = frame[frame["b"] == low], frame[frame["b"] == high]
        x, y = (np.frombuffer(b"".join(f["short"]), np.uint16).reshape(len(f), BANDS * ROWS) for f in (a, b))
        ta, tb, ca, cb = a["t"].to_numpy(), b["t"].to_numpy(), a["c"].to_numpy(), b["c"].to_numpy()
        agree = np.zeros((len(x), len(y)), np.uint8)
        earlier = np.zeros((len(x), len(y)), bool)
        for k in range(BANDS):
            whole = np.ones((len(x), len(y)), bool)
            for r in range(ROWS):
                same = x[:, k * ROWS + r][:, None] == y[:, k * ROWS + r][None, :]
                agree += same
                whole &= same
            if k < band:
                earlier |= whole
        wanted = ~earlier & (ca[:, None] != cb[None, :]) & ((ta[:, None] < tb[None, :]) if low == high else True)
        sa = [_unpacked(s, n) for s, n in zip(a["s"], a["n"], strict=True)]
        sb = [_unpacked(s, n) for s, n in zip(b["s"], b["n"], strict=True)]
        pairs = [np.zeros((2, 0), np.int64)]
        for row, columns, bound in _sharing(sa, sb, wanted):
            columns = columns[bound >= SIMILARITY - 1e-6]
            pairs.append(np.stack([np.full(len(columns), row), columns]))
        i, j = np.concatenate(pairs, axis=1)
        order = np.argsort(-agree[i, j].astype(np.int16), kind="stable")
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        links = []
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            p, q = root(int(ca[x])), root(int(cb[y]))
            if p != q and probability_jaccard(*sa[x], *sb[y]) >= SIMILARITY - 1e-9:
                parent[p] = q
                links.append((ta[x], tb[y]))
        return pd.DataFrame(links, columns=["t", "u"], dtype="int64")

    return met.groupBy("bucket", "low", "high").applyInPandas(compare, "t long, u long")


def text_links(staged: DataFrame, sketched: DataFrame) -> DataFrame:
    """(t, c, links): each distinct text that shares a bucket, its component and the verified links it has; texts are named by a row (t)."""
    texts = sketched.where("digest is not null").groupBy("digest").agg(F.min("_row").alias("t"))
    named = sketched.select(F.col("_row").alias("t"), "buckets", "short").join(texts.select("t"), "t", "left_semi")
    named = materialize(named, "texts")
    exploded = named.select("t", F.posexplode("buckets").alias("band", "bucket"))
    shared = materialize(exploded.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"), "shared-buckets")
    members = materialize(exploded.join(shared, "bucket"), "members")
    nodes = materialize(members.groupBy("t").agg(F.sum("k").alias("weight")), "nodes")
    weighted = materialize(_weighted(staged, nodes.select("t")), "weighted")
    labels = materialize(nodes.select("t", F.col("t").alias("c")), "labels")
    edges = None
    for step in range(HUB_ROUNDS + 1):
        placed = materialize(members.select("bucket", "band", "t").join(labels.join(nodes, "t"), "t"), "placed")
        best = F.max(F.struct("weight", (-F.col("t")).alias("m"), "c")).alias("hub")
        hubs = placed.groupBy("bucket").agg(best, F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most")
        hubs = materialize(hubs.select("bucket", (-F.col("hub.m")).alias("u"), F.col("hub.c").alias("uc")), "hubs")
        if hubs.isEmpty():
            break
        rest = placed.join(hubs, "bucket")
        if step < HUB_ROUNDS:
            pairs = materialize(rest.where("c <> uc").select("t", "u").distinct(), "pairs")
            found = materialize(_verify(pairs, weighted), "links")
        else:  # what hubs could not settle
            found = materialize(_in_blocks(rest.select("bucket", "band", "t", "c"), named.select("t", "short"), weighted), "links")
        edges = found if edges is None else edges.unionByName(found)
        labels = components(nodes, edges)
        # a hub has now been held against all members of its bucket
        members = rest.where("t <> u").select("bucket", "band", "t")
    if edges is None:
        return labels.withColumn("links", F.lit(0).cast("long"))
    ends = edges.unionByName(edges.select(F.col("u").alias("t"), F.col("t").alias("u"))).distinct()
    return labels.join(ends.groupBy("t").agg(F.count("*").alias("links")), "t", "left")


def stage_rows(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with a `_row` that names each row for good, in place of any column of that name."""
    return materialize(documents.select(*columns).withColumn("_row", F.monotonically_increasing_id()), "rows")


def near_duplicates(staged: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(_row, id, class_id, keeper, class_size, links): one row per staged row.

    `links` counts the verified links of the row's text that made its class: enough to hold the class together, not all.
    class_id is the smallest id of the class, keeper marks the class's row with the smallest id (ties: the first row).
    Texts with the same words, in A-Z lower case, are one text.  Null, empty and wordless texts are classes of their own.
    A class whose ids are all null has a null class_id.  Very long texts are shingled whole; an empty table gives no rows; columns besides
    `_row`, text and id are not read.
    """
    with work_tables(staged.sparkSession) as keep:
        sketched = materialize(_sketch(staged), "sketches")
        texts = materialize(sketched.where("digest is not null").groupBy("digest").agg(F.min("_row").alias("t")), "texts")
        labels = text_links(staged, sketched)
        ids = sketched.select("_row", "digest").join(staged.select("_row", F.col(id_column).alias("_id")), "_row")
        named = ids.join(texts, "digest", "left").join(labels, "t", "left")
        named = keep(materialize(named.select("_row", "_id", F.coalesce("c", "t", "_row").alias("c"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), "named"))
        order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))
        first = keep(materialize(named.groupBy("c").agg(F.min(order).alias("first"), F.count("*").alias("class_size")), "classes"))
    rows = named.join(first, "c")
    return rows.select("_row", F.col("_id").alias(id_column), F.col("first.i").alias("class_id"), (F.col("_row") == F.col("first.r")).alias("keeper"), "class_size", "links")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = stage_rows(load(spark, sf_dir, "documents"), ["doc_id", "text"])
    return near_duplicates(staged).select("doc_id", "class_id", "class_size", "links")
