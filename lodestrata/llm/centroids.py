"""k-means over integer vectors by filtering kd-trees.

Each task cuts its vectors into blocks and builds a kd-tree over each; trees are written once.  A node holds how many vectors it has,
their exact sums and their bounding box.  In a round every tree is walked level by level with the set of centroids that may still
be nearest: a centroid that is farther than another from every point of a node's box goes, a node with one centroid left is added
as a whole, and the vectors of a leaf with several are compared one by one.  All of it is integer arithmetic, so results are the
same however vectors are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import load, materialize

#: Vectors in one tree, and in one leaf at most.
BLOCK = 8192
LEAF = 32
SCALE = 64
#: Larger integers count as this one, so that a squared distance of 64 components fits a long.
LARGEST = 1 << 26
#: Up to here squared distances are exact in floating point.
EXACT = 1 << 22
#: Nodes that one step compares with all centroids.
STEP_NODES = 512

TREE = "vec_id array<bigint>, points binary, start binary, stop binary, left binary, low binary, high binary, sums binary"


def whole(column: str, dims: int) -> Column:
    """True for vectors of `dims` components, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(column) == dims) & F.forall(column, finite), F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int32)


class KdTree:
    """A kd-tree over `points`, which it reorders: node i has rows start[i] to stop[i], children left[i] and left[i] + 1 (a leaf: -1)."""

    def __init__(self, points, start, stop, left, low, high, sums):
        self.points, self.start, self.stop, self.left, self.low, self.high, self.sums = points, start, stop, left, low, high, sums

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[KdTree, np.ndarray]:
        """The tree, and the input row of each of its points.  Nodes are halved along their widest side; one without any is a leaf."""
        order = np.arange(len(points))
        start, stop, left, low, high, sums = [0], [len(points)], [], [], [], []
        at = 0
        while at < len(start):
            a, b = start[at], stop[at]
            rows = points[order[a:b]]
            low.append(rows.min(0))
            high.append(rows.max(0))
            sums.append(rows.sum(0, dtype=np.int64))
            side = int(np.argmax(high[-1].astype(np.int64) - low[-1]))
            if b - a <= leaf or low[-1][side] == high[-1][side]:
                left.append(-1)
            else:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, side], half)]
                left.append(len(start))
                start += [a, a + half]
                stop += [a + half, b]
            at += 1
        as_int = lambda x: np.array(x, np.int32)
        return cls(points[order], as_int(start), as_int(stop), as_int(left), np.stack(low), np.stack(high), np.stack(sums)), order

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.points, self.start, self.stop, self.left, self.low, self.high, self.sums)]

    @classmethod
    def unpacked(cls, dims: int, points, start, stop, left, low, high, sums) -> KdTree:
        flat = [np.frombuffer(x, np.int32) for x in (start, stop, left)]
        wide = [np.frombuffer(x, kind).reshape(-1, dims) for x, kind in ((points, np.int32), (low, np.int32), (high, np.int32), (sums, np.int64))]
        return cls(wide[0], *flat, *wide[1:])

    def filter(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, their centroid, leaves, their possible centroids): nodes that one centroid takes whole, and leaves where several remain."""
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        taken, takers, leaves, masks = [], [], [], []
        while len(nodes):
            open_ = np.concatenate([self._undominated(nodes[i : i + STEP_NODES], open_[i : i + STEP_NODES], centroids) for i in range(0, len(nodes), STEP_NODES)])
            single = open_.sum(1) == 1
            taken.append(nodes[single])
            takers.append(open_[single].argmax(1))
            nodes, open_ = nodes[~single], open_[~single]
            ends = self.left[nodes] < 0
            leaves.append(nodes[ends])
            masks.append(open_[ends])
            nodes, open_ = self.left[nodes[~ends]], open_[~ends]
            nodes, open_ = np.concatenate([nodes, nodes + 1]), np.concatenate([open_, open_])
        return np.concatenate(taken), np.concatenate(takers), np.concatenate(leaves), np.concatenate(masks)

    def _undominated(self, nodes: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """`open_` without the centroids that are strictly farther than another one from every point of the node's box."""
        low, high = self.low[nodes].astype(np.int64), self.high[nodes].astype(np.int64)
        middle = (low + high) / 2
        far = (middle**2).sum(1)[:, None] - 2 * middle @ centroids.T.astype(np.float64) + (centroids.astype(np.float64) ** 2).sum(1)
        best = centroids[np.where(open_, far, np.inf).argmin(1)]
        # of the box's corners the one farthest towards the centroid speaks for all
        towards = centroids[None] - best[:, None]
        corner = np.where(towards > 0, high[:, None], low[:, None])
        return open_ & ((towards * (centroids[None] + best[:, None] - 2 * corner)).sum(2) <= 0)

    def rows(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows below nodes, and for each row the place of its node among them."""
        sizes = (self.stop[nodes] - self.start[nodes]).astype(np.int64)
        of = np.repeat(np.arange(len(nodes)), sizes)
        return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.start[nodes][of], of

    def resolved(self, leaves: np.ndarray, masks: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of leaves, and each row's nearest possible centroid; ties go to the smaller number."""
        rows, of = self.rows(leaves)
        return rows, np.where(masks[of], squared(self.points[rows], centroids), np.iinfo(np.int64).max).argmin(1)

    def sums_by_centroid(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many vectors each centroid takes, and their sums."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        nodes, takers, leaves, masks = self.filter(centroids)
        np.add.at(counts, takers, self.stop[nodes] - self.start[nodes])
        np.add.at(sums, takers, self.sums[nodes])
        rows, nearest = self.resolved(leaves, masks, centroids)
        np.add.at(counts, nearest, 1)
        np.add.at(sums, nearest, self.points[rows])
        return counts, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's centroid and squared distance."""
        nearest = np.empty(len(self.points), np.int64)
        nodes, takers, leaves, masks = self.filter(centroids)
        rows, of = self.rows(nodes)
        nearest[rows] = takers[of]
        rows, found = self.resolved(leaves, masks, centroids)
        nearest[rows] = found
        return nearest, ((self.points - centroids[nearest]) ** 2).sum(1)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centroids, exactly."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        x, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, block: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    held: list[tuple[np.ndarray, pa.Array]] = []
    size = 0
    for batch in batches:
        points = integers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
        at = 0
        while at < len(points):
            take = min(block - size, len(points) - at)
            held.append((points[at : at + take], batch.column(0).slice(at, take)))
            at, size = at + take, size + take
            if size == block:
                yield np.concatenate([p for p, _ in held]), pa.concat_arrays([i for _, i in held])
                held, size = [], 0
    if size:
        yield np.concatenate([p for p, _ in held]), pa.concat_arrays([i for _, i in held])


def plant(vectors: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """Trees over all vectors of (vec_id, embedding), as a written table; a task holds one block at a time."""

    def grow(batches):
        for points, ids in _blocks(batches, dims, block):
            tree, order = KdTree.build(points)
            arrays = [pa.array([x], pa.binary()) for x in tree.packed()]
            made = pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([made, *arrays], ["vec_id", "points", "start", "stop", "left", "low", "high", "sums"])

    return materialize(vectors.mapInArrow(grow, TREE), "kd-trees")


def _walk(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, KdTree]]:
    for batch in batches:
        ids = batch.column(0)
        for i in range(batch.num_rows):
            yield ids.slice(i, 1).flatten(), KdTree.unpacked(dims, *[memoryview(batch.column(c)[i].as_buffer()) for c in range(1, 8)])


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floors of their vectors' means; one without vectors stays.  k rows come to the driver."""
    k, dims = centroids.shape

    def count(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, tree in _walk(batches, dims):
            c, s = tree.sums_by_centroid(centroids)
            counts += c
            sums += s
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(counts[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = trees.mapInArrow(count, "cluster int, n bigint, sums array<bigint>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]).collect()
    moved = centroids.copy()
    for row in rows:
        moved[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return moved


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: str = "1", block: int = BLOCK) -> DataFrame:
    """Each vector's cluster and squared distance, its cluster's and the whole inertia, and the digest of its centroid.

    Vectors that are null, of another length or hold null or non-finite components take no part.  Components are floor(64 x);
    beyond 2**26 they count as that.  The first centroids are those of smallest hash of id and seed, of equal hashes (repeated ids)
    the smaller vector first, null ids last; fewer vectors than `k` give fewer centroids.  Ties go to the smaller number.
    Repeated rows are rows of their own, an empty table gives no rows, other columns are not read.  An inertia that no long
    holds is null.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(whole("embedding", dims))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(hashed), "embedding").limit(k).collect()
    out = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    centroids = integers(np.array([r.embedding for r in first])).astype(np.int64)
    trees = plant(kept, dims, block)
    for _ in range(rounds):
        centroids = _moved(trees, centroids)

    def assign(batches):
        for ids, tree in _walk(batches, dims):
            nearest, distance = tree.assigned(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = materialize(trees.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "assigned")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda d: int(d) if d < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(c, fits(d), fits(sum(inertia.values())), digest(centroids[c].tolist())) for c, d in inertia.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")  # k rows
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(load(spark, sf_dir, "embeddings"))


def _assignment(name: str, centroids: str) -> str:
    """SQL: each vector with its nearest centroid, all pairs compared."""
    return f"""{name} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(p) AS p, min({{'d': d, 'k': k}}) AS best
  FROM (SELECT row, vec_id, p, k, list_sum(list_transform(list_zip(p, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM v, {centroids}) GROUP BY row)"""


def _round(i: int) -> str:
    return f"""{_assignment(f"a{i}", f"c{i}")},
m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{i}) GROUP BY k, i) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{i} AS o LEFT JOIN m{i} AS m ON m.k = o.k),
"""


SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, p AS c FROM v QUALIFY k < 16),
{"".join(_round(i) for i in range(3))}{_assignment("a", "c3")}
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN c3 ON c3.k = best.k"""
