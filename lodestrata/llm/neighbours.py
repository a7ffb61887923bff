"""Nearest neighbours by cosine, with vantage-point trees.

The angle between two vectors is a metric, so distances to a vantage point bound distances between others.  A small tree over a
sample deals all vectors out to shards; each shard holds trees over pieces of bounded size.  A query searches its own shard first and
then those shards that may hold something nearer than its sixth best row.  A branch is left out when `factor` times its least possible
angle is beyond that; factor 1 leaves nothing out that could be nearer, larger factors search less.

Equal vectors are one point with the smallest ids that it needs, so that copies cost nothing in a tree, and are asked for once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import load, materialize

#: Numbers in the vectors of one piece, points in one leaf of its tree, queries in one block, and bytes of blocks made at once.
PIECE, LEAF, ASKED, BLOCK_BYTES = 1 << 19, 48, 1024, 8 << 20
#: Numbers in the vectors that the tree over shards is fitted on, and vectors that each of its leaves gets about; every vector is indexed.
SAMPLE, PER_SHARD = 1 << 20, 16
#: Angles closer than this may be in either order: what rounding of a cosine near one makes of its angle.
SLACK = 1e-7
#: Factor of the registered query: exact.
FACTOR = 1.0

TREE = "shard int, piece int, vectors binary, ids binary, n_ids binary, vantage binary, left binary, near binary"
BLOCK = "shard int, piece int, nodes binary, asked binary, least binary"
FOUND = "node bigint, vec_id bigint, score double"


def units(values: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaling by a power of two first keeps squares in range and changes no quotient."""
    values = scaled(values)
    return values / np.sqrt((values**2).sum(1))[:, None]


def scaled(values: np.ndarray) -> np.ndarray:
    return np.ldexp(values.astype(np.float64), -np.frexp(np.abs(values).max(1))[1][:, None].astype(np.int32))


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, the same for a row wherever it stands."""
    total = products[:, 0].copy()
    for i in range(1, products.shape[1]):
        total += products[:, i]
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of `a` with that of `b`."""
    a, b = scaled(a), scaled(b)
    return in_order(a * b) / (np.sqrt(in_order(a * a)) * np.sqrt(in_order(b * b)))


class VantageTree:
    """Nodes with a vantage point each; `left[i]` and `left[i] + 1` are the children, the nearer half first (a leaf: -1 - its first row).

    `near[i]`: least and largest angle of either child's points to the vantage point of i.  A leaf's rows end where the next one's begin.
    """

    def __init__(self, vantage: np.ndarray, left: np.ndarray, near: np.ndarray):
        self.vantage, self.left, self.near = vantage, left, near

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> tuple[VantageTree, np.ndarray]:
        """The tree over unit vectors, and the order of its rows.  The vantage point is the farthest from the first point of a node."""
        order = np.arange(len(points))
        ranges, left, near, vantage, at = [(0, len(points))], [], [], [], 0
        while at < len(ranges):
            a, b = ranges[at]
            rows = points[order[a:b]]
            point = rows[int((rows @ rows[0]).argmin())] if b > a else np.zeros(points.shape[1])
            angle = np.arccos(np.clip(rows @ point, -1, 1))
            if b - a <= leaf or angle.max() - angle.min() <= SLACK:
                left.append(-1 - a)
                near.append((0.0,) * 4)
            else:
                half = (b - a) // 2
                by = np.argpartition(angle, half)
                order[a:b], angle = order[a:b][by], angle[by]
                left.append(len(ranges))
                near.append((angle[:half].min(), angle[:half].max(), angle[half:].min(), angle[half:].max()))
                ranges += [(a, a + half), (a + half, b)]
            vantage.append(point)
            at += 1
        return cls(np.stack(vantage), np.array(left, np.int32), np.array(near)), order

    def angles(self, asked: np.ndarray) -> np.ndarray:
        """Angles of unit vectors to all vantage points."""
        return np.arccos(np.clip(asked @ self.vantage.T, -1, 1))

    def reach(self, asked: np.ndarray, limit: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs that may hold a point within `limit` of a query."""
        angles = self.angles(asked)
        query, node, bound = np.arange(len(asked)), np.zeros(len(asked), np.int64), np.zeros(len(asked))
        queries, leaves = [], []
        while len(query):
            ends = self.left[node] < 0
            queries.append(query[ends])
            leaves.append(node[ends])
            query, node, bound = query[~ends], node[~ends], bound[~ends]
            angle = angles[query, node][:, None]
            near = self.near[node]
            # how far the query is at least from either child's ring
            ring = np.maximum(np.maximum(near[:, ::2] - angle, angle - near[:, 1::2]), bound[:, None])
            query, node, bound = np.repeat(query, 2), np.stack([self.left[node], self.left[node] + 1], 1).ravel(), ring.ravel()
            stays = factor * bound <= limit[query] + SLACK
            query, node, bound = query[stays], node[stays], bound[stays]
        return np.concatenate(queries), np.concatenate(leaves)

    def home(self, asked: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into: at every node the child whose ring is nearer, of both the first."""
        node, angles = np.zeros(len(asked), np.int64), self.angles(asked)
        while len(open_ := np.flatnonzero(self.left[node] >= 0)):
            at = node[open_]
            node[open_] = self.left[at] + self._side(at, angles[open_, at])
        return node

    def _side(self, node: np.ndarray, angle: np.ndarray) -> np.ndarray:
        return (angle > (self.near[node, 1] + self.near[node, 2]) / 2).astype(np.int64)

    def widened(self, low: np.ndarray, high: np.ndarray) -> VantageTree:
        """The same tree with rings as measured over more points than it was built on."""
        return VantageTree(self.vantage, self.left, np.stack([low[:, 0], high[:, 0], low[:, 1], high[:, 1]], 1))

    def path_angles(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node and child the least and largest angle of the vectors that fall into it; inf, -inf where none does."""
        low, high = np.full((len(self.left), 2), np.inf), np.full((len(self.left), 2), -np.inf)
        node, angles = np.zeros(len(asked), np.int64), self.angles(asked)
        while len(open_ := np.flatnonzero(self.left[node] >= 0)):
            at = node[open_]
            angle = angles[open_, at]
            side = self._side(at, angle)
            np.minimum.at(low, (at, side), angle)
            np.maximum.at(high, (at, side), angle)
            node[open_] = self.left[at] + side
        return low, high


class Piece:
    """A tree with its points: vectors in the tree's order, and the smallest ids of each."""

    def __init__(self, tree: VantageTree, vectors: np.ndarray, ids: np.ndarray, n_ids: np.ndarray):
        self.tree, self.vectors, self.ids, self.n_ids = tree, vectors, ids, n_ids
        self.first = np.cumsum(n_ids) - n_ids
        self.units = units(vectors)
        leaves = np.flatnonzero(tree.left < 0)
        leaves = leaves[np.argsort(-1 - tree.left[leaves], kind="stable")]
        self.span = np.zeros((len(tree.left), 2), np.int64)
        self.span[leaves, 0] = -1 - tree.left[leaves]
        self.span[leaves, 1] = np.append(self.span[leaves[1:], 0], len(vectors))
        self.looked = 0  # pairs of a query and a vector that were compared

    def search(self, asked: np.ndarray, least: np.ndarray, most: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): the `most` nearest rows of each query that score `least` or more; ties go to the smaller id."""
        unit = units(asked)
        home = self.tree.home(unit)
        first = self._near(unit, np.arange(len(asked)), home, least, most)
        known = self._best(asked, *first, most)
        # the score of the last of `most` rows, where there are as many
        full = np.bincount(known[0], minlength=len(asked)) >= most
        last = np.full(len(asked), np.inf)
        np.minimum.at(last, known[0], known[2])
        least = np.maximum(least, np.where(full, last, -2))
        query, leaf = self.tree.reach(unit, np.arccos(np.clip(least, -1, 1)), factor)
        other = leaf != home[query]
        more = self._near(unit, query[other], leaf[other], least, most)
        query, row = np.concatenate([first[0], more[0]]), np.concatenate([first[1], more[1]])
        found = self._best(asked, query, row, most)
        good = found[2] >= least[found[0]]
        return tuple(x[good] for x in found)

    def _near(self, unit: np.ndarray, query: np.ndarray, leaf: np.ndarray, least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of leaves that may be among a query's `most` best."""
        queries, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(leaf, kind="stable")
        query, leaf = query[order], leaf[order]
        cuts = np.append(np.flatnonzero(np.diff(leaf, prepend=-1)), len(leaf))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            low, high = self.span[leaf[a]]
            score = unit[query[a:b]] @ self.units[low:high].T
            self.looked += score.size
            floor = least[query[a:b]]
            if high - low > most:
                floor = np.maximum(floor, -np.partition(-score, most - 1, axis=1)[:, most - 1])
            i, j = np.nonzero(score >= floor[:, None] - SLACK)
            queries.append(query[a:b][i])
            rows.append(low + j)
        return np.concatenate(queries), np.concatenate(rows)

    def _best(self, asked: np.ndarray, query: np.ndarray, row: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = np.concatenate([cosines(asked[query[i : i + 65536]], self.vectors[row[i : i + 65536]]) for i in range(0, len(query), 65536)] or [np.zeros(0)])
        # the first rows lie within as many points, by score and smallest id
        keep = _leading(query, score, self.ids[self.first[row]], most)
        query, row, score = query[keep], row[keep], score[keep]
        n = self.n_ids[row].astype(np.int64)
        of = np.repeat(np.arange(len(row)), n)
        ids = self.ids[self.first[row][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
        keep = _leading(query[of], score[of], ids, most)
        return query[of][keep], ids[keep], score[of][keep]


def _leading(query: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best of each query, by score and then id."""
    order = np.lexsort((ids, -score, query))
    sorted_ = query[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < most]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for i in range(0, len(frame), ASKED):
            yield frame.iloc[i : i + ASKED]


def _wide(column, dims: int) -> np.ndarray:
    """A column of lists as a matrix."""
    return np.stack(list(column)) if len(column) else np.zeros((0, dims))


def points_of(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, hash, vector) of vectors that take part, and their dimensions; a shorter vector ends in zeros."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    dims = rows.agg(F.max(F.size("vector")).alias("d")).first()["d"] or 0
    number = kind[6:-1]
    padded = F.concat("vector", F.array_repeat(F.lit(0).cast(number), F.lit(dims) - F.size("vector")))
    # a negative zero is a zero
    rows = rows.select("vec_id", F.transform(padded, lambda x: x + F.lit(0).cast(number)).alias("vector"))
    return rows.select("vec_id", F.xxhash64("vector").alias("hash"), "vector"), dims


def distinct_points(rows: DataFrame, most: int) -> DataFrame:
    """(node, hash, vector, ids): each vector once, with its `most` smallest ids; written, for node numbers must stay."""
    w = Window.partitionBy("hash", "vector").orderBy("vec_id")
    # ranks above are dropped before the exchange, so a vector with very many copies sends a few rows
    few = rows.withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= most)
    points = few.groupBy("hash", "vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return materialize(points.withColumn("node", F.monotonically_increasing_id()), "points")


class Index:
    """Shards of trees over all points, as a written table; the tree over shards and the number of pieces of each shard are small."""

    def __init__(self, points: DataFrame, dims: int, piece: int = PIECE, sample: int = SAMPLE):
        self.points, self.dims = points, dims
        self.kind = "f4" if "float" in points.schema["vector"].dataType.simpleString() else "f8"
        piece, sample = max(4 * LEAF, piece // dims), max(PER_SHARD, sample // dims)
        n = points.count()
        shards = min(-(-n // piece), max(1, min(n, sample) // PER_SHARD))
        share = max(1, round(min(1.0, sample / max(n, 1)) * (1 << 20)))
        fitted = points.where(F.pmod(F.xxhash64("hash"), F.lit(1 << 20)) < share).select("vector").limit(2 * sample).collect() if shards > 1 else []
        fitted = units(np.array([r.vector for r in fitted], np.float64)) if fitted else np.eye(1, dims)
        # `turn` deals points out, as the sample says; `top` tells how far a shard reaches, which all points say
        self.turn, _ = VantageTree.build(fitted, -(-len(fitted) // shards))
        self.top = self._measured() if shards > 1 else self.turn
        counts = {r["shard"]: r["n"] for r in self._placed().groupBy("shard").agg(F.count("*").alias("n")).collect()}
        self.pieces = [max(1, -(-counts.get(i, 0) // piece)) for i in range(len(self.top.left))]
        self.trees = self._grow()

    def _measured(self) -> VantageTree:
        """The tree over shards with rings of all points: an entry for each node, side and task comes together."""
        top = self.turn

        def rings(batches):
            low, high = np.full((len(top.left), 2), np.inf), np.full((len(top.left), 2), -np.inf)
            for frame in _parts(batches):
                a, b = top.path_angles(units(_wide(frame["vector"], 0)))
                low, high = np.minimum(low, a), np.maximum(high, b)
            node, side = np.nonzero(high >= low)
            yield pd.DataFrame({"node": node, "side": side, "low": low[node, side], "high": high[node, side]})

        made = self.points.select("vector").mapInPandas(rings, "node int, side int, low double, high double")
        low, high = np.full((len(top.left), 2), np.inf), np.full((len(top.left), 2), -np.inf)
        for r in made.groupBy("node", "side").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            low[r["node"], r["side"]], high[r["node"], r["side"]] = r["low"], r["high"]
        return top.widened(low, high)

    def _placed(self) -> DataFrame:
        """Points with their shard."""
        turn = self.turn

        def place(batches):
            for frame in _parts(batches):
                yield frame.assign(shard=turn.home(units(_wide(frame["vector"], 0))).astype(np.int32))

        if len(turn.left) == 1:
            return self.points.select("node", "vector", "ids", F.lit(0).alias("shard"))
        kind = self.points.schema["vector"].dataType.simpleString()
        return self.points.select("node", "vector", "ids").mapInPandas(place, f"node bigint, vector {kind}, ids array<bigint>, shard int")

    def _grow(self) -> DataFrame:
        kind = self.kind

        def build(key, frame):
            values = _wide(frame["vector"], 0)
            tree, order = VantageTree.build(units(values), LEAF)
            ids = frame["ids"].to_numpy()[order]
            packed = [values[order].astype(kind), np.concatenate(ids).astype(np.int64), np.array([len(i) for i in ids], np.int32), tree.vantage, tree.left, tree.near]
            return pd.DataFrame([[*key, *[x.tobytes() for x in packed]]], columns=[c.split()[0] for c in TREE.split(", ")])

        pieces = F.element_at(F.lit(self.pieces), F.col("shard") + 1)
        dealt = self._placed().withColumn("piece", F.pmod(F.xxhash64("node"), pieces).cast("int"))
        return materialize(dealt.groupBy("shard", "piece").applyInPandas(build, TREE), "vantage-trees")

    def blocks(self, asked: DataFrame, factor: float) -> DataFrame:
        """Queries (node, vector, shard, least) for the pieces that they must search: without `least` all of their own shard, with it
        those of other shards that may hold a row of that score."""
        top, pieces, kind, columns = self.top, self.pieces, self.kind, [c.split()[0] for c in BLOCK.split(", ")]

        def pack(batches):
            for frame in _parts(batches):
                values = _wide(frame["vector"], 0).astype(kind)
                own, least = frame["shard"].to_numpy(np.int64), frame["least"].to_numpy(np.float64, na_value=np.nan)
                first = np.isnan(least)
                query, shard = np.flatnonzero(first), own[first]
                again = np.flatnonzero(~first)
                if len(again):
                    i, leaf = top.reach(units(values[again]), np.arccos(np.clip(least[again], -1, 1)), factor)
                    other = leaf != own[again][i]
                    query, shard = np.concatenate([query, again[i[other]]]), np.concatenate([shard, leaf[other]])
                least = np.where(first, -2, least)
                nodes = frame["node"].to_numpy(np.int64)
                out, size = [], 0
                for s in np.unique(shard):
                    part = query[shard == s]
                    packed = [nodes[part].tobytes(), values[part].tobytes(), least[part].tobytes()]
                    for p in range(pieces[s]):
                        out.append([s, p, *packed])
                        size += sum(map(len, packed))
                        if size >= BLOCK_BYTES:
                            yield pd.DataFrame(out, columns=columns)
                            out, size = [], 0
                yield pd.DataFrame(out, columns=columns)

        return asked.select("node", "vector", "shard", "least").mapInPandas(pack, BLOCK)

    def search(self, blocks: DataFrame, most: int, factor: float) -> DataFrame:
        """(node, vec_id, score): the `most` best rows of each query in each piece that it searches."""
        dims, kind = self.dims, self.kind

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    array = lambda c, t: np.frombuffer(at[c][i].as_buffer(), t)  # noqa: B023, E731
                    tree = VantageTree(array("vantage", "f8").reshape(-1, dims), array("left", "i4"), array("near", "f8").reshape(-1, 4))
                    found = Piece(tree, array("vectors", kind).reshape(-1, dims), array("ids", "i8"), array("n_ids", "i4")).search(array("asked", kind).reshape(-1, dims), array("least", "f8"), most, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(array("nodes", "i8")[found[0]]), pa.array(found[1]), pa.array(found[2])], ["node", "vec_id", "score"])

        # a piece is one row, so the join holds one tree at a time beside the blocks that stream past it.  A query goes to nearly every piece,
        # which Spark's estimate of the blocks, from the table of queries, does not tell: it would send them all through the driver
        joined = blocks.hint("merge").join(self.trees, ["shard", "piece"])
        return materialize(joined.mapInArrow(run, FOUND), "found")


def _best(df: DataFrame, by: list[str], most: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= most)


def nearest(vectors: DataFrame, asks: Column, k: int = 5, factor: float = FACTOR, piece: int = PIECE, sample: int = SAMPLE) -> DataFrame:
    """The `k` nearest rows of each row where `asks` holds, by cosine: query_id, rank, vec_id, score.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part.  A shorter vector
    counts as ending in zeros.  Rows with the query's id are its own.  Repeated rows count once; equal scores go to the smaller id.
    An empty table gives no rows; other columns are not read.
    """
    spark, most = vectors.sparkSession, k + 1
    rows, dims = points_of(vectors)
    if not dims:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    points = distinct_points(rows, most)
    index = Index(points, dims, piece, sample)
    queries = rows.where(asks).select(F.col("vec_id").alias("query_id"), "hash", "vector").join(points.select("hash", "vector", "node"), ["hash", "vector"]).select("query_id", "node").distinct()
    queries = materialize(queries, "queries")
    asked = index._placed().join(queries.select("node").distinct(), "node", "left_semi")
    asked = materialize(asked.select("node", "vector", "shard"), "asked")
    found = index.search(index.blocks(asked.withColumn("least", F.lit(None).cast("double")), factor), most, factor)
    found = _best(found, ["node"], most, "_n")
    if len(index.pieces) > 1:
        # where a query has all its rows already, the last one's score is what others must reach
        least = found.groupBy("node").agg(F.when(F.count("*") >= most, F.min("score")).otherwise(-2.0).alias("least"))
        more = index.search(index.blocks(asked.join(least, "node"), factor), most, factor)
        found = _best(found.drop("_n").unionByName(more), ["node"], most, "_n")
    # a query's own row is one of k + 1
    pairs = queries.join(found.drop("_n"), "node").where("query_id <> vec_id")
    return _best(pairs, ["query_id", "node"], k, "rank").select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_SUM = "list_reduce(list_transform(list_zip({0}, {1}), lambda x: x[1] * x[2]), lambda a, b: a + b)"
SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt({_SUM.format("e", "e")}) AS size FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id, {_SUM.format("q.e", "c.e")} / (q.size * c.size) AS score FROM n AS q JOIN n AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 5"""
