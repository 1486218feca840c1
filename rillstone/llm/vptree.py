"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt into shards of bounded size by a hash of their id; a shard's tree is built once and written.  A node
holds a vantage point and, for each of its two halves, the range of distances from that point.  By the triangle
inequality a half can be skipped if a query's distance from the point lies outside its range by more than the
query's tenth best distance; `factor` times the gap is compared, so factors over one skip more, and one is exact.
Queries come to every shard in waves of bounded size and go down a tree together; the best of every shard meet in a
window per query.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix, one_per_id

SHARD_ROWS, WAVE_ROWS, LEAF = 8_192, 4_096, 64
#: Distances are rounded; bounds give way by this share.
SLACK = 1e-9


class Tree:
    """Vectors in tree order; nodes are (first, last, vantage, [(node, low, high), ...]) over ranges of that order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors, self.leaf = ids.copy(), vectors.copy(), leaf
        self.root = self._build(0, len(ids)) if len(ids) else None

    def _build(self, first: int, last: int):
        if last - first <= self.leaf:
            return (first, last, None, ())
        own = self.vectors[first:last]
        far = ((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()
        distance = np.sqrt(((own - own[far]) ** 2).sum(axis=1))
        distance[far] = -1  # the vantage point comes first
        order = np.argsort(distance, kind="stable")
        self.vectors[first:last], self.ids[first:last] = own[order], self.ids[first:last][order]
        distance = distance[order]
        middle = (last - first + 1) // 2
        halves = []
        for a, b in ((1, middle), (middle, last - first)):
            low, high = float(distance[a]), float(distance[b - 1])
            halves.append((self._build(first + a, first + b), low, high))
        return (first, last, first, tuple(halves))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids), each of shape (queries, k), nearest first; infinity and -1 where there are fewer."""
        n = len(queries)
        self.query_ids, self.queries, self.k, self.factor = query_ids, queries, k, factor
        self.bound = np.full(n, np.inf)
        if self.root is None or not n:
            return np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        self._clear()
        self._descend(self.root, np.arange(n))
        self.bound = self.distances[:, -1].copy()  # from the nearest leaf alone
        self._clear()
        self._visit(self.root, np.arange(n))
        return self.distances, self.found

    def _clear(self) -> None:
        self.distances = np.full((len(self.queries), self.k), np.inf)
        self.found = np.full((len(self.queries), self.k), -1, np.int64)

    def _offer(self, active: np.ndarray, first: int, last: int) -> np.ndarray:
        """Take the vectors of a range into account; their distances from the active queries."""
        distance = np.concatenate(
            [
                np.sqrt(((self.queries[part][:, None, :] - self.vectors[None, first:last]) ** 2).sum(axis=2))
                for part in np.array_split(active, max(1, len(active) * (last - first) // 20_000))
            ]
        )
        ids = np.broadcast_to(self.ids[first:last], distance.shape)
        offered = np.where(ids == self.query_ids[active][:, None], np.inf, distance)
        better = (offered <= self.distances[active, -1:]).any(axis=1)
        rows = active[better]
        if len(rows):
            all_distances = np.concatenate([self.distances[rows], offered[better]], axis=1)
            all_ids = np.concatenate([self.found[rows], ids[better]], axis=1)
            order = np.lexsort((all_ids, all_distances), axis=1)[:, : self.k]
            self.distances[rows] = np.take_along_axis(all_distances, order, axis=1)
            self.found[rows] = np.where(np.isinf(self.distances[rows]), -1, np.take_along_axis(all_ids, order, axis=1))
            self.bound[rows] = np.minimum(self.bound[rows], self.distances[rows, -1])
        return distance

    def _descend(self, node, active: np.ndarray) -> None:
        first, last, vantage, halves = node
        if not len(active):
            return
        if vantage is None:
            self._offer(active, first, last)
            return
        distance = self._offer(active, vantage, vantage + 1)[:, 0]
        inner = distance <= (halves[0][2] + halves[1][1]) / 2
        self._descend(halves[0][0], active[inner])
        self._descend(halves[1][0], active[~inner])

    def _visit(self, node, active: np.ndarray) -> None:
        first, last, vantage, halves = node
        if vantage is None:
            self._offer(active, first, last)
            return
        distance = self._offer(active, vantage, vantage + 1)[:, 0]
        for half, low, high in halves:
            gap = np.maximum(0, np.maximum(low - distance, distance - high))
            near = gap * self.factor <= self.bound[active] * (1 + SLACK) + SLACK
            if near.any():
                self._visit(half, active[near])


def _packed_tree(table: pa.Table) -> pa.Table:
    """The tree of a shard as one row."""
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    tree = Tree(table.column("id").to_numpy(), matrix(table.column("vector")))
    nodes = pickle.dumps((tree.ids, tree.vectors, tree.leaf, tree.root))
    return pa.table({"shard": table.column("shard").slice(0, 1), "dims": table.column("dims").slice(0, 1), "tree": pa.array([nodes], pa.binary())})


def trees(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, dims, tree) of (id, vector) rows, written to the shared folder; vectors of different length never meet."""
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.withColumn("dims", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    built = dealt.groupBy("shard", "dims").applyInArrow(_packed_tree, "shard int, dims int, tree binary")
    return stored(built, "trees")


def _searched(k: int, factor: float):
    def search(tree_table: pa.Table, query_table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if tree_table.num_rows and query_table.num_rows:
            ids, vectors, leaf, root = pickle.loads(tree_table.column("tree")[0].as_py())
            tree = Tree.__new__(Tree)
            tree.ids, tree.vectors, tree.leaf, tree.root = ids, vectors, leaf, root
            query_ids = query_table.column("id").to_numpy()
            distances, found = tree.search(query_ids, matrix(query_table.column("vector")), k, factor)
            real = ~np.isinf(distances)
            out = {"query_id": np.repeat(query_ids, k)[real.ravel()], "vec_id": found[real], "score": distances[real]}
        return pa.table({n: pa.array(v, pa.float64() if n == "score" else pa.int64()) for n, v in out.items()})

    return search


def nearest(
    rows: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    factor: float = 1.0,
    shard_rows: int = SHARD_ROWS,
    wave_rows: int = WAVE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other vectors of each query by Euclidean distance.

    `is_query` is a condition on the column `id`.  Ties go to the smaller id.  Null ids, and vectors that are null, empty,
    zero or hold null or non-finite components, take no part; an id that comes more than once counts as its smallest
    vector; vectors of another length are no candidates.  With fewer than k candidates all are returned, with none
    (or an empty table) nothing.  Other columns are ignored.
    """
    vectors = stored(one_per_id(rows, id_col, vector_col), "ids")
    index = trees(vectors, shard_rows)
    queries = vectors.where(is_query).withColumn("dims", F.size("vector"))
    waves = max(1, -(-queries.count() // wave_rows))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    sent = queries.withColumn("wave", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(waves)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    standing = index.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    key = ["shard", "dims", "wave"]
    found = standing.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_searched(k, factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
