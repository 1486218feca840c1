"""Near duplicates among vectors by an inverted multi-index.

Each half of a unit vector has a codebook of its own; a pair of codewords is a cell of the product grid.  Every vector is
a member of its nearest cell and visits the cells nearest to it in the order of multi-sequence traversal: the two sorted
lists of distances to the codewords are merged through a heap, the smallest sum first.  How many cells are visited is
found at fitting time, on pairs with exactly the threshold's similarity, so that at least one side of a pair visits the
other's cell with the target recall.  Members that visitors meet are verified by their cosine in double precision.

Equal vectors take part once, with their number.  A cell with very many members or visitors is cut into chunks whose
pairs go to separate tasks.  A task returns counts of links per vector and the edges of a spanning forest, never pairs.  A pair that
both sides could find is counted where the smaller id visits.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components
from .vectors import matrix, one_per_id

#: Rows of the sample that codebooks and visits are fitted to, vectors in a cell aimed at, codewords of a half at most.
SAMPLE_ROWS, CELL_ROWS, CODEWORDS = 8_192, 64, 256
#: Members and visitors of a cell that meet in one task.
MEMBERS, VISITORS = 512, 2_048


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _distances(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ words.T + (words**2).sum(axis=1)[None]


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    words = points[np.sort(rng.choice(len(points), k, replace=False))]
    for _ in range(rounds):
        own = _distances(points, words).argmin(axis=1)
        sums = np.zeros_like(words)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=k)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def traverse(left: np.ndarray, right: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """The first cells (i, j) in the order of left[i] + right[j], by merging both sorted lists."""
    i_order, j_order = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, out = [(left[i_order[0]] + right[j_order[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, a, b = heapq.heappop(heap)
        out.append((int(i_order[a]), int(j_order[b])))
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(left) and y < len(right) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (left[i_order[x]] + right[j_order[y]], x, y))
    return out


@dataclass
class MultiIndex:
    """Codebooks of both halves, and how many cells a vector visits."""

    left: np.ndarray
    right: np.ndarray
    visits: int

    def cells(self, units: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The cells that each vector visits, its own first; shape (vectors, visits)."""
        visits = min(visits or self.visits, len(self.left) * len(self.right))
        half = self.left.shape[1]
        a, b = _distances(units[:, :half], self.left), _distances(units[:, half:], self.right)
        out = [[i * len(self.right) + j for i, j in traverse(x, y, visits)] for x, y in zip(a, b, strict=True)]
        return np.array(out, np.int64).reshape(len(units), visits)


def fit(sample: np.ndarray, rows: int, threshold: float, recall: float, seed: int = 7) -> MultiIndex:
    """Codebooks from a sample, sized for `rows` vectors, and the visits that give `recall` at the threshold."""
    rng = np.random.default_rng(seed)
    units = _unit(sample)
    half = max(1, units.shape[1] // 2)
    k = int(min(CODEWORDS, len(units), max(1, math.ceil(math.sqrt(rows / CELL_ROWS)))))
    index = MultiIndex(_kmeans(units[:, :half], k, rng), _kmeans(units[:, half:], k, rng), 1)
    probes = units[np.sort(rng.choice(len(units), min(len(units), 1_000), replace=False))]
    noise = rng.normal(size=probes.shape)
    noise -= (noise * probes).sum(axis=1, keepdims=True) * probes
    length = np.sqrt((noise**2).sum(axis=1, keepdims=True))
    partners = threshold * probes + math.sqrt(1 - threshold**2) * noise / np.maximum(length, 1e-12)

    def ranks(visitors: np.ndarray, members: np.ndarray) -> np.ndarray:
        a, b = _distances(visitors[:, :half], index.left), _distances(visitors[:, half:], index.right)
        i, j = _distances(members[:, :half], index.left).argmin(axis=1), _distances(members[:, half:], index.right).argmin(axis=1)
        at = np.arange(len(visitors))
        sums = a[:, :, None] + b[:, None, :]
        return (sums < (a[at, i] + b[at, j])[:, None, None]).sum(axis=(1, 2))

    parts = np.array_split(np.arange(len(probes)), max(1, len(probes) * k * k // 1_000_000))
    needed = np.concatenate([np.minimum(ranks(probes[p], partners[p]), ranks(partners[p], probes[p])) for p in parts])
    index.visits = int(np.sort(needed)[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1
    return index


def _visits(index: MultiIndex):
    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = index.cells(_unit(matrix(batch.column("vector")))) if batch.num_rows else np.zeros((0, 1), np.int64)
            flat = pa.array(cells.ravel())
            offsets = pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], [*batch.schema.names, "cells"])

    return visits


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links a-b, those that connect what isn't connected yet."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _verified(threshold: float):
    """Links between the members of a chunk of a cell and a chunk of its visitors."""

    def verify(members: pa.Table, visitors: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if members.num_rows and visitors.num_rows:
            m_id, v_id = members.column("id").to_numpy(), visitors.column("id").to_numpy()
            m_n, v_n = members.column("n").to_numpy(), visitors.column("n").to_numpy()
            v_own = visitors.column("own").to_numpy()
            near = _unit(matrix(visitors.column("vector"))) @ _unit(matrix(members.column("vector"))).T >= threshold
            near &= v_id[:, None] != m_id[None]
            v, m = np.nonzero(near)
            if len(v):
                # both would find it: the member visits the visitor's own cell as well
                member_cells = members.column("cells").combine_chunks()
                flat, width = member_cells.flatten().to_numpy(), len(member_cells[0])
                returned = (flat.reshape(-1, width)[m] == v_own[v][:, None]).any(axis=1)
                counted = ~returned | (v_id[v] < m_id[m])
                v, m = v[counted], m[counted]
                ids = np.concatenate([v_id, m_id])
                totals = np.concatenate([np.bincount(v, m_n[m], len(v_id)), np.bincount(m, v_n[v], len(m_id))]).astype(np.int64)
                some = totals > 0
                kept = np.array(_forest(v_id[v], m_id[m]), np.int64).reshape(-1, 2)
                out = [
                    np.concatenate([ids[some], kept[:, 0]]),
                    np.concatenate([np.full(some.sum(), -1), kept[:, 1]]),
                    np.concatenate([totals[some], np.zeros(len(kept), np.int64)]),
                ]
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("id", "other", "links"), out, strict=True)})

    return verify


def _chunk(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")


def near_duplicates(
    rows: DataFrame,
    threshold: float = 0.95,
    recall: float = 0.995,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    members: int = MEMBERS,
    visitors: int = VISITORS,
) -> DataFrame:
    """(id, n_links, component_id, kept): one row per id.

    Vectors link at a cosine of `threshold` or more.  `n_links` counts the other ids linked directly, `component_id` is the
    smallest id reachable by links, `kept` says whether that is the id itself.  Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different length with each other.  An id
    that comes more than once counts as its smallest usable vector; rows with a null id are left out.  An empty table gives no
    rows.  Other columns are ignored.
    """
    ids = rows.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    vectors = stored(one_per_id(rows, id_col, vector_col).withColumn("dims", F.size("vector")), "vectors")
    distinct = stored(vectors.groupBy("vector", "dims").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct")
    found = None
    for row in distinct.groupBy("dims").count().orderBy("dims").collect():  # one row per length of a vector
        part = _links(distinct.where(F.col("dims") == row["dims"]).drop("dims"), row["count"], threshold, recall, sample_rows, members, visitors)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return ids.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "links")
    links = found.where("other < 0").groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("other >= 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    told = (
        distinct.join(links, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    )
    told = stored(told, "classes")
    known = vectors.select("id", "vector").join(told, "vector").select("id", "n_links", "component_id")
    out = ids.join(known, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id") == F.col("component_id"))


def _links(distinct: DataFrame, count: int, threshold: float, recall: float, sample_rows: int, members: int, visitors: int) -> DataFrame:
    """(id, other, links): counts of links per id (other is -1), and edges id-other of spanning forests."""
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("id", "vector").toArrow().sort_by("id")
    index = fit(matrix(sample.column("vector")), count, threshold, recall)
    kind = distinct.schema["vector"].dataType.simpleString()
    placed = stored(distinct.select("id", "n", "vector").mapInArrow(_visits(index), f"id long, n long, vector {kind}, cells array<long>"), "cells")
    standing = placed.withColumn("cell", F.get("cells", F.lit(0)))
    fresh = [F.col(c).alias(c) for c in ("id", "n", "vector")]  # columns of their own, for the meeting below
    coming = placed.select(*fresh, F.get("cells", F.lit(0)).alias("own"), F.explode("cells").alias("cell"))
    there = standing.groupBy("cell").agg(F.count("*").alias("m"))
    sizes = stored(
        coming.groupBy("cell").agg(F.count("*").alias("v")).join(there, "cell")
        .select("cell", _chunk(F.col("m"), members).alias("m"), _chunk(F.col("v"), visitors).alias("v")), "sizes",
    )
    chunk = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    standing = standing.join(sizes, "cell").withColumn("mc", chunk(1, F.col("m"))).withColumn("vc", every("v")).drop("m", "v")
    coming = coming.join(sizes, "cell").withColumn("vc", chunk(2, F.col("v"))).withColumn("mc", every("m")).drop("m", "v")
    key = ["cell", "mc", "vc"]
    met = standing.groupBy(*key).cogroup(coming.groupBy(*key))
    return met.applyInArrow(_verified(threshold), "id long, other long, links long")
