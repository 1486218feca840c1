"""Whitening of vectors from an exact scatter matrix, counted on bit slices.

Components become integers.  Per dimension they are shifted by the smallest one, and bit b of the shifted values of
many rows is packed into words, 64 rows in each.  The sum of products of two dimensions is then

    sum over bits a, b of 2^(a + b) * popcount(plane a of one AND plane b of the other),

exact for any number of rows, since the popcounts of all tasks are added as integers.  The scatter is centred as an
integer too, n * sum(x y) - sum(x) * sum(y), and only its quotient by n^2 becomes a double before `eigh`.

What reaches the driver are four numbers per dimension and one or a few per pair of dimensions, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Integers are kept within this distance of zero, so that differences fit a word.
MOST = 1 << 62
#: Rows that are packed into bit planes at a time.
ROWS = 1 << 16
#: Bits of one weight band: popcounts of a band are added up as one decimal.
BAND = 40


def whole(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(True)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _integers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    return np.clip(scaled, -float(MOST - (1 << 20)), float(MOST - (1 << 20))).astype(np.int64) + OFFSET


def _ranges(dims: int):
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _integers(batch, dims)
            columns = [np.arange(dims), np.full(dims, len(x)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["dim", "n", "high", "low", "least", "most"])

    return ranges


def planes(shifted: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of the columns, one after another: a row of words for each bit of each column."""
    n = len(shifted)
    out = np.zeros((sum(bits), -(-n // 64) * 8), np.uint8)
    at = 0
    for d, width in enumerate(bits):
        for b in range(width):
            packed = np.packbits((shifted[:, d] >> np.uint64(b) & np.uint64(1)).astype(np.uint8))
            out[at, : len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def _products(dims: int, least: list[int], bits: list[int]):
    """Popcounts of the pairs of planes of a task, added up by the pair of dimensions and the weight of the pair of bits."""
    owner = np.repeat(np.arange(dims), bits)
    weight = np.concatenate([np.arange(b) for b in bits]) if sum(bits) else np.zeros(0, np.int64)
    weights = 2 * max(bits, default=0) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims, weights), np.int64)
        held: list[np.ndarray] = []

        def add(x: np.ndarray) -> None:
            words = planes((x - np.array(least)).astype(np.uint64), bits)
            for p in range(len(words)):
                found = np.bitwise_count(words[p:] & words[p]).sum(axis=1, dtype=np.int64)
                # bits of one dimension come twice in its square
                found[1:] *= np.where(owner[p + 1 :] == owner[p], 2, 1)
                np.add.at(total, (owner[p], owner[p:], weight[p] + weight[p:]), found)

        for batch in batches:
            held.append(_integers(batch, dims))
            if sum(map(len, held)) >= ROWS:
                add(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            add(np.concatenate(held))
        i, j, w = np.nonzero(total)
        columns = [i, j, w, total[i, j, w]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["i", "j", "weight", "count"])

    return products


@dataclass(frozen=True)
class Whitening:
    """Integer sums of `n` rows, and the unit eigenvectors of their covariance with the largest eigenvalues."""

    n: int
    sums: tuple[int, ...]
    least: tuple[int, ...]
    most: tuple[int, ...]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one column for each
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Whether a component's variance is more than rounding."""
        return self.values > self.trace * len(self.sums) * np.finfo(float).eps

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, as integers of any size."""
        if self._span() < MOST:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def _span(self) -> int:
        return max((max(abs(self.n * e - s), abs(self.n * e), abs(s)) for s, *ends in zip(self.sums, self.least, self.most, strict=True) for e in ends), default=0)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sums of squares; null where they don't fit a long."""
        if centred.dtype != object and self._span() ** 2 * len(self.sums) < 1 << 63:
            return (centred * centred).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in centred)]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; nan where there is no variance."""
        scale = np.where(self.usable, np.sqrt(np.where(self.usable, self.values, 1)), np.nan)
        return centred.astype(np.float64) / self.n @ self.vectors / scale


def solved(n: int, sums: list[int], least: list[int], most: list[int], products: dict[tuple[int, int], int], components: int) -> Whitening:
    """`products` holds the sums of products of the values shifted by `least`, i <= j."""
    dims = len(sums)
    shifted = [s - n * m for s, m in zip(sums, least, strict=True)]
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            covariance[i, j] = covariance[j, i] = (n * products.get((i, j), 0) - shifted[i] * shifted[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return Whitening(n, tuple(sums), tuple(least), tuple(most), values, vectors * np.where(lead < 0, -1, 1), float(np.trace(covariance)))


def taken(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vector) of the rows that take part, stored, and the dimensions they have."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    kept = rows.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector")).where(whole(F.col("vector")) & (F.size("vector") > 0))
    sizes = kept.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = sizes[0]["dims"] if sizes else 0
    return stored(kept.where(F.size("vector") == dims), "vectors"), dims


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of stored vectors of `dims` components."""
    schema = "dim long, n long, high long, low long, least long, most long"
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    ranges = vectors.select("vector").mapInArrow(_ranges(dims), schema).groupBy("dim")
    found = sorted(ranges.agg(total("n"), total("high"), total("low"), F.min("least").alias("least"), F.max("most").alias("most")).collect())
    n = int(found[0]["n"])
    sums = [(int(r["high"]) << 32) + int(r["low"]) for r in found]
    least, most = [r["least"] for r in found], [r["most"] for r in found]
    bits = [(b - a).bit_length() for a, b in zip(least, most, strict=True)]
    counted = vectors.select("vector").mapInArrow(_products(dims, least, bits), "i long, j long, weight long, count long")
    band = F.floor(F.col("weight") / BAND)
    power = F.lit(1).cast("decimal(20,0)") * F.pow(F.lit(2.0), F.col("weight") % BAND).cast("decimal(14,0)")
    value = (F.col("count").cast("decimal(20,0)") * power.cast("decimal(14,0)")).cast("decimal(38,0)")
    products: dict[tuple[int, int], int] = {}
    for r in counted.groupBy("i", "j", band.alias("band")).agg(F.sum(value).alias("value")).toLocalIterator():
        products[r["i"], r["j"]] = products.get((r["i"], r["j"]), 0) + (int(r["value"]) << (BAND * r["band"]))
    return solved(n, sums, least, most, products, components)


def _moments(model: Whitening, dims: int):
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.values)
        for batch in batches:
            w = np.nan_to_num(model.whitened(model.centred(_integers(batch, dims))))
            i, j = np.triu_indices(size)
            columns = [np.r_[np.full(size, -1), i], np.r_[np.arange(size), j], np.r_[w.sum(axis=0), (w.T @ w)[i, j]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "value"])

    return moments


def identity_error(vectors: DataFrame, dims: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured on all rows."""
    sums = vectors.select("vector").mapInArrow(_moments(model, dims), "i long, j long, value double")
    found = {(r["i"], r["j"]): r["value"] / model.n for r in sums.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    usable = np.flatnonzero(model.usable).tolist()
    return max((abs(found[i, j] - found[-1, i] * found[-1, j] - (i == j)) for i in usable for j in usable if i <= j), default=0.0)


def _projected(model: Whitening, dims: int, error: float):
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.values)
        explained = pa.array((model.values / model.trace).tolist() if model.trace > 0 else [None] * size, pa.float64())
        for batch in batches:
            centred = model.centred(_integers(batch, dims))
            row = pa.array(np.repeat(np.arange(len(batch)), size))
            number = pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(batch)))
            whitened = pa.array(model.whitened(centred).ravel(), from_pandas=True)
            every = len(row)
            arrays = [
                batch.column("id").take(row),
                number,
                pa.array(np.full(every, model.n)),
                pa.array(model.deviations(centred), pa.int64()).take(row),
                whitened,
                explained.take(pa.array(np.tile(np.arange(size), len(batch)))),
                pa.array(np.full(every, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return projected


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each vector's whitened components: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty or hold null or non-finite components are left out, and of the rest those that don't
    have the most common number of components (the larger of equally common ones).  Repeated rows and ids count each
    time; null ids stay null.  Components beyond +-2^62 / 1024 count as that.  A component without variance has a null `whitened`,
    and all have a null `explained` if no dimension has any; a `deviation` that doesn't fit a long is null.  Vectors of
    fewer dimensions than `components` have as many components as dimensions.  An empty table gives no rows.
    """
    vectors, dims = taken(rows, id_col, vector_col)
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return rows.sparkSession.createDataFrame([], schema)
    model = fit(vectors, dims, components)
    error = identity_error(vectors, dims, model)
    return vectors.mapInArrow(_projected(model, dims, error), schema)
