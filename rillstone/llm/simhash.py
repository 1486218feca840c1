"""SimHash near duplicates found through pigeonring filtering.

A fingerprint is a ring of three segments (22, 21 and 21 bits).  If two fingerprints differ in at most four bits,
then from some segment on the differences of one, two and three consecutive segments stay within the budgets
floor(4 * length / 3) = 1, 2 and 4.  The search looks for such chains:

* Chains of two segments (42 or 43 bits) that differ in at most two bits meet in a key: each fingerprint emits
  its chain as it is and with each single bit flipped, from each of the three segments.
* Whatever meets in a key must pass the budgets of the chain, segment by segment, before the full Hamming check.
* Only distinct fingerprints take part.  A task emits the edges of a spanning forest per key, never all pairs.
* A key that too many fingerprints could share is known beforehand from the counts of unflipped chains.  Its
  members are keyed by the remaining bits as well, flipped so often that at most two flips are spent in all:
  two fingerprints that meet there are at most four bits apart without any comparison, and each pair within
  four bits has such a midpoint.  That way is exact, linear, and has no group to hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, row_key, stored
from .graph import components

MAX_BITS = 4
#: Segments of the ring, low bits first.
SEGMENTS = (22, 21, 21)
#: A chain with this many fingerprints sends the keys around it down the way for dense keys.
DENSE_CHAIN = 128
#: Words whose shingles are hashed at a time.
BLOCK = 100_000


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The SimHash of the shingles of `width` words, as an unsigned number; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for begin in range(0, count, BLOCK):
        end = min(count, begin + BLOCK)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(begin, end)),
            np.uint64,
            end - begin,
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(text.as_py()) for text in batch.column("__text")]
        signed = np.array(prints, np.uint64).view(np.int64)
        kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "__text"]
        names = [name for name in batch.schema.names if name != "__text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(signed, pa.int64())], [*names, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp) of every row; `key` is a hash of the whole row, `fp` the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), row_key(docs).alias("key"), F.col(text_col).cast("binary").alias("__text")
    )
    return rows.mapInArrow(_fingerprints, f"id {kind}, key long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _chains() -> list[tuple[int, int, int]]:
    """(number, rotation, bits) of the chain of two segments from each segment on."""
    out, rotation = [], 0
    for i, bits in enumerate(SEGMENTS):
        out.append((i, rotation, bits + SEGMENTS[(i + 1) % len(SEGMENTS)]))
        rotation += bits
    return out


def _rotated(fp: str, by: str) -> str:
    return f"(shiftrightunsigned({fp}, {by}) | IF({by} = 0, 0L, shiftleft({fp}, 64 - {by})))"


def _keys(distinct: DataFrame, flips: bool) -> DataFrame:
    """(fp, chain, key, flipped): the chains of each fingerprint, as they are or also with one bit flipped."""
    parts = [
        f"named_struct('chain', {i}, 'by', {by}, 'mask', {(1 << bits) - 1}L, 'flip', {flip}L)"
        for i, by, bits in _chains()
        for flip in [0, *((1 << b for b in range(bits)) if flips else ())]
    ]
    return (
        distinct.select("fp", F.explode(F.expr(f"array({', '.join(parts)})")).alias("c"))
        .select("fp", "c.chain", "c.by", "c.flip", "c.mask")
        .select(
            "fp",
            # the number of the chain stands above its 43 bits
            F.expr(f"(({_rotated('fp', 'by')} & mask) ^ flip) | shiftleft(CAST(chain AS BIGINT), 44)").alias("key"),
            F.expr("flip <> 0").alias("flipped"),
        )
    )


def _within(left: np.ndarray, right: np.ndarray, chain: np.ndarray | int) -> np.ndarray:
    """Chain budgets first (one segment: 1, two: 2), then the whole distance."""
    diff = np.bitwise_xor(left, right)
    per = []
    low = 0
    for bits in SEGMENTS:
        per.append(np.bitwise_count((diff >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int16))
        low += bits
    per = np.stack(per)
    at = np.arange(per.shape[1])
    first = per[chain, at]
    second = per[(chain + 1) % len(SEGMENTS), at]
    n = len(SEGMENTS)
    passed = (first <= MAX_BITS // n) & (first + second <= MAX_BITS * 2 // n)
    passed[passed] = np.bitwise_count(diff[passed]) <= MAX_BITS
    return passed


def _forest(prints: np.ndarray, chain: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest among fingerprints that share a key."""
    rest = np.arange(1, len(prints))
    front = [0]
    while len(rest):
        if not front:
            front, rest = [int(rest[0])], rest[1:]
            continue
        at = front.pop()
        near = _within(np.broadcast_to(prints[at], rest.shape), prints[rest], np.full(rest.shape, chain))
        for other in rest[near]:
            yield at, int(other)
        front.extend(int(x) for x in rest[near])
        rest = rest[~near]


def _links_of_runs(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole runs of equal keys."""
    unsigned = prints.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    chain = (keys >> 44).astype(np.int64)
    pairs = starts[sizes == 2]
    linked = pairs[_within(unsigned[pairs], unsigned[pairs + 1], chain[pairs])] if len(pairs) else pairs
    left, right = [linked], [linked + 1]
    for begin, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        found = np.array(list(_forest(unsigned[begin : begin + size], int(chain[begin]))), np.int64).reshape(-1, 2)
        left.append(found[:, 0] + begin)
        right.append(found[:, 1] + begin)
    return prints[np.concatenate(left)], prints[np.concatenate(right)]


def _key_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last run of a batch waits for the next one."""
    held_keys, held_prints = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = _links_of_runs(keys, prints)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
        prints = np.concatenate([held_prints, batch.column("fp").to_numpy()])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield out(keys[:cut], prints[:cut])
        held_keys, held_prints = keys[cut:], prints[cut:]
    if len(held_keys):
        yield out(held_keys, held_prints)


def _dense_links(hot: DataFrame) -> DataFrame:
    """Links among the members (fp, key, flipped) of dense keys, by midpoints of the remaining bits."""
    widest = max(SEGMENTS)
    once = [0, *(1 << i for i in range(widest))]
    twice = once + [(1 << i) | (1 << j) for i in range(widest) for j in range(i)]
    array = lambda masks: f"array({', '.join(f'{m}L' for m in masks)})"
    by = "CASE shiftright(key, 44) " + " ".join(f"WHEN {i} THEN {by}" for i, by, _ in _chains()) + " END"
    bits = "CASE shiftright(key, 44) " + " ".join(f"WHEN {i} THEN {bits}" for i, _, bits in _chains()) + " END"
    rest = hot.withColumns({"by": F.expr(by), "bits": F.expr(bits)}).select(
        "fp", "key", "flipped", F.expr(f"shiftrightunsigned({_rotated('fp', 'by')}, bits)").alias("rest")
    )
    midpoints = rest.select(
        "fp", "key", "rest", F.explode(F.expr(f"IF(flipped, {array(once)}, {array(twice)})")).alias("flip")
    ).select("fp", "key", F.expr("rest ^ flip").alias("point"))
    # fewer than 2,100 distinct fingerprints lie within two bits of a point, so these windows are small
    hub = F.min("fp").over(Window.partitionBy("key", "point"))
    return midpoints.select("fp", hub.alias("hub")).where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def links(distinct: DataFrame, dense_chain: int = DENSE_CHAIN) -> DataFrame:
    """(a, b): links among distinct fingerprints with the components of all pairs within four bits."""
    keyed = _keys(distinct, flips=True)
    dense = stored(
        _keys(distinct, flips=False).groupBy("key").count().where(F.col("count") >= dense_chain).select("key"), "dense"
    )
    if dense.isEmpty():
        cold, out = keyed, None
    else:
        flips = [f"IF(shiftright(key, 44) = {i} AND {b} < {bits}, {1 << b}L, 0L)" for i, _, bits in _chains() for b in range(bits)]
        around = dense.select(F.explode(F.expr(f"array_distinct(array(key, {', '.join(f'key ^ {x}' for x in flips)}))")).alias("key")).distinct()
        cold = keyed.join(around, "key", "left_anti")
        out = _dense_links(keyed.join(around, "key", "left_semi"))
    cold = cold.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = cold.mapInArrow(_key_links, "a long, b long")
    return found if out is None else found.unionByName(out)


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense_chain: int = DENSE_CHAIN) -> DataFrame:
    """(id, key, fp, class_fp, component_id) of every row of `docs`.

    Rows whose fingerprints link, directly or through others, share `class_fp`, and `component_id` is the
    smallest id among them.  A null or empty text has fingerprint zero and links like any other.  Repeated rows
    and ids stay separate rows of one class.  A null id is never the smallest; a class of null ids alone has a
    null `component_id`.  An empty table gives no rows.  Other columns only enter `key`, a hash of the row.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    found = components(links(prints.select("fp").distinct(), dense_chain))
    # fingerprints without links are their own class
    classed = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "id", "key", "fp", F.coalesce("root", "fp").alias("class_fp")
    )
    # written, so that the join below reads plain shuffles on both sides and a class of very many rows is split
    smallest = stored(classed.groupBy("class_fp").agg(F.min("id").alias("component_id")), "smallest")
    return classed.join(smallest, "class_fp").select("id", "key", "fp", "class_fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near duplicates, with the columns of `docs`.

    The row with the smallest id stays; null ids come last, and among rows of one id the smallest row hash
    decides.  Of identical rows one stays.
    """
    docs, names = plain(docs)
    id_col, text_col = names[id_col], names[text_col]
    classes = stored(simhash_classes(docs, id_col, text_col), "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "key")).alias("first")
    chosen = classes.groupBy("class_fp").agg(first).select(F.col("first.id").alias("__id"), F.col("first.key").alias("__key"))
    keyed = docs.withColumn("__key", row_key(docs))
    kept = keyed.join(chosen.withColumnRenamed("__key", "__first"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__first")), "left_semi")
    repeated = classes.groupBy("id", "key").count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([id_col, "__key"])
    return kept.select(*docs.columns).toDF(*names)
