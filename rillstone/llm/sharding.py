"""Shards of bounded size by extendible hashing.

Documents hash to a string of bits.  A bucket is a prefix of bits; one that holds more bytes than a shard may is split on
its next bit, others stay, so shards have prefixes of different lengths.  The directory is indexed by a fixed number of leading
bits and names the shard of each index; an index whose bucket is still too large has a directory of its own on the
following bits.  What can't be split by bits any more (one id many times, or a document larger than a shard) is cut in
the order of a stored serial number.

Only bytes per directory index are aggregated, before any shuffle of rows, and the work per round is one grouped sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, stored

#: Bits of the hash, bits that a directory is indexed by, bytes of a shard.
HASH_BITS, INDEX_BITS, SHARD_BYTES = 60, 12, 1 << 20


def hash_bits(id_: Column) -> Column:
    """The first 60 bits of the md5 of the id as text; a null id hashes like an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(value: Column | str, have: int, want: Column | int) -> Column:
    """The first `want` of `have` bits."""
    by = F.lit(have) - want
    return F.call_function("shiftright", F.col(value) if isinstance(value, str) else value, by.cast("int"))


def _directory(bytes_at: DataFrame, known: int, bits: int, shard_bytes: int) -> DataFrame:
    """(index, depth): for each index of known + bits bits, the length of its shard's prefix; null if none is small enough.

    `bytes_at` has (index, bytes) of indexes below prefixes of `known` bits that are too large.
    """
    depths = F.explode(F.sequence(F.lit(known), F.lit(known + bits)))
    nodes = bytes_at.withColumn("depth", depths).withColumn("node", _prefix("index", known + bits, F.col("depth")))
    fits = nodes.groupBy("depth", "node").agg(F.sum("bytes").alias("held")).where(F.col("held") <= shard_bytes)
    placed = nodes.join(fits, ["depth", "node"]).groupBy("index").agg(F.min("depth").alias("depth"))
    return bytes_at.select("index").join(placed, "index", "left")


def sharded(docs: DataFrame, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", index_bits: int = INDEX_BITS, serial_col: str | None = None) -> DataFrame:
    """(id, serial, bytes, depth, shard): one row per row of `docs`; `serial_col` names a column of distinct numbers to take.

    `shard` is the prefix of the shard as ones and zeros (empty if all fits into one), followed by a dash and a number where
    a full hash had to be cut.  `bytes` is the UTF-8 length of the text, 0 if null.  Shards hold at most `shard_bytes`, but
    for a single document that is larger: it is alone in its shard.  Empty shards don't appear.  Repeated rows are
    rows of their own.  An empty table gives no rows.  Other columns are ignored.
    """
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.col(serial_col) if serial_col else F.monotonically_increasing_id()).alias("serial"),
            F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"),
            hash_bits(F.col(id_col)).alias("hash"),
        ),
        "shard-sizes",
    )
    parts, left, known = [], sized, 0
    while known < HASH_BITS:
        bits = min(index_bits, HASH_BITS - known)
        indexed = left.withColumn("index", _prefix("hash", HASH_BITS, F.lit(known + bits)))
        sums = stored(indexed.groupBy("index").agg(F.sum("bytes").alias("bytes")), "shard-sums")
        directory = stored(_directory(sums, known, bits, shard_bytes), "directory")
        told = indexed.join(directory, "index")
        parts.append(told.where(F.col("depth").isNotNull()))
        known += bits
        if directory.where(F.col("depth").isNull()).isEmpty():
            left = None
            break
        left = stored(told.where(F.col("depth").isNull()).select("id", "serial", "bytes", "hash"), "oversized")
    label = F.when(F.col("depth") == 0, "").otherwise(
        F.lpad(F.bin(_prefix("hash", HASH_BITS, F.col("depth"))), F.col("depth"), F.lit("0"))
    )
    out = None
    for part in parts:
        rows = part.select("id", "serial", "bytes", "depth", label.alias("shard"))
        out = rows if out is None else out.unionByName(rows)
    if left is not None:
        out = out.unionByName(_cut(left, shard_bytes))
    return out


def _cut(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """Rows of equal hashes that don't fit into a shard, cut in the order of their serial numbers.

    Each stored file's range of serial numbers is summed first, so that a hash with very many rows is laid end to end without
    being in one task.  A place on that line names the shard: rows that begin within the same `shard_bytes` of the line and
    don't cross its end are together, and a row that crosses an end is a shard of its own.
    """
    block = F.call_function("shiftright", F.col("serial"), F.lit(33)) * 1_000_000 + F.floor(
        F.col("serial").bitwiseAND((1 << 33) - 1) / 4_096
    )
    rows = rows.withColumn("__block", block)
    sums = rows.groupBy("hash", "__block").agg(F.sum("bytes").alias("sum"))
    before = Window.partitionBy("hash").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("hash", "__block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("hash", "__block").orderBy("serial").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("at", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(stored(starts, "shard-blocks"), ["hash", "__block"])
    begin = F.col("start") + F.col("at")
    end = F.greatest(begin, begin + F.col("bytes") - 1)
    slot = F.floor(begin / shard_bytes)
    crossing = F.floor(end / shard_bytes) > slot
    name = F.concat(F.lpad(F.bin("hash"), HASH_BITS, "0"), F.lit("-"), slot, F.when(crossing, F.concat(F.lit("+"), F.col("serial"))).otherwise(""))
    return laid.select("id", "serial", "bytes", F.lit(HASH_BITS).alias("depth"), name.alias("shard"))


def write_sharded(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write `docs` with one folder of Parquet per shard; repeated rows and ids and null ids are rows of their own.

    Rows get a serial number in a stored table first, so that each finds its own shard again.
    """
    rows, names = plain(docs)
    numbered = stored(rows.withColumn("serial", F.monotonically_increasing_id()), "numbered")
    placed = sharded(numbered, shard_bytes, names[id_col], names[text_col], serial_col="serial").select("serial", F.concat(F.lit("bits-"), "shard").alias("__shard"))
    joined = numbered.join(placed, "serial").select(*[F.col(c).alias(n) for n, c in names.items()], "__shard")
    joined.repartition("__shard").write.partitionBy("__shard").parquet(path)
