"""Exact removal of repeated byte strings by a suffix sort that compares hashes.

A string of `length` bytes repeats if two suffixes that lie next to each other in sorted order share their first
`length` bytes.  The sort is done as follows.

* Sparse suffixes.  Every string of `length` bytes has an anchor: the leftmost of its `GRAM`-byte strings with the
  smallest hash.  Equal strings have equal anchors in the same place, so an *item*, an anchor with the strings it is
  the anchor of, only needs comparing with the items of an equal gram.  Items whose gram is the only one of its kind
  are dropped by a count; the others meet by the hash of their gram.
* Hash-compared mergesort.  Prefix polynomial hashes of a task's bytes give the hash of any substring in two reads,
  and a binary search over it the common extension of two suffixes, so a comparison takes a logarithmic number of
  steps whatever the suffixes share.  All suffixes at anchors are merged in runs of 1, 2, 4, ... at once.
* Induced order.  The suffixes that start one byte earlier are a stable sort of the former ones by that byte.  In each
  of these orders, neighbours with equal `length`-byte hashes are repeats.
* Collision verification.  The sorted order is checked on the bytes themselves, and so is every equal pair of
  neighbours.  If a check fails, the batch is done again on the bytes alone.

Hot grams.  A gram with more than `GROUP` items is no group for one task.  Its items are first collapsed where they
are equal as a whole (all their strings repeat then, and one item stands for the rest), and what is left is cut into
items of fewer strings each, which share a longer core to meet by: all strings of an item hold its core.  After three
cuts an item is one string, and the core is that string; a count of these needs no sort.  Keys of such items are two
independent hashes (128 bits).  Texts that are equal as a whole are collapsed at the start, by 120 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.session import fresh_dir

from .common import stored

LENGTH = 200
#: Bytes that an anchor holds.
GRAM = 48
#: Items of one gram that a task sorts; more are cut.
GROUP = 1_024
#: Bytes that are hashed at a time; longer texts are hashed in overlapping parts.
PART = 1 << 18
#: Items that are sorted at a time, and those of the last group.
BATCH = 4_096
#: Items that a hot item is cut into at most.
CUT = 9
SEEDS = (11, 12)

#: What tells texts apart: 120 bits of their SHA-256.
_TEXT = ["h1", "h2"]


@lru_cache(maxsize=4)
def _table(seed: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    """A random value for each byte, an odd base and its inverse modulo 2^64."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 1 << 62)) * 2 + 1
    return rng.integers(0, 1 << 63, 256, np.uint64), np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(seed: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse below 2^bits."""
    found = []
    for base in _table(seed)[1:]:
        out = np.ones(1 << bits, np.uint64)
        for b in range(bits):
            half = 1 << b
            out[half : 2 * half] = out[:half] * np.multiply(out[half - 1 : half], base)
        found.append(out)
    return found[0], found[1]


class Prefixes:
    """Prefix polynomial hashes modulo 2^64: the hash of any substring from two of them."""

    def __init__(self, data: np.ndarray, seed: int = SEEDS[0]):
        powers, self.inverse = _powers(seed, max(18, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_table(seed)[0][data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.inverse[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the low bits, which are the weak ones of these hashes."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` consecutive values."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    rows = full.reshape(-1, width)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, anchor, low, high) of every item of texts that lie one after another and end at `ends`.

    The item's strings start at anchor-high .. anchor-low.
    """
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    hashes = Prefixes(data)
    grams = mixed(hashes.of(np.arange(len(data) - gram + 1), gram))
    place = np.uint64((1 << max(1, int(len(data)).bit_length())) - 1)
    low_bits = np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_min((grams & ~place) | low_bits, length - gram + 1) & place).astype(np.int64)
    # strings that reach beyond the end of their text are none
    text = np.searchsorted(ends, np.arange(len(at)), side="right")
    inside = np.arange(len(at)) + length <= ends[text]
    first = np.flatnonzero(inside & np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    last = np.flatnonzero(inside & np.r_[(at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~inside[1:], True])
    anchor = at[first]
    return grams[anchor], anchor, anchor - last, anchor - first


class _Suffixes:
    """Suffixes from `start` to `end` of some bytes, sorted within their groups."""

    def __init__(self, data: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.group, self.start, self.end = data, group, start, end
        self.hashes = Prefixes(data)
        self.padded = np.r_[data, np.uint8(0)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search over equal hashes."""
        p, q = self.start[a], self.start[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.end[a] - p, self.end[b] - q)
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes.of(p, middle) == self.hashes.of(q, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: whether suffix a comes before, with or after b."""
        shared = self.common(a, b)
        p, q = self.start[a] + shared, self.start[b] + shared
        x = np.where(p < self.end[a], self.padded[p].astype(np.int16), -1)
        y = np.where(q < self.end[b], self.padded[q].astype(np.int16), -1)
        return np.sign(x - y)

    def sorted(self) -> np.ndarray:
        """Indices in sorted order; `group` rises, and every group keeps its place."""
        n = len(self.group)
        order = np.arange(n)
        begin = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[begin, n])
        base, count = np.repeat(begin, size), np.repeat(size, size)
        inside = np.arange(n) - base
        run = 1
        while run < int(size.max(initial=0)):
            left = (inside // run) % 2 == 0
            other = (inside // run + np.where(left, 1, -1)) * run
            moving = np.flatnonzero(other < count)  # the others have no run to merge with
            low = base[moving] + other[moving]
            high = np.minimum(low + run, base[moving] + count[moving])
            zero, mine, is_left = low.copy(), order[moving], left[moving]
            open_ = np.arange(len(moving))
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                sign = self.after(order[middle], mine[open_])
                smaller = (sign < 0) | ((sign == 0) & ~is_left[open_])
                low[open_], high[open_] = np.where(smaller, middle + 1, low[open_]), np.where(smaller, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            first = np.where(is_left, moving - inside[moving] % run, zero)
            merged = order.copy()
            merged[first + inside[moving] % run + (low - zero)] = mine
            order = merged
            run *= 2
        return order

    def in_order(self, order: np.ndarray) -> bool:
        """Whether neighbours are in order by their bytes."""
        a, b = order[:-1], order[1:]
        pairs = np.flatnonzero(self.group[a] == self.group[b])
        a, b = a[pairs], b[pairs]
        shared = self.common(a, b)
        return same_bytes(self.data, self.start[a], self.start[b], shared) and bool((self.after(a, b) <= 0).all())


def same_bytes(data: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray) -> bool:
    """Whether all pairs of substrings are equal, byte by byte."""
    for at in range(0, len(p), 4_096):
        width = np.arange(int(size[at : at + 4_096].max(initial=0)))
        x, y = p[at : at + 4_096, None] + width, q[at : at + 4_096, None] + width
        wanted = width < size[at : at + 4_096, None]
        last = len(data) - 1
        if not ((data[np.minimum(x, last)] == data[np.minimum(y, last)]) | ~wanted).all():
            return False
    return True


def repeats(data: np.ndarray, group: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance before its anchor at which each item has a repeated string (-1: none).

    `group` rises; items of one group lie anywhere in `data`, with all bytes that their strings cover.
    """
    suffixes = _Suffixes(data, group, anchor, anchor - low + length)
    order = suffixes.sorted()
    if not suffixes.in_order(order):
        return repeats_by_bytes(data, group, anchor, low, high, length)
    n = len(anchor)
    least, most = np.full(n, -1), np.full(n, -1)
    partner, seen = np.full(n, -1), np.full(n, -2)
    for d in range(int(high.max(initial=-1)) + 1):
        order = order[high[order] >= d]
        if d:
            order = order[np.argsort(data[anchor[order] - d], kind="stable")]
        have = order[low[order] <= d]
        hashes = suffixes.hashes.of(anchor[have] - d, length)
        equal = np.flatnonzero(hashes[1:] == hashes[:-1])
        a, b = have[equal], have[equal + 1]
        new = np.flatnonzero((partner[a] != b) | (seen[a] != d - 1) | (data[anchor[a] - d] != data[anchor[b] - d]))
        if not same_bytes(data, anchor[a[new]] - d, anchor[b[new]] - d, np.full(len(new), length)):
            return repeats_by_bytes(data, group, anchor, low, high, length)
        partner[a], seen[a] = b, d
        found = np.r_[a, b]
        most[found] = d
        least[found] = np.where(least[found] < 0, d, least[found])
    return least, most


def repeats_by_bytes(data: np.ndarray, group: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes, for batches in which two strings share a hash."""
    whole, places = data.tobytes(), {}
    for i in range(len(anchor)):
        for d in range(low[i], high[i] + 1):
            places.setdefault(whole[anchor[i] - d : anchor[i] - d + length], []).append((i, d))
    least, most = np.full(len(anchor), -1), np.full(len(anchor), -1)
    for found in places.values():
        for i, d in found if len(found) > 1 else ():
            least[i] = d if least[i] < 0 else min(least[i], d)
            most[i] = max(most[i], d)
    return least, most


def _parts(texts: Sequence[np.ndarray], length: int, most: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Bytes to hash at a time, and (text, where it starts in them, how much of it comes before) of what they hold.

    Long texts come in parts that share all but one byte of a string: a string is in one part only.
    """
    held, found, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), most):
            part = text[at : at + most + length - 1]
            if size and size + len(part) > most:
                yield np.concatenate(held), found
                held, found, size = [], [], 0
            found.append((i, size, at))
            held.append(part)
            size += len(part)
    if held:
        yield np.concatenate(held), found


def _bytes(column: pa.Array) -> list[np.ndarray]:
    """Views of the values of a binary column."""
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _packed(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return anchor << 24 | low << 12 | high


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, place >> 12 & 0xFFF, place & 0xFFF


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _items(length: int, gram: int, most: int):
    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(c).to_numpy() for c in _TEXT]
            for data, found in _parts(_bytes(batch.column("text")), length, most):
                which, start, before = np.array(found).T
                key, anchor, low, high = anchors(data, np.r_[start[1:], len(data)], length, gram)
                at = np.searchsorted(start, anchor - high, side="right") - 1
                place = _packed(anchor - start[at] + before[at], low, high)
                yield _batch({"key": key, **{c: t[which[at]] for c, t in zip(_TEXT, texts, strict=True)}, "place": place})

    return items


def _listed(batch: pa.RecordBatch, name: str) -> tuple[pa.StructArray, np.ndarray]:
    """All structs of a column of lists, and which row each comes from."""
    lists = batch.column(name)
    size = np.diff(np.asarray(lists.offsets))
    return lists.flatten(), np.repeat(np.arange(len(lists)), size)


def _slices(length: int):
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column("text"))
            items, row = _listed(batch, "items")
            key, place = (items.field(n).to_numpy(zero_copy_only=False) for n in ("key", "place"))
            anchor, low, high = _unpacked(place)
            for at in range(0, len(row), BATCH):
                some = slice(at, at + BATCH)
                cut = [texts[r][a:b].tobytes() for r, a, b in zip(row[some].tolist(), (anchor - high)[some].tolist(), (anchor - low + length)[some].tolist(), strict=True)]
                own = {c: batch.column(c).to_numpy()[row[some]] for c in _TEXT}
                yield _batch({"key": key[some], **own, "place": place[some], "bytes": pa.array(cut, pa.binary())})

    return slices


def _sorted_repeats(length: int):
    """Spans of the repeated strings of items that come in the order of their keys."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        part = table.combine_chunks().to_batches()[0]
        anchor, low, high = _unpacked(part.column("place").to_numpy())
        cut = _bytes(part.column("bytes"))
        size = np.array([len(c) for c in cut])
        least, most = repeats(np.concatenate(cut), part.column("key").to_numpy(), np.cumsum(size) - size + high, low, high, length)
        hit = np.flatnonzero(most >= 0)
        own = {c: part.column(c).to_numpy()[hit] for c in _TEXT}
        return _batch({**own, "start": (anchor - most)[hit], "end": (anchor - least + length)[hit]})

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) < BATCH:
                continue
            table = pa.Table.from_batches(waiting)
            keys = table.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if whole:
                yield spans(table.slice(0, whole))
            waiting = table.slice(whole).to_batches()
        if sum(map(len, waiting)):
            yield spans(pa.Table.from_batches(waiting))

    return sort


def _cuts(length: int, width: int):
    """Hash of all bytes of hot items of at most `width` strings, and the keys of the items they are cut into."""
    step = -(-width // CUT)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column("text"))
            items, row = _listed(batch, "items")
            key, place = (items.field(n).to_numpy(zero_copy_only=False) for n in ("key", "place"))
            anchor, low, high = _unpacked(place)
            for at in range(0, len(row), BATCH):
                some = slice(at, at + BATCH)
                a, l, h = anchor[some], low[some], high[some]
                pieces = [texts[r][x:y] for r, x, y in zip(row[some].tolist(), (a - h).tolist(), (a - l + length).tolist(), strict=True)]
                size = np.array([len(p) for p in pieces])
                begin = np.cumsum(size) - size
                data = np.concatenate(pieces)
                hashes, others = (Prefixes(data, s) for s in SEEDS)
                whole = mixed(others.of(begin, size)) + h.astype(np.uint64)
                number, first = -(-width // step), begin + h
                keys = np.zeros((len(a), number), np.int64)
                for t in range(number):
                    top = min(width, (t + 1) * step) - 1
                    have = (l <= top) & (h >= t * step)
                    core = mixed(hashes.of(first[have] - t * step, length - top + t * step)) ^ mixed(np.uint64([width * 4_096 + t]))
                    keys[have, t] = core.view(np.int64)
                # alike items of one text are one row
                alike = np.lexsort((place[some], whole, key[some], row[some]))
                same = [c[alike][1:] == c[alike][:-1] for c in (whole, key[some], row[some])]
                begins = np.flatnonzero(np.r_[True, ~np.logical_and.reduce(same)])
                one = alike[begins]
                places = pa.ListArray.from_arrays(np.r_[begins, len(alike)].astype(np.int32), pa.array(place[some][alike]))
                lists = pa.ListArray.from_arrays(np.arange(0, len(one) * number + 1, number, dtype=np.int32), pa.array(keys[one].ravel()))
                own = {c: batch.column(c).to_numpy()[row[some][one]] for c in _TEXT}
                yield _batch({"key": key[some][one], "whole": whole[one], **own, "places": places, "cuts": lists})

    return cuts


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text: spans are merged, those of texts with copies are the whole text."""
    for batch in batches:
        columns: list[list] = [[], [], []]
        for text, copies, spans in zip(_bytes(batch.column("text")), batch.column("copies").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            runs = merged([(0, len(text))] if copies > 1 else [(s["start"], s["end"]) for s in spans])
            left = hashlib.sha256()
            at = 0
            for start, end in [*runs, (len(text), len(text))]:
                left.update(text[at:start])
                at = end
            for column, value in zip(columns, ([{"start": s, "end": e} for s, e in runs], sum(e - s for s, e in runs), left.hexdigest()), strict=True):
                column.append(value)
        kinds = [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in _TEXT), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*_TEXT, "spans", "n_removed", "kept_sha256"]
        )


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover; touching ones become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _bucketed(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """`df` written in buckets to the shared folder: joins on `by` read it without a shuffle."""
    spark = df.sparkSession
    table = f"rillstone_{name}_{uuid.uuid4().hex}"
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(number, *by).option("path", fresh_dir(spark, name)).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def _free(spark) -> None:
    """Let go of shuffle files of steps whose results are stored."""
    spark._jvm.System.gc()


def _with_texts(texts: DataFrame, rows: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """The texts with a list of their rows."""
    return texts.join(rows.groupBy(*_TEXT).agg(F.collect_list(F.struct(*columns)).alias(name)), _TEXT)


def _span(length: int):
    """The bytes that all strings of an item cover."""

    def span(place: Column) -> Column:
        anchor, low, high = F.call_function("shiftright", place, F.lit(24)), F.call_function("shiftright", place, F.lit(12)).bitwiseAND(4_095), place.bitwiseAND(4_095)
        return F.struct((anchor - high).alias("start"), (anchor - low + length).alias("end"))

    return span


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, part: int = PART) -> DataFrame:
    """Per row of `docs`: id, n_bytes, n_removed, spans (start, end of maximal runs of bytes to remove), kept_sha256.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in this row or another.  Texts
    are UTF-8, null texts are empty, strings never cross rows.  Rows that repeat, ids too, are rows of their own, so
    each removes the others whole if they are long enough.  Other columns are not looked at.  An empty table gives none.
    """
    if not 1 <= gram <= length < 4_096:
        raise ValueError("an anchor can't be longer than the strings, nor these longer than 4,095 bytes")
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary"))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.sha2(text, 256).alias("sha256"))
    parts = [F.conv(F.substring("sha256", 1 + 15 * i, 15), 16, 10).cast("long").alias(c) for i, c in enumerate(_TEXT)]
    rows = stored(read.select("id", *parts, F.octet_length("text").cast("long").alias("n_bytes"), "sha256"), "rows")
    long = read.where(F.octet_length("text") >= length).select(*parts, "text")
    texts = _bucketed(long.groupBy(*_TEXT).agg(F.first("text").alias("text"), F.count("*").alias("copies")), _TEXT, "texts")
    _free(spark)

    key_schema = "key long, h1 long, h2 long, place long"
    span_schema = "h1 long, h2 long, start long, end long"
    items = stored(texts.select(*_TEXT, "text").mapInArrow(_items(length, gram, part), key_schema), "items")
    width, cool, spans = length - gram + 1, None, []
    while True:
        counts = stored(items.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
        met = stored(items.join(counts, "key").withColumn("hot", F.col("n") > group).drop("n"), "candidates")
        _free(spark)
        some = met.where("NOT hot").drop("hot")
        cool = some if cool is None else cool.unionByName(some)
        hot = met.where("hot").drop("hot")
        if hot.isEmpty():
            break
        step = -(-width // CUT)
        schema = "key long, whole long, h1 long, h2 long, places array<long>, cuts array<long>"
        cut = stored(_with_texts(texts.drop("copies"), hot, ["key", "place"], "items").mapInArrow(_cuts(length, width), schema), "hot")
        first = F.min(F.struct("h1", "h2", F.col("places")[0].alias("place"), "cuts")).alias("one")
        classes = stored(cut.groupBy("key", "whole").agg(F.sum(F.size("places")).alias("n"), first), "classes")
        alike = cut.drop("cuts").join(classes.where("n > 1").select("key", "whole"), ["key", "whole"])
        spans.append(stored(alike.select(*_TEXT, F.transform("places", _span(length)).alias("spans")), "spans"))
        low, high = F.expr("place >> 12 & 4095"), F.expr("place & 4095")
        # one of each class is cut; `place` of a part counts from its own anchor
        less = classes.select("one.*").select(*_TEXT, "place", F.posexplode("cuts").alias("t", "key")).withColumn("back", F.col("t") * step)
        less = less.withColumn("low", F.greatest(low - F.col("back"), F.lit(0))).withColumn("high", F.least(high - F.col("back"), F.lit(step - 1)))
        less = less.where((F.col("high") >= 0) & (F.col("low") <= step - 1))
        place = F.expr("((place >> 24) - back) << 24 | cast(low AS long) << 12 | cast(high AS long)")
        items = stored(less.select("key", *_TEXT, place.alias("place")), "items")
        width = step
        _free(spark)

    item_schema = f"{key_schema}, bytes binary"
    cut = _with_texts(texts.drop("copies"), cool, ["key", "place"], "items").mapInArrow(_slices(length), item_schema)
    dealt = cut.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    sorted_spans = dealt.mapInArrow(_sorted_repeats(length), span_schema)
    spans.append(stored(sorted_spans.select(*_TEXT, F.array(F.struct("start", "end")).alias("spans")), "spans"))
    _free(spark)
    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    listed = found.groupBy(*_TEXT).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    hit = texts.join(listed, _TEXT, "left").where("copies > 1 OR spans IS NOT NULL")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    hit = hit.select(*_TEXT, "text", "copies", F.coalesce("spans", none).alias("spans"))
    kept = stored(hit.mapInArrow(_kept, "h1 long, h2 long, spans array<struct<start: bigint, end: bigint>>, n_removed long, kept_sha256 string"), "kept")
    return rows.join(kept, _TEXT, "left").select(
        "id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def removed(text: Column, spans: Column) -> Column:
    """The bytes of `text` outside of `spans`, as `repeated` gives them."""
    data = F.coalesce(text.cast("binary"), F.lit("").cast("binary"))
    edges = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))), spans)
    following = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(data).cast("long")))
    gaps = F.zip_with(edges, following, lambda e, n: F.substring(data, (e["end"] + 1).cast("int"), (n - e["end"]).cast("int")))
    return F.aggregate(gaps, F.lit("").cast("binary"), lambda a, b: F.concat(a, b))
