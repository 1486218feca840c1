"""Best-fit packing by minimum bin slack.

Documents become token ids, longer ones are cut, and the pieces fill sequences of a fixed number of tokens.  Pieces
of one length are interchangeable, so the packing is decided on the counts per length, of which there are at most
as many as a sequence has tokens, however many documents there are:

* Per bin, the longest length that is left is set, and a subset-sum over a bitset finds the fullest combination of
  the remaining lengths that fits.  It is removed as often as the counts allow; then the next one is sought.
* Every piece gets a number among the pieces of its length, counted in blocks of bounded size so that a very common
  length is spread over many tasks.  The number says which bin, and where in it.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key, stored

MAX_TOKENS = 1024
#: Pieces of one length that are numbered together.
BLOCK_ROWS = 1_024
#: Fixed value: how byte-level BPE cuts texts before it merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text on which both ways have to agree.
PROBE = "It's 10  o'clock,\n\n über\u3000日本 \U0001f600 <|endoftext|> \t x"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Encoder:
    """Ids of a byte-level BPE of the `tokenizers` library as little-endian unsigned 32-bit numbers.

    The vocabulary and merges come from the file.  `tiktoken` applies the same ones several times faster; what it can't
    encode, texts that hold an added token of the file, and files it reads differently, go to the library itself.  With
    `literal`, added tokens are encoded as the text they are.
    """

    def __init__(self, path: str, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = None if literal or not special else re.compile("|".join(map(re.escape, special)))
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.quick = None
        # a normalizer could make an added token of other text
        if all(c in letters for token in vocabulary for c in token) and (literal or self.tokenizer.normalizer is None):
            ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
            quick = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            if quick.encode_ordinary(PROBE) == self._slow(PROBE):
                self.quick = quick
        self.tokenizer.encode_special_tokens = literal

    def _slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return np.asarray(self._slow(text), "<u4").tobytes()
        try:
            ids = self.quick.encode_to_numpy(text, disallowed_special=()) if self.quick else self._slow(text)
        except (ValueError, RuntimeError):  # its pattern engine gave up
            ids = self._slow(text)
        return np.asarray(ids, "<u4").tobytes()


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole ones at the end, the first may be shorter."""
    first = length % most or most
    return [(0, first), *((start, most) for start in range(first, length, most))] if length > most else [(0, length)]


def _pieces(path: str, end_id: int, most: int, keep_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, literal=False)
        end = np.array([end_id], "<u4").tobytes()
        serial = 0
        for batch in batches:
            rows, columns = [], [[] for _ in range(6)]
            for row, text in enumerate(batch.column("__text")):
                ids = encoder.encode((text.as_py() or b"").decode("utf-8", "replace")) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, most)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append(row)
                    for column, value in zip(columns, (piece, start, length, zlib.crc32(part), serial, part), strict=True):
                        column.append(value)
                    serial += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["piece", "start", "length", "ids_crc32", "__serial", "ids"]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            kept = [n for n in batch.schema.names if n != "__text"]
            source = pa.array(rows, pa.int64())
            number = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(source) for n in kept), *arrays[:number]], [*kept, *names[:number]])

    return pieces


def pieces(docs: DataFrame, tokenizer: str, keep: Sequence[str], text_col: str = "text", end_id: int = 2, most: int = MAX_TOKENS, keep_ids: bool = False) -> DataFrame:
    """One row per piece: the columns `keep`, piece, start, length, ids_crc32, and the ids as bytes if asked for."""
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], row_key(docs).alias("__key"), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    added = "__key long, piece int, start long, length long, ids_crc32 long, __serial long" + (", ids binary" if keep_ids else "")
    schema = T.StructType([*(docs.schema[k] for k in keep), *T.StructType.fromDDL(added)])
    return rows.mapInArrow(_pieces(tokenizer, end_id, most, keep_ids), schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths of a combination with the largest sum up to `room`, longer ones first; each at most as often as counted."""
    stages: list[tuple[int, int]] = []  # (length, sums reachable before it)
    reach, mask = 1, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            grown = (reach | (reach << length)) & mask
            if grown == reach:
                break
            stages.append((length, reach))
            reach = grown
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, []
    for length, before in reversed(stages):
        if not before >> total & 1:
            taken.append(length)
            total -= length
    return taken[::-1]


def patterns(counts: dict[int, int], most: int = MAX_TOKENS) -> list[tuple[list[int], int]]:
    """(lengths of one bin, number of such bins), until all pieces are placed."""
    left = {length: n for length, n in counts.items() if n}
    out = []
    while left:
        first = max(left)
        left[first] -= 1
        lengths = [first, *fullest({k: n for k, n in left.items() if n}, most - first)]
        left[first] += 1
        need = {length: lengths.count(length) for length in set(lengths)}
        times = min(left[length] // n for length, n in need.items())
        out.append((lengths, times))
        for length, n in need.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return out


def _slots(plan: list[tuple[list[int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length, in order of the numbers of its pieces: (first number, pieces in a bin, first bin, place in the bin)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    bins = 0
    for lengths, times in plan:
        place = 0
        for length in sorted(set(lengths), reverse=True):
            n = lengths.count(length)
            out.setdefault(length, []).append((used.get(length, 0), n, bins, place))
            used[length] = used.get(length, 0) + n * times
            place += n * length
        bins += times
    return out


def _placed(slots: dict[int, list[tuple[int, int, int, int]]]):
    firsts = {length: [s[0] for s in rows] for length, rows in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, places = [], []
            for length, number in zip(batch.column("length").to_pylist(), batch.column("__number").to_pylist(), strict=True):
                first, n, begin, place = slots[length][bisect.bisect_right(firsts[length], number) - 1]
                bin_, slot = divmod(number - first, n)
                bins.append(begin + bin_)
                places.append(place + slot * length)
            kept = [n for n in batch.schema.names if n != "__number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(bins, pa.int64()), pa.array(places, pa.int64())], [*kept, "sequence_id", "offset"]
            )

    return place


def packed(
    docs: DataFrame,
    tokenizer: str,
    keep: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    end_id: int = 2,
    most: int = MAX_TOKENS,
    keep_ids: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; sequences hold at most `most` tokens, without gaps.

    Each text's ids end with `end_id`; null and empty texts are that id alone.  Only documents of more than `most`
    ids are cut.  Repeated rows and ids are packed row by row.  The columns `keep` go along unchanged, nulls too
    (they must not be named like the columns that are added).  An empty table gives no rows.  `keep_ids` adds the
    ids of each piece as little-endian unsigned 32-bit numbers.
    """
    table = stored(pieces(docs, tokenizer, keep, text_col, end_id, most, keep_ids), "pieces")
    # at most one row per possible length
    counts = {row["length"]: row["count"] for row in table.groupBy("length").count().collect()}
    blocks = F.array(*[F.lit(max(1, -(-counts.get(length, 0) // block_rows))) for length in range(most + 1)])
    table = table.withColumn(
        "__block", F.pmod(F.xxhash64("__key", "piece", "__serial"), F.element_at(blocks, (F.col("length") + 1).cast("int"))).cast("int")
    )
    sizes = table.groupBy("length", "__block").count()
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sizes.select("length", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")), "blocks")
    inside = Window.partitionBy("length", "__block").orderBy("__key", "piece", "__serial", "ids_crc32")
    kept = [*(f"`{k}`" for k in keep), "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    numbered = table.withColumn("__inside", F.row_number().over(inside)).join(starts, ["length", "__block"])
    numbered = numbered.select(*kept, (F.col("__before") + F.col("__inside") - 1).alias("__number"))
    schema = T.StructType([*(f for f in numbered.schema if f.name != "__number"), *T.StructType.fromDDL("sequence_id long, offset long")])
    return numbered.mapInArrow(_placed(_slots(patterns(counts, most))), schema)
