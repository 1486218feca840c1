"""Grouping of spelling variants: words of a vocabulary that differ by one code point.

Bit-sliced position index.  For a block of words there is one bitset per position and letter, with a bit for every
word that has the letter there.  A word is looked up by walking over its letters once, with four bitsets:

    zero     words equal so far
    replaced words with one other letter so far
    longer   words with one more letter so far (read one position ahead)
    shorter  words with one letter less so far (read one position behind)

Each step is a few ANDs and ORs over all words of the block at once.

Blocks.  Of two words with one edit, the shorter c code points long, the first or the last c // 2 are the same.  So
words meet by that prefix and by that suffix, among those of c and c + 1 code points; what both find counts once.  A
block with more than `BLOCK` words is cut into a grid of index parts and query parts, so no task holds more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
#: One of so many (document, word) pairs loses a code point.
SLIP = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: Words of an index part.
BLOCK = 1 << 14
#: Distinct words that a task counts before it passes them on.
HELD = 200_000


def slipped(doc_id: str, word: str, slip: int = SLIP) -> str:
    """The word, without one code point if the checksum of document and word says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % slip:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counts(slip: int, least_length: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
                # bytes.lower() changes A-Z alone
                lowered = (text.as_py() or b"").lower().decode("utf-8", "replace")
                name = doc.as_py() or ""
                for word, n in Counter(RUNS.findall(lowered)).items():
                    if len(word) >= least_length:
                        word = slipped(name, word, slip)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    return counts


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; null texts hold none, null ids are empty."""
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    counted = texts.mapInArrow(_counts(slip, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class PositionIndex:
    """One bitset per position and letter over some words."""

    def __init__(self, words: list[str]):
        self.words = words
        self.at: dict[tuple[int, str], int] = {}
        self.length: dict[int, int] = {}
        rows: dict[tuple[int, str], list[int]] = {}
        for i, word in enumerate(words):
            for place in enumerate(word):
                rows.setdefault(place, []).append(i)
            self.length.setdefault(len(word), 0)
        size = len(words) // 8 + 1
        for place, members in rows.items():
            data = bytearray(size)
            for i in members:
                data[i >> 3] |= 1 << (i & 7)
            self.at[place] = int.from_bytes(data, "little")
        for length in self.length:
            data = bytearray(size)
            for i, word in enumerate(words):
                if len(word) == length:
                    data[i >> 3] |= 1 << (i & 7)
            self.length[length] = int.from_bytes(data, "little")
        self.all = (1 << len(words)) - 1

    def near(self, word: str) -> list[int]:
        """Indices of the words that differ by exactly one inserted, deleted or replaced code point."""
        zero, replaced, longer, shorter = self.all, 0, 0, 0
        for i, letter in enumerate(word):
            same = self.at.get((i, letter), 0)
            ahead = self.at.get((i + 1, letter), 0)
            behind = self.at.get((i - 1, letter), 0) if i else 0
            shorter = shorter & behind | zero
            longer = (longer | zero) & ahead
            replaced = replaced & same | zero & ~same
            zero &= same
        n, of = len(word), self.length
        found = replaced & of.get(n, 0) | (longer | zero) & of.get(n + 1, 0) | shorter & of.get(n - 1, 0)
        out = []
        while found:
            low = found & -found
            out.append(low.bit_length() - 1)
            found ^= low
        return out


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block knows of its words: number of near ones, and the best one with its count."""
    members: list[tuple] = []
    block = None
    names = ["word", "near", "best_n", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def solved() -> pa.RecordBatch:
        ends, short = block[0], block[1]
        index = [(w, n) for w, n, role in members if role & 1]
        queries = [(w, n) for w, n, role in members if role & 2 and len(w) == short]
        found: dict[str, list] = {}

        def meet(word: str, other: str, n: int) -> None:
            known = found.setdefault(word, [0, 0, ""])
            known[0] += 1
            if (-n, other) < (-known[1], known[2]):
                known[1:] = n, other

        half = short // 2
        bits = PositionIndex([w for w, _ in index])
        for word, n in queries:
            for i in bits.near(word):
                other, other_n = index[i]
                if ends == "s" and word[:half] == other[:half]:
                    continue  # they meet by their prefix too
                if len(other) == short:
                    meet(word, other, other_n)  # the other one asks itself
                elif len(other) > short:
                    meet(word, other, other_n)
                    meet(other, word, n)
        rows = [(w, *v) for w, v in found.items()]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("ends", "short", "key", "part", "other", "word", "n", "role")]
        for *at, word, n, role in zip(*columns, strict=True):
            if at != block:
                if block is not None:
                    yield solved()
                block, members = at, []
            members.append((word, n, role))
    if block is not None:
        yield solved()


def variants(words: DataFrame, block: int = BLOCK, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) of stored words of at least two code points, each once, with their counts.

    `form` is the near word of largest count (of equal ones the first in code-point order) if that is at least `times`
    the word's own, else null.
    """
    size = F.length("word")
    lengths = F.array(size, size - 1)
    placed = words.select("word", "n", F.explode(lengths).alias("short")).where("short >= 1")
    keys = F.array(
        F.struct(F.lit("p").alias("ends"), F.expr("left(word, cast(floor(short / 2) AS int))").alias("key")),
        F.struct(F.lit("s").alias("ends"), F.expr("right(word, cast(floor(short / 2) AS int))").alias("key")),
    )
    by = ["ends", "short", "key"]
    members = placed.select("word", "n", "short", F.explode(keys).alias("at")).select("word", "n", "short", "at.*")
    sizes = members.groupBy(*by).agg(F.count("*").alias("size")).where(F.col("size") > block)
    full = stored(sizes.select(*by, F.ceil(F.col("size") / block).cast("int").alias("grid")), "blocks")
    at = F.pmod(F.xxhash64("word"), F.col("grid")).cast("int")
    every = F.sequence(F.lit(0), F.col("grid") - 1)
    as_index = F.transform(every, lambda o: F.struct(at.alias("part"), o.alias("other"), F.lit(1).alias("role")))
    as_query = F.transform(every, lambda o: F.struct(o.alias("part"), at.alias("other"), F.lit(2).alias("role")))
    both = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("other"), F.lit(3).alias("role")))
    # words that are too long to ask are only in the index
    cells = F.when(F.col("grid").isNull(), both).when(F.length("word") == F.col("short"), F.concat(as_index, as_query)).otherwise(as_index)
    gridded = members.join(full, by, "left").select(*by, "word", "n", F.explode(cells).alias("cell")).select(*by, "cell.part", "cell.other", "word", "n", "cell.role")
    cell = [*by, "part", "other"]
    dealt = gridded.repartition(*cell).sortWithinPartitions(*cell)
    found = dealt.select(*cell, "word", "n", "role").mapInArrow(_variants, "word string, near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )


def rooted(forms: DataFrame) -> DataFrame:
    """`forms` with `root`: the last word that forms lead to from a word, itself if it has none.

    Counts grow along forms, so there are no cycles and few steps; each round doubles the steps taken.
    """
    links = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Words of whole texts with the form that each is a variant of: word, form, root, n, n_near, form_n.

    Words are maximal runs of Latin letters, A-Z in lower case, with the slips that `slipped` makes, of at least six
    code points and five occurrences.  Null and empty texts hold none, null ids count as empty, repeated rows count each
    time, other columns are not looked at.  An empty table gives no rows.
    """
    words = stored(vocabulary(docs, id_col, text_col), "words")
    return rooted(stored(variants(words, block), "variants")).select("word", "form", "root", "n", "n_near", "form_n")
