"""Spelling variants: words one letter apart, and the frequent word that a rare one stands for.

Two words are near when they differ by one inserted, deleted or replaced letter (code point). A bit-sliced index holds,
for every position and letter, the set of words with that letter there, one bit a word. A word is looked up in all
words at once: going through its letters, bitsets of the words that agree so far (zero errors) and of those that agree but
for one replaced, one more or one less letter (one error; the last two with positions shifted by one) are carried on by a few
operations on whole machine words, for many looked-up words side by side.

Near words agree in the first or in the second half of the shorter one, so words are dealt by these halves and
indexed in cells of bounded size; a cell that holds a hot half is cut into slices, and every two slices meet.

A word's form is its near word of largest count (ties: smallest in code-point order) where that count is at least
``TIMES`` the word's own. Counts grow tenfold from form to form, so the way to a word's root, the last form, is short;
it is followed by doubling.

Defined cases: null words and counts take no part; words are compared as they are, also empty and very long ones; rows
that repeat a word add up; an empty table gives no rows. Other columns are not carried, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import cut

TIMES = 10
#: Words, and letters (for words of over 64), of a cell; at least ``FEWEST`` words.
CELL_WORDS, CELL_LETTERS, FEWEST = 1_024, 1 << 16, 64


class PositionIndex:
    """Bitsets of the words with a letter at a position; the end of a word counts as a letter after the last."""

    def __init__(self, words: list[str]):
        self.words, self.width = words, max(map(len, words), default=0)
        points = self.points(words, self.width + 3)
        self.letters, coded = np.unique(points, return_inverse=True)
        coded = coded.reshape(points.shape)
        blocks = -(-len(words) // 64)
        held = np.zeros((points.shape[1], len(self.letters) + 1, blocks * 64), bool)  # the last letter is any unknown one
        for place in range(points.shape[1]):
            held[place, coded[:, place], np.arange(len(words))] = True
        self.sets = np.packbits(held, axis=2, bitorder="little").view(np.uint64)
        self.all = np.zeros(blocks * 64, bool)
        self.all[: len(words)] = True
        self.all = np.packbits(self.all, bitorder="little").view(np.uint64)
        self.end = self.sets[:, 0] if len(words) and self.letters[0] == 0 else np.zeros_like(self.sets[:, 0])

    @staticmethod
    def points(words: list[str], width: int) -> np.ndarray:
        """Code points plus one, 0 after the end."""
        out = np.zeros((len(words), width), np.int64)
        for i, w in enumerate(words):
            out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        return out

    def near(self, asked: list[str]) -> Iterator[tuple[int, int]]:
        """Places of asked words and of indexed words one letter apart; the asked words are equally long."""
        n = len(asked[0]) if asked else 0
        if not asked or not self.words or n > self.width + 1:
            return
        points = self.points(asked, n)
        known = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        letter = np.where(self.letters[known] == points, known, len(self.letters))
        shape = (len(asked), len(self.all))
        zero = np.broadcast_to(self.all, shape)
        replaced, more, less = np.zeros(shape, np.uint64), zero & ~self.end[0], np.zeros(shape, np.uint64)
        for i in range(n):
            here = self.sets[i][letter[:, i]]
            before = self.sets[i - 1][letter[:, i]] if i else np.uint64(0)
            replaced = replaced & here | zero & ~here & ~self.end[i]
            less = less & before | zero
            zero = zero & here
            more = more & self.sets[i + 1][letter[:, i]] | zero & ~self.end[i + 1]
        found = replaced & self.end[n] | more & self.end[n + 1] | (less & self.end[n - 1] if n else np.uint64(0))
        row, block = np.nonzero(found)
        which, bit = np.nonzero(np.unpackbits(found[row, block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield from zip(row[which].tolist(), (block[which] * 64 + bit).tolist())


def _cell(rows: list[tuple[int, str, int]], shorter: int) -> Iterator[tuple[str, int, str, int]]:
    """Near pairs of a cell whose shorter word has ``shorter`` letters; words of two slices meet those of the other."""
    slices = sorted({r[0] for r in rows})
    for asking, answering in [(slices[0], slices[-1]), (slices[-1], slices[0])][: len(slices)]:
        members = [r for r in rows if r[0] == answering]
        asked = [r for r in rows if r[0] == asking and len(r[1]) == shorter]
        for i, j in PositionIndex([m[1] for m in members]).near([r[1] for r in asked]):
            yield asked[i][1], asked[i][2], members[j][1], members[j][2]


PAIRS = "word string, n long, near string, near_n long"


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their cells."""

    def found() -> Iterator[pa.RecordBatch]:
        pairs = list(_cell(rows, now[0]))
        columns = list(zip(*pairs)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64()) * 2)], ["word", "n", "near", "near_n"])

    now, rows = None, []
    for batch in batches:
        for *cell, own, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if cell != now:
                if rows:
                    yield from found()
                now, rows = cell, []
            rows.append((own, word, n))
    if rows:
        yield from found()


def _room(shorter: Column) -> Column:
    """Words of a cell."""
    return F.greatest(F.lit(FEWEST), F.least(F.lit(CELL_WORDS), F.floor(F.lit(CELL_LETTERS) / F.greatest(shorter, F.lit(1))))).cast("long")


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: all ordered pairs of near words of ``word``, ``n``."""
    size = F.length("word")
    halves = []
    for shorter in (size, size - 1):
        half = F.floor(shorter / 2).cast("int")
        parts = (F.substring("word", F.lit(1), half), F.when(shorter > half, F.substring("word", half - shorter, shorter - half)).otherwise(F.lit("")))
        halves += [F.struct(shorter.alias("shorter"), F.lit(side).alias("side"), F.xxhash64(part).alias("half")) for side, part in enumerate(parts)]
    dealt = words.select("word", "n", F.explode(F.array(*halves)).alias("h")).select("word", "n", "h.*").filter("shorter >= 0")
    lengths = words.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("of"))
    # a cell gets words of its shorter length and of one letter more
    shorter = lengths.select(F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("shorter"), "of").groupBy("shorter").agg(F.sum("of").alias("of"))
    blocks = shorter.select("shorter", F.ceil(F.col("of") / _room(F.col("shorter"))).alias("blocks"))
    placed = cut(dealt.join(blocks, "shorter").select("shorter", "side", F.pmod("half", "blocks").alias("block"), "word", "n"))
    cell = ["shorter", "side", "block"]
    # twice the room is usual; more is a hot half
    slices = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / (2 * _room(F.first("shorter")))).alias("slices"))
    sliced = placed.join(slices, cell).withColumn("own", F.pmod(F.xxhash64(F.lit(7), "word"), "slices"))
    met = sliced.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    rows = met.select(*cell, F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "own", "word", "n")
    together = rows.repartition(*cell, "s", "t").sortWithinPartitions(*cell, "s", "t")
    found = together.mapInArrow(_pairs, PAIRS)
    return found.union(found.select("near", "near_n", "word", "n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for rows ``word``, ``form``: where following forms ends."""
    way = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = way.select(F.col("word").alias("at"), F.col("root").alias("then"))
        far = cut(way.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")))
        way = far.select("word", "root")
        if far.filter("moved").isEmpty():
            return way


def group_variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` for every word of ``word``, ``n``."""
    given = counts.filter("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = cut(given)
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("most"))
    most = F.col("most.less") * -1
    enough = most >= times * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("most.form")).alias("form"), F.when(enough, most).alias("form_n")
    )
    known = cut(known)
    last = roots(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
