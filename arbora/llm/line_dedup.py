"""Line deduplication by a deletion-neighbourhood join.

A line is its sequence of words. It goes if an equal line, or one within one word of it (a word put in, left out or
changed; both lines with at least ``LEAST_WORDS`` words), stands earlier, by document id, then text hash, then line
number. Lines without words always stay.

Equal lines meet by a 128-bit hash. Of distinct lines, those that share their first or last half with another are the
only ones that can be within one edit (one edit leaves one half alone); they emit a hashed key for every variant with
one word left out. Lines with equal variants at the same place differ in that word only, and a line that equals a
variant is the other without that word, so the earliest line of a key is a partner of all others of the key: minima per
key find each line's earliest partner without pairing lines. Words of both lines are then compared.

All steps are sums over keys and joins on keys that are unique on one side. Texts travel compressed.
Defined cases: null and empty texts have no lines to remove; a document without id takes no part and stays as it is;
repeated rows (equal id and text) are one document and keep or lose the same lines; very long lines cost time in
proportion to their words; an empty table gives no rows. Columns named ``removed_lines`` or ``lines`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import WORD, Powers, RunningSums, Words, cut, mixed, unused

LEAST_WORDS = 8
_WORDS = re.compile(WORD).findall
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SAME_PLACE, WHOLE, WITHOUT = 0, 1, 2


def signed(x: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
    return mixed(x, *more).view(np.int64)


class Hashes:
    """What a worker keeps over its batches."""

    def __init__(self) -> None:
        self.words, self.powers = Words(), [Powers(b) for b in _BASES]

    def lines(self, texts: list[str]) -> tuple[list[RunningSums], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Running sums over all words; start, end, text and number of each line that has words."""
        word, of, line = self.words(texts)
        new = np.r_[True, (of[1:] != of[:-1]) | (line[1:] != line[:-1])] if len(word) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        return [RunningSums(word, p) for p in self.powers], start, np.r_[start[1:], len(word)].astype(np.int64)[: len(start)], of[start], line[start]


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether at most one word is put in, left out or changed."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return max(len(a), len(b)) - head - tail <= 1


def _mapped(df: DataFrame, schema: str, rows) -> DataFrame:
    """``rows`` turns the columns' values of a few rows into columns."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                columns = rows(*(c.to_pylist() for c in batch.slice(at, 64).columns))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)


def lines_of(documents: DataFrame) -> DataFrame:
    """``doc``, ``version``, ``line``, ``n``, ``a``, ``b``, ``halves``: the lines that have words."""
    hashes = []

    def rows(docs, versions, texts):
        kept = hashes[0] if hashes else hashes.append(Hashes()) or hashes[0]
        sums, start, end, of, number = kept.lines(texts)
        n = end - start
        a, b = (signed(s.run(start, end), n) for s in sums)
        # first and last halves; for odd lengths with and without the middle word
        long = np.flatnonzero(n >= LEAST_WORDS)
        odd = long[n[long] % 2 == 1]
        line, half = np.r_[long, odd], np.r_[n[long] // 2, n[odd] // 2 + 1]
        first = signed(sums[0].run(start[line], start[line] + half), half, 3)
        last = signed(sums[0].run(end[line] - half, end[line]), half, 4)
        order = np.argsort(np.r_[line, line], kind="stable")
        ends = np.cumsum(np.r_[0, np.bincount(np.r_[line, line], minlength=len(n))]).astype(np.int32)
        halves = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.r_[first, last][order]))
        own = [np.array(x, np.int64)[of] for x in (docs, versions)]
        return [*map(pa.array, own), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(a), pa.array(b), halves]

    return _mapped(documents, "doc long, version long, line int, n int, a long, b long, halves array<long>", rows)


def variants_of(chosen: DataFrame) -> DataFrame:
    """``key``, ``role``, ``doc``, ``version``, ``line`` and, with the line itself, its ``text``."""
    hashes = []

    def rows(docs, versions, packed, numbers):
        kept = hashes[0] if hashes else hashes.append(Hashes()) or hashes[0]
        unpack = zstandard.ZstdDecompressor().decompress
        own, texts = [], []
        for doc, version, data, wanted in zip(docs, versions, packed, numbers):
            lines = unpack(data).decode().split("\n")
            own += [(doc, version, number) for number in wanted]
            texts += [lines[number] for number in wanted]
        (sums, _), start, end, _, _ = kept.lines(texts)
        n = end - start
        each = np.repeat(np.arange(len(n)), n)  # the line of each word
        at = np.arange(len(each))
        with np.errstate(over="ignore"):
            less = sums.run(start[each], at) + sums.run(at + 1, end[each], start[each] + 1)
        # leaving out either of two equal neighbours gives the same variant; once is enough for it
        new = np.r_[True, (less[1:] != less[:-1]) | (each[1:] != each[:-1])] if len(less) else np.zeros(0, bool)
        keys = [signed(less, at - start[each], n[each], 5), signed(sums.run(start, end), n, 6), signed(less[new], n[each[new]] - 1, 6)]
        role = np.repeat([SAME_PLACE, WHOLE, WITHOUT], [len(k) for k in keys]).astype(np.int32)
        line = np.concatenate([each, np.arange(len(n)), each[new]])
        where = np.array(own, np.int64).reshape(-1, 3)[line]
        told = pa.array(texts, pa.string()).take(pa.array(line, mask=role != WHOLE))
        return [pa.array(np.concatenate(keys)), pa.array(role), pa.array(where[:, 0]), pa.array(where[:, 1]), pa.array(where[:, 2].astype(np.int32)), told]

    return _mapped(chosen, "key long, role int, doc long, version long, line int, text string", rows)


def packed_texts(documents: DataFrame) -> DataFrame:
    def rows(docs, versions, texts):
        pack = zstandard.ZstdCompressor(level=3).compress
        return [pa.array(docs, pa.int64()), pa.array(versions, pa.int64()), pa.array([pack(t.encode("utf-8", "replace")) for t in texts], pa.binary())]

    return _mapped(documents, "doc long, version long, packed binary", rows)


PLACE = ("doc", "version", "line")


def removed_lines(documents: DataFrame) -> DataFrame:
    """``doc``, ``version`` and ``numbers``, the lines to remove; of ``documents`` with ``doc``, ``version`` and ``text``."""
    place = F.struct(*PLACE)
    lines = cut(lines_of(documents))
    firsts = cut(lines.groupBy("a", "b").agg(F.min(F.struct(*PLACE, "n", "halves")).alias("f")).select("a", "b", "f.*"))

    halves = firsts.filter(F.col("n") >= LEAST_WORDS).select(*PLACE, F.explode("halves").alias("half"))
    shared = halves.groupBy("half").count().filter("count > 1").select("half")
    possible = halves.join(shared, "half").groupBy(*PLACE).count()
    by_document = possible.groupBy("doc", "version").agg(F.collect_set("line").alias("numbers"))
    chosen = packed_texts(documents).join(by_document, ["doc", "version"]).select("doc", "version", "packed", "numbers")
    variants = cut(variants_of(chosen))

    def least(role: int):
        return F.min(F.when(F.col("role") == role, place))

    keys = variants.groupBy("key").agg(F.count(F.lit(1)).alias("of"), *(least(r).alias(f"first{r}") for r in (SAME_PLACE, WHOLE, WITHOUT))).filter("of > 1")
    partner = F.when(F.col("role") == SAME_PLACE, F.col("first0")).when(F.col("role") == WHOLE, F.col("first2")).otherwise(F.col("first1"))
    earlier = variants.join(keys, "key").select(*PLACE, partner.alias("partner")).filter(F.col("partner") < place)
    linked = earlier.groupBy(*PLACE).agg(F.min("partner").alias("partner")).select(*PLACE, *(F.col(f"partner.{c}").alias(f"partner_{c}") for c in PLACE))
    texts = variants.filter(F.col("role") == WHOLE).select(*PLACE, F.col("text").alias("words")).dropDuplicates(list(PLACE))
    others = texts.select(*(F.col(c).alias(f"partner_{c}") for c in PLACE), F.col("words").alias("partner_words"))
    pairs = linked.join(texts, list(PLACE)).join(others, [f"partner_{c}" for c in PLACE]).select(*PLACE, "words", "partner_words")

    def verified(docs, versions, numbers, words, partners):
        kept = [i for i, (x, y) in enumerate(zip(words, partners)) if within_one(_WORDS(x), _WORDS(y))]
        return [pa.array([c[i] for i in kept], k) for c, k in ((docs, pa.int64()), (versions, pa.int64()), (numbers, pa.int32()))]

    near = _mapped(pairs, "doc long, version long, line int", verified).withColumn("near", F.lit(True))
    decided = firsts.join(near, list(PLACE), "left").select("a", "b", place.alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.join(decided, ["a", "b"]).filter(F.col("near") | (F.col("first") < place))
    return gone.groupBy("doc", "version").agg(F.collect_set("line").alias("numbers"))


def dedup_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their lines deduplicated, ``lines`` (how many there were) and ``removed_lines`` (how many went)."""
    kept = [c for c in documents.columns if c.lower() not in ("lines", "removed_lines", text.lower())]
    version = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keyed = documents.select(F.col(key).cast("long").alias("doc"), version.alias("version"), F.col(text).alias("text"))
    numbers = removed_lines(keyed.filter("doc IS NOT NULL AND text IS NOT NULL"))
    given, doc, ver, packed_text, of, within, gone = unused(kept, "_text", "_doc", "_version", "_packed", "_of", "_in", "_numbers")
    numbers = numbers.toDF(of, within, gone)

    rows = documents.select(*kept, F.col(text).alias(given), F.col(key).cast("long").alias(doc), version.alias(ver))
    pack = T.StructType([*(f for f in rows.schema.fields if f.name != given), T.StructField(packed_text, T.BinaryType())])

    def compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            i = batch.schema.get_field_index(given)
            packed = pa.array([None if t is None else squeeze(t.encode("utf-8", "replace")) for t in batch.column(i).to_pylist()], pa.binary())
            others = [j for j in range(batch.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in others), packed], names=[*(batch.schema.names[j] for j in others), packed_text])

    marked = rows.mapInArrow(compress, pack).join(numbers, (F.col(doc) == F.col(of)) & (F.col(ver) == F.col(within)), "left")
    marked = marked.select(*kept, packed_text, gone)
    fields = [f for f in marked.schema.fields if f.name in kept]
    out = T.StructType([*fields, T.StructField(text, T.StringType()), T.StructField("lines", T.LongType()), T.StructField("removed_lines", T.LongType())])

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, counts, removed = [], [], []
                for packed, gone in zip(*(part.column(part.num_columns - 2 + i).to_pylist() for i in (0, 1))):
                    lines = None if packed is None else unpack(packed).decode().split("\n")
                    gone = set(gone or ())
                    texts.append(None if lines is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
                    counts.append(len(lines or ()))
                    removed.append(len(gone))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=out.names)

    return marked.mapInArrow(rebuild, out).select(*(c for c in documents.columns if c in kept or c == text), "lines", "removed_lines")
