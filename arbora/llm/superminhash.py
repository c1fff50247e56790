"""Near duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

A document's set holds the hashes of its distinct word n-grams. Every element deals out the signature's places in its
own random order and marks the j-th of them with ``j`` plus a random fraction; a place keeps its smallest mark. Marks of one
element go to different places, so the estimates vary less than with independent permutations. An element needs no
further place once all places hold marks of earlier ranks: all elements of many documents go on rank by rank, and a
document stops when its signature is full, after about ``places * log(places)`` marks however long it is.

``ROWS`` places make a band. Sets that share a band are candidates: a pair at the threshold of 85 % misses all
``BANDS`` bands with a chance of 3 in 10 million, one of 90 % with less than one in a thousand million. Candidates are
joined to groups, and inside a group links are confirmed on the full sets (``set_links``), which needs neither all
pairs nor a bound on the size of a group. Links make the classes by contraction (``components``).

Equal sets are one class from the start; sets of up to ``ALONE`` elements can be similar to equal sets only.
Defined cases: null and empty texts and texts without words have no elements and link with nothing; texts of fewer words
than n are one element; very long texts are read whole; documents without id link with nothing, have a null class
and are kept; rows that repeat an id are told apart by their sets; an empty table gives no rows. Other columns are
not carried, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import by_bytes, cut, mixed
from arbora.llm.components import components
from arbora.llm.ngram_join import Shingles
from arbora.llm.set_links import MEMBERS, batch_of, links_within

N, PERCENT = 3, 85
ROWS, BANDS = 6, 32
#: Text of so many bytes is read at once; a longer text is read by itself.
BYTES_AT_ONCE = 1 << 18


def alone(percent: int = PERCENT) -> int:
    """Largest size of a set that has no similar set but itself: n of n + 1 elements are too few."""
    return -(-percent // (100 - percent)) - 1


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash of each set (distinct 64-bit hashes): a row of ``places`` marks; empty sets have infinite ones."""
    marks = np.full(len(sets) * places, np.inf)
    element = np.concatenate([np.zeros(0, np.uint64), *sets])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None
    for rank in range(places):
        if not len(element):
            break
        draw = mixed(element, rank)
        other = rank + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
        each = np.arange(len(element))
        place = other if order is None else order[each, other]
        np.minimum.at(marks, row * places + place, rank + (draw >> np.uint64(11)).astype(float) / (1 << 53))
        full = np.isfinite(marks.reshape(-1, places)).all(1)
        left = ~full[row]
        element, row = element[left], row[left]
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint16), (len(element), 1))
            moved, at = other[left], np.arange(len(element))
            order[at, moved] = order[:, 0]  # the exchange of a Fisher-Yates step; the place at ``rank`` is not asked again
        else:
            order[each, other] = order[:, rank]
            order = order[left]
    return marks.reshape(-1, places)


def bands(marks: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature, different between bands."""
    parts = np.ascontiguousarray(marks).view(np.uint64).reshape(len(marks), marks.shape[1] // rows, rows)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        key = mixed(key, parts[:, :, i])
    return key.view(np.int64)


SETS = "doc long, version long, n long, a long, b long, bands array<long>"


def describe(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """Of rows ``doc``, ``version``, ``text``: the size and fingerprint of the set, and its bands."""
    least = alone(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for part in by_bytes(batches, BYTES_AT_ONCE):
            ids, versions, texts = (c.to_pylist() for c in part.columns)
            sets = shingles(texts)
            fingerprints = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            distinct = {f: i for i, f in enumerate(fingerprints) if len(sets[i]) > least}
            keys = dict(zip(distinct, bands(signatures([sets[i] for i in distinct.values()], ROWS * BANDS))))
            a, b = (np.array([x >> s & (1 << 64) - 1 for x in fingerprints], np.uint64).view(np.int64) for s in (64, 0))
            found = [keys[f].tolist() if f in keys else None for f in fingerprints]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), pa.array(found, pa.list_(pa.int64()))],
                ["doc", "version", "n", "a", "b", "bands"],
            )

    return documents.mapInArrow(run, SETS)


def _members(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for part in by_bytes(batches, BYTES_AT_ONCE):
            groups, ids, texts = (c.to_pylist() for c in part.columns)
            yield batch_of([(g, i, len(s), 0, s.tobytes()) for g, i, s in zip(groups, ids, shingles(texts))], MEMBERS)

    return run


def candidates(classes: DataFrame) -> DataFrame:
    """``node`` and ``component``: classes that bands connect."""
    postings = classes.select("a", F.explode("bands").alias("key"))
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("of"), F.min("a").alias("least")).filter("of > 1")
    return components(postings.join(lists.select("key", "least"), "key").filter("a <> least").select(F.col("a").alias("u"), F.col("least").alias("v")).distinct())


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``version`` (hash of the text), ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the smallest id that links lead to; ``kept`` tells the rows of that id.
    """
    given = documents.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))
    marks = cut(describe(given, n, percent))
    # copies count once, whatever their number; equal sets have equal bands
    classes = marks.filter("doc IS NOT NULL AND n > 0").groupBy("a", "b").agg(F.min(F.struct("doc", "version")).alias("first"), F.first("bands").alias("bands"))
    classes = cut(classes)
    near = candidates(classes.filter("bands IS NOT NULL"))
    chosen = near.join(classes.select("a", "first"), F.col("node") == F.col("a")).select(F.col("component").alias("group"), "a", "first.doc", "first.version")
    texts = given.filter("doc IS NOT NULL").join(chosen, ["doc", "version"]).select("group", F.col("a").alias("id"), "text").dropDuplicates(["id"])
    links = links_within(texts.mapInArrow(_members(n), MEMBERS), percent)
    linked = components(links).join(classes.select("a", "first"), F.col("node") == F.col("a")).select("a", "component", "first")
    groups = linked.groupBy("component").agg(F.min("first.doc").alias("least"))
    named = linked.join(groups, "component").select("a", "least")
    rows = marks.join(named, "a", "left").join(classes.select("a", "b", F.col("first.doc").alias("own")), ["a", "b"], "left")
    component = F.when(F.col("n") > 0, F.coalesce(F.when(F.col("doc").isNotNull(), F.coalesce("least", "own")), F.col("doc"))).otherwise(F.col("doc"))
    found = rows.select(F.col("doc").alias("doc_id"), "version", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
