"""Approximate nearest neighbours by adaptive dimension scan.

The largest inner product becomes the smallest Euclidean distance once every vector gets one more component,
``sqrt(M^2 - |x|^2)`` with the largest norm M (0 for queries). Vectors are put into lists by their nearest centroid
and rotated at random; a list is scanned in column blocks. After each block the partial distance of a candidate,
scaled to all dimensions, is tested against the query's bound: a candidate is abandoned once it exceeds the bound by more
than chance explains (error ``tolerance``). Survivors are scored exactly on the original vectors in double precision.

Centroids and the pilot rows (whose k-th best score bounds each query's search from the start, and which are results
themselves) come from a sample of at most ``FIT_ROWS`` rows by hash; every row is indexed. Lists are cut into chunks of bounded size by a hash
of the id, so one crowded list does not end in one task. Ties go to smaller ids; an empty table gives no rows. See
``vectors.clean_vectors`` for the rows that take part. With few rows there are few lists, and one list means an exact search.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import cut
from arbora.llm.vectors import best, blocks, ids_of, matrix

#: Bound of the sample that centroids and pilots are fitted on.
FIT_ROWS = 16_384
PILOTS = 1_024
LISTS, ROWS_PER_LIST, PROBED = 128, 64, 0.72
CHUNK_ROWS, QUERY_ROWS = 2_048, 512
COLUMNS, TOLERANCE = 16, 2.1


@dataclass(frozen=True)
class Index:
    """What tasks need to place vectors: a few MB whatever the size of the data."""

    centroids: np.ndarray
    rotation: np.ndarray
    norm: float
    pilot_ids: np.ndarray
    pilots: np.ndarray

    def lift(self, rows: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(rows)) if query else np.sqrt(np.maximum(0.0, self.norm**2 - (rows**2).sum(1)))
        return np.column_stack([rows, more])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        return (lifted**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * lifted @ self.centroids.T


def fit(vectors: DataFrame, lists: int = LISTS, rounds: int = 12, seed: int = 5) -> Index | None:
    """Centroids by Lloyd's rounds over the sample, and a random rotation."""
    norm = vectors.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    if norm is None:
        return None
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(FIT_ROWS).toPandas()
    rows, rng = np.array(sample["v"].tolist()), np.random.default_rng(seed)
    width = rows.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.standard_normal((width, width)))
    index = Index(np.zeros((1, width)), rotation, float(norm), sample["vec_id"].to_numpy()[:PILOTS], rows[:PILOTS])
    lifted = index.lift(rows, False)
    centroids = lifted[rng.permutation(len(rows))[: max(1, min(lists, len(rows) // ROWS_PER_LIST))]]
    for _ in range(rounds):
        nearest = Index(centroids, rotation, norm, index.pilot_ids, index.pilots).distances(lifted).argmin(1)
        sums, sizes = np.zeros_like(centroids), np.bincount(nearest, minlength=len(centroids))
        np.add.at(sums, nearest, lifted)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return Index(centroids, rotation, float(norm), index.pilot_ids, index.pilots)


def batch_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    return ids, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def scan(queries: np.ndarray, rows: np.ndarray, bounds: np.ndarray, tolerance: float = TOLERANCE, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of rotated vectors that no test abandons and that end within the squared bounds."""
    width = queries.shape[1]
    alive = np.ones((len(queries), len(rows)), bool)
    partial = np.zeros(alive.shape)
    for at in range(0, width, columns):
        q, x = queries[:, at : at + columns], rows[:, at : at + columns]
        who, which = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(who):
            break
        q, x = q[who], x[which]
        partial[np.ix_(who, which)] += (q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T
        seen = min(at + columns, width)
        slack = (1 + tolerance / np.sqrt(seen)) ** 2 * seen / width if seen < width else 1 + 1e-9
        alive &= partial <= (bounds * slack + 1e-12)[:, None]
    return np.nonzero(alive)


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", queries, rows)


RESULT = "query_id long, found array<struct<below: double, vec_id: long>>"


def _found(ids: np.ndarray, who: np.ndarray, which: np.ndarray, scores: np.ndarray, row_ids: np.ndarray, k: int) -> Iterator[tuple[int, list]]:
    """Each query's ``k`` best of the given pairs."""
    order = np.lexsort((row_ids[which], -scores, who))
    who, which, scores = who[order], which[order], scores[order]
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else []
    for a, b in zip(starts, [*starts[1:], len(who)]):
        n = min(b, a + k)
        yield int(ids[who[a]]), [{"below": -s, "vec_id": i} for s, i in zip(scores[a:n].tolist(), row_ids[which[a:n]].tolist())]


def _batch(found: list[tuple[int, list]]) -> pa.RecordBatch:
    pairs = pa.struct([("below", pa.float64()), ("vec_id", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int64()), pa.array([f for _, f in found], pa.list_(pairs))], ["query_id", "found"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, index: Index | None = None, probed: float = PROBED) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` nearest found among all vectors but itself.

    ``vectors`` and ``queries`` have ``vec_id`` and ``v``; an id of both is the same row.
    """
    index = index or fit(vectors)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch_rows(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.distances(index.lift(rows, False)).argmin(1), pa.int32())], ["vec_id", "v", "list"])

    placed = cut(vectors.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<double>, list int"))
    sizes = placed.groupBy(F.col("list").alias("_list")).agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK_ROWS)).alias("chunks"))
    chunked = placed.join(F.broadcast(sizes), F.col("list") == F.col("_list"))  # one row per list: LISTS at most
    chunks = blocks(chunked, F.pmod(F.xxhash64(F.lit(9), "vec_id"), "chunks").cast("int"), "list")

    most = max(1, round(probed * len(index.centroids)))
    asked = "list int, query_ids array<long>, query_flat array<double>, bounds array<double>"

    def pilot_scores(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        scores = rows @ index.pilots.T
        scores[ids[:, None] == index.pilot_ids] = -np.inf
        return scores

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                ids, rows = batch_rows(batch.slice(at, QUERY_ROWS))
                scores = pilot_scores(ids, rows)
                kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
                bounds = (rows**2).sum(1) + index.norm**2 - 2 * kth
                distance = index.distances(index.lift(rows, True))
                near = np.argpartition(distance, most - 1, axis=1)[:, :most]
                takes = np.zeros(distance.shape, bool)
                np.put_along_axis(takes, near, True, axis=1)
                parts = [(j, np.flatnonzero(takes[:, j])) for j in range(takes.shape[1]) if takes[:, j].any()]
                yield pa.RecordBatch.from_pylist(
                    [{"list": j, "query_ids": ids[i], "query_flat": rows[i].ravel(), "bounds": bounds[i]} for j, i in parts],
                    pa.schema([("list", pa.int32()), ("query_ids", pa.list_(pa.int64())), ("query_flat", pa.list_(pa.float64())), ("bounds", pa.list_(pa.float64()))]),
                )

    def pilots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                ids, rows = batch_rows(batch.slice(at, QUERY_ROWS))
                scores = pilot_scores(ids, rows)
                n = min(k, scores.shape[1])
                which = np.argpartition(-scores, n - 1, axis=1)[:, :n].ravel()
                who = np.repeat(np.arange(len(ids)), n)
                other = ids[who] != index.pilot_ids[which]
                who, which = who[other], which[other]
                yield _batch(list(_found(ids, who, which, exact(rows[who], index.pilots[which]), index.pilot_ids, k)))

    def scan_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row_ids, ids = ids_of(batch.column("ids")[i]), ids_of(batch.column("query_ids")[i])
                rows, asking = matrix(batch.column("flat")[i], row_ids), matrix(batch.column("query_flat")[i], ids)
                who, which = scan(index.lift(asking, True) @ index.rotation, index.lift(rows, False) @ index.rotation, ids_of(batch.column("bounds")[i]))
                other = ids[who] != row_ids[which]
                who, which = who[other], which[other]
                yield _batch(list(_found(ids, who, which, exact(asking[who], rows[which]), row_ids, k)))

    asking = queries.select("vec_id", "v")
    pairs = chunks.join(asking.mapInArrow(probe, asked), "list").select("ids", "flat", "query_ids", "query_flat", "bounds")
    found = pairs.mapInArrow(scan_chunks, RESULT).unionByName(asking.mapInArrow(pilots, RESULT))
    # a row is found twice at most, as a pilot and in its list, so the first 2k hold the best k
    first = F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, 2 * k)
    ranked = found.groupBy("query_id").agg(F.slice(F.array_distinct(first), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("at", "one")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.below")).alias("score")
    )
