"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments, coarse to fine; each segment keeps its mean and deviation. By the Cauchy-Schwarz
inequality a segment of length n adds at most ``n * (mean_q * mean_x + dev_q * dev_x)`` to the product (the same
bound as the lower bound ``n * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)`` on the squared distance). Rows whose bound
stays below the k-th best score so far of every query of a tile are dropped at each level; the tile is multiplied out
with the rows that survive, exactly.

All queries meet all vectors in blocks: queries are dealt to every block of vectors. A block is met in strips, longest
vectors first, and the k-th score rises from strip to strip, so a query and block send ``k`` rows at most. Pilot rows, a
sample of bounded size, give each query a first k-th score, which only saves work. Ties go to smaller ids and nothing is
missed. Vectors are whole numbers; scores are exact below 2^53. See ``vectors.clean_vectors`` for the rows that take
part (rows with null ids, null vectors or null components do not); zero vectors do. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.vectors import blocks, hashed_block, ids_of, matrix, number_of_blocks

#: Pilot rows; rows of a block, of a strip of a block, and queries that meet a block at once.
PILOTS, BLOCK_ROWS, STRIP_ROWS, QUERY_ROWS = 1_024, 8_192, 2_048, 1_024
#: Bytes of a block's vectors at most: wide vectors come in fewer rows.
BLOCK_BYTES = 4 << 20
#: Segments at each level.
LEVELS = (1, 4, 16)
#: What rounding can take from a bound, as a part of the product of both lengths.
SLACK = 1e-9
#: Queries of a tile; bounds a task's memory.
AT_ONCE = 64


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled by their lengths, so that a bound is one inner product."""
    parts = np.array_split(rows, min(segments, rows.shape[1]), axis=1)
    return np.column_stack([s for p in parts for s in (p.mean(1) * np.sqrt(p.shape[1]), p.std(1) * np.sqrt(p.shape[1]))])


class Strip:
    """Rows of a block with their statistics at each level."""

    def __init__(self, rows: np.ndarray, row_ids: np.ndarray):
        self.rows, self.ids = rows, row_ids
        self.longest = float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0.0)))
        self.levels = [statistics(rows, s) for s in LEVELS]


def strips(rows: np.ndarray, row_ids: np.ndarray) -> list[Strip]:
    """The block in strips, longest vectors first: their bounds are the highest."""
    order = np.argsort(-np.einsum("ij,ij->i", rows, rows), kind="stable")
    return [Strip(rows[p], row_ids[p]) for p in (order[at : at + STRIP_ROWS] for at in range(0, len(order), STRIP_ROWS))]


def top_rows(queries: np.ndarray, ids: np.ndarray, met: list[Strip], floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids of rows and scores: each query's ``k`` best rows of the strips not under its floor."""
    floor, length = floor.copy(), np.sqrt(np.einsum("ij,ij->i", queries, queries))
    asked = [statistics(queries, s) for s in LEVELS]
    who, found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for strip in met:
        least = (floor - SLACK * (1 + length * strip.longest))[:, None]
        left = np.arange(len(strip.ids))
        for query, row in zip(asked, strip.levels):
            left = left[(query @ row[left].T >= least).any(axis=0)]
        product = queries @ strip.rows[left].T
        q, r = np.nonzero(product >= floor[:, None])
        other = ids[q] != strip.ids[left[r]]
        q, r = q[other], r[other]
        if not len(q):
            continue
        who, found, scores = np.r_[who, q], np.r_[found, strip.ids[left[r]]], np.r_[scores, product[q, r]]
        order = np.lexsort((found, -scores, who))
        rank = np.arange(len(who)) - np.searchsorted(who[order], who[order])  # from where each query's rows begin
        order, rank = order[rank < k], rank[rank < k]
        who, found, scores = who[order], found[order], scores[order]
        full = rank == k - 1
        floor[who[full]] = np.maximum(floor[who[full]], scores[full])
    return who, found, scores


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` highest products with all vectors but its own."""
    n, asked = vectors.count(), queries.count()
    sample = vectors.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(PILOTS).toPandas()
    pilot_ids, pilots = sample["vec_id"].to_numpy(dtype=np.int64), np.array(sample["v"].tolist(), dtype=float)
    most = max(1, BLOCK_BYTES // (8 * pilots.shape[1])) if len(pilots) else 1
    many = number_of_blocks(n, min(BLOCK_ROWS, most))
    dealt = blocks(queries, hashed_block(number_of_blocks(asked, min(QUERY_ROWS, most)))).select(
        F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("block"), F.col("ids").alias("query_ids"), F.col("flat").alias("query_flat")
    )
    pairs = blocks(vectors, hashed_block(many)).join(dealt, "block").select("ids", "flat", "query_ids", "query_flat")

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row_ids, ids = ids_of(batch.column("ids")[i]), ids_of(batch.column("query_ids")[i])
                met, asking = strips(matrix(batch.column("flat")[i], row_ids), row_ids), matrix(batch.column("query_flat")[i], ids)
                for at in range(0, len(ids), AT_ONCE):
                    some = slice(at, at + AT_ONCE)
                    known = asking[some] @ pilots.T
                    known[ids[some][:, None] == pilot_ids] = -np.inf
                    floor = np.partition(known, -k, axis=1)[:, -k] if len(pilot_ids) >= k else np.full(len(known), -np.inf)
                    who, found, score = top_rows(asking[some], ids[some], met, floor, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][who]), pa.array(found), pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(scores, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
