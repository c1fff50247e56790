"""Vectors as rows and as blocks for the nearest-neighbour operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import cut


def clean_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", zero: bool = False) -> DataFrame:
    """``vec_id`` and ``v`` (doubles), one row per id, written as a table.

    Null ids and vectors that are null, empty, hold null or non-finite components (or, unless ``zero``, are zero) take
    no part. An id names one vector: of rows that repeat it the smallest vector counts. Vectors of another width than
    most (ties: the smaller width) can't be compared with the rest and take no part either.
    """
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~odd)
    if not zero:
        kept = kept.filter(F.exists(v, lambda x: x != 0))
    one = cut(kept.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")))
    width = one.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return one.filter(F.size("v") == (width["w"] if width else 0))


def blocks(vectors: DataFrame, block: Column, *keys: str) -> DataFrame:
    """Rows gathered into blocks of bounded size: ``block``, ``keys``, ``ids`` and ``flat``, the vectors one after another."""
    rows = vectors.select(*keys, block.alias("block"), F.struct("vec_id", "v").alias("row"))
    packed = rows.groupBy(*keys, "block").agg(F.collect_list("row").alias("rows"))
    return packed.select(*keys, "block", F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("flat"))


def number_of_blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def hashed_block(count: int, seed: int = 3) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(count)).cast("int")


def matrix(flat: pa.Scalar, ids: np.ndarray) -> np.ndarray:
    return flat.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def ids_of(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]
