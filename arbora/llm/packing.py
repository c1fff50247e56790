"""Token-id output: best-fit-decreasing packing into rows of fixed length.

Documents longer than a row are split into parts without loss; every document ends with the end id. Segments are dealt by
a hash into pools of bounded size, and each pool is packed by itself: longest segments first, each into the row with the least
room that still holds it, found by descending a segment tree over capacities. A packed row holds its ids (padded),
the cumulative segment lengths, and positions that start again at each segment.

Ids come as bytes, ``width`` bytes each, little endian. Null ids count as none: such a document is its end id alone.
Long documents become many segments in many pools; repeated rows are packed as often as they come; an empty table
gives no rows. Other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW, POOL_TOKENS = 4096, 4 << 20
STORED = np.dtype("<u4")


class Capacities:
    """Rows by their room: a segment tree over 0..row counts the rows of each room."""

    def __init__(self, row: int):
        self.leaves = 1 << row.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self.change(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """A row of the least room that holds ``length``, and its room."""
        at, count = length + self.leaves, self.count
        while not count[at]:
            while at & 1:  # a right child: everything under its parent has been seen
                at >>= 1
                if at == 1:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self.change(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: np.ndarray, row: int = ROW) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of each segment; ties keep the given order."""
    where, start = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free, rows = Capacities(row), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = free.take(n)
        if found is None:
            found, rows = (rows, row), rows + 1
        where[i], start[i] = found[0], row - found[1]
        free.put(found[1] - n, found[0])
    return where, start


SEGMENTS = "doc_id long, part int, parts int, pool int, data binary"
PACKED = "pool int, row int, n_tokens int, doc_ids array<long>, parts array<int>, of_parts array<int>, cumulative array<int>, ids binary, positions binary"


def pack(documents: DataFrame, ids: str, end: int, pad: int, width: int = 4, row: int = ROW, key: str = "doc_id", pool_tokens: int = POOL_TOKENS, size: str | None = None) -> DataFrame:
    """Packed rows: ``ids`` and ``positions`` hold ``row`` 32-bit integers each.

    ``size``: a column with the bytes of the ids; of a stored table, ids are then not read to be counted.
    """
    given = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("data"))
    sizes = documents.select((F.octet_length(ids) if size is None else F.col(size)).alias("bytes"))
    tokens = sizes.agg(F.sum(F.coalesce("bytes", F.lit(0)) / F.lit(width) + 1)).first()[0] or 0
    pools = max(1, int(-(-tokens // pool_tokens)))
    kind = np.dtype(f"<u{width}")

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for doc, data in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    data = data or b""
                    n = len(data) // width + 1  # with the end id
                    rows += [(doc, j // row, -(-n // row), data[j * width : (j + row) * width]) for j in range(0, n, row)]
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "part", "parts", "data"])

    segments = given.mapInArrow(split, "doc_id long, part int, parts int, data binary")
    dealt = segments.select("doc_id", "part", "parts", F.pmod(F.xxhash64(F.lit(13), "doc_id", "part", "data"), F.lit(pools)).cast("int").alias("pool"), "data")

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("part", "ascending"), ("data", "ascending")])
        docs, part, parts, data = (table.column(c).to_pylist() for c in ("doc_id", "part", "parts", "data"))
        last = np.array([p + 1 == q for p, q in zip(part, parts)])
        lengths = np.array([len(d) // width for d in data]) + last
        where, start = best_fit(lengths, row)
        order = np.lexsort((start, where))
        rows = int(where.max()) + 1
        matrix, positions = np.full((rows, row), pad, STORED), np.zeros((rows, row), STORED)
        for i in order.tolist():
            r, s, n = where[i], start[i], lengths[i]
            body = np.frombuffer(data[i], kind)
            matrix[r, s : s + len(body)] = body
            if last[i]:
                matrix[r, s + n - 1] = end
            positions[r, s : s + n] = np.arange(n)
        edges = np.searchsorted(where[order], np.arange(rows + 1))
        groups = [order[a:b] for a, b in zip(edges, edges[1:])]
        columns = {
            "pool": pa.array(np.full(rows, table.column("pool")[0].as_py()), pa.int32()),
            "row": pa.array(np.arange(rows), pa.int32()),
            "n_tokens": pa.array([int(lengths[g].sum()) for g in groups], pa.int32()),
            "doc_ids": pa.array([[docs[i] for i in g] for g in groups], pa.list_(pa.int64())),
            "parts": pa.array([[part[i] for i in g] for g in groups], pa.list_(pa.int32())),
            "of_parts": pa.array([[parts[i] for i in g] for g in groups], pa.list_(pa.int32())),
            "cumulative": pa.array([[0, *np.cumsum(lengths[g]).tolist()] for g in groups], pa.list_(pa.int32())),
            "ids": pa.array([m.tobytes() for m in matrix], pa.binary()),
            "positions": pa.array([p.tobytes() for p in positions], pa.binary()),
        }
        return pa.table(columns)

    return dealt.groupBy("pool").applyInArrow(packed, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    packed.write.parquet(path)
