"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach; one is made only for a local master without a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
    folder = tempfile.mkdtemp(prefix="corpus-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    A lost executor then costs one task, not the lineage, and the planner knows the table's true size.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``BATCH_BYTES`` bytes from now on, unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name, None)
    if given is None or not given.isdigit() or int(given) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names`` for columns of an operator's own, each with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while any(n.lower() in taken for n in names):
        names = tuple(n + "_" for n in names)
    return list(names)


def release_memory() -> None:
    """Give memory that is no longer used back to the system: Python workers live on between tasks and steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def by_bytes(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in slices whose last column (strings or bytes) has at most ``most`` bytes; a longer value comes alone."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_BASE, _MIX = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWERED = _BYTES.copy()
_LOWERED[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of the values."""
    with np.errstate(over="ignore"):
        for m in (0, *more):
            x = (x ^ np.asarray(m).astype(np.uint64) * _MIX) * _BASE
            x = x ^ x >> np.uint64(29)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int = int(_BASE)):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            with np.errstate(over="ignore"):
                size = max(2 * n, 1 << 16)
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(self.base))])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(pow(self.base, -1, 1 << 64)))])


class RunningSums:
    """Hashes of runs of values: differences of running sums, divided by the power of the run's first place."""

    def __init__(self, values: np.ndarray, powers: Powers):
        powers.reach(len(values) + 2)
        self.down = powers.down
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum(values * powers.up[: len(values)])]

    def run(self, start: np.ndarray, end: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """Of the runs from ``start`` to ``end``, as if they began at ``place`` before ``start``."""
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start if place is None else place]


class Words:
    """Hashes of the words of many texts at once, from their bytes."""

    #: Bytes taken at once.
    BYTES = 1 << 20

    def __init__(self, lower: bool = False):
        self.table, self.powers = _LOWERED if lower else _BYTES, Powers()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every word in order: its hash, the text it is in, and its line there."""
        parts = list(self._parts([t.encode("utf-8", "replace") for t in texts]))
        return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _parts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) < self.BYTES):
                size += len(texts[last]) + 1
                last += 1
            yield self._part(texts[first:last], first)
            first = last

    def _part(self, texts: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = _SPACE[data]
        edges = np.flatnonzero(space[1:] != space[:-1])
        start, end = edges[0::2], edges[1::2]
        hashes = mixed(RunningSums(self.table[data], self.powers).run(start, end), end - start)
        of = np.searchsorted(begins, start, side="right") - 1
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, start) - np.searchsorted(breaks, begins)[of]
        return hashes, of + first, line
