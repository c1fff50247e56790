"""Periodic runs of words by online dyadic square catching, and texts without the repetitions.

A run is a longest stretch of consecutive words with smallest period q that is at least ``2 * q`` and ``least`` words
long. Every completed, aligned block of ``L = 2 ** l`` words has a catcher for periods from ``2 * L`` to ``4 * L - 1`` (at
``L = 1`` also 1): as words are appended, the window of the last L words is compared with the two blocks that lie so far
back. A square of such a period holds a whole block in its first half, so one of its catchers meets it. Equal windows
of neighbouring blocks at the same distance are one stretch; less than L words are missing at either end, and these are
compared word by word. Squares merge into runs there, and of equal stretches the smallest period stays.

Windows are named by pairs of names of half windows, so a level costs two comparisons a word: time n log n, memory a
few numbers a word. All words of many texts are appended side by side; a text never meets another.

Defined cases: null texts have no runs and stay null, empty texts and texts of white space collapse to the empty text;
very long texts are read whole, one text at a time; repeated rows come out alike; an empty table gives no rows. Other
columns stay, whatever their names; ``runs`` and ``collapsed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import by_bytes, mixed

LEAST = 12
#: Bytes of texts that are read side by side; a longer text is read by itself.
BYTES_AT_ONCE = 1 << 20
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def caught(names: np.ndarray, rest: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``size`` words that equal a block at a catcher's distance: index of the window, distance."""
    window = np.flatnonzero(rest >= size)
    near = 2 * size + (place[window] & (size - 1))
    found, distances = [], []
    for distance in (near, near + size, *[near - size] * (size == 1)):
        reach = distance <= place[window]
        w, q = window[reach], distance[reach]
        same = names[w] == names[w - q]
        found.append(w[same])
        distances.append(q[same])
    return np.concatenate(found), np.concatenate(distances)


def stretches(block: np.ndarray, distance: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring blocks caught at one distance become one stretch: first word, end of its last block, distance."""
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    new = np.flatnonzero(np.r_[True, (distance[1:] != distance[:-1]) | (block[1:] - block[:-1] != size)]) if len(block) else np.zeros(0, np.int64)
    return block[new], block[np.r_[new[1:], len(block)] - 1] + size if len(block) else new, distance[new]


def find_runs(words: np.ndarray, edges: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows ``text, start, length, period``: all runs of texts that have the words from ``edges[i]`` to ``edges[i + 1]``.

    ``words`` are numbers; equal words have equal numbers. Rows are in order of text, start and period.
    """
    lengths = np.diff(edges)
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words)) - edges[text]
    at, names, size, runs = np.arange(len(words)), words.astype(np.uint64), 1, []
    while True:
        long = lengths[text[at]] >= max(least, 4 * size if size > 1 else 2)
        if not long.any():
            break
        at, names = at[long], names[long]  # whole texts go, so words stay neighbours
        rest = lengths[text[at]] - place[at]
        window, distance = caught(names, rest, place[at], size)
        first, end, period = stretches(at[window] - distance, distance, size)
        enough = end - first >= np.maximum(period, least - period) - 2 * (size - 1)
        for a, b, q in zip(first[enough].tolist(), end[enough].tolist(), period[enough].tolist()):
            begin, last = int(edges[text[a]]), int(edges[text[a] + 1])
            lo, hi = max(begin, a - size + 1), min(b + size - 1, last - q)
            if lo < a:
                differ = np.flatnonzero(words[lo:a] != words[lo + q : a + q])
                a = lo + int(differ[-1]) + 1 if len(differ) else lo
            if b < hi:
                differ = np.flatnonzero(words[b:hi] != words[b + q : hi + q])
                b = b + int(differ[0]) if len(differ) else hi
            if b - a >= q and b - a + q >= least:
                runs.append((int(text[a]), a - begin, b - a + q, q))
        after = np.minimum(np.arange(len(names)) + size, len(names) - 1)
        names = mixed(names, names[after])
        size *= 2
    found = np.array(sorted(set(runs)), np.int64).reshape(-1, 4)
    # multiples of a period have the same stretch; the smallest period comes first
    return found[np.r_[True, (found[1:, :3] != found[:-1, :3]).any(1)]] if len(found) else found


def add_runs(documents: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The documents with ``runs`` (start, length, period; words from 0) and ``collapsed``.

    ``collapsed`` holds the words, joined by a space, that no run contains after its first period.
    """
    kept = [(f"c{i}", f) for i, f in enumerate(documents.schema.fields) if f.name.lower() not in ("runs", "collapsed")]
    # by position: names may clash in any way
    plain = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))
    rows = plain.select(*(c for c, _ in kept), F.col(f"c{documents.columns.index(text)}").cast("binary").alias("text"))
    added = [T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, BYTES_AT_ONCE):
            texts = part.column(part.num_columns - 1).to_pylist()
            words = [(t or b"").split() for t in texts]  # of bytes: exactly the six ASCII white spaces
            number: dict[bytes, int] = {}
            flat = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64)
            edges = np.cumsum([0, *map(len, words)])
            found = find_runs(flat, edges, least)
            bounds = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).tolist()
            collapsed = []
            for t, ws, a, b in zip(texts, words, bounds, bounds[1:]):
                if a < b:
                    stays = np.ones(len(ws), bool)
                    for _, start, length, period in found[a:b].tolist():
                        stays[start + period : start + length] = False
                    ws = [ws[i] for i in np.flatnonzero(stays).tolist()]
                collapsed.append(None if t is None else b" ".join(ws).decode("utf-8", "replace"))
            structs = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], runs, pa.array(collapsed, pa.string())], names=[*part.schema.names[:-1], "runs", "collapsed"])

    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in kept), *added])
    return rows.mapInArrow(run, schema).toDF(*(f.name for _, f in kept), "runs", "collapsed")
