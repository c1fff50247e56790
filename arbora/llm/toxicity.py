"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all documents. Suspect stretches of a text (look-alike symbols in or at
words, letters repeated three times or more, words spelled with gaps) become lattices: a symbol may stand for letters
or be noise, a run may stand for one or two letters, a gap may be nothing. Viterbi decoding picks the most likely
reading under channel costs and the language model, and the restored text is scored.

The score is a logistic function of evidence from words: a word's weight is the largest log odds of its whole form and
its beginnings, for forms that differ significantly between the classes. Forms are counted on at most ``FIT_ROWS``
labelled rows (smallest hashes); two halves of them fit the forms and the logistic part apart. Labels, language,
source and id are never inputs of a score.

Null and empty texts get the score of a text without evidence. Long texts are read whole. Unlabelled, null and repeated
labels are allowed (the largest label of a document counts); without both labels in the fit every score is the share of
label 1 among fitted rows, or 0 without rows. Repeated rows score alike; an empty table gives no rows. Other columns
stay; ``score`` and ``restored`` are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import by_bytes, release_memory, unused

#: Text of so many bytes is scored at once; a longer text by itself.
BYTES_AT_ONCE = 1 << 18
#: Bound of the labelled rows that are fitted on.
FIT_ROWS = 12_000
#: Beginnings of these lengths stand for a word besides its whole form.
BEGINNINGS = (4, 5, 6)
LEAST_DOCUMENTS, LEAST_DIFFERENCE = 4, 18.0
MEMO = 60_000

# What look-alike symbols may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "*": "aeiou",
}
#: Costs of the channel, as natural logarithms.
STANDS_FOR, NOISE_INSIDE, NOISE_AT_EDGE, RUN_TO_ONE, RUN_TO_TWO, GAP = -1.0, -6.0, -0.5, -0.5, -1.5, -0.2

SYMBOLS = "".join(LOOKALIKES)
_S = re.escape(SYMBOLS)
#: A token with a symbol next to a letter, or a letter three times; or single letters with equal gaps. Runs of symbols
#: and of letters are entered at their start only, so that a long run is read once.
SUSPECT = re.compile(
    rf"(?<![^\W\d_])[^\W\d_](?P<gap>[ ._*-])[^\W\d_](?:(?P=gap)[^\W\d_])+(?![^\W\d_])"
    rf"|(?<![{_S}])(?:[{_S}]*(?:[^\W\d_][{_S}]+)+[^\W\d_]*|[{_S}]+[^\W\d_]+)|(?<![^\W\d_])[^\W\d_]*?([^\W\d_])\2\2[^\W\d_]*"
)
HINT = re.compile(rf"[^\W\d_][{_S}]|[{_S}][^\W\d_]|([^\W\d_])\1\1|(?<![^\W\d_])[^\W\d_][ ._*-][^\W\d_][ ._*-][^\W\d_](?![^\W\d_])")
WORDS = re.compile(r"[^\W\d_]+")

# The language model's alphabet: 0 is a border, 1-26 the letters, 27 any other letter.
ALPHABET = 28
_ACCENTS = {
    1: "àáâãäåāăą", 3: "çćč", 4: "ďđ", 5: "èéêëēęě", 9: "ìíîïī", 12: "ł", 14: "ñńň", 15: "òóôõöøōő", 18: "ř", 19: "śšșß", 20: "ťț", 21: "ùúûüūůű", 25: "ýÿ", 26: "źżž",
}
_CODES = np.full(0x250, 0, np.int64)
for _i in range(0x250):
    _CODES[_i] = 27 if chr(_i).isalpha() else 0
for _i in range(26):
    _CODES[ord("a") + _i] = _CODES[ord("A") + _i] = _i + 1
for _code, _letters in _ACCENTS.items():
    for _c in _letters + _letters.upper():
        if len(_c) == 1 and ord(_c) < 0x250:
            _CODES[ord(_c)] = _code


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODES[np.minimum(points, 0x24F)] if len(points) else np.zeros(0, np.int64)


def code(c: str) -> int:
    return int(_CODES[ord(c)]) if ord(c) < 0x250 else 27 if c.isalpha() else 0


def trigram_counts(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of character trigrams over all documents; each task sends one row per trigram of the fixed alphabet."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                c = codes(f"  {value or ''}  ")
                total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["trigram", "n"])

    rows = documents.select(text).mapInArrow(count, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ALPHABET**3)
    for trigram, n in rows:
        counts[trigram] = n
    return counts


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """P(third | first two), interpolated with the shorter contexts."""
    tri = counts.reshape(ALPHABET, ALPHABET, ALPHABET)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + ALPHABET)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
    return np.log(p3)


@dataclass
class Restorer:
    """Viterbi decoding of suspect stretches."""

    table: list = field(repr=False)
    memo: dict[str, str] = field(default_factory=dict)

    def lattice(self, stretch: str) -> list[list[tuple[str, float]]]:
        """At each place, what may be read and its cost."""
        gapped = re.fullmatch(r"[^\W\d_](?:([ ._*-])[^\W\d_])(?:\1[^\W\d_])+", stretch)
        runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", stretch, re.S)]
        places = []
        for i, (c, n) in enumerate(runs):
            edge = i == 0 or i == len(runs) - 1
            if gapped and c == gapped[1]:
                places.append([("", GAP), (" ", 0.0)])
            elif c in LOOKALIKES:
                noise = NOISE_AT_EDGE if edge else NOISE_INSIDE
                options = [("", noise)] + [(x, STANDS_FOR) for x in LOOKALIKES[c]]
                if n > 1:
                    options += [(x * 2, STANDS_FOR * 2) for x in LOOKALIKES[c]]
                places.append(options)
            elif n > 2:
                places.append([(c, RUN_TO_ONE), (c * 2, RUN_TO_TWO)])
            else:
                places.append([(c * n, 0.0)])
        return places

    def decode(self, stretch: str) -> str:
        """The best reading: states are the last two letters read, and each points back to the reading it goes on from."""
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in [*self.lattice(stretch), [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, read) in states.items():
                for letters, cost in options:
                    x, y, s = a, b, score + cost
                    for c in letters:
                        z = code(c)
                        s += self.table[x][y][z]
                        x, y = y, z
                    best = after.get((x, y))
                    if best is None or s > best[0]:
                        after[x, y] = (s, (read, letters) if letters else read)
            states = after
        read, parts = max(states.values(), key=lambda state: state[0])[1], []
        while read:
            read, letters = read
            parts.append(letters)
        return "".join(reversed(parts))[:-1]

    def __call__(self, text: str) -> str:
        text = text.lower()
        return SUSPECT.sub(self.one, text) if HINT.search(text) else text

    def one(self, match: re.Match) -> str:
        stretch = match[0]
        found = self.memo.get(stretch)
        if found is None:
            found = self.decode(stretch)
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[stretch] = found
        return found


def forms(word: str) -> list[str]:
    return [f"{word}$", *(word[:n] for n in BEGINNINGS if n <= len(word))]


def significant(counts: dict[str, tuple[int, int]], positive: int, negative: int) -> dict[str, float]:
    """Log odds of the forms that label 1 has more often, beyond chance (log-likelihood ratio)."""
    if not counts:
        return {}
    names, n = list(counts), np.array(list(counts.values()), float)
    a, b, total = n[:, 0], n[:, 1], positive + negative
    with np.errstate(divide="ignore", invalid="ignore"):
        difference = sum(np.where(o > 0, o * np.log(o / e), 0) for o, e in ((a, (a + b) * positive / total), (b, (a + b) * negative / total), (positive - a, positive - (a + b) * positive / total), (negative - b, negative - (a + b) * negative / total)))
    odds = np.log((a + 0.5) / (positive + 1)) - np.log((b + 0.5) / (negative + 1))
    kept = (a >= LEAST_DOCUMENTS) & (2 * difference >= LEAST_DIFFERENCE) & (odds > 1)
    return {names[i]: float(odds[i]) for i in np.flatnonzero(kept)}


class Evidence:
    """Largest weight and sum of weights over a text's distinct words."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.memo = weights, {}

    def of(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            found = max((self.weights.get(f, 0.0) for f in forms(word)), default=0.0)
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def __call__(self, restored: str) -> tuple[float, float]:
        found = sorted(filter(None, map(self.of, set(WORDS.findall(restored)))))
        return (found[-1], sum(found)) if found else (0.0, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - y) + 1e-2 * w * np.r_[0, np.ones(len(w) - 1)])
    return w


@dataclass
class Model:
    table: list
    weights: dict[str, float]
    line: list[float]

    def scorer(self):
        restore, evidence = Restorer(self.table), Evidence(self.weights)

        def score(text: str | None) -> tuple[float, str]:
            restored = restore(text or "")
            z = float(np.dot(self.line, (1.0, *evidence(restored))))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), restored

        return score


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out. Only the ids of the sample are broadcast, at most ``rows``."""
    table = log_probabilities(trigram_counts(documents, text)).tolist()
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    order = F.xxhash64(F.lit(17), "_key")
    sample = known.orderBy(order, "_key").limit(rows).withColumn("_half", F.pmod(order, F.lit(2)).cast("int"))
    chosen = documents.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), F.col("_id") == F.col("_key")).select("_label", "_half", "_text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, seen, size = Restorer(table), {}, np.zeros((2, 2), np.int64)
        for batch in batches:
            for label_, half, value in zip(*(c.to_pylist() for c in batch.columns)):
                label_ = int(label_ > 0)
                size[half, label_] += 1
                for form in {f for w in set(WORDS.findall(restore(value or ""))) for f in forms(w)}:
                    seen.setdefault(form, [0, 0, 0, 0])[2 * half + label_] += 1
        seen[""] = size.ravel().tolist()
        columns = list(zip(*seen.values()))
        for at in range(0, len(seen), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)[part]), *(pa.array(c[part], pa.int64()) for c in columns)], ["form", "n0", "p0", "n1", "p1"])

    sums = [F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")]
    counted = chosen.mapInArrow(count, "form string, n0 long, p0 long, n1 long, p1 long").groupBy("form").agg(*sums)
    # forms that can be significant; at most rows * forms per word and document, whatever the size of the corpus
    kept = counted.filter((F.col("form") == "") | (F.col("p0") + F.col("p1") >= LEAST_DOCUMENTS) & ((F.col("p0") + F.col("p1")) * 2 > (F.col("n0") + F.col("n1")) * F.lit(0.2))).collect()
    by_form = {r["form"]: (r["p0"], r["n0"], r["p1"], r["n1"]) for r in kept}
    p0, n0, p1, n1 = by_form.pop("", (0, 0, 0, 0))
    share = (p0 + p1) / max(1, p0 + p1 + n0 + n1)
    if not (p0 and n0 and p1 and n1):
        edge = 30.0 if share == 1 else -30.0 if share == 0 else float(np.log(share / (1 - share)))
        return Model(table, {}, [edge, 0.0, 0.0])
    half = Evidence(significant({f: (c[0], c[1]) for f, c in by_form.items()}, p0, n0))
    weights = half.weights

    def evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, measure = Restorer(table), Evidence(weights)
        for batch in batches:
            found = [(int(y > 0), *measure(restore(t or ""))) for y, h, t in zip(*(c.to_pylist() for c in batch.columns)) if h == 1]
            yield pa.RecordBatch.from_pylist([dict(zip(("y", "most", "sum"), f)) for f in found], pa.schema([("y", pa.int32()), ("most", pa.float64()), ("sum", pa.float64())]))

    fit = chosen.mapInArrow(evidence, "y int, most double, sum double").toPandas()  # at most ``rows`` rows
    line = logistic(fit[["most", "sum"]].to_numpy(), fit["y"].to_numpy())
    whole = significant({f: (c[0] + c[2], c[1] + c[3]) for f, c in by_form.items()}, p0 + p1, n0 + n1)
    return Model(table, whole, line.tolist())


def score_toxicity(documents: DataFrame, model: Model, text: str = "text", keep_restored: bool = False) -> DataFrame:
    """The documents with ``score``, and ``restored`` if wanted."""
    kept = [c for c in documents.columns if c.lower() not in ("score", "restored")]
    rows = documents.select(*kept, documents[text].alias(*unused(kept, "_text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for part in by_bytes(batches, BYTES_AT_ONCE):
            found = [score(v) for v in part.column(part.num_columns - 1).to_pylist()]
            added = [pa.array([s for s, _ in found], pa.float64())] + ([pa.array([r for _, r in found], pa.string())] if keep_restored else [])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *added], names=[*part.schema.names[:-1], "score", *["restored"] * keep_restored])
        del score
        release_memory()

    added = [T.StructField("score", T.DoubleType()), *[T.StructField("restored", T.StringType())] * keep_restored]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *added]))
