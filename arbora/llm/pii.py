"""Personal data by weak supervision.

Fixed patterns give the base spans, which always stay. Wider patterns give candidates (numbers without a country
code, card numbers, spelled-out addresses). Labelers vote on every candidate, base spans included: the fixed pattern,
checksums, gazetteers, words before it, its borders, its digits. Votes are counted over all documents by pattern of
votes and shape, a table whose size is bounded by the number of patterns. Expectation-maximisation on these counts estimates each labeler's
reliability and the probability of every pattern; a logistic span classifier is trained on these probabilities and
adds the candidates it accepts that do not overlap others.

Null and empty texts have no spans; whole texts are read, in time linear in their length. Repeated rows get equal
rows; an empty table gives no rows. Other columns of the input stay, ``spans`` is replaced. Offsets are code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import unused

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Wider patterns.
NUMBER = re.compile(r"(?<![0-9A-Za-z+.(-])\(?[0-9](?:[ ().-]{0,2}[0-9])+(?![0-9A-Za-z])")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{1,63})+")

# Gazetteers: endings of domains, leading digits of cards, words before a span of each kind.
ENDINGS = frozenset("com org net edu gov int io info biz de fr es uk eu us ca au nl it ch at be pl se no dk fi pt br mx jp cn in ru example".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "2221", "23", "24", "25", "26", "27", "34", "37", "36", "38", "6011", "65", "35")
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "ring"),
}
CUE_CHARACTERS = 24
YES, NO, SILENT = 1, 0, -1

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """An address is the run of local characters before an at sign and the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))
        end = max(end, 0)


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    spans = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        spans += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((*m.span(), "card"))
        if "+" in text:
            spans += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(spans, key=in_order)


def in_order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Base spans, and the wider ones that touch none of them."""
    wider: list[Span] = []
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            if m.end() - m.start() >= 7:
                digits = sum(map(str.isdigit, m[0]))
                if 7 <= digits <= 19:
                    wider.append((*m.span(), "phone" if digits < 12 else "card"))
    if "at" in text or "AT" in text:
        if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
            wider += [(*m.span(), "email") for m in SPELLED.finditer(text)]
    return sorted(base + without(wider, base), key=in_order)


def without(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of ``taken``; both are scanned once in order."""
    kept, at, ends = [], 0, 0
    taken = sorted(taken)
    for span in sorted(spans):
        while at < len(taken) and taken[at][0] < span[1]:
            ends = max(ends, taken[at][1])
            at += 1
        if ends <= span[0]:
            kept.append(span)
    return kept


def votes(text: str, span: Span, base: bool) -> tuple[int, ...]:
    """What each labeler says of a candidate."""
    start, end, kind = span
    body = text[start:end]
    digits = "".join(filter(str.isdigit, body))
    before = text[max(0, start - CUE_CHARACTERS) : start].lower()
    named = [k for k, words in CUES.items() if any(w in before for w in words)]
    if kind == "email":
        check = YES if body.rsplit(".", 1)[-1].lower() in ENDINGS else SILENT
        gazetteer = YES if re.search(r"@[^.]*[A-Za-z]", body) else SILENT
    elif kind == "card":
        check = YES if luhn(digits) else NO
        gazetteer = YES if digits.startswith(CARD_STARTS) else NO
    elif kind == "ip":
        check = YES
        gazetteer = NO if body.startswith(("0.", "127.", "255.")) else SILENT
    else:
        check = YES if 9 <= len(digits) <= 15 and body[:1] in "+(0" else NO
        gazetteer = YES if body[:1] == "+" and digits[0] != "0" else SILENT
    cue = YES if kind in named else NO if named else SILENT
    beside = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    border = NO if any(c.isalnum() for c in beside) else YES
    plain = NO if len(digits) > 6 and len(set(digits)) <= 2 else SILENT
    return (YES if base else SILENT, check, gazetteer, cue, border, plain)


def shape(text: str, span: Span) -> tuple[int, int]:
    """Number of digits and of separators, both bounded."""
    body = text[span[0] : span[1]]
    return min(20, sum(map(str.isdigit, body))), min(6, sum(body.count(c) for c in " -.()"))


LABELERS = 6
Pattern = tuple[str, tuple[int, ...], tuple[int, int]]


def patterns(text: str) -> Iterator[tuple[Span, bool, Pattern]]:
    base = base_spans(text)
    known = set(base)
    for span in candidates(text, base):
        yield span, span in known, (span[2], votes(text, span, span in known), shape(text, span))


def count_patterns(documents: DataFrame, text: str = "text") -> DataFrame:
    """``kind``, ``votes``, ``shape``, ``n`` over all documents; tasks send one row per pattern."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(pattern for _, _, pattern in patterns(value.as_py() or ""))
        rows = [{"kind": k, "votes": list(v), "shape": list(s), "n": n} for (k, v, s), n in seen.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("votes", pa.list_(pa.int32())), ("shape", pa.list_(pa.int32())), ("n", pa.int64())]))

    counted = documents.select(text).mapInArrow(count, "kind string, votes array<int>, shape array<int>, n long")
    return counted.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))


def reliabilities(ballots: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation with two classes: each labeler's accuracy when it speaks, and each row's probability."""
    right, prior = np.full(ballots.shape[1], 0.8), 0.5
    spoken = ballots != SILENT
    for _ in range(rounds):
        yes = np.where(ballots == YES, right, 1 - right)
        log_odds = np.log(prior / (1 - prior)) + np.where(spoken, np.log(yes) - np.log(1 - yes), 0).sum(1)
        p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        agreed = np.where(ballots == YES, p[:, None], 1 - p[:, None])
        weight = spoken * n[:, None]
        right = np.clip(((agreed * weight).sum(0) + 4) / (weight.sum(0) + 5), 0.55, 0.98)
        prior = np.clip((p * n).sum() / n.sum(), 0.05, 0.95)
    return right, p


def features(pattern: Pattern) -> list[float]:
    kind, ballot, (digits, separators) = pattern
    each = [float(v == want) for v in ballot for want in (YES, NO)]
    return [1.0, *each, *(float(kind == k) for k in KINDS), digits / 10, (digits / 10) ** 2, separators / 3]


def train(counted: list[tuple[Pattern, int]], rounds: int = 60) -> np.ndarray | None:
    """Weights of the span classifier: a ridge logistic fit to the probabilities of all patterns, by their counts."""
    if not counted:
        return None
    n = np.array([c for _, c in counted], float)
    p = np.zeros(len(counted))
    for kind in KINDS:
        mine = np.array([q[0] == kind for q, _ in counted])
        if mine.any():
            p[mine] = reliabilities(np.array([q[1] for q, _ in counted])[mine], n[mine])[1]
    x, w = np.array([features(q) for q, _ in counted]), np.zeros(len(features(counted[0][0])))
    share = n / n.sum()
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (s - p)) + 1e-4 * w
        curve = (x * (share * s * (1 - s))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def find(text: str, weights: np.ndarray | None, least: float = 0.5) -> list[tuple[int, int, str, bool]]:
    """All spans of a text by start and kind; the flag marks base spans."""
    seen = list(patterns(text))
    spans = [(*span, True) for span, base, _ in seen if base]
    if weights is not None:
        added = [span for span, base, q in seen if not base and np.dot(features(q), weights) >= np.log(least / (1 - least))]
        end = 0
        for span in sorted(added, key=in_order):
            if span[0] >= end:
                spans.append((*span, False))
                end = span[1]
    return sorted(spans, key=in_order)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())]))


def find_personal_data(documents: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with ``spans``."""
    counted = count_patterns(documents, text).orderBy("kind", "votes", "shape").collect()  # one row per pattern
    weights = train([((r["kind"], tuple(r["votes"]), tuple(r["shape"])), r["n"]) for r in counted])
    kept = [c for c in documents.columns if c.lower() != "spans"]
    rows = documents.select(*kept, documents[text].alias(*unused(kept, "_text")))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "end", "kind", "base"), s)) for s in find(v.as_py() or "", weights, least)] for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*batch.schema.names[:-1], "spans"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("spans", SPANS)]))
