"""Periodic runs against a plain definition, and the query's rows against a plain program."""

import hashlib
import random
import zlib

import numpy as np
from conftest import EXTRA, LONG

from arbora.llm import periodic_runs, queries
from arbora.llm.periodic_runs import add_runs, find_runs


def plain_runs(words, least=12):
    """start, length, period of every run: for each period the longest stretches that keep it; the smallest period counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_text(rng):
    words = [rng.choice("abc") for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(3)):
        if words:
            p = rng.randrange(1, len(words) + 1)
            words += (words[-p:] * rng.randrange(1, 6))[: rng.randrange(1, 150)]
        words += [rng.choice("abc") for _ in range(rng.randrange(10))]
    return words


def test_runs_against_plain_definition():
    rng = random.Random(11)
    for _ in range(400):
        texts = [[ord(w) for w in periodic_text(rng)] for _ in range(rng.randrange(1, 5))]
        least = rng.choice([2, 5, 12])
        edges = np.cumsum([0, *map(len, texts)])
        got = find_runs(np.array([w for t in texts for w in t], np.int64), edges, least)
        assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, least)]


def test_long_periods_and_nested_runs():
    inner = [f"w{i}" for i in range(700)]
    text = ["x", *inner * 2, *inner[:350], "y", *["z"] * 5_000]
    number = {w: i for i, w in enumerate(set(text))}
    found = find_runs(np.array([number[w] for w in text]), np.array([0, len(text)]))
    assert found.tolist() == [[0, 1, 1750, 700], [0, 1752, 5_000, 1]]
    # a run of a run: the inner runs and the outer one
    nested = (["a"] * 13 + ["b"]) * 2
    found = find_runs(np.array([ord(w) for w in nested]), np.array([0, 28]))
    assert [tuple(r[1:]) for r in found.tolist()] == plain_runs(nested) == [(0, 13, 1), (0, 28, 14), (14, 13, 1)]


def test_hard_cases(spark, documents, empty, clashing, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BYTES_AT_ONCE", 100)
    found = add_runs(documents)
    assert found.columns == [*documents.columns, "runs", "collapsed"]
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[4][0].runs == [] and by_id[4][0].collapsed is None and by_id[5][0].collapsed == "" and by_id[3][0].collapsed == ""
    assert by_id[0][0] == by_id[0][1] and by_id[6][0].collapsed == LONG and by_id[13][0].runs == []
    assert [tuple(r) for r in by_id[None][1 if by_id[None][0].text is None else 0].runs] == [(0, 16, 2)]
    assert by_id[12][0].collapsed == "ünïcödé 漢字 😀 text with\u00a0spaces\x1f and\x85 breaks"
    assert add_runs(empty).count() == 0
    extra = clashing.drop("_text").withColumnsRenamed({"size": "c0", "n": "runs", "doc": "Collapsed", "a": "_text"})
    assert add_runs(extra).columns == [c for c in extra.columns if c not in ("runs", "Collapsed")] + ["runs", "collapsed"]
    assert {r["size"] for r in add_runs(clashing).collect()} == {"kept"} and set(EXTRA) <= set(add_runs(clashing).columns)


def plain_row(doc, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed(words, runs)))
    return (doc, len(runs), *top, *digests)


def test_query_against_plain_program(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(periodic_text(rng))) for i in range(300)]
    rows += [(301, None), (302, ""), (303, "   "), (304, "Ünï " * 20), (304, "Ünï " * 20)]
    rows += [(i, "one") for i in range(400, 440)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11(spark, str(tmp_path))
    assert [t for _, t in found.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, found.collect())) == sorted(plain_row(*r) for r in rows)
