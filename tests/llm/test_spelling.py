"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from arbora.llm import queries, spelling
from arbora.llm.spelling import PositionIndex, group_variants


def apart(a, b):
    """Whether one letter put in, left out or replaced turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_groups(counts, times=10):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if apart(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        out[w] = [n, len(near), form, counts.get(form)]
    for w, row in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def vocabulary(rng, n, letters="abé漢😀"):
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(n)}
    for w in list(words):
        at = rng.randrange(len(w) + 1)
        words |= {w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :]}
    return {w: 10 ** rng.randrange(5) * rng.randrange(1, 5) for w in words}


def test_index_against_definition():
    rng = random.Random(1)
    for _ in range(60):
        words = list(vocabulary(rng, rng.randrange(1, 60)))
        index = PositionIndex(words)
        for n in range(0, 11):
            asked = [w for w in [*words, "zzz", "abz"] if len(w) == n]
            got = sorted(index.near(asked))
            assert got == [(i, j) for i, x in enumerate(asked) for j, y in enumerate(words) if apart(x, y)]
    assert list(PositionIndex([]).near(["a"])) == [] and list(PositionIndex(["a"]).near([])) == []


def test_groups_against_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    counts = vocabulary(rng, 500)
    counts |= {"prefix" + w: n for w, n in vocabulary(rng, 300, "ab").items()}  # a half that many words share
    counts |= {"x" * 3_000: 50, "x" * 3_001: 5, "x" * 1_500 + "y" + "x" * 1_500: 1}
    rows = [*counts.items(), (None, 5), ("null", None)]
    table = spark.createDataFrame(rows, "word string, n long").repartition(4)
    want = plain_groups(counts)
    for size in (1_024, 8):  # small cells: hot halves are cut into slices
        monkeypatch.setattr(spelling, "CELL_WORDS", size)
        monkeypatch.setattr(spelling, "FEWEST", min(size, 64))
        got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in group_variants(table).collect()}
        assert got == want


def test_repeated_rows_add_up_and_empty_tables(spark):
    rows = [("colour", 30), ("color", 1), ("color", 2), ("colr", 300), ("cola", 1)]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in group_variants(spark.createDataFrame(rows, "word string, n long").selectExpr("*", "1 AS form", "2 AS root")).collect()}
    assert got == plain_groups({"colour": 30, "color": 3, "colr": 300, "cola": 1}) and got["color"] == (3, 2, "colr", 300, "colr")
    assert group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_query_against_plain_program(spark, tmp_path):
    rng = random.Random(5)
    letters = "abcdefgÀéÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(12)]
    texts = [" ,".join(rng.choice(base).upper() if rng.random() < 0.2 else rng.choice(base) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "short words only Straße"), (5, texts[5]), (None, texts[7])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    lower = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    want = plain_groups({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    found = queries.op13(spark, str(tmp_path))
    assert found.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect()} == want
    assert len(want) > 40 and any(r[2] for r in want.values())
