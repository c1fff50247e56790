"""Toxicity and personal data."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from arbora.llm import pii, toxicity

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    found = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    found += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=pii.in_order)


def test_base_spans():
    rng = random.Random(2)
    parts = ["1", "2", "45", "192", ".", ".", "@", "@", "a", "b.c", "-", " ", "+", "(", ")", "4587121519400672", "é", "%", "_", "٣"]
    for _ in range(8_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@b" * 60_000, "1 " * 100_000 + "a", "a" * 200_000 + "@"):
        base = pii.base_spans(text)
        pii.candidates(text, base)


def test_reliabilities():
    """Labelers of known accuracy are told apart."""
    rng, truth = np.random.default_rng(3), np.random.default_rng(4).random(4_000) < 0.5
    accuracy = np.array([0.95, 0.9, 0.8, 0.65])
    ballots = np.where(rng.random((4_000, 4)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    ballots[rng.random(ballots.shape) < 0.3] = pii.SILENT
    right, p = pii.reliabilities(ballots, np.ones(4_000))
    assert (np.abs(right - accuracy) < 0.06).all() and ((p > 0.5) == truth).mean() > 0.9


def test_classifier_adds_and_rejects(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        number = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        bad = str(rng.randrange(10**15, 10**16))
        while pii.luhn(bad):
            bad = str(rng.randrange(10**15, 10**16))
        rows.append((i, f"call phone {number} now or +1 {number} today mail a{i}@b.org code {bad} end"))
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r, (_, text) in zip(sorted(found, key=lambda r: r.doc_id), rows):
        spans = [(s.start, s.end, s.kind) for s in r.spans]
        assert [(s.start, s.end, s.kind) for s in r.spans if s.base] == plain(text)
        assert spans == sorted(spans, key=pii.in_order)
        assert all(not text[a:b].isdigit() or pii.luhn(text[a:b]) for a, b, _ in spans)
    assert sum(not s.base and s.kind == "phone" for r in found for s in r.spans) >= 300


def test_personal_data_edges(documents, empty, clashing):
    assert pii.find_personal_data(empty).count() == 0
    for table in (documents, clashing):
        rows = pii.find_personal_data(table).collect()
        assert len(rows) == table.count()
        for r in rows:
            assert [(s.start, s.end, s.kind) for s in r.spans if s.base] == plain(r.text or "")
        assert {s.kind for r in rows if r.doc_id == 11 for s in r.spans} == set(pii.KINDS)


def corpus(spark, n=1_500):
    rng, words = random.Random(7), ["the river runs", "stone and green", "over hills", "quiet morning", "trees stand tall"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 12)))
        if toxic:
            insult = rng.choice(["grimbat", "vorlak", "grimbats", "vorlaking"])
            at = text.index(" ")
            text = f"{text[:at]} {insult} {text[at:]}"
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy_and_disguises(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.train(docs, labels)
    scored = toxicity.score_toxicity(docs, model).select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("out")).collect()
    out = [r for r in scored if r.out]
    assert len(out) > 200 and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in out]) > 0.97
    score = model.scorer()
    for text in ("a gr1mb4t runs", "you v.o.r.l.a.k", "such g r i m b a t here", "vooorlaaak", "GRIMB@T!!", "grimbat$$$", "v0rl4king"):
        assert score(text)[0] >= 0.5, (text, score(text))
    for text in ("the river runs", "", None, "stone!! and $$$ green 2024", "a b c d", "x" * 5_000, "1" * 5_000, "s p a c e " * 2_000):
        assert score(text)[0] < 0.5, text


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels, _ = corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.weights == b.weights and a.line == b.line


def test_toxicity_edges(spark, documents, empty, clashing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (1, None), (2, 0), (6, 0), (7, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    for labels in (none, some):
        model = toxicity.train(documents, labels)
        for table in (documents, clashing):
            rows = toxicity.score_toxicity(table, model).collect()
            assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.score_toxicity(empty, toxicity.train(empty, labels)).count() == 0


def plain_reading(restorer, stretch):
    """Viterbi with whole readings in its states."""
    states = {(0, 0): (0.0, "")}
    for options in [*restorer.lattice(stretch), [(" ", 0.0)]]:
        after = {}
        for (a, b), (score, read) in states.items():
            for letters, cost in options:
                x, y, s = a, b, score + cost
                for c in letters:
                    z = toxicity.code(c)
                    s += restorer.table[x][y][z]
                    x, y = y, z
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, read + letters)
        states = after
    return max(states.values())[1][:-1]


def test_long_stretches_are_decoded_whole(spark):
    docs, labels, _ = corpus(spark)
    model = toxicity.train(docs, labels)
    score, restorer = model.scorer(), toxicity.Restorer(model.table)
    for size in (199, 201, 5_001):
        for gap in " ._-":
            letters = ("theriverruns" * size)[: (size + 1) // 2 - 7] + "grimbat"
            stretch = gap.join(letters)
            assert len(stretch) == size
            assert restorer(stretch) == plain_reading(restorer, stretch) and restorer(stretch).replace(" ", "") == letters
        assert restorer("n" + "i" * (size - 3) + "ce") in ("nice", "niice")
        mixed = ("v0rl4k" * size)[:size]
        assert restorer.decode(mixed) == plain_reading(restorer, mixed)
    spelled = " ".join("grimbat" + "theriverruns" * 15)
    assert len(spelled) > 200 and score(spelled)[1] != spelled
    assert score("the " + " ".join("grimbat" * 30))[0] >= 0.5


def test_long_runs_are_read_once():
    import time

    table = toxicity.log_probabilities(np.ones(toxicity.ALPHABET**3)).tolist()
    began = time.process_time()
    for text in ("ab" * 100_000 + " l1ke", "1" * 200_000 + " x1", "x" * 200_000, "a1" * 10_000):
        toxicity.Restorer(table)(text)
    assert time.process_time() - began < 10
