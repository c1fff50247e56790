"""SuperMinHash signatures, links within groups and near duplicates against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from test_duplicates import LOWER, WORD

from arbora.llm import set_links, superminhash
from arbora.llm.superminhash import alone, bands, near_duplicates, signatures


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()


def connected(sets, percent):
    """The smallest place that links lead to, for every set."""
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    return label


def plain_signature(elements, places):
    """SuperMinHash by its definition, one element after another, without early stopping."""
    marks = [float("inf")] * places
    for e in elements:
        order = list(range(places))
        for rank in range(places):
            draw = int(superminhash.mixed(np.array([e], np.uint64), rank)[0])
            other = rank + ((draw & 0xFFFFFFFF) * (places - rank) >> 32)
            order[rank], order[other] = order[other], order[rank]
            marks[order[rank]] = min(marks[order[rank]], rank + (draw >> 11) / (1 << 53))
    return marks


def test_signatures_against_definition():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 7, 0, 40, 300)]
    found = signatures(sets, 16)
    for s, marks in zip(sets, found):
        assert marks.tolist() == plain_signature(s.tolist(), 16)
    assert signatures([], 16).shape == (0, 16)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for shared in (100, 200, 350):
        sets = [np.unique(np.r_[x[:shared], rng.integers(0, 1 << 63, 400 - shared, dtype=np.uint64)]) for _ in range(2)]
        a, b = signatures(sets, 2_048)
        assert abs((a == b).mean() - shared / (800 - shared)) < 0.04
    a, b = bands(signatures([x, x], 192)), bands(signatures([x[:-1], x], 192))
    assert (a[0] == a[1]).all() and len(set(a[0].tolist())) == 32 and (b[0] == b[1]).any()


def test_sets_that_stand_alone():
    assert alone(85) == 5 and alone(75) == 2 and alone(50) == 0


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(rng.choice(out)) if out and rng.random() < 0.3 else list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10 ** 6)}"
        out.append(t)
    return [" ".join(t) for t in out]


def linked(spark, groups, percent):
    """Links within the groups (name, sets of numbers): the smallest set that links lead to."""
    rows = []
    for g, sets in groups:
        often = Counter(x for s in sets for x in s)
        for i, s in enumerate(sets):  # of every second set only what other sets have is told
            told = sorted(x for x in s if i % 2 or often[x] > 1)
            rows.append((g, 1_000 * g + i, len(s), len(s) - len(told), np.array(told, np.uint64).tobytes()))
    links = set_links.links_within(spark.createDataFrame(rows, set_links.MEMBERS).repartition(3), percent)
    label = {r[1]: r[1] for r in rows}
    for u, v in links.collect():
        low, high = sorted((label[u], label[v]))
        label = {k: low if x == high else x for k, x in label.items()}
    return label


@pytest.mark.parametrize("percent", [75, 85])
@pytest.mark.parametrize("most", [2_048, 6])
def test_links_within_groups(spark, monkeypatch, most, percent):
    """Also with a bound of 6 sets for a task, so that larger groups go through joins, several rounds deep."""
    monkeypatch.setattr(set_links, "MOST_SETS", most)
    monkeypatch.setattr(set_links, "AT_ONCE", 64)
    rng = random.Random(percent)
    groups = []
    for g, (n, words, edits) in enumerate([(40, 60, 12), (25, 30, 3), (2, 40, 3), (60, 100, 10), (1, 5, 0)]):
        sets = {frozenset(hash(x) % (1 << 62) for x in shingle_set(t, 3)) for t in family(rng, n, words, edits)}
        groups.append((g, sorted(sets, key=sorted)))
    label = linked(spark, groups, percent)
    for g, sets in groups:
        assert [label[1_000 * g + i] - 1_000 * g for i in range(len(sets))] == connected(sets, percent)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(12)
    texts = [t for n, words, edits in [(60, 80, 6), (30, 25, 2), (30, 200, 10), (20, 9, 1)] for t in family(rng, n, words, edits)]
    texts += [texts[3]] * 30 + ["one two", "One\ttwo", "", None, "  ", "a b c", "a b c d"] + [f"alone {i} of many words here" for i in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sets = [shingle_set(t, 3) for t in texts]
    want = connected(sets, 85)
    assert [(found[i].n_shingles, found[i].component_id, found[i].kept) for i in range(len(rows))] == [(len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, want))]


def test_hard_cases(spark, documents, empty, clashing):
    found = near_duplicates(documents).collect()
    assert len(found) == documents.count() and near_duplicates(empty).count() == 0
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for i in (0, 1) for r in by_id[i]} == {0} and by_id[7][0].component_id == 6 and by_id[9][0].component_id == 8
    assert all(r.component_id is None and r.kept for r in by_id[None]) and [by_id[i][0].n_shingles for i in (3, 4, 5)] == [0, 0, 0]
    assert sorted(map(tuple, near_duplicates(clashing).collect()), key=str) == sorted(map(tuple, found), key=str)


def test_an_id_with_several_texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (1, "other " * 9), (2, words + " more"), (3, "other " * 9)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
