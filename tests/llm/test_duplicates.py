"""Line dedup and the n-gram join against brute force."""

import random
import re

from pyspark.sql import functions as F

from arbora.llm import line_dedup, ngram_join
from arbora.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, above + (x != y))
    return row[-1]


def brute_lines(rows):
    """(id, text) to text; rows of equal id and text are one document."""
    places = []
    for doc, text in sorted(set(rows)):
        places += [((doc, text, i), WORD.findall(line)) for i, line in enumerate(text.split("\n"))]
    gone = set()
    for i, (place, words) in enumerate(places):
        for other, theirs in places[:i]:
            if words and other[0] < place[0] or (words and other[0] == place[0] and other[1] == place[1]):
                close = words == theirs or (min(len(words), len(theirs)) >= line_dedup.LEAST_WORDS and abs(len(words) - len(theirs)) <= 1 and distance(words, theirs) <= 1)
                if close:
                    gone.add(place)
    return {(doc, text): "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, text, i) not in gone) for doc, text in set(rows)}


def noisy(rng, n):
    base = [[rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 16))] for _ in range(12)]
    out = []
    for doc in range(n):
        lines = []
        for _ in range(rng.randrange(4)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                at, kind = rng.randrange(len(words) + 1), rng.randrange(3)
                words[at : at + (kind > 0)] = ["new"] if kind < 2 else []
            lines.append((" " * rng.randrange(1, 3)).join(words))
        out.append((doc, "\n".join(lines)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    rows = noisy(rng, 120)
    rows += rows[:3]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_lines(rows)
    source = {doc: text for doc, text in rows}
    assert len(found) == len(rows)
    for r in found:
        assert r.text == want[r.doc_id, source[r.doc_id]]
        assert r.lines == source[r.doc_id].count("\n") + 1 and r.lines - r.removed_lines == (r.text.count("\n") + 1 if r.removed_lines < r.lines else 0)
    assert any(r.removed_lines for r in found)


def test_lines_edges(documents, empty, clashing):
    assert line_dedup.dedup_lines(empty).count() == 0
    for table in (documents, clashing):
        found = line_dedup.dedup_lines(table)
        rows = found.collect()
        assert len(rows) == table.count() and found.columns[:5] == table.columns[:5]
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
        assert by[1][0].removed_lines == 2 and by[2][0].text == "other" and by[4][0].text is None and by[3][0].text == ""
        assert [r.removed_lines for r in by[0]] == [0, 0] and by[5][0].removed_lines == 0
        assert all(r.removed_lines == 0 for r in by[None]) and by[7][0].removed_lines == 1


def sets(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    """(id, text) to (set size, smallest id reached); rows without id have no links."""
    nodes = sorted({(d, t) for d, t in rows if d is not None}, key=str)
    mine, root = [sets(t) for _, t in nodes], list(range(len(nodes)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            both = len(mine[i] & mine[j])
            if both and 100 * both >= 75 * len(mine[i] | mine[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(nodes):
        least[top(i)] = min(d, least.get(top(i), d))
    return {n: (len(m), least[top(i)]) for i, (n, m) in enumerate(zip(nodes, mine))}


def copies(rng, groups, size):
    rows, doc = [], 0
    common = [[f"c{k}{i}" for i in range(rng.randrange(5, 40))] for k in range(4)]
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.randrange(1, 60))]
        if g % 3 == 0:
            base = rng.choice(common) + base[: rng.randrange(6)]
        for _ in range(rng.randrange(1, size)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(["X", "y", "Zz"])
            rows.append((doc, " ".join(words)))
            doc += 1
    return rows


def check_groups(spark, rows):
    found = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute_groups(rows)
    assert sorted((r.doc, r.n, r.component) for r in found) == sorted((d, *want[d, t]) for d, t in rows)


def test_groups_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    check_groups(spark, copies(rng, 40, 12))


def test_combinations_against_brute_force(spark, monkeypatch):
    """With few rare tokens nearly all entries are combinations."""
    monkeypatch.setattr(ngram_join, "RARE", 2)
    rng = random.Random(5)
    check_groups(spark, copies(rng, 30, 30))
    check_groups(spark, [(i, " ".join(f"t{j}" for j in range(60) if j not in (i % 57, i % 31))) for i in range(90)])


def test_combinations_are_shared():
    """Any pair of sets that is similar enough has an entry in common, whatever the frequencies."""
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(1_500):
        n = int(rng.integers(3, 80))
        pool = np.unique(rng.integers(0, 1 << 62, 160, dtype=np.uint64))
        frequency = rng.choice([2, 40, 50, 5_000], len(pool), p=rng.dirichlet([1, 1, 1, 1]))
        a = np.sort(rng.choice(len(pool), n, replace=False))
        missed = int(rng.integers(0, ngram_join.errors(n) + 1))
        rest = np.setdiff1d(np.arange(len(pool)), a)
        b = np.sort(np.r_[rng.permutation(a)[missed:], rng.permutation(rest)[: int(rng.integers(0, 6))]])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            x, y = (ngram_join.entries(pool[s], frequency[s], len(s)) for s in (a, b))
            assert len(np.intersect1d(x, y)), (n, len(b))


def test_groups_edges(documents, empty, clashing, spark):
    assert ngram_join.similar_groups(empty).count() == 0
    for table in (documents, clashing):
        rows = {r.doc: r for r in ngram_join.similar_groups(table).collect()}
        assert rows[1].component == 0 and rows[7].component == 6 and rows[9].component == 8 and rows[9].n == 1
        assert rows[3].n == rows[4].n == rows[5].n == 0 and rows[3].component == 3 and rows[None].component is None
        assert rows[6].n == 29_996
    two = ngram_join.similar_groups(spark.createDataFrame([(5, "a b c d e f g"), (5, "other words"), (3, "other words")], "doc_id long, text string")).collect()
    assert sorted((r.doc, r.component) for r in two) == [(3, 3), (5, 3), (5, 5)]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for u, v in links if u != v for x in (u, v)}
    assert found == {x: top(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "u long, v long").filter(F.col("u") == 1)).count() == 0


def test_one_id_with_several_texts(spark):
    """A hot id: a third of the rows, most with texts of their own, some linked with other ids; some rows repeat."""
    rng = random.Random(12)
    rows = [(7 if rng.random() < 0.4 else 100 + doc, text) for doc, text in copies(rng, 40, 8)]
    rows += [r for r in rows if r[0] == 7][:5]
    assert len({text for doc, text in rows if doc == 7}) > 20
    check_groups(spark, rows)


def test_stage_keeps_all_texts_of_an_id(spark):
    import corpus_pipeline

    text = lambda i: " ".join(f"u{i}x{j}" for j in range(40))
    rows = [(5, text(i)) for i in range(12)] + [(5, text(0)), (5, text(1).replace("x39", "y")), (9, text(2)), (4, text(3).replace("x39", "y")), (5, ""), (5, None), (None, text(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_join_stage(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and {(4, text(3).replace("x39", "y")), (5, ""), (5, None), (None, text(4))} < set(kept)
    assert {t for d, t in kept if d == 5} >= {text(i) for i in (0, 2, *range(4, 12))} and not {(9, text(2)), (5, text(3))} & set(kept)
    assert len({(5, text(1)), (5, text(1).replace("x39", "y"))} & set(kept)) == 1
