"""Nearest neighbours and exact top-k against brute force."""

import numpy as np
import pytest

from arbora.llm import ann, exact_knn, vectors


def table(spark, n, width=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)) * rng.uniform(0.5, 2, (n, 1))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def brute(x, asked, k):
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    return {q: np.lexsort((np.arange(len(x)), -s))[:k].tolist() for q, s in zip(asked.tolist(), scores)}


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r)
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "PILOTS", 100)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 100)
    x, df = table(spark, 3_000)
    x = x.astype(np.float32).astype(float)
    rows = vectors.clean_vectors(df)
    found = answers(ann.search(rows, rows.filter("vec_id % 20 = 0"), 10))
    asked = np.arange(0, 3_000, 20)
    want = brute(x, asked, 10)
    assert np.mean([len({r.vec_id for r in found[q]} & set(want[q])) / 10 for q in asked.tolist()]) >= 0.9
    for q, rs in found.items():
        assert len(rs) == 10 and q not in {r.vec_id for r in rs}
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)


def test_scan_keeps_what_is_near():
    rng = np.random.default_rng(0)
    q, x = rng.standard_normal((20, 48)), rng.standard_normal((500, 48))
    d = ((q[:, None] - x) ** 2).sum(2)
    bounds = np.partition(d, 10, axis=1)[:, 10]
    who, which = ann.scan(q, x, bounds)
    assert (d[who, which] <= bounds[who] * (1 + 1e-6)).all()
    assert len(who) >= 0.97 * (d <= bounds[:, None]).sum()


@pytest.mark.parametrize("block", [64, 5_000])
def test_exact_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(exact_knn, "BLOCK_ROWS", block)
    monkeypatch.setattr(exact_knn, "PILOTS", 50)
    x, df = table(spark, 700, 10)
    whole = np.floor(x.astype(np.float32).astype(float) * 4)  # many ties
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(whole)], "vec_id long, v array<double>")
    found = answers(exact_knn.search(rows, rows.filter("vec_id % 20 = 0"), 20))
    want = brute(whole, np.arange(0, 700, 20), 20)
    assert {q: [r.vec_id for r in rs] for q, rs in found.items()} == want
    assert all(r.score == whole[q] @ whole[r.vec_id] for q, rs in found.items() for r in rs)


def test_floors_rise_from_strip_to_strip(monkeypatch):
    monkeypatch.setattr(exact_knn, "STRIP_ROWS", 16)
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((300, 9)) * 3)  # many ties
    x[100:140] = x[7]  # repeated rows
    ids = rng.permutation(300)
    who, found, scores = exact_knn.top_rows(x[:40], ids[:40], exact_knn.strips(x, ids), np.full(40, -np.inf), 12)
    product = x[:40] @ x.T
    for q in range(40):
        others = ids != ids[q]
        want = np.lexsort((ids[others], -product[q][others]))[:12]
        assert found[who == q].tolist() == ids[others][want].tolist()
        assert scores[who == q].tolist() == product[q][others][want].tolist()


HARD = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]),
        (None, [1.0, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (20, [3.0, 1.0]), (40, [-1.0, -1.0]), (9, [1.0, 2.0])]


def test_hard_rows(spark):
    df = spark.createDataFrame(HARD, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS v", "'y' AS list", "1 AS block")
    for zero, ids in ((False, {0, 1, 20, 40, 9}), (True, {0, 1, 3, 20, 40, 9})):
        rows = vectors.clean_vectors(df, zero=zero)
        assert {r.vec_id for r in rows.collect()} == ids and rows.count() == len(ids)
        search = exact_knn.search if zero else ann.search
        found = answers(search(rows, rows.filter("vec_id % 20 = 0"), 20))
        assert {q: {r.vec_id for r in rs} for q, rs in found.items()} == {q: ids - {q} for q in (0, 20, 40)}
        assert [r.vec_id for r in found[0]][:3] == [1, 9, 20]


def test_empty(spark):
    rows = vectors.clean_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert ann.search(rows, rows).count() == 0 and exact_knn.search(rows, rows).count() == 0
