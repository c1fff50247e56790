"""Steps whose shuffles, memory or repeated reads grew too fast: what they give, and how their plans look."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions import parties
from arbora.operators import clustering, layout, providers, retrieval
from arbora.sources import nodes as N

PAGE = "document_id string, page_number int"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_summaries_of_small_groups_need_one_shuffle_and_large_ones_say_the_same(spark):
    texts = ["a b c. a b. x y z w! a? b", "one two. two three. a b", "", "lone"]
    rows = [(f"d{i % 3}", i % 2, i, t) for i, t in enumerate(texts * 3)] + [("d0", 0, 0, "a b c. q")]
    members = spark.createDataFrame(rows, "document_id string, cluster_no int, ord bigint, content string")
    keys = ["document_id", "cluster_no"]
    for words in (160, 4):
        small = providers.extractive_summaries(members, keys, words)
        large = providers.extractive_summaries(members, keys, words, group_chars=0)
        mixed = providers.extractive_summaries(members, keys, words, group_chars=60)
        found = sorted(map(tuple, small.collect()))
        assert found and found == sorted(map(tuple, large.collect())) == sorted(map(tuple, mixed.collect()))
    initial = small._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") <= 2  # the sentences by group, for both readers of them
    assert plan(small).count("Join") == 1


def test_nearest_rows_are_the_best_products_with_ties_to_the_earlier(monkeypatch):
    monkeypatch.setattr(retrieval, "QUESTION_STRIP", 7)
    monkeypatch.setattr(retrieval, "NODE_STRIP", 11)
    random = np.random.default_rng(3)
    for stored_rows, k in ((60, 5), (4, 5), (11, 11), (33, 12)):
        stored = random.integers(-1, 2, (stored_rows, 3)).astype(float)
        asked = random.integers(-1, 2, (20, 3)).astype(float)
        rows, columns, scores = retrieval.nearest_rows(asked, stored, k)
        every = asked @ stored.T
        best = np.argsort(-np.round(every, 12), axis=1, kind="stable")[:, :k]
        assert [list(columns[rows == i]) for i in range(20)] == best.tolist()
        assert np.array_equal(scores, every[rows, columns])


def test_blocks_are_large_for_narrow_vectors_and_bounded_for_wide_ones(spark, monkeypatch):
    seen = {}

    def note(questions, nodes, *rest):
        seen["q"], seen["n"] = (df.agg(F.max(c)).first()[0] for df, c in ((questions, "__q_blocks"), (nodes, "__n_blocks")))
        return spark.createDataFrame([], "question_id bigint, id string, node_type string, similarity double")

    monkeypatch.setattr(retrieval, "_block_matches", note)

    def blocks(n, width):
        vector = F.array_repeat(F.lit(1.0).cast("float"), width)
        asked = spark.range(n).select(F.col("id").alias("question_id"), F.lit("o").alias("owner_id"), vector.alias("question_embedding"))
        stored = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("o").alias("owner_id"), F.lit("leaf").alias("node_type"), vector.alias("embedding"))
        retrieval.best_matches(asked, stored, ["owner_id"], 3, False)
        return seen["q"], seen["n"]

    assert blocks(12_000, 2) == (1, 1)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 2048 * 8 * 16)
    assert blocks(12_000, 16) == (6, 6)


def test_project_pages_reads_the_items_once(spark, tmp_path):
    rows = [("d", 1, 1, "PARAGRAPH", "b"), ("d", 1, 0, "TABLE", "a"), ("d", 1, 2, "PAGE_FOOTER", "f"), ("d", 1, 3, "PARAGRAPH", ""), ("d", 2, 0, "PAGE_FOOTER", "f")]
    spark.createDataFrame(rows, f"{PAGE}, reading_order int, label string, text string").write.parquet(f"{tmp_path}/items")
    sizes = spark.createDataFrame([("d", p, 1.0, 2.0) for p in (1, 2, 3)] + [(None, 1, 1.0, 2.0)], f"{PAGE}, width double, height double")
    pages = layout.project_pages(spark.read.parquet(f"{tmp_path}/items"), sizes)
    found = {(r["document_id"], r["page_number"]): (r["text"], r["n_items"], r["component_counts"]) for r in pages.collect()}
    assert found == {
        ("d", 1): ("a\n\nb", 4, {"PARAGRAPH": 2, "TABLE": 1, "PAGE_FOOTER": 1}), ("d", 2): ("", 1, {"PAGE_FOOTER": 1}),
        ("d", 3): ("", 0, None), (None, 1): ("", 0, None),
    }
    assert plan(pages).count("Relation [") == 1


def test_words_into_lines_sorts_without_a_lambda(spark):
    words = spark.createDataFrame([("d", 1, "b", 5.0, 6.0, 1.0, 2.0), ("d", 1, "a", 1.0, 2.0, 2.0, 3.0), ("d", 1, "c", 1.0, 2.0, 30.0, 31.0)], f"{PAGE}, text string, x0 double, x1 double, top double, bottom double")
    lines = layout.group_words_into_lines(words)
    assert sorted((r["line_no"], r["text"]) for r in lines.collect()) == [(0, "a b"), (1, "c")]
    assert "array_sort" not in plan(lines)


@pytest.mark.parametrize("text, hits", [("the", 1), ("bathe the", 1), ("bathe them", 0), ("éthe", 0), ("theé", 0), ("(the)", 1), ("the_", 0), ("", 0), ("THE end", 1)])
def test_party_words_are_whole_words(spark, text, hits):
    rule = ("P", ("the",), "", ("nothing",))
    row = spark.createDataFrame([(text,)], "t string").select(parties.party_score(F.col("t"), rule).alias("n")).first()
    assert row["n"] == hits


def test_party_words_are_compared_before_their_boundaries(spark):
    shown = str(parties.party_score(F.col("t"), ("P", ("the",), "", ("nothing",)))._jc.toString())
    assert "(?U)the(?<=" in shown


def test_mixture_fits_bound_arrow_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, str(1 << 30))
        nodes = spark.createDataFrame([("d", str(i), i, [float(i % 2), 1.0]) for i in range(6)], "document_id string, id string, ord bigint, embedding array<float>")
        clustering.cluster_embeddings(nodes, spark.createDataFrame([("d", 2)], "document_id string, target int"), block_rows=2)
        assert int(spark.conf.get(name)) <= 4 << 20
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_nodes_are_replaced_without_writing_them_twice(spark, tmp_path, monkeypatch):
    calls = []
    cut = N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df: calls.append(df.columns) or cut(df))

    def rows(*pairs):
        return spark.createDataFrame(pairs, "document_id string, id string, owner_id string")

    path = f"{tmp_path}/nodes"
    N.replace_document_nodes(rows(("a", "1", "o"), ("b", "2", "o"), ("a", "3", "o"), (None, "4", "o")), path, buckets=1)
    assert calls == []
    N.replace_document_nodes(rows(("a", "5", "o"), (None, "6", "o")), path, buckets=1)
    assert sorted(r["id"] for r in N.read_nodes(spark, path).collect()) == ["2", "4", "5", "6"]


def test_lineage_query_spreads_its_second_reading(spark, tmp_path):
    import suite.all_queries  # noqa: F401
    from suite.registry import QUERIES

    spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0], i) for i in range(10)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = QUERIES["S8_write_lineage"](spark, str(tmp_path))
    assert sorted((r["document_id"], r["row_count"], r["hashed"]) for r in stored.collect()) == [("doc-0", 25, True), ("doc-1", 5, True)]
    assert "Repartition 3" not in plan(stored)


def test_cut_rows_are_written_with_zstd(spark):
    from arbora.session import cut_lineage

    files = cut_lineage(spark.range(10)).inputFiles()
    assert files and all(".zstd." in f for f in files)


def test_node_texts_are_joined_last(spark, tmp_path):
    from suite.views import Views

    spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0], i) for i in range(6)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sources = Views(spark, str(tmp_path)).node_sources
    assert sorted((r["node_no"], r["text"], r["label"]) for r in sources.collect()) == [(i, f"text {i % 4}", i) for i in range(6)]
    shown = plan(sources)
    assert shown.index("Relation [vec_id") < shown.index("Relation [doc_id")
