"""The pipeline's stages on a small corpus with planted cases, and the registered queries."""

from collections import Counter

import corpus_pipeline
from arbora.llm import mixing
from arbora.llm.queries import ORACLE, QUERIES
from test_duplicates import brute_groups, brute_lines
from test_labels import corpus


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} and set(ORACLE) <= set(QUERIES)
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram join", "mixing", "byte-level BPE"]


def test_stages(spark, tmp_path):
    docs, labels, truth = corpus(spark)
    rows = [(r.doc_id, r.text, "en", f"s{r.doc_id % 3}", len(r.text)) for r in docs.collect()]
    unique = lambda i: " ".join(f"u{i}x{j}" for j in range(40))
    rows += [(5_000 + i, unique(i), "en", "s1", 1) for i in range(20)]
    rows += [(6_000, unique(0), "en", "s2", 1), (6_001, unique(1).replace("x7 ", "x7 new ").replace("x30", "other"), "en", "s0", 1), (6_002, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    seen = [table]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / str(number)))
        seen.append(spark.read.parquet(str(tmp_path / str(number))))
    given, clean, lines, first, mixed, encoded = ([r.asDict() for r in s.collect()] for s in seen)
    assert all(s.columns == table.columns for s in seen[:-1])

    kept = {r["doc_id"] for r in clean}
    assert not any(truth.get(r["doc_id"]) for r in clean) and {5_000 + i for i in range(20)} | {6_000, 6_001, 6_002} <= kept
    assert len(kept) == sum(not truth.get(r["doc_id"]) for r in given)

    want = brute_lines([(r["doc_id"], r["text"]) for r in clean if r["text"] is not None])
    left = {d: t for (d, _), t in want.items() if t.strip()}
    assert {r["doc_id"]: r["text"] for r in lines if r["text"] is not None} == left
    assert 6_002 in {r["doc_id"] for r in lines} and 6_000 not in left and 6_001 in left

    groups = brute_groups([(r["doc_id"], r["text"]) for r in lines])
    assert sorted(r["doc_id"] for r in first) == sorted(d for (d, _), (_, c) in groups.items() if c == d)

    copies = Counter(r["doc_id"] for r in mixed)
    assert copies == {r.doc_id: r.copies for r in mixing.mix(seen[3]).collect() if r.copies}
    assert len(encoded) == len(mixed) and all(len(r["ids"]) == r["n_tokens"] for r in encoded)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
