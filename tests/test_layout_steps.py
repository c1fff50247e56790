"""Layout steps on rows of their own: results as before, and plans that read and shuffle less."""

from __future__ import annotations

from arbora.operators import blocks as B
from arbora.operators import layout as Y
from suite.layout_queries import raw_blocks
from suite.views import Views

LINES = "document_id string, page_number int, line_no int, text string, x0 double, top double, x1 double, bottom double, height double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return Views(spark, str(tmp_path))


def test_pages_of_lines_come_from_counts(spark, tmp_path):
    """repeated, null and empty documents have the same pages as their lines."""
    eleven = "\n".join(f"line {i}" for i in range(11))
    v = documents(spark, tmp_path, [(1, eleven, "en"), (1, "short", "en"), (2, None, "en"), (3, "", "en"), (None, "a\nb", "en"), (4, "\n" * 20, "en")])
    expected = sorted(map(str, v.raw_lines.select("document_id", "page_number").distinct().collect()))
    assert sorted(map(str, v.line_pages.collect())) == expected
    assert v.line_pages.dtypes == v.raw_lines.select("document_id", "page_number").dtypes


def test_extraction_reads_stored_lines(spark, tmp_path):
    """blocks are made from written lines, the documents are not derived again."""
    v = documents(spark, tmp_path, [(1, "one two three four five six seven\nb c", "en"), (2, "x\n\ny\nz w", "en")])
    assert "documents.parquet" not in plan_of(raw_blocks(v))


def test_words_of_a_page_combine_before_the_shuffle(spark):
    """columns are counted without a distinct over words; words without a place count as words only."""
    words = spark.createDataFrame(
        [("d", 1, 0.0), ("d", 1, 1.0), ("d", 1, 100.0), ("d", 1, None), ("d", 2, 500.0)], "document_id string, page_number int, x0 double"
    )
    pages = words.select("document_id", "page_number")
    profile = B.page_profile(pages, words, pages, pages.limit(0), pages.limit(0))
    assert "count(distinct" not in plan_of(profile)
    found = {r.page_number: (r.word_count, r.is_complex_layout) for r in profile.collect()}
    assert found == {1: (4, False), 2: (1, False)}


def test_tables_are_rendered_once(spark):
    """the filter on the text does not render a second time."""
    tables = spark.createDataFrame(
        [("d", 1, 0, [["a", None], [" b ", "c"]]), ("d", 1, 1, [[" "]]), ("d", 2, 0, None)],
        "document_id string, page_number int, table_index int, rows array<array<string>>",
    )
    rendered = Y.rendered_tables(tables)
    assert [(r.page_number, r.table_index, r.text) for r in rendered.collect()] == [(1, 0, "a | \nb | c")]
    assert plan_of(rendered).count("array_join") == 2  # cells to rows, rows to text


def test_furniture_keeps_lines_on_their_pages(spark):
    """lines are not dealt by furniture key; repeated, null and empty texts and repeated rows come out as before."""
    rows = [("d", p, 0, "Draft Copy", 0.0, 10.0, 9.0, 20.0, 792.0) for p in (1, 2, 3)]
    rows += [("d", p, 1, "Draft Copy", 0.0, 300.0, 9.0, 310.0, 792.0) for p in (1, 2, 3)]
    rows += [("d", 1, 2, None, 0.0, 10.0, 9.0, 20.0, 792.0), ("d", 1, 3, "once only here", 0.0, 780.0, 9.0, 790.0, 792.0), rows[0]]
    rows += [(None, 1, 0, "Draft Copy", 0.0, 10.0, 9.0, 20.0, 792.0)]
    lines = spark.createDataFrame(rows, LINES)
    marked = Y.classify_furniture(lines, Y.repeated_furniture_keys(lines))
    assert marked.columns == [*lines.columns, "furniture"]
    found = sorted((str(r.document_id), r.page_number, r.line_no, r.furniture or "") for r in marked.collect())
    header = [("d", p, 0, "PAGE_HEADER") for p in (1, 1, 2, 3)]
    plain = [("None", 1, 0, ""), ("d", 1, 2, ""), ("d", 1, 3, ""), *[("d", p, 1, "") for p in (1, 2, 3)]]
    assert found == sorted(header + plain)
    assert "concat(|" not in plan_of(marked)


def test_glyphs_are_counted_and_not_sorted(spark):
    """the median of sizes with repeats, nulls and none; glyphs stream past hashed line boxes."""
    lines = spark.createDataFrame(
        [("d", 1, i, 0.0, 20.0 * i, 100.0, 20.0 * i + 10) for i in range(3)], "document_id string, page_number int, line_no int, x0 double, top double, x1 double, bottom double"
    )
    glyphs = [("d", 1, float(x), 1.0, float(x) + 1, 2.0, size, font) for x, (size, font) in enumerate([(8.0, "Arial"), (8.0, None), (9.0, "X-Bold"), (12.0, "Arial")])]
    glyphs += [("d", 1, 0.0, 21.0, 1.0, 22.0, None, "Arial"), ("e", 1, 0.0, 1.0, 1.0, 2.0, 99.0, "Arial")]
    chars = spark.createDataFrame(glyphs, "document_id string, page_number int, x0 double, top double, x1 double, bottom double, size double, fontname string")
    features = Y.line_font_features(lines, chars)
    assert {r.line_no: (r.font_size, r.bold) for r in features.collect()} == {0: (8.5, True), 1: (None, False), 2: (None, False)}
    plan = plan_of(features)
    assert "ShuffledHashJoin" in plan and "percentile(size" in plan
