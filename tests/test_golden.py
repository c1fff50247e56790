"""Known rows of single operators."""

from pyspark.sql import functions as F

from arbora.functions import text as X
from arbora.operators import blocks, chunking, layout, planning, validation

DOC = "d"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_hyphen_repair(spark):
    assert one(spark, X.repair_text(F.col("t")), t="The agree-\nment applies.") == "The agreement applies."
    assert one(spark, X.repair_text(F.col("t")), t="é-\r\nx") == "éx"


def heading(spark, **line):
    cols = [F.col(n) for n in ("text", "font_size", "bold", "gap_before", "body")]
    return one(spark, X.heading_level(*cols), **line)


def test_heading_level(spark):
    assert heading(spark, text="4.2 Data Governance Allocation", font_size=12.0, bold=True, gap_before=12.0, body=10.0) == 2
    assert heading(spark, text="3.14 apples are sweet.", font_size=10.0, bold=False, gap_before=2.0, body=10.0) is None


def test_repeated_furniture(spark):
    rows = []
    for page in (1, 2):
        rows.append((DOC, page, 100.0, "Confidential Draft", 2.0, 8.0))
        rows.append((DOC, page, 100.0, str(page), 94.0, 98.0))
    lines = spark.createDataFrame(rows, "document_id string, page_number int, height double, text string, top double, bottom double")
    keys = {r["furniture_key"] for r in layout.repeated_furniture_keys(lines).collect()}
    assert keys == {"confidential draft", "#"}


def test_tables(spark):
    df = spark.createDataFrame(
        [(DOC, 1, 0, [["Clause", "Risk"], ["4.1", "High"], [None, " "]])],
        "document_id string, page_number int, table_index int, rows array<array<string>>",
    )
    assert df.select(layout.render_table(F.col("rows"))).first()[0] == "Clause | Risk\n4.1 | High"
    assert layout.table_cells(df).count() == 4


def test_hierarchical_chunk_of_items(spark):
    items = spark.createDataFrame(
        [(DOC, 1, "SECTION_HEADER", "Section 1 Introduction", 0, 1), (DOC, 1, "PARAGRAPH", "This agreement applies.", 1, None)],
        "document_id string, page_number int, label string, text string, reading_order int, section_level int",
    )
    pages = spark.createDataFrame([], "document_id string, page_number int, text string")
    chunks = chunking.hierarchical_chunks(chunking.text_units(pages, items, "line")).collect()
    assert [(c["section_key"], c["structural_depth"], c["content"]) for c in chunks] == [
        ("section-1", 1, "Section 1 Introduction\nThis agreement applies.")
    ]


def test_window_pages(spark):
    pages = spark.createDataFrame(
        [(DOC, 1, "one two three four five"), (DOC, 2, "six seven eight nine ten")],
        "document_id string, page_number int, text string",
    )
    chunks = {c["chunk_index"]: c for c in chunking.transactional_chunks(pages, 6, 2).collect()}
    assert (chunks[1]["page_start"], chunks[1]["page_end"]) == (1, 2)
    assert chunks[1]["content"] == "five six seven eight nine ten"


def test_party_paragraphs(spark):
    units = spark.createDataFrame(
        [(DOC, 1, 0, "The Claimant says breach occurred."), (DOC, 1, 1, "The background facts are undisputed.")],
        "document_id string, page_number int, block_no int, text string",
    )
    chunks = chunking.adversarial_chunks(units).orderBy("chunk_index").collect()
    assert [c["party_enclave"] for c in chunks] == ["CLAIMANT", "NEUTRAL"]


def test_routes(spark):
    flags = "document_id string, page_number int, requires_ocr boolean, is_table_heavy boolean, is_complex_layout boolean, is_mixed boolean"
    rows = [(DOC, 1, True, True, False, False), (DOC, 2, False, True, True, True), (DOC, 3, False, False, False, True), (DOC, 4, False, False, False, False)]
    methods = [r["method"] for r in blocks.route_page(spark.createDataFrame(rows, flags)).orderBy("page_number").collect()]
    assert methods == ["OCR", "PDFPLUMBER_TABLE_AWARE", "HYBRID", "PYMUPDF_BLOCKS"]


def test_block_furniture(spark):
    rows = [(DOC, p, t, "paragraph", {"top": top, "bottom": top + 10.0}) for p, t, top in
            ((1, "Confidential Draft", 10.0), (1, "Body One", 120.0), (2, "Confidential  draft", 10.0), (2, "Body Two", 120.0))]
    df = spark.createDataFrame(rows, "document_id string, page_number int, text string, block_type string, bbox struct<top:double,bottom:double>")
    assert sorted(r["text"] for r in blocks.remove_repeated_furniture(df).collect()) == ["Body One", "Body Two"]


def test_no_chunks(spark):
    jobs = spark.createDataFrame([(DOC, "TRANSACTIONAL")], "document_id string, layout_strategy string")
    none = spark.createDataFrame([], "document_id string, chunk_id string, content string, layout_strategy string")
    errors = validation.validate_chunks(none, jobs)
    assert [r["error"] for r in errors.collect()] == ["No chunks were produced."]
    assert [r["passed"] for r in validation.merge_validations(jobs, errors).collect()] == [False]


def members(spark, rows):
    """rows: (id, words, page, cluster, partition)"""
    data = [(DOC, i, n, k, "w " * words, page, page, part) for n, (i, words, page, k, part) in enumerate(rows)]
    return spark.createDataFrame(
        data, "document_id string, id string, ord long, cluster_no int, content string, page_start int, page_end int, layout_partition string"
    )


def test_cluster_status(spark):
    df = members(spark, [("a", 120, 1, 0, "P"), ("b", 70, 1, 0, "P"), ("c", 240, 2, 1, "P"), ("d", 40, 3, 2, "P"), ("e", 50, 3, 2, "P"), ("f", 120, 4, 3, "P")])
    diag = {r["cluster_no"]: r for r in planning.cluster_diagnostics(df).collect()}
    assert [diag[k]["is_tiny"] for k in range(4)] == [True, False, True, True]
    assert [diag[k]["status"] for k in range(4)] == ["tiny", "summarizable", "invalid", "tiny"]


def test_merge_target_prefers_partition(spark):
    df = members(spark, [("a", 40, 1, 0, "A"), ("b", 220, 2, 1, "B"), ("c", 220, 10, 2, "A")])
    targets = planning.best_merge_target(planning.cluster_diagnostics(df)).collect()
    assert [(t["cluster_no"], t["merge_target"]) for t in targets] == [(0, 2)]
    plan = planning.build_cluster_plan(df)
    merged = {r["id"]: r["cluster_no"] for r in plan["normalized_members"].collect()}
    assert merged == {"a": 0, "c": 0, "b": 1}


def test_tiny_after_its_target_and_ring(spark):
    df = members(spark, [("a", 220, 1, 0, "A"), ("b", 30, 1, 1, "A")])
    plan = planning.build_cluster_plan(df)
    assert {r["cluster_no"] for r in plan["normalized_members"].collect()} == {0}
    ring = planning.build_cluster_plan(members(spark, [("a", 20, 1, 0, "A"), ("b", 30, 1, 1, "A"), ("c", 30, 9, 2, "B")]))
    assert {r["cluster_no"] for r in ring["normalized_members"].collect()} == {0}


def test_cluster_requests(spark):
    df = spark.createDataFrame([("0",), ("",), (None,), ("x",), ("4",)], "target_clusters string")
    rows = [(r["target"], r["reject_reason"] is None) for r in validation.validate_cluster_requests(df).collect()]
    assert rows == [(None, False), (None, True), (None, True), (None, False), (4, True)]
