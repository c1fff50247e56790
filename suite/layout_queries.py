"""Layout and block queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import geometry as G
from arbora.functions import text as X
from arbora.functions import fixed_values as FV
from arbora.operators import blocks as B
from arbora.operators import layout as Y
from arbora.operators import validation as VAL
from arbora.session import cut_lineage
from suite import sql_exprs as S
from suite.registry import query
from suite.sql_views import view
from suite.text_queries import LINE, marked_lines

c = F.col
PAGE = "document_id, page_number"


@query(
    "W1_group_words_into_lines",
    f"""SELECT {PAGE}, CAST(ln AS INTEGER) AS line_no, string_agg(text, ' ' ORDER BY x0, top) AS text, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom FROM (
          SELECT *, sum(CASE WHEN prev IS NULL OR top - prev <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY {PAGE} ORDER BY top, x0) AS ln FROM (
            SELECT *, lag(top) OVER (PARTITION BY {PAGE} ORDER BY top, x0) AS prev FROM v_words))
        GROUP BY {PAGE}, ln""",
)
def w1(v):
    return Y.group_words_into_lines(v.words)


view(
    "v_gaps",
    f"SELECT *, greatest(0, top - lag(bottom) OVER (PARTITION BY {PAGE} ORDER BY line_index)) AS raw_gap, lag(bottom) OVER (PARTITION BY {PAGE} ORDER BY line_index) AS above FROM v_marked",
)


@query("W2_gap_before", f"SELECT {PAGE}, line_index, CASE WHEN above IS NOT NULL THEN raw_gap END AS gap FROM v_gaps")
def w2(v):
    return Y.gap_before(v.lines, ("line_index",)).select(*LINE, c("gap_before").alias("gap"))


@query(
    "J1_line_font_features",
    f"""SELECT l.document_id, l.page_number, l.line_index, median(w.size) AS font_size, coalesce(bool_or(regexp_matches(lower(w.fontname), 'bold|black|heavy|semibold|demi')), FALSE) AS bold
        FROM v_lines l LEFT JOIN v_words w ON l.document_id = w.document_id AND l.page_number = w.page_number
             AND l.x1 >= w.x0 AND w.x1 >= l.x0 AND l.bottom >= w.top AND w.bottom >= l.top
        GROUP BY l.document_id, l.page_number, l.line_index""",
)
def j1(v):
    return Y.line_font_features(v.lines, v.words, "line_index").select(*LINE, "font_size", "bold")


OUTSIDE = """NOT EXISTS (SELECT 1 FROM v_tables t WHERE t.document_id = l.document_id AND t.page_number = l.page_number
      AND l.x1 >= t.x0 AND t.x1 >= l.x0 AND l.bottom >= t.top AND t.bottom >= l.top
      AND (least(l.bottom, t.bottom) - greatest(l.top, t.top)) / greatest(1, l.bottom - l.top) >= CAST(0.55 AS DOUBLE))"""


@query("J2_lines_outside_tables", f"SELECT {PAGE}, line_index FROM v_lines l WHERE {OUTSIDE}")
def j2(v):
    return Y.lines_outside_tables(v.lines, v.tables).select(*LINE)


view(
    "v_repeated",
    f"""SELECT document_id, key, count(DISTINCT page_number) AS n_found FROM (
          SELECT *, {S.furniture_key('text')} AS key FROM v_marked WHERE top <= 79.2 OR bottom >= 712.8)
        JOIN (SELECT document_id, count(DISTINCT page_number) AS n_pages FROM v_marked GROUP BY document_id) USING (document_id)
        WHERE key <> '' AND n_pages >= 2 GROUP BY document_id, key, n_pages
        HAVING count(DISTINCT page_number) >= greatest(2, round_even(CAST(n_pages AS DOUBLE) * CAST(0.45 AS DOUBLE), 0))""",
)


@query("G1_repeated_furniture_keys", "SELECT document_id, key AS furniture_key, n_found FROM v_repeated")
def g1(v):
    return Y.repeated_furniture_keys(marked_lines(v))


view(
    "v_classified",
    f"""SELECT l.*, CASE WHEN r.key IS NOT NULL OR regexp_matches(text, {S.PAGE_NUMBER}) THEN
            CASE WHEN top <= 79.2 THEN 'PAGE_HEADER' WHEN bottom >= 712.8 THEN 'PAGE_FOOTER' END END AS furniture
        FROM (SELECT *, CASE WHEN top <= 79.2 OR bottom >= 712.8 THEN {S.furniture_key('text')} END AS fkey FROM v_gaps) l
        LEFT JOIN v_repeated r ON r.document_id = l.document_id AND r.key = l.fkey""",
)


@query("F34_classify_furniture", f"SELECT {PAGE}, line_index, furniture FROM v_classified")
def f34(v):
    lines = marked_lines(v.with_stored_lines())
    return Y.classify_furniture(lines, Y.repeated_furniture_keys(lines)).select(*LINE, "furniture")


view(
    "v_page_stats",
    f"""SELECT {PAGE}, greatest(CAST(8 AS DOUBLE), coalesce(median(CASE WHEN above IS NOT NULL THEN raw_gap END) * CAST(1.8 AS DOUBLE), CAST(10 AS DOUBLE))) AS paragraph_gap,
          median(font_size) AS body_font_size FROM v_gaps GROUP BY {PAGE}""",
)


@query("G4_page_layout_stats", f"SELECT {PAGE}, round(paragraph_gap, 6) AS paragraph_gap, body_font_size FROM v_page_stats")
def g4(v):
    stats = Y.page_layout_stats(Y.gap_before(v.lines, ("line_index",)))
    return stats.withColumn("paragraph_gap", F.round("paragraph_gap", 6))


view(
    "v_events",
    f"""SELECT *, row_number() OVER (PARTITION BY {PAGE} ORDER BY top, x0, CASE event WHEN 'table' THEN 0 ELSE 1 END, line_index) - 1 AS event_no FROM (
          SELECT {PAGE}, line_index, 'line' AS event, text, x0, top, x1, bottom, font_size, bold, CASE WHEN above IS NOT NULL THEN raw_gap END AS gap, furniture FROM v_classified l WHERE {OUTSIDE}
          UNION ALL
          SELECT {PAGE}, NULL, 'table', array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), chr(10)), x0, top, x1, bottom, NULL, NULL, NULL, NULL FROM v_tables)""",
)


@query("T10_order_page_events", f"SELECT {PAGE}, line_index, event, CAST(event_no AS INTEGER) AS event_no FROM v_events")
def t10(v):
    lines = Y.lines_outside_tables(marked_lines(v), v.tables)
    return Y.order_page_events(lines, v.tables).select(*LINE, "event", "event_no")


view(
    "v_typed",
    f"""SELECT *, CASE WHEN event = 'table' THEN 'TABLE' WHEN furniture IS NOT NULL THEN furniture WHEN lvl IS NOT NULL THEN 'SECTION_HEADER'
              WHEN regexp_matches(text, {S.LIST_ITEM}) THEN 'LIST_ITEM' ELSE 'PARAGRAPH' END AS label FROM (
          SELECT *, CAST({S.heading_level('t', 'font_size', 'coalesce(bold, FALSE)', 'gap', 'body_font_size')} AS INTEGER) AS lvl
          FROM (SELECT e.*, s.paragraph_gap, s.body_font_size, {S.strip('text')} AS t FROM v_events e LEFT JOIN v_page_stats s USING (document_id, page_number)))""",
)
view(
    "v_broken_lines",
    f"""SELECT *, CASE WHEN label = 'PARAGRAPH' AND coalesce(plabel, '') = 'PARAGRAPH' AND NOT coalesce(gap >= paragraph_gap OR (abs(x0 - px0) >= 24 AND gap >= 3)
              OR (regexp_matches(ptext, '[.:;]$') AND gap >= paragraph_gap * CAST(0.7 AS DOUBLE)), FALSE) THEN 0 ELSE 1 END AS brk FROM (
          SELECT *, lag(label) OVER w AS plabel, lag(x0) OVER w AS px0, lag(text) OVER w AS ptext FROM v_typed WINDOW w AS (PARTITION BY {PAGE} ORDER BY event_no))""",
)
view(
    "v_items",
    f"""SELECT {PAGE}, CAST(ro AS INTEGER) AS reading_order, any_value(label) AS label,
          CASE WHEN any_value(label) = 'PARAGRAPH' THEN {S.strip(S.collapse(S.repair("string_agg(text, chr(10) ORDER BY event_no)")))} ELSE min(text) END AS text,
          max(CASE WHEN label = 'SECTION_HEADER' THEN lvl END) AS section_level, min(x0) AS "left", min(top) AS top, max(x1) AS "right", max(bottom) AS bottom
        FROM (SELECT *, sum(brk) OVER (PARTITION BY {PAGE} ORDER BY event_no) - 1 AS ro FROM v_broken_lines) GROUP BY {PAGE}, ro""",
)


@query(
    "F41_starts_new_paragraph",
    f"""SELECT {PAGE}, line_index, coalesce(gap >= pg OR (abs(x0 - px0) >= 24 AND gap >= 3) OR (regexp_matches(ptext, '[.:;]$') AND gap >= pg * CAST(0.7 AS DOUBLE)), FALSE) AS starts FROM (
          SELECT *, CASE WHEN above IS NOT NULL THEN raw_gap END AS gap, lag(x0) OVER w AS px0, lag(text) OVER w AS ptext, CAST(90 AS DOUBLE) AS pg FROM v_gaps WINDOW w AS (PARTITION BY {PAGE} ORDER BY line_index))""",
)
def f41(v):
    from pyspark.sql import Window

    w = Window.partitionBy("document_id", "page_number").orderBy("line_index")
    lines = Y.gap_before(marked_lines(v), ("line_index",))
    starts = G.starts_new_paragraph(c("gap_before"), c("x0"), F.lag("x0").over(w), F.lag("text").over(w), F.lit(90.0))
    return lines.select(*LINE, starts.alias("starts"))


def items_of(v):
    v = v.with_stored_lines()
    lines = marked_lines(v).withColumnRenamed("line_index", "line_no")
    return Y.assemble_paragraphs(lines, v.tables)


@query("W3_assemble_paragraphs", "SELECT * FROM v_items")
def w3(v):
    return items_of(v)


BODY = "('SECTION_HEADER','PARAGRAPH','LIST_ITEM','TABLE','TEXT')"


@query("P3_body_items", f"SELECT {PAGE}, reading_order, label FROM v_items WHERE label IN {BODY}")
def p3(v):
    return Y.body_items(items_of(v)).select("document_id", "page_number", "reading_order", "label")


@query(
    "G3_component_counts",
    f"""SELECT {PAGE}, string_agg(label || '=' || n, ',' ORDER BY label) AS counts FROM (SELECT {PAGE}, label, count(*) AS n FROM v_html_items GROUP BY {PAGE}, label) GROUP BY {PAGE}""",
)
def g3(v):
    counts = Y.component_counts(v.html_items)
    entries = F.array_sort(F.transform(F.map_entries("component_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return counts.select("document_id", "page_number", F.array_join(entries, ",").alias("counts"))


view("v_item_text", f"SELECT {PAGE}, string_agg(text, chr(10) || chr(10) ORDER BY reading_order) AS text FROM v_items WHERE label IN {BODY} AND text <> '' GROUP BY {PAGE}")


@query("G8_page_text", f"SELECT {PAGE}, text FROM v_item_text")
def g8(v):
    return Y.page_text(items_of(v))


def sizes_of(v):
    return v.lines.select("document_id", "page_number", "width", "height").distinct()


@query(
    "P1_project_pages",
    f"""SELECT {PAGE}, coalesce(t.text, '') AS text, n_items, counts, CAST(612 AS DOUBLE) AS width, CAST(792 AS DOUBLE) AS height
        FROM (SELECT {PAGE}, count(*) AS n_items FROM v_items GROUP BY {PAGE}) LEFT JOIN v_item_text t USING (document_id, page_number)
        LEFT JOIN (SELECT {PAGE}, string_agg(label || '=' || n, ',' ORDER BY label) AS counts FROM (SELECT {PAGE}, label, count(*) AS n FROM v_items GROUP BY {PAGE}, label) GROUP BY {PAGE}) USING (document_id, page_number)""",
)
def p1(v):
    pages = Y.project_pages(items_of(v), sizes_of(v))
    entries = F.array_sort(F.transform(F.map_entries("component_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return pages.withColumn("counts", F.array_join(entries, ",")).drop("component_counts")


@query(
    "P2_drop_empty_pages",
    f"SELECT {PAGE} FROM v_raw_lines GROUP BY {PAGE} HAVING count(CASE WHEN label_ok THEN 1 END) > 0".replace(
        "FROM v_raw_lines", "FROM (SELECT *, strip_text <> '' AND lang <> 'fr' AS label_ok FROM (SELECT *, trim(text) AS strip_text FROM v_raw_lines))"
    ),
)
def p2(v):
    """French pages lose their text, as a page whose glyphs could not be read would."""
    pages = v.raw_lines.groupBy("document_id", "page_number").agg(
        F.count_if((F.trim("text") != "") & (c("lang") != "fr")).alias("n_items")
    )
    return Y.drop_empty_pages(pages.withColumn("text", F.lit(""))).select("document_id", "page_number")


@query(
    "G18_merge_bboxes",
    """SELECT document_id, min(CASE WHEN line_index > 1 THEN x0 END) AS "left", min(CASE WHEN line_index > 1 THEN top END) AS top, max(CASE WHEN line_index > 1 THEN x1 END) AS "right", max(CASE WHEN line_index > 1 THEN bottom END) AS bottom FROM v_lines GROUP BY document_id""",
)
def g18(v):
    known = {n: F.when(c("line_index") > 1, c(n)) for n in ("x0", "top", "x1", "bottom")}
    return v.lines.withColumns(known).groupBy("document_id").agg(*G.merge_bboxes())


# --- blocks --------------------------------------------------------------------------------

view("v_images", f"SELECT {PAGE}, line_index FROM v_lines WHERE bold")
view(
    "v_page_profile",
    f"""SELECT {PAGE}, n_chars > 0 AS has_digital_text, least(1, n_words / CAST(350 AS DOUBLE)) AS text_density, least(1, n_images / CAST(8 AS DOUBLE)) AS image_coverage,
          n_words = 0 AND n_images = 0 AS is_empty, n_chars = 0 AND NOT (n_words = 0 AND n_images = 0) AS requires_ocr, n_tables > 0 AS is_table_heavy,
          n_columns >= 3 AS is_complex_layout, n_chars > 0 AND least(1, n_images / CAST(8 AS DOUBLE)) >= CAST(0.2 AS DOUBLE) AS is_mixed, CAST(n_words AS INTEGER) AS word_count FROM (
          SELECT p.document_id, p.page_number, coalesce(n_words, 0) AS n_words, coalesce(n_columns, 0) AS n_columns, coalesce(n_chars, 0) AS n_chars, coalesce(n_images, 0) AS n_images, coalesce(n_tables, 0) AS n_tables
          FROM (SELECT DISTINCT {PAGE} FROM v_lines) p
          LEFT JOIN (SELECT {PAGE}, count(*) AS n_words, count(DISTINCT round_even(x0 / 40, 0)) AS n_columns FROM v_words GROUP BY {PAGE}) USING (document_id, page_number)
          LEFT JOIN (SELECT {PAGE}, count(*) AS n_chars FROM v_words WHERE size > 12 AND line_index > 0 GROUP BY {PAGE}) USING (document_id, page_number)
          LEFT JOIN (SELECT {PAGE}, count(*) AS n_images FROM v_images GROUP BY {PAGE}) USING (document_id, page_number)
          LEFT JOIN (SELECT {PAGE}, count(*) AS n_tables FROM v_tables WHERE len(rows) > 1 GROUP BY {PAGE}) USING (document_id, page_number))""",
)


def profile_of(v):
    """Large glyphs of body lines stand in for characters, bold lines for images, two-row tables for tables."""
    chars = v.words.where((c("size") > 12) & (c("line_index") > 0))
    return B.page_profile(v.lines, v.words, chars, v.lines.where("bold"), v.tables.where("size(rows) > 1"))


@query("G21_page_profile", "SELECT * REPLACE (round(text_density, 6) AS text_density, round(image_coverage, 6) AS image_coverage) FROM v_page_profile")
def g21(v):
    return profile_of(v).withColumns({n: F.round(n, 6) for n in ("text_density", "image_coverage")})


view("v_routed", "SELECT *, CASE WHEN requires_ocr THEN 'OCR' WHEN is_table_heavy THEN 'PDFPLUMBER_TABLE_AWARE' WHEN is_complex_layout OR is_mixed THEN 'HYBRID' ELSE 'PYMUPDF_BLOCKS' END AS method FROM v_page_profile")


@query("P5_route_page", f"SELECT {PAGE}, method FROM v_routed")
def p5(v):
    return B.route_page(profile_of(v)).select("document_id", "page_number", "method")


@query(
    "G6_document_profile",
    """SELECT document_id, count(*) AS total_pages, bool_and(requires_ocr OR is_empty) AS is_scanned, bool_or(is_mixed) AS is_mixed, bool_or(is_table_heavy) AS has_tables, bool_or(is_complex_layout) AS has_complex_layout,
         count(CASE WHEN requires_ocr THEN 1 END) AS n_ocr_required, count(CASE WHEN is_table_heavy THEN 1 END) AS n_table_heavy, count(CASE WHEN is_empty THEN 1 END) AS n_empty,
         round(avg(text_density), 6) AS average_text_density, CAST(0.9 AS DOUBLE) AS confidence FROM v_page_profile GROUP BY document_id""",
)
def g6(v):
    return B.document_profile(profile_of(v)).withColumn("average_text_density", F.round("average_text_density", 6))


@query(
    "G6_profile_page_lists",
    """SELECT document_id, 'ocr_required_pages' AS list_name, page_number FROM v_page_profile WHERE requires_ocr UNION ALL
       SELECT document_id, 'table_heavy_pages', page_number FROM v_page_profile WHERE is_table_heavy UNION ALL
       SELECT document_id, 'empty_pages', page_number FROM v_page_profile WHERE is_empty""",
)
def g6b(v):
    return B.profile_page_lists(profile_of(v))


view(
    "v_blocks",
    f"""SELECT document_id, page_number, {S.strip('text')} AS text, bx0, btop, bx1, bbottom, source, block_type, font_size, is_bold, confidence, reading_order FROM (
          SELECT l.document_id, l.page_number, text, x0 AS bx0, top AS btop, x1 AS bx1, bottom AS bbottom, 'pdfplumber' AS source, 'paragraph' AS block_type, font_size, bold AS is_bold, CAST(0.96 AS DOUBLE) AS confidence, line_index AS reading_order
          FROM v_marked l JOIN v_routed r USING (document_id, page_number) WHERE method <> 'OCR'
          UNION ALL
          SELECT t.document_id, t.page_number, array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), chr(10)), x0, top, x1, bottom, 'pdfplumber', 'table', NULL, FALSE, CAST(0.94 AS DOUBLE), CAST(n AS INTEGER)
          FROM v_tables t JOIN v_routed r USING (document_id, page_number) JOIN (SELECT {PAGE}, count(*) AS n FROM v_marked GROUP BY {PAGE}) USING (document_id, page_number) WHERE method <> 'OCR'
          UNION ALL
          SELECT {PAGE}, '', NULL, NULL, NULL, NULL, 'ocr', 'unknown', NULL, FALSE, CAST(0 AS DOUBLE), 0 FROM v_routed WHERE method = 'OCR')""",
)
BLOCK = "document_id, page_number, text, btop AS top, source, block_type, font_size, is_bold, confidence, reading_order"


def routed_of(v):
    """Routed pages, written once: extraction reads them for lines, tables and OCR pages."""
    return cut_lineage(B.route_page(profile_of(v)))


def raw_blocks(v):
    v = v.with_stored_lines()
    routed = routed_of(v)
    return B.extract_pages(routed, marked_lines(v), v.tables, line_order="line_index")


def flat(blocks, *extra):
    return blocks.select(
        "document_id", "page_number", "text", c("bbox.top").alias("top"), "source", "block_type", "font_size", "is_bold",
        "confidence", "reading_order", *extra,
    )


@query("C23_extract_pages", f"SELECT {BLOCK} FROM v_blocks")
def c23(v):
    return flat(raw_blocks(v))


@query(
    "C23_extraction_warnings",
    "SELECT document_id, 'OCR required for page ' || page_number || ' but no OCR engine is configured.' AS warning FROM v_routed WHERE method = 'OCR'",
)
def c23w(v):
    return B.extraction_warnings(B.route_page(profile_of(v)))


@query(
    "C23_fallback_items",
    f"""SELECT {PAGE}, text, top, 'legacy_pdfplumber' AS source, CASE label WHEN 'SECTION_HEADER' THEN 'heading' WHEN 'PARAGRAPH' THEN 'paragraph' WHEN 'LIST_ITEM' THEN 'list_item' WHEN 'TABLE' THEN 'table' WHEN 'PAGE_HEADER' THEN 'header' ELSE 'footer' END AS block_type,
          CAST(NULL AS DOUBLE) AS font_size, FALSE AS is_bold, CAST(0.85 AS DOUBLE) AS confidence, reading_order FROM v_items""",
)
def c23f(v):
    v = v.with_stored_lines()
    routed = routed_of(v)
    failed = routed.select("document_id").distinct()
    return flat(B.extract_pages(routed, marked_lines(v), v.tables, line_order="line_index", failed=failed))


@query(
    "P4_normalize_blocks",
    f"""SELECT {PAGE}, reading_order, t AS text, coalesce(nullif(bt, ''), 'paragraph') AS block_type, coalesce(src, 'unknown') AS source, coalesce(conf, CAST(1 AS DOUBLE)) AS confidence, coalesce(bt = 'list_item', FALSE) AS list_item FROM (
          SELECT *, {S.strip("CASE WHEN bold THEN '  ' ELSE ' ' || text || chr(10) END")} AS t, CASE line_index % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'list_item' WHEN 2 THEN '' END AS bt,
                 CASE WHEN line_index % 2 = 0 THEN 'pdfplumber' END AS src, CASE WHEN line_index % 3 = 0 THEN CAST(0.5 AS DOUBLE) END AS conf, line_index AS reading_order FROM v_lines)
        WHERE t <> '' OR coalesce(bt, '') = 'unknown'""",
)
def p4(v):
    i = c("line_index")
    raw = v.lines.select(
        "document_id", "page_number",
        F.when(c("bold"), F.lit("  ")).otherwise(F.concat(F.lit(" "), c("text"), F.lit("\n"))).alias("text"),
        F.when(i % 4 == 0, "unknown").when(i % 4 == 1, "list_item").when(i % 4 == 2, "").alias("block_type"),
        F.when(i % 2 == 0, "pdfplumber").alias("source"),
        F.when(i % 3 == 0, 0.5).alias("confidence"),
        F.lit(None).cast("boolean").alias("is_bold"),
        i.alias("reading_order"),
    )
    return B.normalize_blocks(raw).select(
        "document_id", "page_number", "reading_order", "text", "block_type", "source", "confidence", "list_item"
    )


CAND = "(coalesce(btop, 0) <= 80 OR coalesce(bbottom, 0) >= 720)"
FOLD = S.collapse("lower(text)")


@query("P15_is_furniture_candidate", f"SELECT {PAGE}, reading_order, block_type, {CAND} AS candidate FROM v_blocks")
def p15(v):
    hit = G.is_furniture_candidate(c("bbox.top"), c("bbox.bottom"), c("block_type"))
    return raw_blocks(v).select("document_id", "page_number", "reading_order", "block_type", hit.alias("candidate"))


view("v_repeated_texts", f"SELECT document_id, {FOLD} AS folded, count(*) AS n FROM v_blocks WHERE {CAND} AND text <> '' GROUP BY 1, 2 HAVING count(*) >= 2")


@query("G2_repeated_block_texts", "SELECT * FROM v_repeated_texts")
def g2(v):
    return B.repeated_block_texts(raw_blocks(v))


view(
    "v_kept_blocks",
    f"SELECT * FROM v_blocks b WHERE NOT EXISTS (SELECT 1 FROM v_repeated_texts r WHERE r.document_id = b.document_id AND {CAND} AND r.folded = {FOLD})",
)


@query("J3_remove_repeated_furniture", f"SELECT {BLOCK} FROM v_kept_blocks")
def j3(v):
    return flat(B.remove_repeated_furniture(cut_lineage(raw_blocks(v))))


view(
    "v_ordered",
    "SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, coalesce(btop, 0), coalesce(bx0, 0), reading_order, text) - 1 AS INTEGER) AS reading_order) FROM v_kept_blocks",
)


def ordered_blocks(v):
    """Extracted once and rid of furniture once: furniture and order each read their rows twice."""
    return B.resolve_reading_order(cut_lineage(B.remove_repeated_furniture(cut_lineage(raw_blocks(v)))))


@query("W4_resolve_reading_order", f"SELECT {BLOCK} FROM v_ordered")
def w4(v):
    return flat(ordered_blocks(v))


view(
    "v_body_font",
    """SELECT document_id, list_sort(list(font_size))[count(*) // 2 + 1] AS body_font_size FROM v_ordered WHERE font_size <> 0 GROUP BY document_id""",
)


@query("G5_document_body_font", "SELECT * FROM v_body_font")
def g5(v):
    return B.document_body_font(B.remove_repeated_furniture(cut_lineage(raw_blocks(v))))


view(
    "v_normalized",
    f"""SELECT * REPLACE (CASE WHEN is_list THEN 'list_item' WHEN lvl IS NOT NULL THEN 'heading' ELSE block_type END AS block_type),
          is_list AS list_item, lvl AS section_level, CASE WHEN block_type = 'table' AND NOT is_list THEN 'table-' || page_number || '-' || reading_order END AS table_id FROM (
          SELECT *, regexp_matches(text, {S.LIST_ITEM}) AS is_list, CASE WHEN block_type <> 'table' AND text <> '' THEN CAST({S.heading_level('text', 'font_size', 'is_bold', 'zero', 'body_font_size')} AS INTEGER) END AS lvl
          FROM (SELECT o.*, CAST(0 AS DOUBLE) AS zero, f.body_font_size FROM v_ordered o LEFT JOIN v_body_font f USING (document_id)))""",
)


def normalized(v):
    return B.normalize_extraction(B.normalize_blocks(raw_blocks(v)))


@query("C20_normalize_extraction", f"SELECT {BLOCK}, list_item, section_level, table_id FROM v_normalized")
def c20(v):
    return flat(normalized(v), "list_item", "section_level", "table_id")


@query("W15_assign_table_ids", "SELECT document_id, reading_order, 'table-' || page_number || '-' || reading_order AS table_id FROM v_ordered WHERE block_type = 'table'")
def w15(v):
    ordered = ordered_blocks(v)
    return B.assign_table_ids(ordered).where("table_id IS NOT NULL").select("document_id", "reading_order", "table_id")


@query(
    "G7_extraction_quality",
    """SELECT document_id, count(*) AS block_count, count(CASE WHEN text = '' THEN 1 END) AS empty_blocks, round(avg(confidence), 6) AS confidence,
         any_value(coalesce(w, 0)) AS warning_count, coalesce('ocr=' || nullif(count(CASE WHEN source = 'ocr' THEN 1 END), 0) || ',', '') || coalesce('pdfplumber=' || nullif(count(CASE WHEN source <> 'ocr' THEN 1 END), 0), '') AS sources
       FROM v_blocks LEFT JOIN (SELECT document_id, count(*) AS w FROM v_routed WHERE method = 'OCR' GROUP BY document_id) USING (document_id) GROUP BY document_id""".replace(
        "|| ','", "|| CASE WHEN count(CASE WHEN source <> 'ocr' THEN 1 END) > 0 THEN ',' ELSE '' END"
    ),
)
def g7(v):
    quality = B.extraction_quality(raw_blocks(v), B.extraction_warnings(B.route_page(profile_of(v))))
    entries = F.transform(F.map_entries("source_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return quality.select(
        "document_id", "block_count", "empty_blocks", F.round("confidence", 6).alias("confidence"), "warning_count",
        F.array_join(F.array_sort(entries), ",").alias("sources"),
    )


@query(
    "V8_require_text_layer",
    f"""WITH words AS (SELECT document_id, CAST(regexp_extract(document_id, '[0-9]+') AS BIGINT) AS n, sum({S.n_words('text')}) AS n_words FROM v_raw_lines GROUP BY document_id)
        SELECT document_id, CASE WHEN n % 9 = 4 OR n_words < 10 THEN 'No readable text layer was found.' ELSE '{FV.NO_BODY_TEXT}' END AS reject_reason
        FROM words WHERE n % 9 IN (4, 5) OR n_words < 10""",
)
def v8(v):
    """Some documents have no lines at all, some have pages without text and items."""
    number = F.regexp_extract("document_id", "[0-9]+", 0).cast("bigint") % 9
    jobs = v.raw_lines.select("document_id").distinct()
    lines = v.raw_lines.select("document_id", "page_number", "text").where(number != 4)
    pages = lines.groupBy("document_id", "page_number").agg(F.max("text").alias("text"), F.count("*").alias("n_items"))
    bare = {"text": F.when(number == 5, "").otherwise(F.col("text")), "n_items": F.when(number == 5, 0).otherwise(F.col("n_items"))}
    return VAL.require_text_layer(jobs, lines, pages.withColumns(bare))
