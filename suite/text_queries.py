"""Text, geometry, label and planning functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import geometry as G
from arbora.functions import labels as L
from arbora.functions import parties as P
from arbora.functions import protection as C
from arbora.functions import text as X
from arbora.functions import trees as T
from arbora.functions import vectors
from suite import sql_exprs as S
from suite.registry import query
from suite.sql_views import view
from suite.views import FIXTURE_RULES, HIERARCHY, Views

c = F.col

# Layout lines with markers in front, so heading and list rules meet every kind.
MARKERS = ("Section {} ", "{}.1 ", "(a) ", "IV. ", "- ", "PART {} ", "{}. ", "{}.2.3 ")


def marked_lines(v: Views):
    page = c("page_number").cast("string")
    text = c("text")
    for slot, marker in enumerate(MARKERS, start=1):
        before, _, after = marker.partition("{}")
        prefix = F.concat(F.lit(before), page, F.lit(after)) if "{}" in marker else F.lit(marker)
        text = F.when(c("line_index") == slot, F.concat(prefix, c("text"))).otherwise(text)
    unnumbered = (c("line_index") == 0) & (c("page_number") % 2 == 0)
    return v.lines.withColumn("text", F.when(unnumbered, F.lit("Confidential Draft")).otherwise(text))


_case = " ".join(
    f"WHEN {i} THEN '" + m.replace("{}", "' || page_number || '") + "' || text" for i, m in enumerate(MARKERS, start=1)
)
view("v_marked", f"SELECT * REPLACE (CASE CASE WHEN line_index = 0 AND page_number % 2 = 0 THEN -1 ELSE line_index END WHEN -1 THEN 'Confidential Draft' {_case} ELSE text END AS text) FROM v_lines")
LINE = ["document_id", "page_number", "line_index"]


@query("F1_repair_text", f"SELECT doc_id, {S.repair('broken')} AS repaired FROM v_broken")
def f1(v):
    return v.broken_text.select("doc_id", X.repair_text(c("broken")).alias("repaired"))


@query("F2_clean_inline", f"SELECT doc_id, {S.collapse(S.repair('broken'))} AS cleaned FROM v_broken")
def f2(v):
    return v.broken_text.select("doc_id", X.clean_inline(c("broken")).alias("cleaned"))


@query(
    "F3_page_paragraphs",
    f"""SELECT document_id, page_number, CAST(i - 1 AS INTEGER) AS block_no, text FROM (
      SELECT document_id, page_number, unnest(b) AS text, generate_subscripts(b, 1) AS i FROM (
        SELECT document_id, page_number, list_filter(list_transform(string_split_regex(
          replace({S.repair('text')}, '.' || chr(10), '.' || chr(10) || chr(10)), '\\n\\s*\\n'),
          lambda b: {S.collapse('b')}), lambda b: b <> '') AS b FROM v_page_text))""",
)
def f3(v):
    from arbora.operators.chunking import page_paragraphs

    spaced = F.replace(c("text"), F.lit(".\n"), F.lit(".\n\n"))  # blank lines after sentences
    return page_paragraphs(v.page_text.withColumn("text", spaced)).select(
        "document_id", "page_number", "block_no", "text"
    )


@query(
    "F4_page_lines",
    f"""SELECT document_id, page_number, CAST(i - 1 AS INTEGER) AS block_no, text FROM (
      SELECT document_id, page_number, unnest(b) AS text, generate_subscripts(b, 1) AS i FROM (
        SELECT document_id, page_number, list_filter(list_transform(string_split({S.repair('text')}, chr(10)),
          lambda b: {S.collapse('b')}), lambda b: b <> '') AS b FROM v_page_text))""",
)
def f4(v):
    from arbora.operators.chunking import page_lines

    return page_lines(v.page_text).select("document_id", "page_number", "block_no", "text")


@query(
    "F5_render_table",
    """SELECT document_id, page_number, array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), chr(10)) AS rendered
       FROM v_tables""",
)
def f5(v):
    from arbora.operators.layout import render_table

    return v.tables.select("document_id", "page_number", render_table(c("rows")).alias("rendered"))


@query(
    "F6_table_cells",
    """SELECT document_id, page_number, text, CAST(r - 1 AS INTEGER) AS row_start, CAST(r AS INTEGER) AS row_end,
              CAST(k - 1 AS INTEGER) AS col_start, CAST(k AS INTEGER) AS col_end, 1 AS row_span, 1 AS col_span FROM (
         SELECT document_id, page_number, r, unnest(row) AS text, generate_subscripts(row, 1) AS k FROM (
           SELECT document_id, page_number, unnest(rows) AS row, generate_subscripts(rows, 1) AS r FROM v_tables))""",
)
def f6(v):
    from arbora.operators.layout import table_cells

    return table_cells(v.tables).select(
        "document_id", "page_number", "text", "row_start", "row_end", "col_start", "col_end", "row_span", "col_span"
    )


@query(
    "F7_heading_level_from_marker",
    f"SELECT document_id, page_number, line_index, CAST({S.marker_level(S.collapse('text'))} AS INTEGER) AS level FROM v_marked",
)
def f7(v):
    return marked_lines(v).select(*LINE, X.heading_level_from_marker(c("text")).alias("level"))


@query(
    "F8_heading_level",
    f"""SELECT document_id, page_number, line_index, CAST({S.heading_level('t', 'font_size', 'bold', 'gap', 'body')} AS INTEGER) AS level
        FROM (SELECT *, {S.strip('text')} AS t, CAST(10 AS DOUBLE) AS body,
              greatest(0, top - lag(bottom) OVER (PARTITION BY document_id, page_number ORDER BY line_index)) AS gap FROM v_marked)""",
)
def f8(v):
    from arbora.operators.layout import gap_before

    lines = gap_before(marked_lines(v), order=("line_index",))
    return lines.select(
        *LINE, X.heading_level(c("text"), c("font_size"), c("bold"), c("gap_before"), F.lit(10.0)).alias("level")
    )


@query(
    "F9_is_list_item",
    f"SELECT document_id, page_number, line_index, regexp_matches(text, {S.LIST_ITEM}) AS is_list FROM v_marked",
)
def f9(v):
    return marked_lines(v).select(*LINE, X.is_list_item(c("text")).alias("is_list"))


@query(
    "F10_line_zone",
    """SELECT document_id, page_number, line_index, CASE WHEN top <= 79.2 THEN 'PAGE_HEADER' WHEN bottom >= 712.8 THEN 'PAGE_FOOTER' END AS zone
       FROM v_lines""",
)
def f10(v):
    return v.lines.select(*LINE, G.line_zone(c("top"), c("bottom"), c("height")).alias("zone"))


@query(
    "F11_furniture_key",
    f"SELECT document_id, page_number, line_index, {S.furniture_key('text')} AS key FROM v_marked",
)
def f11(v):
    return marked_lines(v).select(*LINE, X.furniture_key(c("text")).alias("key"))


@query(
    "F12_is_page_number",
    f"""SELECT document_id, page_number, line_index, regexp_matches('Page ' || line_index || CASE WHEN bold THEN ' of 12' ELSE text END, {S.PAGE_NUMBER}) AS numbered
        FROM v_lines""",
)
def f12(v):
    text = F.concat(
        F.lit("Page "), c("line_index").cast("string"), F.when(c("bold"), F.lit(" of 12")).otherwise(c("text"))
    )
    return v.lines.select(*LINE, X.is_page_number(text).alias("numbered"))


@query(
    "F13_boxes_overlap",
    """SELECT l.document_id, l.page_number, l.line_index, (l.x1 >= t.x0 AND t.x1 >= l.x0 AND l.bottom >= t.top AND t.bottom >= l.top) AS overlaps
       FROM v_lines l JOIN v_tables t USING (document_id, page_number)""",
)
def f13(v):
    box = lambda p: tuple(c(f"{p}.{n}") for n in ("x0", "top", "x1", "bottom"))
    pages = v.lines.alias("l").join(v.tables.alias("t"), ["document_id", "page_number"])
    return pages.select(*LINE, G.boxes_overlap(box("l"), box("t")).alias("overlaps"))


@query(
    "F14_join_lines",
    f"""SELECT document_id, page_number, {S.strip(S.collapse(S.repair("string_agg(text || CASE WHEN line_no % 3 = 0 THEN '-' ELSE '' END, chr(10) ORDER BY line_no)")))} AS joined
        FROM v_raw_lines GROUP BY document_id, page_number""",
)
def f14(v):
    hyphenated = F.concat(c("text"), F.when(c("line_no") % 3 == 0, "-").otherwise(""))
    pages = v.raw_lines.groupBy("document_id", "page_number").agg(
        F.array_sort(F.collect_list(F.struct("line_no", hyphenated.alias("text")))).alias("lines")
    )
    return pages.select(
        "document_id", "page_number", X.join_lines(F.transform("lines", lambda r: r["text"])).alias("joined")
    )


@query(
    "F15_case_ratios",
    f"""SELECT doc_id, round({S.upper_ratio('text')}, 6) AS upper_ratio, round({S.title_ratio('text')}, 6) AS title_ratio FROM documents""",
)
def f15(v):
    return v.documents.select(
        "doc_id",
        F.round(X.uppercase_ratio(c("text")), 6).alias("upper_ratio"),
        F.round(X.titlecase_ratio(c("text")), 6).alias("title_ratio"),
    )


@query(
    "F16_party_scores",
    "SELECT document_id, line_no, "
    + ", ".join(f"CAST({f('text')} AS INTEGER) AS {p.lower()}" for p, f in S.PARTY_SCORES.items())
    + " FROM v_raw_lines",
)
def f16(v):
    scores = P.party_scores(c("text"), FIXTURE_RULES)
    return v.raw_lines.select("document_id", "line_no", *[s.alias(p.lower()) for p, s in scores.items()])


@query(
    "F17_normalize_heading_candidate",
    f"SELECT document_id, line_no, {S.candidate(chr(39) + '0' + chr(39) + ' || replace(text, ' + chr(39) + 'th' + chr(39) + ', ' + chr(39) + '$h' + chr(39) + ')')} AS candidate FROM v_raw_lines",
)
def f17(v):
    damaged = F.concat(F.lit("0"), F.replace("text", F.lit("th"), F.lit("$h")))
    return v.raw_lines.select("document_id", "line_no", X.normalize_heading_candidate(damaged).alias("candidate"))


@query(
    "F18_looks_structural",
    f"SELECT document_id, line_no, {S.structural('text')} AS structural FROM v_headed",
)
def f18(v):
    return v.headed.select("document_id", "line_no", X.looks_structural(c("text")).alias("structural"))


@query(
    "F19_chunker_heading_level",
    f"SELECT document_id, line_no, CAST({S.chunker_level('t')} AS INTEGER) AS level FROM (SELECT *, {S.candidate('text')} AS t FROM v_headed)",
)
def f19(v):
    none = F.lit(None)
    level = X.chunker_heading_level(none.cast("string"), none.cast("int"), c("text"))
    return v.headed.select("document_id", "line_no", level.alias("level"))


@query("F20_heading_key", f"SELECT document_id, line_no, {S.heading_key('text')} AS heading_key FROM v_headed")
def f20(v):
    return v.headed.select("document_id", "line_no", X.heading_key(c("text")).alias("heading_key"))


@query(
    "F21_estimate_tokens",
    f"SELECT doc_id, CAST(greatest(1, ceil({S.n_words('text')} * CAST(1.33 AS DOUBLE))) AS INTEGER) AS tokens FROM documents",
)
def f21(v):
    return v.documents.select("doc_id", X.estimate_tokens(c("text")).alias("tokens"))


@query("F22_word_count", f"SELECT doc_id, CAST({S.n_words('text')} AS INTEGER) AS n_words FROM documents")
def f22(v):
    return v.documents.select("doc_id", X.word_count(c("text")).alias("n_words"))


@query(
    "F23_leaf_snippet",
    f"""SELECT id, left({S.strip('content')}, 220) AS snippet, CAST({S.n_words('content')} AS INTEGER) AS n_words, layout_partition FROM v_nodes""",
)
def f23(v):
    from arbora.operators.planning import leaf_cards

    return leaf_cards(v.nodes).select("id", "snippet", "n_words", "layout_partition")


@query(
    "F24_cosine_similarity",
    """SELECT id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS similarity
       FROM (SELECT id, CAST(embedding AS DOUBLE[]) AS e, CAST([embedding[64]] || embedding[1:63] AS DOUBLE[]) AS q FROM v_nodes)""",
)
def f24(v):
    rotated = F.concat(F.slice("embedding", 64, 1), F.slice("embedding", 1, 63))
    return v.nodes.select("id", F.round(vectors.cosine_similarity(c("embedding"), rotated), 6).alias("similarity"))


@query(
    "F25_plan_tree_levels",
    """WITH RECURSIVE plan AS (
         SELECT n_chars AS n, [n_chars] AS levels, n_chars AS cur FROM (SELECT DISTINCT n_chars FROM documents WHERE n_chars > 0)
         UNION ALL SELECT n, levels || [CAST(ceil(cur / CAST(4 AS DOUBLE)) AS BIGINT)], CAST(ceil(cur / CAST(4 AS DOUBLE)) AS BIGINT) FROM plan WHERE cur >= 4)
       SELECT n, array_to_string(CASE WHEN len(levels) > 1 AND levels[-1] > 1 THEN levels || [CAST(1 AS BIGINT)] ELSE levels END, ',') AS levels
       FROM plan WHERE cur < 4""",
)
def f25(v):
    sizes = v.documents.select(c("n_chars").alias("n")).where("n > 0").distinct()
    return sizes.select("n", F.array_join(T.plan_tree_levels(c("n")), ",").alias("levels"))


@query(
    "F26_resolve_target_clusters",
    """SELECT doc_id, CASE WHEN n_chars <= 1 THEN CAST(n_chars AS INTEGER)
         WHEN requested IS NOT NULL THEN greatest(1, least(requested, CAST(n_chars AS INTEGER)))
         ELSE CAST(greatest(2, least(5, ceil(sqrt(n_chars / CAST(2 AS DOUBLE))))) AS INTEGER) END AS target
       FROM (SELECT doc_id, n_chars, quality * 12 - toxic AS requested FROM documents LEFT JOIN labels USING (doc_id))""",
)
def f26(v):
    requested = (c("quality") * 12 - c("toxic")).cast("int")
    joined = v.documents.join(v.table("labels"), "doc_id", "left")
    return joined.select("doc_id", T.resolve_target_clusters(c("n_chars"), requested).alias("target"))


@query(
    "F27_page_distance",
    """SELECT id, CASE WHEN a1 < b0 THEN b0 - a1 WHEN b1 < a0 THEN a0 - b1 ELSE 0 END AS distance FROM (
         SELECT id, coalesce(nullif(page_start, 0), nullif(page_end, 0), 0) AS a0, coalesce(nullif(page_end, 0), nullif(page_start, 0), 0) AS a1,
                chunk_index AS b0, chunk_index + cluster_no AS b1 FROM v_nodes WHERE chunk_index > 0
         UNION ALL SELECT id, page_start, page_end, cluster_no, cluster_no FROM v_nodes WHERE chunk_index = 0)""",
)
def f27(v):
    end = F.when(c("chunk_index") > 0, c("chunk_index") + c("cluster_no")).otherwise(c("cluster_no"))
    start = F.when(c("chunk_index") > 0, c("chunk_index")).otherwise(F.lit(0))
    return v.nodes.select("id", T.page_distance(c("page_start"), c("page_end"), start, end).alias("distance"))


@query(
    "F28_title_and_preview",
    f"""SELECT doc_id, {S.title('text')} AS title, CASE WHEN p = '' THEN 'No preview available.' WHEN len(p) > 72 THEN left(p, 69) || '...' ELSE p END AS preview
        FROM (SELECT *, {S.collapse('text')} AS p FROM documents)""",
)
def f28(v):
    return v.documents.select(
        "doc_id", X.title_from_content(c("text")).alias("title"), X.preview(c("text")).alias("preview")
    )


@query("F29_format_page_range", f"SELECT id, {S.page_range('page_start - 1', 'chunk_index')} AS pages FROM v_nodes")
def f29(v):
    return v.nodes.select("id", L.format_page_range(c("page_start") - 1, c("chunk_index")).alias("pages"))


def card_fields(v: Views):
    """Nodes with the metadata fields chips read, derived from catalogue-like columns."""
    nodes = v.tree
    strategy = F.when(c("level") == 0, "ADVERSARIAL").when(c("cluster_no") % 3 == 0, "HIERARCHICAL").when(
        c("cluster_no") % 3 == 1, "TRANSACTIONAL"
    )
    return nodes.select(
        "*",
        strategy.alias("layout_strategy"),
        F.when(c("cluster_no") % 4 == 1, c("cluster_no").cast("string")).alias("clause_number"),
        F.when(c("cluster_no") % 5 == 2, F.lit("Terms")).alias("clause_title"),
        c("layout_partition").alias("party_enclave"),
        F.when(c("chunk_index") % 2 == 0, c("chunk_index").cast("string")).alias("issue_key"),
        F.when(c("chunk_index") % 3 == 0, F.lit("")).otherwise(F.lit("reply")).alias("argument_type"),
        F.when(c("cluster_no") % 2 == 0, F.concat(F.lit("section-"), c("cluster_no").cast("string"))).alias("section_key"),
        F.when(c("level") == 1, 2).alias("structural_depth"),
        F.array(
            F.struct(F.lit("part-1").alias("key"), F.lit("Part One").alias("title"), F.lit(1).alias("depth")),
            F.struct(c("parent_id").alias("key"), F.lit(None).cast("string").alias("title"), F.lit(2).alias("depth")),
        ).alias("section_hierarchy"),
    )


view(
    "v_cards",
    """SELECT *, CASE WHEN level = 0 THEN 'ADVERSARIAL' WHEN cluster_no % 3 = 0 THEN 'HIERARCHICAL' WHEN cluster_no % 3 = 1 THEN 'TRANSACTIONAL' END AS layout_strategy,
         CASE WHEN cluster_no % 4 = 1 THEN CAST(cluster_no AS VARCHAR) END AS clause_number,
         CASE WHEN cluster_no % 5 = 2 THEN 'Terms' END AS clause_title,
         CASE WHEN chunk_index % 2 = 0 THEN CAST(chunk_index AS VARCHAR) END AS issue_key,
         CASE WHEN chunk_index % 3 = 0 THEN '' ELSE 'reply' END AS argument_type,
         CASE WHEN cluster_no % 2 = 0 THEN 'section-' || cluster_no END AS section_key FROM v_tree""",
)
CHIPS_SQL = """list_filter(CASE WHEN len(list_filter(chips0, lambda x: x IS NOT NULL)) = 0 THEN [layout_strategy] ELSE chips0 END, lambda x: x IS NOT NULL)"""
view(
    "v_chips",
    f"""SELECT *, {CHIPS_SQL} AS chips FROM (SELECT *, ['Clause ' || clause_number, clause_title,
          CASE WHEN layout_strategy = 'ADVERSARIAL' THEN layout_partition END,
          CASE WHEN layout_strategy = 'ADVERSARIAL' THEN 'Issue ' || issue_key END,
          CASE WHEN layout_strategy = 'ADVERSARIAL' THEN nullif(argument_type, '') END,
          CASE WHEN layout_strategy = 'HIERARCHICAL' THEN 'Part One' END,
          CASE WHEN layout_strategy = 'HIERARCHICAL' THEN parent_id END,
          CASE WHEN layout_strategy = 'HIERARCHICAL' AND level = 1 THEN 'Structural Depth 2' END] AS chips0 FROM v_cards)""",
)
FIELDS = (
    "layout_strategy", "clause_number", "clause_title", "party_enclave", "issue_key", "argument_type", "section_key",
    "structural_depth",
)


def chips_of(df):
    return L.metadata_chips({f: c(f) for f in FIELDS}, c("section_hierarchy"))


@query("F30_metadata_chips", "SELECT id, array_to_string(chips, '; ') AS chips FROM v_chips")
def f30(v):
    cards = card_fields(v)
    return cards.select("id", F.array_join(chips_of(cards), "; ").alias("chips"))


@query(
    "F31_node_identifier",
    """SELECT id, CASE WHEN level = 0 THEN 'Chunk ' || chunk_index
         ELSE coalesce('Clause ' || clause_number, section_key, chips[1], CASE WHEN level = 2 THEN 'Root Summary' END, 'Level ' || level) END AS identifier
       FROM v_chips""",
)
def f31(v):
    cards = card_fields(v)
    kind = F.when(c("level") == 2, "root_summary").otherwise(c("node_type"))
    return cards.select(
        "id",
        L.node_identifier(
            c("id"), kind, c("level"), c("chunk_index"), c("clause_number"), c("section_key"), chips_of(cards)
        ).alias("identifier"),
    )


@query(
    "F32_status_labels",
    """SELECT document_id, CASE ingestion_status WHEN 'indexed' THEN 'Ready' WHEN 'processing' THEN 'Ingesting...' WHEN 'failed' THEN 'Failed' ELSE 'Queued' END AS label,
         CASE WHEN ingestion_status IN ('failed','indexed','processing') THEN 'done' ELSE 'current' END AS queued,
         CASE ingestion_status WHEN 'failed' THEN 'failed' WHEN 'indexed' THEN 'done' WHEN 'processing' THEN 'current' ELSE 'pending' END AS processing,
         CASE ingestion_status WHEN 'indexed' THEN 'done' ELSE 'pending' END AS ready FROM v_catalog""",
)
def f32(v):
    status = c("ingestion_status")
    steps = [L.step_state(s, status).alias(s) for s in ("queued", "processing", "ready")]
    return v.catalog.select("document_id", L.status_label(status).alias("label"), *steps)


@query(
    "F33_file_names",
    """SELECT upload_id, CASE WHEN lower(file_name) LIKE '%.pdf' THEN file_name ELSE file_name || '.pdf' END AS with_pdf,
         regexp_replace(file_name, '(?i)\\.pdf$', '') AS without_pdf, regexp_replace(file_name, '[^a-zA-Z0-9._-]', '_', 'g') AS safe,
         owner_id || '/1700000000000-' || upload_id || '-' || regexp_replace(file_name, '[^a-zA-Z0-9._-]', '_', 'g') || '.enc' AS storage_path
       FROM v_uploads""",
)
def f33(v):
    name = c("file_name")
    return v.uploads.select(
        "upload_id",
        L.with_pdf(name).alias("with_pdf"),
        L.strip_pdf(name).alias("without_pdf"),
        L.safe_name(name).alias("safe"),
        L.storage_path(c("owner_id"), F.lit(1700000000000), c("upload_id"), name).alias("storage_path"),
    )


@query(
    "F35_normalize_bbox",
    """SELECT document_id, page_number, line_index, coalesce(a, x0) AS "left", coalesce(b, top) AS top, coalesce(d, coalesce(a, x0)) AS "right", bottom FROM (
         SELECT *, CASE WHEN line_index % 2 = 0 THEN x0 + 1 END AS a, CASE WHEN line_index % 3 = 0 THEN top + 1 END AS b,
                   CASE WHEN line_index % 4 > 0 THEN x1 END AS d FROM v_lines)""",
)
def f35(v):
    i = c("line_index")
    box = G.normalize_bbox(
        left=F.when(i % 2 == 0, c("x0") + 1),
        x0=c("x0"),
        top=F.when(i % 3 == 0, c("top") + 1),
        y0=c("top"),
        x1=F.when(i % 4 > 0, c("x1")),
        bottom=c("bottom"),
    )
    return v.lines.select(*LINE, box.alias("box")).select(*LINE, "box.*")


@query(
    "F36_relative_highlight",
    """SELECT document_id, page_number, line_index, round(x0 / 612 * 100, 6) AS left_pct, round(top / 792 * 100, 6) AS top_pct,
              round((x1 - x0) / 612 * 100, 6) AS width_pct, round((bottom - top) / 792 * 100, 6) AS height_pct FROM v_lines""",
)
def f36(v):
    h = G.relative_highlight(G.box(c("x0"), c("top"), c("x1"), c("bottom")), c("width"), c("height"))
    names = ("left_pct", "top_pct", "width_pct", "height_pct")
    return v.lines.select(*LINE, h.alias("h")).select(*LINE, *[F.round(f"h.{n}", 6).alias(n) for n in names])


@query(
    "F37_strategy_label_initials",
    """SELECT p_partkey, coalesce(nullif(array_to_string(list_transform(list_slice(list_filter(string_split(p_name, ' '), lambda w: w <> ''), 1, 2), lambda w: upper(left(w, 1))), ''), ''), 'U') AS initials,
         CASE p_size % 4 WHEN 0 THEN 'Adversarial & Disputed Records' WHEN 1 THEN 'Statutory & Codified Frameworks' ELSE 'Linear & Contractual Instruments' END AS label
       FROM part""",
)
def f37(v):
    strategy = F.when(c("p_size") % 4 == 0, "ADVERSARIAL").when(c("p_size") % 4 == 1, "HIERARCHICAL").when(
        c("p_size") % 4 == 2, "TRANSACTIONAL"
    )
    return v.table("part").select(
        "p_partkey", L.initials(c("p_name")).alias("initials"), L.strategy_label(strategy).alias("label")
    )


@query(
    "F39_shared_hierarchy",
    """SELECT id, CASE WHEN chunk_index % 3 = 0 THEN '' WHEN chunk_index % 3 = 1 THEN 'part-1' ELSE 'part-1/' || coalesce(parent_id, 'x') END AS shared FROM v_tree WHERE chunk_index IS NOT NULL
       UNION ALL SELECT id, 'part-1/' || coalesce(parent_id, 'x') FROM v_tree WHERE chunk_index IS NULL""",
)
def f39(v):
    sample = F.array(
        F.struct(F.lit("part-1").alias("key"), F.lit("Part").alias("title"), F.lit(1).alias("depth")),
        F.struct(F.coalesce("parent_id", F.lit("x")).alias("key"), F.lit("S").alias("title"), F.lit(2).alias("depth")),
    ).cast(HIERARCHY)
    path = F.when(c("chunk_index") % 3 == 0, F.array().cast("array<string>")).when(
        c("chunk_index") % 3 == 1, F.array(F.lit("part-1"))
    ).otherwise(F.array(F.lit("part-1"), F.lit("absent")))
    shared = T.shared_hierarchy(c("sample"), c("path"))
    rows = v.tree.select("id", sample.alias("sample"), path.alias("path"))
    return rows.select("id", F.array_join(F.transform(shared, lambda h: h["key"]), "/").alias("shared"))


@query(
    "F40_content_key",
    """SELECT doc_id, sha256('{"dims":64,"model":"hash","task":"RETRIEVAL_DOCUMENT","text":' || CAST(to_json(text) AS VARCHAR) || '}') AS content_key FROM documents""",
)
def f40(v):
    key = C.content_key(c("text"), "hash", "RETRIEVAL_DOCUMENT", 64)
    return v.documents.select("doc_id", key.alias("content_key"))


@query(
    "F43_names_and_emails",
    """SELECT c_custkey, trim(c_mktsegment || ' ' || c_name) AS full_name, trim(lower(' ' || c_name || '@Firm.Example ')) AS email FROM customer""",
)
def f43(v):
    email = F.concat(F.lit(" "), c("c_name"), F.lit("@Firm.Example "))
    return v.table("customer").select(
        "c_custkey", L.full_name(c("c_mktsegment"), c("c_name")).alias("full_name"), L.email_key(email).alias("email")
    )


@query("F44_content_sha256", "SELECT page_id, sha256(html) AS digest FROM pages")
def f44(v):
    return v.table("pages").select("page_id", C.content_sha256(c("html").cast("binary")).alias("digest"))


@query(
    "F45_encrypt_decrypt",
    """SELECT id, content, CAST(4 * ((octet_length(encode(content)) + 16 + 2) // 3) AS INTEGER) AS cipher_chars, 16 AS iv_chars, 'aes-gcm-v1' AS crypto_version, TRUE AS wrong_key_is_null
       FROM v_nodes""",
)
def f45(v):
    key = F.unhex(F.substring(F.sha2(c("owner_id"), 256), 1, 32))
    iv = C.synthetic_iv(c("id"), F.lit("run-1"), c("content"))
    sealed = v.nodes.select("id", key.alias("key"), F.struct(*[x.alias(n) for n, x in C.encrypt_content(c("content"), key, iv).items()]).alias("s"))
    wrong = F.unhex(F.substring(F.sha2(F.lit("other"), 256), 1, 32))
    return sealed.select(
        "id",
        C.decrypt_content(c("s.encrypted_content"), c("s.content_iv"), c("key")).alias("content"),
        F.length("s.encrypted_content").alias("cipher_chars"),
        F.length("s.content_iv").alias("iv_chars"),
        c("s.crypto_version").alias("crypto_version"),
        C.decrypt_content(c("s.encrypted_content"), c("s.content_iv"), wrong).isNull().alias("wrong_key_is_null"),
    )


@query(
    "F46_embedding_missing",
    """SELECT document_id, bool_or(embedding IS NULL OR len(embedding) = 0 OR cluster_no = 9) AS missing, count(*) AS leaves FROM v_nodes GROUP BY document_id""",
)
def f46(v):
    from arbora.plans.preview import embedding_missing

    damaged = v.nodes.withColumn("embedding", F.when(c("cluster_no") != 9, c("embedding")))
    return embedding_missing(damaged)


@query("F47_stable_id", "SELECT id, sha256(document_id || '|' || 'run-1' || '|' || level || '|' || id) AS stable FROM v_tree")
def f47(v):
    return v.tree.select("id", C.stable_id(c("document_id"), F.lit("run-1"), c("level"), c("id")).alias("stable"))


@query(
    "F48_evidence_label",
    f"""SELECT id, label, {S.page_range('page_start', 'page_end')} || ' · Chunk ' || label || CASE WHEN layout_strategy IS NULL THEN '' ELSE ' · ' || layout_strategy END AS line
        FROM (SELECT *, coalesce(nullif(list_last(string_split(CASE WHEN level = 0 THEN id END, '-')), ''), 'source-' || (vec_id + 1)) AS label FROM v_cards)""",
)
def f48(v):
    label = L.evidence_label(F.when(c("level") == 0, c("id")), c("vec_id") + 1)
    cards = card_fields(v).withColumn("label", label)
    line = L.evidence_line(c("page_start"), c("page_end"), c("label"), c("layout_strategy"))
    return cards.select("id", "label", line.alias("line"))


@query("T9_first_non_blank_line", f"SELECT doc_id, {S.first_line('text')} AS first_line FROM documents")
def t9(v):
    return v.documents.select("doc_id", X.first_non_blank_line(c("text")).alias("first_line"))


@query(
    "T11_leaders",
    "SELECT document_id, line_no, CASE WHEN greatest(a, b, d) = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN a = greatest(a, b, d) THEN 'CLAIMANT' END, CASE WHEN b = greatest(a, b, d) THEN 'RESPONDENT' END, CASE WHEN d = greatest(a, b, d) THEN 'TRIBUNAL' END], lambda x: x IS NOT NULL), ',') END AS leaders FROM ("
    f"SELECT document_id, line_no, {S.PARTY_SCORES['CLAIMANT']('text')} AS a, {S.PARTY_SCORES['RESPONDENT']('text')} AS b, {S.PARTY_SCORES['TRIBUNAL']('text')} AS d FROM v_raw_lines)",
)
def t11(v):
    best = P.leaders(P.party_scores(c("text"), FIXTURE_RULES))
    return v.raw_lines.select("document_id", "line_no", F.array_join(best, ",").alias("leaders"))


@query(
    "P6_normalize_strategy",
    """SELECT upload_id, CASE WHEN trim(upper(coalesce(layout_strategy, ''))) IN ('ADVERSARIAL','HIERARCHICAL','TRANSACTIONAL') THEN trim(upper(layout_strategy)) ELSE 'TRANSACTIONAL' END AS strategy FROM v_uploads""",
)
def p6(v):
    return v.uploads.select("upload_id", L.normalize_strategy(c("layout_strategy")).alias("strategy"))


@query(
    "P7_map_labels",
    """SELECT document_id, reading_order, CASE label WHEN 'SECTION_HEADER' THEN 'heading' WHEN 'PARAGRAPH' THEN 'paragraph' WHEN 'LIST_ITEM' THEN 'list_item' ELSE 'unknown' END AS block_type, label AS back FROM v_html_items
       UNION ALL SELECT document_id, reading_order + 1000000, 'unknown', 'TEXT' FROM v_html_items""",
)
def p7(v):
    other = v.html_items.withColumns({"label": F.lit("FIGURE"), "reading_order": c("reading_order") + 1000000})
    rows = v.html_items.unionByName(other).withColumn("block_type", L.label_to_block_type(c("label")))
    return rows.select("document_id", "reading_order", "block_type", L.block_type_to_label(c("block_type")).alias("back"))


@query(
    "P14_normalize_node_metadata",
    """SELECT event_id, event_type AS layout_strategy, coalesce(CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) END, 'c' || user_id) AS cluster_id,
              nullif(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS structural_depth, '[]' AS section_hierarchy, CAST(NULL AS VARCHAR) AS clause_title FROM events""",
)
def p14(v):
    camel = F.when(c("event_type") == "view", c("user_id").cast("string")).otherwise("")
    meta = F.to_json(
        F.struct(
            c("event_type").alias("layout_strategy"),
            camel.alias("clusterId"),
            F.concat(F.lit("c"), c("user_id").cast("string")).alias("cluster_id"),
            F.get_json_object("props", "$.k").cast("int").alias("structuralDepth"),
            F.lit("").alias("clauseTitle"),
        )
    )
    fields = L.normalize_metadata(c("meta"))
    keep = ("layout_strategy", "cluster_id", "structural_depth", "section_hierarchy", "clause_title")
    return v.table("events").select("event_id", meta.alias("meta")).select(
        "event_id", *[fields[k].alias(k) for k in keep]
    )
