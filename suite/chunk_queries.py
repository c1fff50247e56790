"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import text as X
from arbora.operators import chunking as K
from arbora.operators.scan import ordinal_segment
from suite import sql_exprs as S
from suite.registry import query
from suite.sql_views import view
from suite.views import FIXTURE_RULES, Views

c = F.col


def windows_sql(source: str, keys: str, order: str, target: int, overlap: int) -> str:
    """Positions of every word, then one row per (window, word), grouped back to text."""
    s = target - overlap
    return f"""
    SELECT {keys}, i, string_agg(w, ' ' ORDER BY pos) AS content, min(page_number) AS page_start, max(page_number) AS page_end FROM (
      SELECT {keys}, page_number, w, pos, unnest(generate_series(
               CASE WHEN pos < {target} THEN 0 ELSE (pos - {target}) // {s} + 1 END, least(pos // {s}, n_win - 1))) AS i
      FROM (SELECT *, full_win + CASE WHEN full_win * {s} < total THEN 1 ELSE 0 END AS n_win FROM (
        SELECT *, CASE WHEN total < {target} THEN 0 ELSE (total - {target}) // {s} + 1 END AS full_win FROM (
          SELECT {keys}, page_number, w, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, k) - 1 AS pos,
                 count(*) OVER (PARTITION BY {keys}) AS total
          FROM (SELECT {keys}, {order}, page_number, unnest(ws) AS w, generate_subscripts(ws, 1) AS k
                FROM (SELECT *, {S.words('text')} AS ws FROM {source}))))))
    GROUP BY {keys}, i"""


view("v_page_text_doc", "SELECT document_id, page_number, page_number AS page_order, text FROM v_page_text")


@query(
    "W5_sliding_word_windows",
    f"SELECT document_id, CAST(i AS INTEGER) AS chunk_index, content, page_start, page_end FROM ({windows_sql('v_page_text_doc', 'document_id', 'page_order', 400, 75)})",
)
def w5(v):
    return K.transactional_chunks(v.page_text).select("document_id", "chunk_index", "content", "page_start", "page_end")


@query(
    "W5_sliding_word_windows_50",
    f"SELECT document_id, CAST(i AS INTEGER) AS chunk_index, content, page_start, page_end FROM ({windows_sql('v_page_text_doc', 'document_id', 'page_order', 400, 50)})",
)
def w5b(v):
    return K.transactional_chunks(v.page_text, 400, 50).select(
        "document_id", "chunk_index", "content", "page_start", "page_end"
    )


def turns(v: Views):
    return v.table("conversations").select(
        F.concat(F.lit("conv-"), c("conv_id").cast("string")).alias("document_id"),
        c("turn").alias("block_no"),
        c("turn").cast("int").alias("page_number"),
        c("role").alias("party"),
        "text",
    )


view(
    "v_turns",
    "SELECT 'conv-' || conv_id AS document_id, turn AS block_no, CAST(turn AS INTEGER) AS page_number, role AS party, text FROM conversations",
)
view(
    "v_runs",
    """SELECT *, CAST(sum(chg) OVER (PARTITION BY document_id ORDER BY block_no) - 1 AS INTEGER) AS enclave_index FROM (
         SELECT *, CASE WHEN party IS NOT DISTINCT FROM lag(party) OVER (PARTITION BY document_id ORDER BY block_no) THEN 0 ELSE 1 END AS chg FROM v_turns)""",
)


@query(
    "W6_block_word_windows",
    f"SELECT document_id, enclave_index, CAST(i AS INTEGER) AS fragment, content, page_start, page_end FROM ({windows_sql('v_runs', 'document_id, enclave_index', 'block_no', 40, 10)})",
)
def w6(v):
    runs = K.party_enclaves(turns(v))
    return K.word_windows(runs, ["document_id", "enclave_index"], target=40, overlap=10)


PARTIES = "['CLAIMANT','RESPONDENT','TRIBUNAL']"
_scores = ", ".join(f"{f('text')} AS {p.lower()}" for p, f in S.PARTY_SCORES.items())
view(
    "v_party",
    f"""SELECT document_id, page_number, line_no AS block_no, text, CASE WHEN greatest(claimant, respondent, tribunal) = 0 THEN CAST([] AS VARCHAR[]) ELSE
          list_filter([CASE WHEN claimant = greatest(claimant, respondent, tribunal) THEN 'CLAIMANT' END,
            CASE WHEN respondent = greatest(claimant, respondent, tribunal) THEN 'RESPONDENT' END,
            CASE WHEN tribunal = greatest(claimant, respondent, tribunal) THEN 'TRIBUNAL' END], lambda x: x IS NOT NULL) END AS leaders
        FROM (SELECT document_id, page_number, line_no, {S.collapse('text')} AS text, {_scores} FROM v_raw_lines) WHERE text <> ''""",
)
view(
    "v_carried",
    """SELECT document_id, page_number, block_no, text, leaders,
         CASE WHEN min(CASE WHEN len(leaders) > 1 AND NOT list_contains(leaders, coalesce(anchor, '')) THEN 0 ELSE 1 END)
                OVER (PARTITION BY document_id, grp ORDER BY block_no) = 1 THEN anchor ELSE 'NEUTRAL' END AS party
       FROM (SELECT *, first_value(own) OVER (PARTITION BY document_id, grp ORDER BY block_no) AS anchor FROM (
         SELECT *, sum(CASE WHEN len(leaders) < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY block_no) AS grp,
                CASE len(leaders) WHEN 0 THEN 'NEUTRAL' WHEN 1 THEN leaders[1] END AS own FROM v_party))""",
)
view(
    "v_enclaves",
    """SELECT *, CAST(sum(chg) OVER (PARTITION BY document_id ORDER BY block_no) - 1 AS INTEGER) AS enclave_index FROM (
         SELECT *, CASE WHEN party IS NOT DISTINCT FROM lag(party) OVER (PARTITION BY document_id ORDER BY block_no) THEN 0 ELSE 1 END AS chg FROM v_carried)""",
)


def party_lines(v: Views):
    lines = v.raw_lines.select(
        "document_id", "page_number", c("line_no").alias("block_no"), X.collapse(c("text")).alias("text")
    )
    return lines.where("text <> ''")


@query("W7_carry_party", "SELECT document_id, block_no, party FROM v_carried")
def w7(v):
    return K.carry_party(K.with_leaders(party_lines(v), FIXTURE_RULES)).select("document_id", "block_no", "party")


@query(
    "W8_party_enclaves",
    """SELECT document_id, enclave_index, min(party) AS party, min(page_number) AS page_start, max(page_number) AS page_end, count(*) AS turns
       FROM v_runs GROUP BY document_id, enclave_index""",
)
def w8(v):
    return K.party_enclaves(turns(v)).groupBy("document_id", "enclave_index").agg(
        F.min("party").alias("party"),
        F.min("page_number").alias("page_start"),
        F.max("page_number").alias("page_end"),
        F.count("*").alias("turns"),
    )


@query(
    "C21_adversarial_chunks",
    f"""SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY enclave_index, i) - 1 AS INTEGER) AS chunk_index,
          content, page_start, page_end, party AS party_enclave, enclave_index
        FROM ({windows_sql('v_enclaves', 'document_id, enclave_index, party', 'block_no', 340, 40)})""",
)
def c21(v):
    return K.adversarial_chunks(party_lines(v), FIXTURE_RULES).select(
        "document_id", "chunk_index", "content", "page_start", "page_end", "party_enclave", "enclave_index"
    )


# --- sections ------------------------------------------------------------------------------

view(
    "v_leveled",
    f"""SELECT document_id, page_number, line_no, text, level, {S.heading_key('text')} AS slug,
          CAST(sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY line_no) AS INTEGER) AS section_no
        FROM (SELECT *, CAST({S.chunker_level('t')} AS INTEGER) AS level FROM (SELECT *, {S.candidate('text')} AS t FROM v_headed))""",
)
view(
    "v_headings",
    """SELECT *, coalesce(slug, 'level-' || level || '-' || sum(CASE WHEN slug IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, level ORDER BY section_no)) AS key
       FROM v_leveled WHERE level IS NOT NULL""",
)
# The stack itself, one heading at a time.
STACK = """stack AS (
  SELECT document_id, section_no, [key] AS path FROM v_headings WHERE section_no = 1
  UNION ALL
  SELECT h.document_id, h.section_no, list_slice(s.path, 1, greatest(h.level - 1, 0)) || [h.key]
  FROM stack s JOIN v_headings h ON h.document_id = s.document_id AND h.section_no = s.section_no + 1)"""


def headed_lines(v: Views):
    return K.with_heading_levels(v.headed.withColumnRenamed("line_no", "block_no"))


@query(
    "W9_heading_stack",
    f"WITH RECURSIVE {STACK} SELECT document_id, section_no, array_to_string(path, '/') AS path FROM stack",
)
def w9(v):
    sectioned = K.assign_sections(headed_lines(v))
    return K.section_paths(sectioned).select(
        "document_id",
        "section_no",
        F.array_join(F.transform("section_hierarchy", lambda h: h["key"]), "/").alias("path"),
    )


@query("W10_synthetic_heading_keys", "SELECT document_id, section_no, key AS section_key FROM v_unmarked_headings")
def w10(v):
    """Headings without any marker: every heading line loses its slug."""
    lines = headed_lines(v).withColumn("heading_slug", F.lit(None).cast("string"))
    headings = K.assign_sections(lines).where("heading_level IS NOT NULL")
    return K.synthetic_heading_keys(headings).select("document_id", "section_no", "section_key")


view(
    "v_unmarked_headings",
    """SELECT document_id, section_no, 'level-' || level || '-' || count(*) OVER (PARTITION BY document_id, level ORDER BY section_no) AS key
       FROM v_leveled WHERE level IS NOT NULL""",
)


@query("W11_assign_sections", "SELECT document_id, line_no AS block_no, section_no FROM v_leveled")
def w11(v):
    return K.assign_sections(headed_lines(v)).select("document_id", "block_no", "section_no")


view("v_section_words", f"SELECT document_id, section_no, CAST(sum({S.n_words('text')}) AS BIGINT) AS total FROM v_leveled GROUP BY document_id, section_no")
view("v_long_lines", "SELECT l.* FROM v_leveled l JOIN v_section_words USING (document_id, section_no) WHERE total > 650")
view(
    "v_section_chunks",
    f"""SELECT document_id, section_no, CAST(i AS INTEGER) AS fragment, content, page_start, page_end
        FROM ({windows_sql('v_long_lines', 'document_id, section_no', 'line_no', 500, 0)})
        UNION ALL
        SELECT document_id, section_no, 0, string_agg(text, chr(10) ORDER BY line_no), min(page_number), max(page_number)
        FROM v_leveled JOIN v_section_words USING (document_id, section_no) WHERE total <= 650 GROUP BY document_id, section_no""",
)


@query("W12_section_chunks", "SELECT * FROM v_section_chunks")
def w12(v):
    return K.section_chunks(K.assign_sections(headed_lines(v)))


@query(
    "W13_global_chunk_index",
    "SELECT document_id, section_no, fragment, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_no, fragment) - 1 AS INTEGER) AS chunk_index FROM v_section_chunks",
)
def w13(v):
    chunks = K.section_chunks(K.assign_sections(headed_lines(v)))
    return K.global_chunk_index(chunks, "section_no").select("document_id", "section_no", "fragment", "chunk_index")


C22_SQL = f"""WITH RECURSIVE {STACK}
  SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_no, fragment) - 1 AS INTEGER) AS chunk_index,
         content, page_start, page_end, coalesce(path[1], 'preamble-1') AS layout_partition, array_to_string(coalesce(path, ['preamble-1']), '/') AS path,
         coalesce(path[-1], 'preamble-1') AS section_key, CASE WHEN len(path) > 1 THEN path[-2] END AS section_parent_key,
         CAST(coalesce(len(path), 1) AS INTEGER) AS structural_depth, fragment AS section_fragment
  FROM v_section_chunks LEFT JOIN stack USING (document_id, section_no)"""


@query("C22_hierarchical_chunks", C22_SQL)
def c22(v):
    chunks = K.hierarchical_chunks(v.headed.withColumnRenamed("line_no", "block_no"))
    return chunks.select(
        "document_id", "chunk_index", "content", "page_start", "page_end", "layout_partition", "section_key",
        "section_parent_key", "structural_depth", "section_fragment",
        F.array_join(F.transform("section_hierarchy", lambda h: h["key"]), "/").alias("path"),
    )


view(
    "v_item_lines",
    f"""SELECT document_id, page_number, line_no, text, level, {S.heading_key('text')} AS slug,
          CAST(sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY line_no) AS INTEGER) AS section_no
        FROM (SELECT *, CASE WHEN label = 'SECTION_HEADER' THEN 1 ELSE CAST({S.chunker_level('t')} AS INTEGER) END AS level
              FROM (SELECT document_id, page_number, reading_order AS line_no, label, {S.collapse('text')} AS text, {S.candidate('text')} AS t FROM v_html_items)
              WHERE text <> '')""",
)
view("v_item_words", f"SELECT document_id, section_no, CAST(sum({S.n_words('text')}) AS BIGINT) AS total FROM v_item_lines GROUP BY document_id, section_no")
view("v_item_long", "SELECT l.* FROM v_item_lines l JOIN v_item_words USING (document_id, section_no) WHERE total > 650")


@query(
    "C22_hierarchical_chunks_items",
    f"""SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_no, fragment) - 1 AS INTEGER) AS chunk_index, section_fragment, content
        FROM (SELECT document_id, section_no, CAST(i AS INTEGER) AS fragment, CAST(i AS INTEGER) AS section_fragment, content
              FROM ({windows_sql('v_item_long', 'document_id, section_no', 'line_no', 500, 0)})
              UNION ALL
              SELECT document_id, section_no, 0, 0, string_agg(text, chr(10) ORDER BY line_no)
              FROM v_item_lines JOIN v_item_words USING (document_id, section_no) WHERE total <= 650 GROUP BY document_id, section_no)""",
)
def c22_items(v):
    """Structured web-page items: typed headings open sections, list items and paragraphs fill them."""
    no_text = v.html_items.select("document_id", "page_number", F.lit("").alias("text")).distinct()
    chunks = K.hierarchical_chunks(K.text_units(no_text, v.html_items, "line"))
    return chunks.select("document_id", "chunk_index", "section_fragment", "content")


@query(
    "F38_chunk_metadata",
    f"""SELECT document_id, chunk_index, CAST(greatest(1, ceil({S.n_words('content')} * CAST(1.33 AS DOUBLE))) AS INTEGER) AS token_count,
          'v2' AS extraction_source, confidence AS extraction_confidence, 'TRANSACTIONAL' AS layout_strategy, 75 AS window_overlap_words
        FROM (SELECT document_id, CAST(i AS INTEGER) AS chunk_index, content FROM ({windows_sql('v_page_text_doc', 'document_id', 'page_order', 400, 75)}))
        JOIN (SELECT 'doc-' || doc_id AS document_id, CAST(n_chars % 100 AS DOUBLE) / 100 AS confidence FROM documents) USING (document_id)""",
)
def f38(v):
    quality = v.documents.select(
        F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias("document_id"),
        ((c("n_chars") % 100).cast("double") / 100).alias("confidence"),
    )
    return K.chunk_metadata(K.transactional_chunks(v.page_text), quality).select(
        "document_id", "chunk_index", "token_count", "extraction_source", "extraction_confidence", "layout_strategy",
        "window_overlap_words",
    )
