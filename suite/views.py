"""Derived inputs: page layouts, headed lines, nodes, trees and catalogues from the given tables.

Every view reads every row and every whole text of its source tables. ``suite.sql_views`` states the same
derivations in SQL for the twins.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions import text as X
from arbora.functions.parties import simple_rules
from arbora.session import cut_lineage
from suite.sql_views import view

FIXTURE_RULES = simple_rules(
    {"CLAIMANT": ("the", "and"), "RESPONDENT": ("of", "to"), "TRIBUNAL": ("in", "is")}
)
HIERARCHY = "array<struct<key:string,title:string,depth:int>>"

#: An item of a page: everything up to the next tag that is not inline.
ITEM = (
    "<{tag}(?: [^>]*)?>((?:[^<]+|<[ 0-9=]"
    "|</?(?:a|abbr|b|br|cite|code|em|i|mark|q|s|small|span|strong|sub|sup|u)(?: [^>]*)?/?>)*)"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    # --- text -------------------------------------------------------------------

    @cached_property
    def raw_lines(self) -> DataFrame:
        """One row per physical line, ten lines to a page."""
        return self.documents.select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"),
            "lang",
            F.posexplode(F.split("text", "\n")).alias("line_no", "text"),
        ).withColumn("page_number", (F.floor(F.col("line_no") / 10) + 1).cast("int"))

    @cached_property
    def broken_text(self) -> DataFrame:
        """Documents with hyphenated line breaks, for repair functions."""
        return self.documents.select(
            "doc_id", F.replace("text", F.lit("tion"), F.lit("-\r\ntion")).alias("broken")
        )

    # --- layout -----------------------------------------------------------------

    @cached_property
    def line_pages(self) -> DataFrame:
        """The pages of ``raw_lines``, from the number of lines of each document."""
        counts = self.documents.where(F.col("text").isNotNull()).select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), F.size(F.split("text", "\n")).alias("n")
        )
        longest = counts.groupBy("document_id").agg(F.max("n").alias("n"))
        return longest.select("document_id", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / 10).cast("int"))).alias("page_number"))

    def with_stored_lines(self) -> Views:
        """The same views over lines that are derived and written once."""
        stored = Views(self.spark, self.sf_dir)
        stored.lines = cut_lineage(self.lines)
        return stored

    @cached_property
    def lines(self) -> DataFrame:
        """Layout lines with geometry, plus one running header per page."""
        n = X.word_count(F.col("text"))
        row = F.col("line_no") % 10
        body = self.raw_lines.where(X.strip(F.col("text")) != "").withColumn("n", n)
        body = body.select(
            "document_id",
            "page_number",
            (row + 1).cast("int").alias("line_index"),
            "text",
            (F.lit(72.0) + 12 * (F.col("n") % 3)).alias("x0"),
            F.lit(540.0).alias("x1"),
            (F.lit(60.0) + 72 * row + 8 * (F.col("n") % 5)).alias("top"),
            F.when(F.col("n") <= 4, 14.0).otherwise(10.0).alias("font_size"),
            (F.col("n") <= 4).alias("bold"),
        )
        header = self.line_pages.select(
            "document_id",
            "page_number",
            F.lit(0).alias("line_index"),
            F.concat(F.lit("Confidential Draft "), F.col("page_number").cast("string")).alias("text"),
            F.lit(72.0).alias("x0"),
            F.lit(540.0).alias("x1"),
            F.lit(10.0).alias("top"),
            F.lit(10.0).alias("font_size"),
            F.lit(False).alias("bold"),
        )
        return body.unionByName(header).withColumns(
            {"bottom": F.col("top") + 12, "height": F.lit(792.0), "width": F.lit(612.0)}
        )

    @cached_property
    def page_text(self) -> DataFrame:
        return self.raw_lines.groupBy("document_id", "page_number").agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]
                ),
                "\n",
            ).alias("text")
        )

    @cached_property
    def words(self) -> DataFrame:
        """Layout words; also used as glyph boxes with size and font name."""
        spread = self.lines.select(
            "document_id",
            "page_number",
            "line_index",
            F.col("x0").alias("line_x0"),
            F.col("top").alias("line_top"),
            F.posexplode(X.words(F.col("text"))).alias("pos", "text"),
        )
        return spread.select(
            "document_id",
            "page_number",
            "line_index",
            "pos",
            "text",
            (F.col("line_x0") + 8 * F.col("pos")).alias("x0"),
            (F.col("line_x0") + 8 * F.col("pos") + 6).alias("x1"),
            (F.col("line_top") + F.col("pos") % 3).alias("top"),
            (F.col("line_top") + F.col("pos") % 3 + 10).alias("bottom"),
            (F.lit(8.0) + F.col("pos") % 7).alias("size"),
            F.when(F.col("pos") % 7 == 6, "Helvetica-Bold").otherwise("Helvetica").alias("fontname"),
        )

    @cached_property
    def tables(self) -> DataFrame:
        """One table box per page over its fourth and fifth line, with their words as cells."""
        cell = X.words(F.col("text"))
        rows = self.lines.where(F.col("line_index").isin(4, 5)).select(
            "document_id", "page_number", F.struct("line_index", cell.alias("cells")).alias("r")
        )
        return rows.groupBy("document_id", "page_number").agg(
            F.lit(0).alias("table_index"),
            F.transform(F.sort_array(F.collect_list("r")), lambda r: r["cells"]).alias("rows"),
            F.lit(60.0).alias("x0"),
            F.lit(270.0).alias("top"),
            F.lit(560.0).alias("x1"),
            F.lit(385.0).alias("bottom"),
        )

    @cached_property
    def html_items(self) -> DataFrame:
        """Structured page items from raw web pages: heading, paragraphs, list items.

        An item ends at the next tag that is not inline, so items that nobody closed count too; inline tags go.
        """
        def tagged(tag: str, label: str, base: int) -> Column:
            found = F.regexp_extract_all("html", F.lit(ITEM.format(tag=tag)), F.lit(1))
            return F.transform(
                found,
                lambda t, i: F.struct(
                    (F.lit(base) + i).cast("int").alias("reading_order"),
                    F.lit(label).alias("label"),
                    F.regexp_replace(F.regexp_replace(t, "<br[^>]*>", " "), "</?[a-z][^>]*>", "").alias("text"),
                ),
            )

        items = F.concat(
            tagged("h1", "SECTION_HEADER", 0), tagged("p", "PARAGRAPH", 1000), tagged("li", "LIST_ITEM", 100000)
        )
        return self.table("pages").select(
            F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("document_id"),
            F.lit(1).alias("page_number"),
            F.explode(items).alias("item"),
        ).select(
            "document_id",
            "page_number",
            "item.*",
            F.when(F.col("item.label") == "SECTION_HEADER", 1).alias("section_level"),
        )

    @cached_property
    def headed(self) -> DataFrame:
        """Lines where every fourth one starts with a section heading."""
        k = (F.floor(F.col("line_no") / 12) + 1).cast("string")
        slot = F.col("line_no") % 12
        marker = (
            F.when(slot == 0, F.concat(F.lit("Section "), k, F.lit(" ")))
            .when(slot == 4, F.concat(k, F.lit(".1 ")))
            .when(slot == 8, F.concat(k, F.lit(".1.1 ")))
        )
        # five words make the heading, the rest of the line follows it
        words = X.words(F.col("text"))
        head, rest = F.array_join(F.slice(words, 1, 5), " "), F.array_join(F.slice(words, F.lit(6), F.greatest(F.size(words), F.lit(1))), " ")
        parts = F.when(marker.isNotNull(), F.array(F.concat(marker, head), rest)).otherwise(F.array(F.col("text")))
        return self.raw_lines.select(
            "document_id", "page_number", "line_no", F.posexplode(parts).alias("at", "part")
        ).select(
            "document_id", "page_number", (F.col("line_no") * 2 + F.col("at")).alias("line_no"), X.collapse(F.col("part")).alias("text")
        ).where(F.col("text") != "")

    # --- nodes ------------------------------------------------------------------

    @cached_property
    def node_sources(self) -> DataFrame:
        """Numbers of nodes with a document and a vector each: as many as the longer of both tables, the shorter one repeats."""
        docs, vectors = self.table("documents"), self.table("embeddings")
        n_docs, n_vectors = docs.count(), vectors.count()
        numbers = self.spark.range(max(n_docs, n_vectors)).select(
            F.col("id").alias("node_no"), (F.col("id") % n_docs).alias("doc_id"), (F.col("id") % n_vectors).alias("vec_id")
        )
        # texts come last: they are shuffled once, and not for the vectors
        return numbers.join(vectors, "vec_id").join(docs.select("doc_id", "text"), "doc_id").drop("doc_id", "vec_id")

    @cached_property
    def nodes(self) -> DataFrame:
        """One leaf per document text, 25 to a tree; every text and every vector is used."""
        no = F.col("node_no")
        doc_no = F.floor(no / 25)
        page = (F.floor((no % 25) / 2) + 1).cast("int")
        return self.node_sources.select(
            F.concat(F.lit("leaf-"), no.cast("string")).alias("id"),
            F.concat(F.lit("doc-"), doc_no.cast("string")).alias("document_id"),
            F.concat(F.lit("owner-"), (doc_no % 5).cast("string")).alias("owner_id"),
            F.lit("leaf").alias("node_type"),
            F.lit(0).alias("level"),
            F.lit(None).cast("string").alias("parent_id"),
            F.col("text").alias("content"),
            "embedding",
            page.alias("page_start"),
            page.alias("page_end"),
            (no % 25).cast("int").alias("chunk_index"),
            F.lit(None).cast("string").alias("cluster_id"),
            F.concat(F.lit("P"), (F.col("label") % 3).cast("string")).alias("layout_partition"),
            F.lit("TRANSACTIONAL").alias("layout_strategy"),
            F.col("label").alias("cluster_no"),
            no.alias("vec_id"),
        )

    @cached_property
    def tree(self) -> DataFrame:
        """Three-level trees: leaves, one summary per (document, label), one root per document."""
        leaves = self.nodes.select(
            "id", "document_id", "owner_id", "node_type", "level", "content", "page_start", "page_end",
            "chunk_index", "layout_partition", "vec_id", "cluster_no",
            F.concat_ws("-", F.lit("sum"), "document_id", F.col("cluster_no").cast("string")).alias("parent_id"),
            F.col("chunk_index").alias("member_no"),
        )
        middle = leaves.groupBy("document_id", "owner_id", "cluster_no", F.col("parent_id").alias("id")).agg(
            F.min("page_start").alias("page_start"),
            F.max("page_end").alias("page_end"),
            F.min_by("content", "chunk_index").alias("content"),
            F.min("vec_id").alias("vec_id"),
        ).select(
            "id", "document_id", "owner_id", F.lit("summary").alias("node_type"), F.lit(1).alias("level"),
            "content", "page_start", "page_end", F.lit(None).cast("int").alias("chunk_index"),
            F.lit(None).cast("string").alias("layout_partition"), "vec_id", "cluster_no",
            F.concat(F.lit("root-"), F.col("document_id")).alias("parent_id"),
            F.col("cluster_no").alias("member_no"),
        )
        root = middle.groupBy("document_id", "owner_id", F.col("parent_id").alias("id")).agg(
            F.min("page_start").alias("page_start"),
            F.max("page_end").alias("page_end"),
            F.min_by("content", "member_no").alias("content"),
            F.min("vec_id").alias("vec_id"),
        ).select(
            "id", "document_id", "owner_id", F.lit("summary").alias("node_type"), F.lit(2).alias("level"),
            "content", "page_start", "page_end", F.lit(None).cast("int").alias("chunk_index"),
            F.lit(None).cast("string").alias("layout_partition"), "vec_id", F.lit(None).cast("int").alias("cluster_no"),
            F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("member_no"),
        )
        return leaves.unionByName(middle).unionByName(root)

    @cached_property
    def tree_with_vectors(self) -> DataFrame:
        """Tree nodes carrying the embedding of their first leaf."""
        vectors = self.node_sources.select(F.col("node_no").alias("vec_id"), "embedding")
        return self.tree.join(vectors, "vec_id")

    @cached_property
    def questions(self) -> DataFrame:
        """Every node's vector asked as a question about its own document: all trees are asked."""
        doc_no = F.floor(F.col("node_no") / 25)
        return self.node_sources.select(
            F.col("node_no").alias("question_id"),
            F.concat(F.lit("doc-"), doc_no.cast("string")).alias("document_id"),
            F.concat(F.lit("owner-"), (doc_no % 5).cast("string")).alias("owner_id"),
            F.col("embedding").alias("question_embedding"),
        )

    # --- catalogue --------------------------------------------------------------

    @cached_property
    def catalog(self) -> DataFrame:
        order = F.col("o_orderkey").cast("string")
        return self.table("orders").select(
            F.col("o_orderkey").alias("document_id"),
            F.col("o_custkey").alias("owner_id"),
            F.concat(F.col("o_orderpriority"), F.lit("-"), order, F.lit(".pdf")).alias("name"),
            F.col("o_totalprice").alias("size"),
            F.lit("application/pdf").alias("mime_type"),
            F.concat(F.col("o_custkey").cast("string"), F.lit("/"), order).alias("path"),
            F.element_at(
                F.array(*[F.lit(s) for s in ("ADVERSARIAL", "HIERARCHICAL", "TRANSACTIONAL")]),
                (F.col("o_orderkey") % 3 + 1).cast("int"),
            ).alias("layout_strategy"),
            F.when(F.col("o_orderstatus") == "F", "indexed")
            .when(F.col("o_orderstatus") == "O", "processing")
            .otherwise("pending")
            .alias("ingestion_status"),
            F.lit(None).cast("string").alias("ingestion_error"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def uploads(self) -> DataFrame:
        """Upload requests: one per order, one file per line item, some without crypto metadata."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("request_id"),
            F.col("l_linenumber").alias("file_no"),
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("upload_id"),
            F.col("l_suppkey").alias("owner_id"),
            F.concat(F.lit("Contract #"), F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "N", ".PDF").otherwise(".doc")).alias("file_name"),
            F.when(F.col("l_returnflag") == "A", "application/pdf").otherwise("application/octet-stream").alias("mime_type"),
            (F.col("l_extendedprice") * 1000).cast("bigint").alias("file_size"),
            F.when(F.col("l_quantity") > 25, (F.col("l_extendedprice") * 900).cast("bigint")).alias("content_length"),
            F.when(F.col("l_tax") > 0.02, F.when(F.col("l_linestatus") == "O", "hierarchical").otherwise("Adversarial"))
            .when(F.col("l_tax") > 0.01, "linear").alias("layout_strategy"),
            F.when(F.col("l_discount") > 0.005, F.lit("dek")).alias("wrapped_dek"),
            F.lit("iv").alias("file_iv"),
            F.lit("wrap").alias("wrap_iv"),
            F.lit("v1").alias("crypto_version"),
        )

    @cached_property
    def status_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("user_id").alias("document_id"),
            F.when(kind.isin("view", "signup"), "processing")
            .when(kind == "click", "pending")
            .when(kind == "purchase", "indexed")
            .otherwise("failed")
            .alias("status"),
            F.when(kind == "error", F.col("props")).alias("error"),
            F.col("ts").cast("timestamp").alias("ts"),
            "event_id",
        )

    @cached_property
    def stage_events(self) -> DataFrame:
        """Stage reports of one run per user, stage chosen by event id."""
        return self.table("events").select(
            F.col("user_id").alias("document_id"),
            F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
            (F.col("event_id") % 10).cast("int").alias("stage_no"),
            F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
            F.concat(F.lit("ref-"), F.col("event_id").cast("string")).alias("artifact_ref"),
            F.col("ts").cast("timestamp").alias("ts"),
            "event_id",
        )


# --- the same views in SQL -------------------------------------------------------------

_WS = r"'\s+'"

view("v_raw_lines", r"""
SELECT document_id, lang, CAST(line_no AS INTEGER) AS line_no, text, CAST(line_no // 10 + 1 AS INTEGER) AS page_number
FROM (SELECT 'doc-' || doc_id AS document_id, lang,
             unnest(string_split(text, chr(10))) AS text,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
      FROM documents)
""")
view("v_broken", r"SELECT doc_id, replace(text, 'tion', '-' || chr(13) || chr(10) || 'tion') AS broken FROM documents")
view("v_lines", r"""
SELECT *, top + 12 AS bottom, CAST(792 AS DOUBLE) AS height, CAST(612 AS DOUBLE) AS width FROM (
  SELECT document_id, page_number, CAST(line_no % 10 + 1 AS INTEGER) AS line_index, text,
         CAST(72 + 12 * (n % 3) AS DOUBLE) AS x0, CAST(540 AS DOUBLE) AS x1,
         CAST(60 + 72 * (line_no % 10) + 8 * (n % 5) AS DOUBLE) AS top,
         CAST(CASE WHEN n <= 4 THEN 14 ELSE 10 END AS DOUBLE) AS font_size, n <= 4 AS bold
  FROM (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM v_raw_lines)
  WHERE n > 0
  UNION ALL
  SELECT DISTINCT document_id, page_number, 0, 'Confidential Draft ' || page_number, CAST(72 AS DOUBLE),
         CAST(540 AS DOUBLE), CAST(10 AS DOUBLE), CAST(10 AS DOUBLE), FALSE
  FROM v_raw_lines)
""")
view("v_page_text", r"""
SELECT document_id, page_number, string_agg(text, chr(10) ORDER BY line_no) AS text
FROM v_raw_lines GROUP BY document_id, page_number
""")
view("v_words", r"""
SELECT document_id, page_number, line_index, CAST(pos AS INTEGER) AS pos, text,
       line_x0 + 8 * pos AS x0, line_x0 + 8 * pos + 6 AS x1, line_top + pos % 3 AS top,
       line_top + pos % 3 + 10 AS bottom, CAST(8 + pos % 7 AS DOUBLE) AS size,
       CASE WHEN pos % 7 = 6 THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS fontname
FROM (SELECT document_id, page_number, line_index, x0 AS line_x0, top AS line_top,
             unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS pos
      FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM v_lines))
""")
view("v_tables", r"""
SELECT document_id, page_number, 0 AS table_index,
       list(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') ORDER BY line_index) AS rows,
       CAST(60 AS DOUBLE) AS x0, CAST(270 AS DOUBLE) AS top, CAST(560 AS DOUBLE) AS x1, CAST(385 AS DOUBLE) AS bottom
FROM v_lines WHERE line_index IN (4, 5) GROUP BY document_id, page_number
""")
view("v_html_items", rf"""
SELECT 'page-' || page_id AS document_id, 1 AS page_number, CAST(base + i - 1 AS INTEGER) AS reading_order, label, text,
       CASE WHEN label = 'SECTION_HEADER' THEN 1 END AS section_level
FROM (SELECT page_id, base, label, regexp_replace(regexp_replace(unnest(found), '<br[^>]*>', ' ', 'g'), '</?[a-z][^>]*>', '', 'g') AS text, generate_subscripts(found, 1) AS i FROM (
  SELECT page_id, 0 AS base, 'SECTION_HEADER' AS label, regexp_extract_all(html, '{ITEM.format(tag="h1")}', 1) AS found FROM pages
  UNION ALL SELECT page_id, 1000, 'PARAGRAPH', regexp_extract_all(html, '{ITEM.format(tag="p")}', 1) FROM pages
  UNION ALL SELECT page_id, 100000, 'LIST_ITEM', regexp_extract_all(html, '{ITEM.format(tag="li")}', 1) FROM pages))
""")
view("v_headed", r"""
SELECT document_id, page_number, CAST(line_no * 2 + part_no - 1 AS INTEGER) AS line_no, trim(regexp_replace(part, '\s+', ' ', 'g')) AS text
FROM (SELECT document_id, page_number, line_no, unnest(parts) AS part, generate_subscripts(parts, 1) AS part_no FROM (
  SELECT *, CASE line_no % 12
      WHEN 0 THEN ['Section ' || (line_no // 12 + 1) || ' ' || array_to_string(w[1:5], ' '), array_to_string(w[6:], ' ')]
      WHEN 4 THEN [(line_no // 12 + 1) || '.1 ' || array_to_string(w[1:5], ' '), array_to_string(w[6:], ' ')]
      WHEN 8 THEN [(line_no // 12 + 1) || '.1.1 ' || array_to_string(w[1:5], ' '), array_to_string(w[6:], ' ')]
      ELSE [text] END AS parts
  FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM v_raw_lines)))
WHERE trim(regexp_replace(part, '\s+', ' ', 'g')) <> ''
""")
view("v_node_sources", r"""
SELECT n.no, d.text, e.embedding, e.label
FROM (SELECT unnest(range(greatest((SELECT count(*) FROM documents), (SELECT count(*) FROM embeddings)))) AS no) n
JOIN documents d ON d.doc_id = n.no % (SELECT count(*) FROM documents)
JOIN embeddings e ON e.vec_id = n.no % (SELECT count(*) FROM embeddings)
""")
view("v_nodes", r"""
SELECT 'leaf-' || no AS id, 'doc-' || (no // 25) AS document_id, 'owner-' || ((no // 25) % 5) AS owner_id,
       'leaf' AS node_type, 0 AS level, CAST(NULL AS VARCHAR) AS parent_id, text AS content, embedding,
       CAST((no % 25) // 2 + 1 AS INTEGER) AS page_start, CAST((no % 25) // 2 + 1 AS INTEGER) AS page_end,
       CAST(no % 25 AS INTEGER) AS chunk_index, CAST(NULL AS VARCHAR) AS cluster_id,
       'P' || (label % 3) AS layout_partition, 'TRANSACTIONAL' AS layout_strategy, label AS cluster_no, no AS vec_id
FROM v_node_sources
""")
view("v_tree", r"""
SELECT id, document_id, owner_id, node_type, level, content, page_start, page_end, chunk_index, layout_partition,
       vec_id, cluster_no, 'sum-' || document_id || '-' || cluster_no AS parent_id, chunk_index AS member_no
FROM v_nodes
UNION ALL
SELECT 'sum-' || document_id || '-' || cluster_no, document_id, owner_id, 'summary', 1, arg_min(content, chunk_index),
       min(page_start), max(page_end), NULL, NULL, min(vec_id), cluster_no, 'root-' || document_id, cluster_no
FROM v_nodes GROUP BY document_id, owner_id, cluster_no
UNION ALL
SELECT 'root-' || document_id, document_id, owner_id, 'summary', 2, arg_min(content, (cluster_no, chunk_index)),
       min(page_start), max(page_end), NULL, NULL, min(vec_id), NULL, NULL, NULL
FROM v_nodes GROUP BY document_id, owner_id
""")
view("v_questions", r"""
SELECT no AS question_id, 'doc-' || (no // 25) AS document_id, 'owner-' || ((no // 25) % 5) AS owner_id,
       embedding AS question_embedding FROM v_node_sources
""")
view("v_catalog", r"""
SELECT o_orderkey AS document_id, o_custkey AS owner_id, o_orderpriority || '-' || o_orderkey || '.pdf' AS name,
       o_totalprice AS size, 'application/pdf' AS mime_type, o_custkey || '/' || o_orderkey AS path,
       ['ADVERSARIAL','HIERARCHICAL','TRANSACTIONAL'][o_orderkey % 3 + 1] AS layout_strategy,
       CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS ingestion_status,
       CAST(NULL AS VARCHAR) AS ingestion_error, o_orderdate AS created_at FROM orders
""")
view("v_uploads", r"""
SELECT l_orderkey AS request_id, l_linenumber AS file_no, l_orderkey || '-' || l_linenumber AS upload_id, l_suppkey AS owner_id,
       'Contract #' || l_partkey || CASE WHEN l_returnflag = 'N' THEN '.PDF' ELSE '.doc' END AS file_name,
       CASE WHEN l_returnflag = 'A' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime_type,
       CAST(trunc(l_extendedprice * 1000) AS BIGINT) AS file_size,
       CASE WHEN l_quantity > 25 THEN CAST(trunc(l_extendedprice * 900) AS BIGINT) END AS content_length,
       CASE WHEN l_tax > CAST(0.02 AS DOUBLE) THEN CASE WHEN l_linestatus = 'O' THEN 'hierarchical' ELSE 'Adversarial' END
            WHEN l_tax > CAST(0.01 AS DOUBLE) THEN 'linear' END AS layout_strategy,
       CASE WHEN l_discount > CAST(0.005 AS DOUBLE) THEN 'dek' END AS wrapped_dek, 'iv' AS file_iv, 'wrap' AS wrap_iv, 'v1' AS crypto_version
FROM lineitem
""")
view("v_status", r"""
SELECT user_id AS document_id,
       CASE WHEN event_type IN ('view','signup') THEN 'processing' WHEN event_type = 'click' THEN 'pending'
            WHEN event_type = 'purchase' THEN 'indexed' ELSE 'failed' END AS status,
       CASE WHEN event_type = 'error' THEN props END AS error, ts, event_id FROM events
""")
view("v_stage_events", r"""
SELECT user_id AS document_id, 'run-' || user_id AS run_id, CAST(event_id % 10 AS INTEGER) AS stage_no,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, 'ref-' || event_id AS artifact_ref, ts, event_id
FROM events
""")
