"""Sources, sinks, strategies, ingestion and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import fixed_values as FV
from arbora.operators import chunking as K
from arbora.operators import providers as PR
from arbora.operators import trees as T
from arbora.plans import strategies as ST
from arbora.plans.answers import answer_questions
from arbora.plans.ingest import Ingested, Layout, ingest_corpus
from arbora.session import cut_lineage, work_folder
from arbora.sources import files, lineage
from arbora.sources import nodes as N
from arbora.sources import versions as VN
from arbora.streaming.ingest import incremental_ingest, job_stream
from arbora.streaming.status import status_stream
from suite import sql_exprs as S
from suite.catalog_queries import stamp
from suite.chunk_queries import windows_sql
from suite.registry import query
from suite.sql_views import view
from suite.text_queries import marked_lines

c = F.col
DOC = "document_id"


@query("S1_scan_files")
def s1(v):
    """The given Parquet files as raw objects."""
    rows = files.scan_files(v.spark, v.sf_dir, "*.parquet", most=64 << 20)  # contents are not asked for
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "content_sha256")


@query("S2_scan_layout", "SELECT document_id, page_number, line_index AS line_no, text, font_size, bold, x0, top, x1, bottom FROM v_lines")
def s2(v):
    folder = work_folder(v.spark, "layout")
    v.lines.withColumnRenamed("line_index", "line_no").write.parquet(f"{folder}/lines")
    return files.scan_layout(v.spark, folder, "lines")


@query("S2_scan_layout_json", "SELECT document_id, page_number, table_index, array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), chr(10)) AS rendered, top FROM v_tables")
def s2j(v):
    from arbora.operators.layout import render_table

    folder = work_folder(v.spark, "layout")
    v.tables.write.json(f"{folder}/tables")
    rows = files.scan_layout(v.spark, folder, "tables", "json")
    return rows.select(DOC, "page_number", "table_index", render_table(c("rows")).alias("rendered"), "top")


@query("S3_scan_document_nodes", "SELECT id, document_id, owner_id, node_type, level, content, page_start, page_end, chunk_index FROM v_tree")
def s3(v):
    rows = N.scan_document_nodes(v.tree_with_vectors.withColumn("created_at", F.lit(0)))
    return rows.select("id", DOC, "owner_id", "node_type", "level", "content", "page_start", "page_end", "chunk_index")


@query("S4_scan_leaf_nodes", "SELECT id, document_id, chunk_index, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM v_nodes")
def s4(v):
    rows = N.scan_leaf_nodes(v.tree_with_vectors.withColumn("created_at", F.lit(0)))
    return rows.select("id", DOC, "chunk_index", F.round(c("embedding")[0].cast("double"), 6).alias("first_value"))


def stored_nodes(v):
    """Nodes appended to a fresh table in two loads."""
    path = work_folder(v.spark, "nodes")
    nodes = v.nodes.select("id", DOC, "owner_id", "node_type", "level", "content", "embedding", "chunk_index")
    N.append_nodes(nodes.where("owner_id < 'owner-2'"), path)
    N.append_nodes(nodes.where("owner_id >= 'owner-2'"), path)
    return path


@query("S5_append_nodes", "SELECT id, document_id, owner_id, content FROM v_nodes")
def s5(v):
    return N.read_nodes(v.spark, stored_nodes(v)).select("id", DOC, "owner_id", "content")


@query(
    "S6_replace_document_nodes",
    "SELECT id, document_id, content FROM v_nodes WHERE owner_id <> 'owner-3' UNION ALL SELECT 'new-' || id, document_id, upper(layout_partition) FROM v_nodes WHERE owner_id = 'owner-3' AND cluster_no > 4",
)
def s6(v):
    """Owner 3 re-indexes its documents into other, fewer nodes; doing so twice changes nothing more."""
    path = stored_nodes(v)
    fresh = v.nodes.where("owner_id = 'owner-3' AND cluster_no > 4").select(
        F.concat(F.lit("new-"), "id").alias("id"), DOC, "owner_id", "node_type", "level",
        F.upper("layout_partition").alias("content"), "embedding", "chunk_index",
    )
    N.replace_document_nodes(fresh, path)
    N.replace_document_nodes(fresh, path)
    return N.read_nodes(v.spark, path).select("id", DOC, "content")


@query("S7_delete_document_nodes", "SELECT id FROM v_nodes WHERE owner_id <> 'owner-1'")
def s7(v):
    path = stored_nodes(v)
    N.delete_stored_documents(v.spark, path, v.nodes.where("owner_id = 'owner-1'").select(DOC).distinct())
    return N.read_nodes(v.spark, path).select("id")


@query(
    "S6_versioned_replace",
    "SELECT id, document_id, content FROM v_nodes WHERE owner_id <> 'owner-3' UNION ALL SELECT 'new-' || id, document_id, upper(layout_partition) FROM v_nodes WHERE owner_id = 'owner-3' AND cluster_no > 4"
    " UNION ALL SELECT id, document_id, content FROM v_nodes WHERE owner_id = 'owner-3' AND document_id NOT IN (SELECT document_id FROM v_nodes WHERE cluster_no > 4)",
)
def s6v(v):
    """The same re-index, twice, in versions: only the documents' own rows are written, then compacted."""
    path = work_folder(v.spark, "versions")
    VN.replace_documents(v.nodes, path)
    fresh = v.nodes.where("owner_id = 'owner-3' AND cluster_no > 4").select(
        F.concat(F.lit("new-"), "id").alias("id"), DOC, "owner_id", "node_type", "level",
        F.upper("layout_partition").alias("content"), "embedding", "chunk_index",
    )
    VN.replace_documents(fresh, path)
    VN.replace_documents(fresh, path)
    VN.compact(v.spark, path)
    return VN.read_current(v.spark, path).select("id", DOC, "content")


@query("S7_versioned_delete", "SELECT id FROM v_nodes WHERE owner_id <> 'owner-1'")
def s7v(v):
    """Tombstones only: the rows of the others are not written again."""
    path = work_folder(v.spark, "versions")
    VN.replace_documents(v.nodes, path)
    VN.delete_documents(v.spark, path, v.nodes.where("owner_id = 'owner-1'").select(DOC))
    return VN.read_current(v.spark, path).select("id")


@query("S8_write_lineage", "SELECT document_id, 'run-1' AS run_id, 'nodes' AS artifact_type, count(*) AS row_count, TRUE AS hashed FROM v_nodes GROUP BY document_id")
def s8(v):
    path = work_folder(v.spark, "lineage")
    lineage.write_lineage(lineage.lineage_records(v.nodes, "run-1", "nodes", ["id", "content"]), path)
    again = lineage.lineage_records(v.nodes.repartition("id"), "run-1", "nodes", ["id", "content"])
    stored = v.spark.read.parquet(path)
    same = again.select(DOC, c("content_hash").alias("again"))
    return stored.join(same, DOC).select(
        DOC, "run_id", "artifact_type", "row_count", (c("content_hash") == c("again")).alias("hashed")
    )


@query(
    "S9_append_checkpoints",
    "SELECT 'doc-' || doc_id AS document_id, stage, 'completed' AS status, 'doc-' || doc_id || '/run-1/' || stage AS artifact_ref, '2026-01-01 00:00:00' AS created_at FROM documents, (VALUES ('chunk_complete'), ('store_complete')) AS s(stage)",
)
def s9(v):
    path = work_folder(v.spark, "checkpoints")
    docs = v.table("documents").select(F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias(DOC))
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    for stage in ("chunk_complete", "store_complete"):
        lineage.append_checkpoints(lineage.checkpoint_records(docs, "run-1", stage, "completed", at), path)
    rows = v.spark.read.parquet(path)
    return rows.select(DOC, "stage", "status", "artifact_ref", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def document_keys(v):
    """A key per document, except for owner 4."""
    docs = v.nodes.select(DOC, "owner_id").distinct()
    return docs.where("owner_id <> 'owner-4'").select(DOC, F.unhex(F.substring(F.sha2(DOC, 256), 1, 32)).alias("key"))


@query("J14_decrypt_nodes", "SELECT id, content, owner_id = 'owner-4' AS stayed_plain FROM v_nodes")
def j14(v):
    keys = document_keys(v)
    sealed = N.protect_nodes(v.nodes, keys, "run-1").unionByName(v.nodes.where("owner_id = 'owner-4'"), allowMissingColumns=True)
    return N.decrypt_nodes(sealed, keys).select("id", "content", c("encrypted_content").isNull().alias("stayed_plain"))


# --- strategies ------------------------------------------------------------------------------

view(
    "v_strategy",
    "SELECT 'doc-' || doc_id AS document_id, CASE doc_id % 3 WHEN 0 THEN 'ADVERSARIAL' WHEN 1 THEN 'HIERARCHICAL' ELSE 'TRANSACTIONAL' END AS strategy FROM documents",
)
view("v_st_t", "SELECT document_id, page_number, page_number AS page_order, text FROM v_page_text JOIN v_strategy USING (document_id) WHERE strategy = 'TRANSACTIONAL'")
view("v_st_a", "SELECT document_id, page_number, page_number AS page_order, text FROM v_page_text JOIN v_strategy USING (document_id) WHERE strategy = 'ADVERSARIAL'")
view(
    "v_st_h",
    f"""SELECT document_id, page_number, line_no, text, CAST(sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY line_no) AS INTEGER) AS section_no FROM (
          SELECT *, CAST({S.chunker_level('t')} AS INTEGER) AS level FROM (
            SELECT document_id, page_number, line_no, {S.collapse('text')} AS text, {S.candidate('text')} AS t FROM v_raw_lines JOIN v_strategy USING (document_id) WHERE strategy = 'HIERARCHICAL')) WHERE text <> ''""",
)
view("v_st_hw", f"SELECT document_id, section_no, sum({S.n_words('text')}) AS total FROM v_st_h GROUP BY document_id, section_no")
view("v_st_hl", "SELECT h.* FROM v_st_h h JOIN v_st_hw USING (document_id, section_no) WHERE total > 650")
STRATEGY_SQL = f"""SELECT document_id, CAST(i AS INTEGER) AS chunk_index, 'TRANSACTIONAL' AS layout_strategy, content FROM ({windows_sql('v_st_t', 'document_id', 'page_order', 400, 75)})
  UNION ALL SELECT document_id, CAST(i AS INTEGER), 'ADVERSARIAL', content FROM ({windows_sql('v_st_a', 'document_id', 'page_order', 340, 40)})
  UNION ALL SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_no, i) - 1 AS INTEGER), 'HIERARCHICAL', content FROM (
    SELECT document_id, section_no, i, content FROM ({windows_sql('v_st_hl', 'document_id, section_no', 'line_no', 500, 0)})
    UNION ALL SELECT document_id, section_no, 0, string_agg(text, chr(10) ORDER BY line_no) FROM v_st_h JOIN v_st_hw USING (document_id, section_no) WHERE total <= 650 GROUP BY document_id, section_no)"""


def jobs_by_strategy(v):
    n = c("doc_id")
    return v.table("documents").select(
        F.concat(F.lit("doc-"), n.cast("string")).alias(DOC),
        F.concat(F.lit("owner-"), (n % 7).cast("string")).alias("owner_id"),
        F.when(n % 3 == 0, " adversarial").when(n % 3 == 1, "HIERARCHICAL").otherwise("linear").alias("layout_strategy"),
    )


def no_items(v):
    return v.page_text.where("text IS NULL").select(
        DOC, "page_number", F.lit(0).alias("reading_order"), F.lit("TEXT").alias("label"), "text",
        F.lit(None).cast("int").alias("section_level"),
    )


@query("C16_strategy_router", STRATEGY_SQL)
def c16(v):
    """Every document through its own strategy; unknown ones are transactional."""
    chunks = ST.chunk_by_strategy(jobs_by_strategy(v), v.page_text, no_items(v))
    return chunks.select(DOC, "chunk_index", "layout_strategy", "content")


# --- ingestion ---------------------------------------------------------------------------------


LAST_PAGE = 10_000


def blank_documents(v):
    """Documents whose one page has no line; every second one also failed extraction."""
    n = c("doc_id")
    return v.table("documents").where(n % 50 == 7).select(F.concat(F.lit("blank-"), n.cast("string")).alias(DOC), (n % 100 == 7).alias("failed"))


def corpus_layout(v):
    """Every document also has a last page without a line; on every fifth one it holds a picture.

    Lines and tables are written once: every stage reads them again.
    """
    v = v.with_stored_lines()
    lines = marked_lines(v).withColumnRenamed("line_index", "line_no")
    chars = v.words.where((c("size") > 12) & (c("line_index") > 0))
    last = v.table("documents").select(F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias(DOC), F.lit(LAST_PAGE).alias("page_number"), "doc_id")
    blank = blank_documents(v)
    pages = v.lines.select(DOC, "page_number").distinct().unionByName(last.select(DOC, "page_number"))
    pages = pages.unionByName(blank.select(DOC, F.lit(1).alias("page_number")))
    images = v.lines.where("bold").select(DOC, "page_number").unionByName(last.where("doc_id % 5 = 0").select(DOC, "page_number"))
    return Layout(pages, lines, v.words, chars, images, cut_lineage(v.tables), blank.where("failed").select(DOC))


# Chunks from the normalised blocks. No fixture text names a party, so a disputed document is one neutral run.
view("v_ing", "SELECT n.*, strategy FROM v_normalized n JOIN v_strategy USING (document_id)")
view("v_ing_t", "SELECT document_id, page_number, reading_order, text FROM v_ing WHERE strategy = 'TRANSACTIONAL' AND block_type IN ('paragraph','heading','list_item','table')")
view("v_ing_a", f"SELECT document_id, page_number, reading_order, {S.repair('text')} AS text FROM v_ing WHERE strategy = 'ADVERSARIAL'")
view(
    "v_ing_lines",
    f"""SELECT document_id, page_number, reading_order, line_no, text, CASE WHEN block_type = 'heading' AND section_level IS NOT NULL THEN section_level ELSE CAST({S.chunker_level('t')} AS INTEGER) END AS level FROM (
          SELECT *, {S.candidate('text')} AS t FROM (
            SELECT document_id, page_number, reading_order, block_type, section_level, line_no, {S.collapse('line')} AS text FROM (
              SELECT *, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (
                SELECT *, string_split({S.repair('text')}, chr(10)) AS ls FROM v_ing WHERE strategy = 'HIERARCHICAL')))) WHERE text <> ''""",
)
view(
    "v_ing_h",
    "SELECT *, CAST(sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY reading_order, line_no) AS INTEGER) AS section_no FROM v_ing_lines",
)
view("v_ing_sections", f"SELECT document_id, section_no, sum({S.n_words('text')}) AS total FROM v_ing_h GROUP BY document_id, section_no")
view("v_ing_hl", "SELECT h.* FROM v_ing_h h JOIN v_ing_sections USING (document_id, section_no) WHERE total > 650")
view(
    "v_ing_chunks",
    f"""SELECT document_id, 0 AS section_no, i, content FROM ({windows_sql('v_ing_t', 'document_id', 'reading_order', 400, 75)})
      UNION ALL SELECT document_id, 0, i, content FROM ({windows_sql('v_ing_a', 'document_id', 'reading_order', 340, 40)})
      UNION ALL SELECT document_id, section_no, i, content FROM ({windows_sql('v_ing_hl', 'document_id, section_no', 'reading_order, line_no', 500, 0)})
      UNION ALL SELECT document_id, section_no, 0, string_agg(text, chr(10) ORDER BY reading_order, line_no) FROM v_ing_h JOIN v_ing_sections USING (document_id, section_no) WHERE total <= 650 GROUP BY document_id, section_no""",
)
INGEST_SQL = f"""WITH made AS (SELECT document_id, count(*) AS leaves, count(*) FILTER (WHERE sha256(content) LIKE '0%') AS refused,
      sha256(string_agg(sha256(content), ',' ORDER BY section_no, i)) AS digest FROM v_ing_chunks GROUP BY document_id),
    jobs AS (SELECT document_id, leaves, refused, digest, FALSE AS failed, CAST(regexp_extract(document_id, '[0-9]+') AS BIGINT) % 5 = 0 AS pictured FROM v_strategy LEFT JOIN made USING (document_id)
      UNION ALL SELECT 'blank-' || doc_id, NULL, NULL, NULL, doc_id % 100 = 7, FALSE FROM documents WHERE doc_id % 50 = 7),
    told AS (SELECT *, CASE WHEN failed THEN '{FV.NO_TEXT_LAYER}' WHEN leaves IS NULL THEN '{FV.NO_CHUNKS}' WHEN refused > 0 THEN '{FV.NOT_EMBEDDED}' END AS reason FROM jobs)
    SELECT document_id, CASE WHEN reason IS NULL THEN 'indexed' ELSE 'failed' END AS ingestion_status, CAST(CASE WHEN reason IS NULL THEN 0 WHEN refused > 0 THEN refused ELSE 1 END AS BIGINT) AS n_errors,
      coalesce(reason, '') AS reasons, CASE WHEN reason IS NULL THEN leaves END AS leaves, CASE WHEN reason IS NULL THEN digest END AS digest,
      CAST(CASE WHEN reason IS NULL THEN 0 END AS BIGINT) AS plain_rows,
      CAST(coalesce(ocr, 0) + CASE WHEN pictured THEN 1 ELSE 0 END AS BIGINT) AS warnings
    FROM told LEFT JOIN (SELECT document_id, count(*) AS ocr FROM v_routed WHERE method = 'OCR' GROUP BY document_id) USING (document_id)"""


def refusing(chunks):
    """The default embedder, which refuses some chunk texts by their digest."""
    embedded = PR.hashed_embeddings(chunks)
    if "chunk_id" not in chunks.columns:
        return embedded
    return embedded.withColumn("embedding", F.when(~F.sha2("content", 256).startswith("0"), c("embedding")))


@query("C18_ingest_corpus", INGEST_SQL)
def c18(v):
    """Layout tables to stored, encrypted nodes for every document; one row per document with its outcome, reasons and leaf texts."""
    blank = blank_documents(v).select(DOC, F.lit("owner-0").alias("owner_id"), F.lit("linear").alias("layout_strategy"))
    jobs = jobs_by_strategy(v).unionByName(blank)
    keys = jobs.select(DOC, F.unhex(F.substring(F.sha2(DOC, 256), 1, 32)).alias("key"))
    done = ingest_corpus(jobs, corpus_layout(v), run_id="run-1", keys=keys, embed=refusing)
    plain = N.decrypt_nodes(done.nodes.withColumn("was_plain", c("content").isNotNull()), keys)
    leaf = c("node_type") == "leaf"
    texts = F.array_sort(F.collect_list(F.when(leaf, F.struct("chunk_index", F.sha2("content", 256).alias("text")))))
    counts = plain.groupBy(DOC).agg(
        F.count_if(leaf).alias("leaves"), F.sha2(F.array_join(F.transform(texts, lambda t: t["text"]), ","), 256).alias("digest"),
        F.count_if("was_plain").alias("plain_rows"),
    )
    reasons = done.rejects.groupBy(DOC).agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("reasons"))
    warned = done.quality.select(DOC, "warning_count")
    rows = done.statuses.join(counts, DOC, "left").join(reasons, DOC, "left").join(warned, DOC, "left")
    return rows.select(
        DOC, "ingestion_status", "n_errors", F.coalesce("reasons", F.lit("")).alias("reasons"), "leaves", "digest", "plain_rows",
        F.coalesce("warning_count", F.lit(0)).alias("warnings"),
    )


@query(
    "C15_answer_flow",
    "SELECT q.question_id, CASE WHEN o.o_orderstatus = 'F' THEN 'answered' WHEN o.o_orderstatus IS NULL THEN 'Document not found.' ELSE 'Document is not indexed yet.' END AS outcome FROM v_questions q LEFT JOIN orders o ON 'doc-' || o.o_orderkey = q.document_id",
)
def c15f(v):
    """Questions against a catalogue: answered where indexed, otherwise rejected with a reason."""
    from suite.retrieval_queries import question_texts

    owners = v.questions.select(DOC, "owner_id").distinct()
    catalog = v.catalog.select(
        F.concat(F.lit("doc-"), c(DOC).cast("string")).alias(DOC), "ingestion_status"
    ).join(owners, DOC)
    flow = answer_questions(question_texts(v), v.tree_with_vectors, catalog=catalog)
    answered = flow["answers"].where("answer IS NOT NULL").select("question_id", F.lit("answered").alias("outcome"))
    return answered.unionByName(flow["rejects"].withColumnRenamed("reject_reason", "outcome"))


# --- streams --------------------------------------------------------------------------------------


@query(
    "R1_status_stream",
    "SELECT document_id, ingestion_status, ingestion_error, strftime(completed_at, '%Y-%m-%d %H:%M:%S.%f') AS completed_at FROM v_latest",
)
def r1(v):
    """The events table as a stream; the final state equals the batch result."""
    schema = v.table("events").schema
    stream = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    kind = c("event_type")
    events = stream.select(
        c("user_id").alias(DOC),
        F.when(kind.isin("view", "signup"), "processing").when(kind == "click", "pending")
        .when(kind == "purchase", "indexed").otherwise("failed").alias("status"),
        F.when(kind == "error", c("props")).alias("error"),
        c("ts").cast("timestamp").alias("ts"),
        "event_id",
    )
    target = work_folder(v.spark, "status")

    def publish(batch, batch_id):
        batch.write.mode("overwrite").parquet(target)

    running = (
        status_stream(events).writeStream.outputMode("complete").foreachBatch(publish)
        .option("checkpointLocation", work_folder(v.spark, "stream")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return v.spark.read.parquet(target).select(
        DOC, "ingestion_status", "ingestion_error", stamp("ingestion_completed_at").alias("completed_at")
    )


@query(
    "R2_incremental_ingest",
    f"""SELECT sha256(document_id || '|stable|0|' || i) AS id, document_id, CAST(i AS INTEGER) AS chunk_index, content
        FROM ({windows_sql('v_page_text_doc', 'document_id', 'page_order', 400, 75)})""",
)
def r2(v):
    """Job files arrive twice; the second ingestion replaces the first instead of doubling it."""
    jobs_path, node_path = work_folder(v.spark, "jobs"), work_folder(v.spark, "nodes")
    state = work_folder(v.spark, "stream")
    docs = v.table("documents").select(
        F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias(DOC),
        F.lit("owner-1").alias("owner_id"),
        F.concat("lang", F.lit(".pdf")).alias("file_name"),
        F.lit("path").alias("storage_path"),
        F.lit("TRANSACTIONAL").alias("layout_strategy"),
    )
    pages = v.page_text

    def ingest(batch, run_id):
        chunks = K.transactional_chunks(pages.join(batch.select(DOC), DOC, "left_semi"))
        nodes = T.leaf_nodes_from_chunks(chunks.withColumn("owner_id", F.lit("owner-1")), run_id="stable")
        none = nodes.limit(0)
        return Ingested(nodes, none, batch.select(DOC), none, none)

    for _ in range(2):
        docs.write.mode("append").json(jobs_path)
        incremental_ingest(job_stream(v.spark, jobs_path), ingest, node_path, state).awaitTermination()
    return N.read_nodes(v.spark, node_path).select("id", DOC, "chunk_index", "content")


