"""Catalogue, validation and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import labels as L
from arbora.operators import catalog as A
from arbora.operators import validation as VAL
from arbora.operators.clustering import cluster_structurally
from suite import sql_exprs as S
from suite.registry import query
from suite.sql_views import view

c = F.col
NOW = "TIMESTAMP '2026-01-01 00:00:00'"


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


view(
    "v_upload_checks",
    """SELECT *, CASE WHEN n_files > 10 THEN 'Too many files.' WHEN largest > 26214400 THEN 'File too large.'
         WHEN upper(coalesce(nullif(layout_strategy, ''), 'TRANSACTIONAL')) NOT IN ('ADVERSARIAL','HIERARCHICAL','TRANSACTIONAL') THEN 'layoutStrategy must be ADVERSARIAL, HIERARCHICAL, or TRANSACTIONAL.'
         WHEN wrapped_dek IS NULL THEN 'Missing encryption metadata for ' || file_name || '.' END AS reject_reason
       FROM v_uploads JOIN (SELECT request_id, count(*) AS n_files, max(file_size) AS largest FROM v_uploads GROUP BY request_id) USING (request_id)""",
)


@query("V4_validate_uploads", "SELECT upload_id, reject_reason FROM v_upload_checks")
def v4(v):
    return VAL.validate_uploads(v.uploads).select("upload_id", "reject_reason")


@query(
    "S10_register_documents",
    """SELECT upload_id AS document_id, owner_id, file_name AS name, coalesce(nullif(content_length, 0), file_size) AS size, 'application/octet-stream' AS mime_type,
         owner_id || '/1767225600000-' || upload_id || '-' || regexp_replace(file_name, '[^a-zA-Z0-9._-]', '_', 'g') || '.enc' AS path,
         upper(coalesce(layout_strategy, 'TRANSACTIONAL')) AS layout_strategy, 'pending' AS ingestion_status, 'encrypted' AS encryption_status,
         mime_type AS original_mime_type, coalesce(nullif(content_length, 0), file_size) AS content_length FROM v_upload_checks WHERE reject_reason IS NULL""",
)
def s10(v):
    rows = A.register_documents(v.uploads, F.timestamp_millis(F.lit(1767225600000)))
    return rows.select(
        "document_id", "owner_id", "name", "size", "mime_type", "path", "layout_strategy", "ingestion_status",
        c("storage_encryption.status").alias("encryption_status"),
        c("storage_encryption.original_mime_type").alias("original_mime_type"),
        c("storage_encryption.content_length").alias("content_length"),
    )


def requests_of(v):
    """One request per line item: its order as the document, asked for by a customer key."""
    return v.table("lineitem").select(
        F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("request_id"),
        c("l_orderkey").alias("document_id"),
        (c("l_orderkey") * 7 % 10 + c("l_partkey")).alias("guess"),
        c("l_returnflag").alias("flag"),
    )


view(
    "v_requests",
    """SELECT l_orderkey || '-' || l_linenumber AS request_id, l_orderkey AS document_id, CASE WHEN l_returnflag = 'N' THEN l_partkey ELSE o_custkey END AS owner_id
       FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""",
)


def owner_requests(v):
    """Two thirds ask for their own document, the rest for someone else's."""
    lines = v.table("lineitem").join(v.table("orders"), c("l_orderkey") == c("o_orderkey"), "left")
    return lines.select(
        F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("request_id"),
        c("l_orderkey").alias("document_id"),
        F.when(c("l_returnflag") == "N", c("l_partkey")).otherwise(c("o_custkey")).alias("owner_id"),
    )


@query(
    "S12_delete_document",
    "SELECT document_id, name FROM v_catalog k WHERE NOT EXISTS (SELECT 1 FROM v_requests r WHERE r.document_id = k.document_id AND r.owner_id = k.owner_id)",
)
def s12(v):
    return A.delete_documents(v.catalog, owner_requests(v)).select("document_id", "name")


@query(
    "S13_mark_processing",
    """SELECT document_id, CASE WHEN hit THEN 'processing' ELSE ingestion_status END AS ingestion_status, CASE WHEN hit THEN '2026-01-01 00:00:00.000000' END AS requested_at
       FROM v_catalog LEFT JOIN (SELECT DISTINCT l_orderkey AS document_id, TRUE AS hit FROM lineitem) USING (document_id)""",
)
def s13(v):
    catalog = v.catalog.withColumns(
        {n: F.lit(None).cast("timestamp") for n in ("ingestion_requested_at", "ingestion_completed_at")}
    )
    starts = v.table("lineitem").select(c("l_orderkey").alias("document_id"))
    return A.mark_processing(catalog, starts, now()).select(
        "document_id", "ingestion_status", stamp("ingestion_requested_at").alias("requested_at")
    )


@query(
    "S13_rename_documents",
    f"""SELECT document_id, coalesce(nullif(CASE WHEN new_name IS NOT NULL THEN {S.strip('new_name')} END, ''), name) AS name FROM v_catalog
        LEFT JOIN (SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'F' THEN ' Final ' || o_orderpriority || chr(10)
            WHEN o_orderkey % 2 = 0 THEN 'Earlier name' ELSE ' ' || chr(10) END AS new_name FROM orders) USING (document_id)""",
)
def s13r(v):
    renames = v.table("orders").select(
        c("o_orderkey").alias("document_id"),
        F.when(c("o_orderstatus") == "F", F.concat(F.lit(" Final "), c("o_orderpriority"), F.lit("\n"))).otherwise(F.lit(" \n")).alias("new_name"),
    )
    earlier = renames.withColumn("new_name", F.lit("Earlier name"))  # a document renamed twice has the later name once
    both = renames.withColumn("at", F.lit(2)).unionByName(earlier.withColumn("at", F.lit(1)).where(c("document_id") % 2 == 0))
    return A.rename_documents(v.catalog, both, order="at").select("document_id", "name")


@query("P8_find_owned_document", "SELECT request_id FROM v_requests r JOIN v_catalog k ON r.document_id = k.document_id AND r.owner_id = k.owner_id")
def p8(v):
    """The point lookup for a table of requests at once."""
    return owner_requests(v).join(v.catalog.select("document_id", "owner_id"), ["document_id", "owner_id"]).select("request_id")


@query("J12_owned_semi", "SELECT request_id, document_id FROM v_requests r WHERE EXISTS (SELECT 1 FROM v_catalog k WHERE r.document_id = k.document_id AND r.owner_id = k.owner_id)")
def j12(v):
    return A.owned_semi(owner_requests(v), v.catalog).select("request_id", "document_id")


@query("P9_search_documents", "SELECT document_id, name FROM v_catalog WHERE contains(lower(name), 'urgent-1')")
def p9(v):
    return A.search_documents(v.catalog, "  URGENT-1 ").select("document_id", "name")


@query("P10_pending_documents", "SELECT document_id FROM v_catalog WHERE ingestion_status IN ('pending','processing')")
def p10(v):
    return A.pending_documents(v.catalog).select("document_id")


@query("P11_accept_pdf_uploads", "SELECT upload_id FROM v_uploads WHERE mime_type = 'application/pdf' OR lower(file_name) LIKE '%.pdf'")
def p11(v):
    return A.accept_pdf_uploads(v.uploads).select("upload_id")


@query(
    "T5_list_documents",
    "SELECT document_id, name, size, layout_strategy, ingestion_status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM v_catalog WHERE owner_id = 7",
)
def t5(v):
    rows = A.list_documents(v.catalog, 7)
    return rows.select(
        "document_id", "name", "size", "layout_strategy", "ingestion_status",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


@query(
    "P16_gate_indexed",
    """SELECT request_id, CASE WHEN k.document_id IS NULL THEN 'Document not found.' WHEN ingestion_status <> 'indexed' THEN 'Document is not indexed yet.' END AS reject_reason
       FROM v_requests r LEFT JOIN v_catalog k ON r.document_id = k.document_id AND r.owner_id = k.owner_id""",
)
def p16(v):
    return A.gate_indexed(owner_requests(v), v.catalog).select("request_id", "reject_reason")


view("v_latest", """SELECT document_id, CASE WHEN st IN ('indexed','failed','pending') THEN st ELSE 'processing' END AS ingestion_status, err AS ingestion_error,
      CASE WHEN st IN ('indexed','failed') THEN ts END AS completed_at FROM (
      SELECT document_id, status AS st, error AS err, ts FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) AS rn FROM v_status) WHERE rn = 1)""")


@query(
    "J10_apply_status_updates",
    """SELECT k.document_id, CASE WHEN l.document_id IS NULL THEN k.ingestion_status ELSE l.ingestion_status END AS ingestion_status, l.ingestion_error
       FROM v_catalog k LEFT JOIN v_latest l USING (document_id)""",
)
def j10(v):
    return A.apply_status_updates(v.catalog, A.latest_status(v.status_events)).select(
        "document_id", "ingestion_status", "ingestion_error"
    )


@query(
    "R1_latest_status",
    "SELECT document_id, ingestion_status, ingestion_error, strftime(completed_at, '%Y-%m-%d %H:%M:%S.%f') AS completed_at FROM v_latest",
)
def r1(v):
    return A.latest_status(v.status_events).select(
        "document_id", "ingestion_status", "ingestion_error", stamp("ingestion_completed_at").alias("completed_at")
    )


def trackers_of(v):
    """Each order tracks the catalogue entries named by its part keys, in line order."""
    lines = v.table("lineitem").groupBy(c("l_orderkey").alias("tracker_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l")
    )
    return lines.select("tracker_id", F.transform("l", lambda x: x["l_partkey"] * 13).alias("document_ids"))


view(
    "v_tracked",
    """SELECT tracker_id, position, k.document_id, k.ingestion_status FROM (
         SELECT l_orderkey AS tracker_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS position, l_partkey * 13 AS document_id FROM lineitem)
       JOIN v_catalog k USING (document_id)""",
)


@query("J11_tracked_documents", "SELECT tracker_id, position, document_id FROM v_tracked")
def j11(v):
    return A.tracked_documents(trackers_of(v), v.catalog).select("tracker_id", "position", "document_id")


@query("G19_ingestion_complete", "SELECT tracker_id, count(*) AS n_documents, bool_and(ingestion_status IN ('indexed','failed')) AS complete FROM v_tracked GROUP BY tracker_id")
def g19(v):
    return A.ingestion_complete(A.tracked_documents(trackers_of(v), v.catalog))


@query("J15_orphan_nodes", "SELECT id FROM v_nodes n WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'doc-' || o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'F') k WHERE k.document_id = n.document_id)")
def j15(v):
    kept = v.catalog.where("ingestion_status = 'indexed'").select(
        F.concat(F.lit("doc-"), c("document_id").cast("string")).alias("document_id")
    )
    return A.orphan_nodes(v.nodes, kept).select("id")


@query("V6_validate_status", "SELECT event_id, CASE WHEN event_type NOT IN ('pending','processing','indexed','failed') THEN 'Invalid ingestion status.' END AS reject_reason FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'indexed' WHEN 'click' THEN 'pending' ELSE event_type END AS event_type FROM events)")
def v6(v):
    kind = F.when(c("event_type") == "purchase", "indexed").when(c("event_type") == "click", "pending").otherwise(c("event_type"))
    updates = v.table("events").select("event_id", kind.alias("ingestion_status"))
    return VAL.validate_statuses(updates).select("event_id", "reject_reason")


@query(
    "V5_validate_cluster_request",
    """SELECT event_id, CASE WHEN bad THEN NULL ELSE TRY_CAST(t AS INTEGER) END AS target, CASE WHEN bad THEN 'targetClusters must be a positive integer when provided.' END AS reject_reason
       FROM (SELECT *, t IS NOT NULL AND coalesce(TRY_CAST(t AS INTEGER) <= 0, TRUE) AS bad FROM (
         SELECT event_id, nullif(CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'x' || user_id WHEN 'error' THEN CAST(user_id % 3 - 1 AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END, '') AS t FROM events))""",
)
def v5(v):
    kind, user = c("event_type"), c("user_id")
    raw = (
        F.when(kind == "view", "").when(kind == "click", F.concat(F.lit("x"), user.cast("string")))
        .when(kind == "error", (user % 3 - 1).cast("string")).otherwise(user.cast("string"))
    )
    requests = v.table("events").select("event_id", raw.alias("target_clusters"))
    return VAL.validate_cluster_requests(requests).select("event_id", "target", "reject_reason")


# --- chunks and trees ------------------------------------------------------------------------


def jobs_of(v):
    """Every document as a job."""
    return v.table("documents").select(
        F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias("document_id"), F.lit("TRANSACTIONAL").alias("layout_strategy")
    )


def line_chunks(v):
    """Lines as chunks: French ones never arrive, German ones carry another strategy."""
    return v.raw_lines.where("lang <> 'fr'").select(
        "document_id",
        F.concat_ws("-", "document_id", c("line_no").cast("string")).alias("chunk_id"),
        c("text").alias("content"),
        F.when(c("lang") == "de", F.lit(None)).otherwise(F.lit("TRANSACTIONAL")).alias("layout_strategy"),
    )


view("v_jobs", "SELECT 'doc-' || doc_id AS document_id, lang FROM documents")
view(
    "v_chunk_errors",
    f"""SELECT document_id, NULL AS record_id, 'No chunks were produced.' AS error FROM v_jobs WHERE lang = 'fr'
        UNION ALL SELECT document_id, document_id || '-' || line_no, 'Chunk ' || document_id || '-' || line_no || ' is empty.' FROM v_raw_lines WHERE lang <> 'fr' AND {S.strip('text')} = ''
        UNION ALL SELECT document_id, document_id || '-' || line_no, 'Chunk ' || document_id || '-' || line_no || ' has mismatched layout_strategy.' FROM v_raw_lines WHERE lang = 'de'""",
)


@query("V1_validate_chunks", "SELECT * FROM v_chunk_errors")
def v1(v):
    return VAL.validate_chunks(line_chunks(v), jobs_of(v))


def damaged_tree(v):
    """Tree with every kind of damage: lost parents, doubled ids, wrong pages and strategies."""
    tree = v.tree.withColumns(
        {
            "page_start": F.when(c("cluster_no") == 4, 99).otherwise(c("page_start")),
            "layout_strategy": F.when(c("level") == 2, "HIERARCHICAL").otherwise("TRANSACTIONAL"),
        }
    )
    kept = tree.where(~((c("level") == 1) & (c("cluster_no") == 2)))
    return kept.unionByName(kept.where("chunk_index = 0 AND cluster_no > 5"))


view(
    "v_damaged",
    """WITH t AS (SELECT * REPLACE (CASE WHEN cluster_no = 4 THEN 99 ELSE page_start END AS page_start), CASE WHEN level = 2 THEN 'HIERARCHICAL' ELSE 'TRANSACTIONAL' END AS layout_strategy
                  FROM v_tree WHERE NOT (level = 1 AND coalesce(cluster_no, -1) = 2))
       SELECT * FROM t UNION ALL SELECT * FROM t WHERE chunk_index = 0 AND cluster_no > 5""",
)
view(
    "v_tree_errors",
    """SELECT document_id, NULL AS record_id, 'No tree nodes were produced.' AS error FROM v_jobs WHERE document_id NOT IN (SELECT document_id FROM v_damaged)
       UNION ALL SELECT DISTINCT document_id, NULL, 'Duplicate node IDs detected.' FROM (SELECT document_id FROM v_damaged GROUP BY document_id, id HAVING count(*) > 1)
       UNION ALL SELECT document_id, NULL, 'No leaf nodes were produced.' FROM v_jobs WHERE document_id NOT IN (SELECT document_id FROM v_damaged WHERE node_type = 'leaf')
       UNION ALL SELECT document_id, id, 'Node ' || id || ' references missing parent ' || parent_id || '.' FROM v_damaged n WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_damaged p WHERE p.document_id = n.document_id AND p.id = n.parent_id)
       UNION ALL SELECT document_id, id, 'Node ' || id || ' has invalid page range.' FROM v_damaged WHERE page_start > page_end
       UNION ALL SELECT document_id, id, 'Node ' || id || ' has mismatched layout strategy.' FROM v_damaged WHERE layout_strategy <> 'TRANSACTIONAL'""",
)


@query("V2_validate_tree", "SELECT * FROM v_tree_errors")
def v2(v):
    return VAL.validate_tree(damaged_tree(v), jobs_of(v))


@query(
    "J7_missing_parents",
    "SELECT id, parent_id FROM v_damaged n WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_damaged p WHERE p.document_id = n.document_id AND p.id = n.parent_id)",
)
def j7(v):
    return VAL.missing_parents(damaged_tree(v)).select("id", "parent_id")


@query(
    "V7_merge_validations",
    "SELECT document_id, coalesce(n, 0) AS n_errors, n IS NULL AS passed FROM v_jobs LEFT JOIN (SELECT document_id, count(*) AS n FROM (SELECT document_id FROM v_chunk_errors UNION ALL SELECT document_id FROM v_tree_errors) GROUP BY document_id) USING (document_id)",
)
def v7(v):
    jobs = jobs_of(v)
    merged = VAL.merge_validations(jobs, VAL.validate_chunks(line_chunks(v), jobs), VAL.validate_tree(damaged_tree(v), jobs))
    return merged.select("document_id", "n_errors", "passed")


@query(
    "V3_validate_constraints",
    """SELECT document_id, id AS record_id, 'embedding is null' AS error FROM v_nodes WHERE cluster_no = 1
       UNION ALL SELECT document_id, id, 'node_type is not leaf or summary' FROM v_nodes WHERE cluster_no = 2
       UNION ALL SELECT document_id, id, 'embedding has the wrong width' FROM v_nodes WHERE cluster_no = 3
       UNION ALL SELECT min(document_id), 'leaf-x' || cluster_no, 'id is not unique' FROM v_nodes WHERE cluster_no > 7 GROUP BY cluster_no HAVING count(*) > 1""",
)
def v3(v):
    k = c("cluster_no")
    nodes = v.nodes.withColumns(
        {
            "node_type": F.when(k == 2, "branch").otherwise(c("node_type")),
            "embedding": F.when(k == 1, None).when(k == 3, F.slice("embedding", 1, 8)).otherwise(c("embedding")),
            "id": F.when(k > 7, F.concat(F.lit("leaf-x"), k.cast("string"))).otherwise(c("id")),
        }
    )
    return VAL.validate_constraints(nodes, 64)


@query(
    "V3_validate_catalog",
    """SELECT document_id, CAST(document_id AS VARCHAR) AS record_id, 'unknown ingestion_status' AS error FROM v_catalog WHERE ingestion_status = 'pending'
       UNION ALL SELECT min(document_id), CAST(owner_id AS VARCHAR), 'path is not unique' FROM v_catalog GROUP BY owner_id HAVING count(*) > 1""",
)
def v3c(v):
    catalog = v.catalog.withColumns(
        {
            "ingestion_status": F.when(c("ingestion_status") == "pending", "queued").otherwise(c("ingestion_status")),
            "path": c("owner_id").cast("string"),
        }
    )
    return VAL.validate_catalog(catalog)


@query("V3_validate_users", "SELECT email, count(*) AS n_users FROM (SELECT trim(lower(' ' || n_name || '-' || c_mktsegment || ' ')) AS email FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY email HAVING count(*) > 1")
def v3u(v):
    people = v.table("customer").join(v.table("nation"), c("c_nationkey") == c("n_nationkey"))
    email = F.concat(F.lit(" "), c("n_name"), F.lit("-"), c("c_mktsegment"), F.lit(" "))
    return VAL.validate_users(people, L.email_key(email))


@query("V9_validate_clusters", "SELECT document_id, CAST(NULL AS VARCHAR) AS record_id, 'No clusters were produced.' AS error FROM v_jobs WHERE document_id NOT IN (SELECT document_id FROM v_nodes)")
def v9(v):
    return VAL.validate_clusters(jobs_of(v), cluster_structurally(v.nodes))


# --- checkpoints and stages ----------------------------------------------------------------------

STAGE_NAMES = """(VALUES (0,'downloading_pdf',10),(1,'extracting_pdf_structure',25),(2,'profiling_document',35),(3,'selecting_strategy',40),(4,'chunking_document',55),
  (5,'validating_chunks',60),(6,'embedding_chunks',72),(7,'building_tree',84),(8,'validating_tree',92),(9,'storing_nodes',98)) AS s(stage_no, stage, progress)"""


def checkpoints_of(v):
    return v.stage_events.select(
        "document_id", "run_id", c("stage_no").cast("string").alias("stage"), "status", "artifact_ref",
        c("ts").alias("created_at"), c("event_id").alias("checkpoint_id"),
    )


@query(
    "W14_latest_checkpoint",
    "SELECT document_id, run_id, CAST(stage_no AS VARCHAR) AS stage, status, artifact_ref FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) AS rn FROM v_stage_events) WHERE rn = 1",
)
def w14(v):
    return A.latest_checkpoint(checkpoints_of(v))


@query(
    "W14_stage_artifact",
    "SELECT document_id, run_id, CAST(stage_no AS VARCHAR) AS stage, artifact_ref FROM (SELECT *, row_number() OVER (PARTITION BY document_id, run_id, stage_no ORDER BY ts DESC, event_id DESC) AS rn FROM v_stage_events WHERE status = 'completed') WHERE rn = 1",
)
def w14b(v):
    return A.stage_artifact(checkpoints_of(v))


@query(
    "W16_stage_progress",
    f"""SELECT event_id, document_id, stage, progress, round((epoch_us(lead(ts) OVER (PARTITION BY document_id, run_id ORDER BY ts, event_id DESC)) - epoch_us(ts)) / CAST(1000000 AS DOUBLE), 6) AS seconds
        FROM v_stage_events JOIN {STAGE_NAMES} USING (stage_no)""",
)
def w16(v):
    return A.stage_progress(v.stage_events).select(
        "event_id", "document_id", "stage", "progress", F.round("seconds", 6).alias("seconds")
    )
