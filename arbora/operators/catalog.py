"""The document catalogue: registration, lookups, status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V
from arbora.functions import labels, text
from arbora.operators.scan import prefix_scan
from arbora.operators.validation import validate_uploads


def register_documents(uploads: DataFrame, now: Column) -> DataFrame:
    """Catalogue rows for the accepted uploads, status pending, encryption data nested."""
    accepted = validate_uploads(uploads).where(F.col("reject_reason").isNull())
    size = F.coalesce(F.nullif("content_length", F.lit(0)), F.col("file_size")).cast("bigint")
    return accepted.select(
        F.col("upload_id").alias("document_id"),
        "owner_id",
        F.col("file_name").alias("name"),
        size.alias("size"),
        F.lit("application/octet-stream").alias("mime_type"),
        labels.storage_path(F.col("owner_id"), F.unix_millis(now), F.col("upload_id"), F.col("file_name")).alias("path"),
        labels.normalize_strategy(F.col("layout_strategy")).alias("layout_strategy"),
        F.lit("pending").alias("ingestion_status"),
        F.lit(None).cast("string").alias("ingestion_error"),
        now.alias("ingestion_requested_at"),
        F.lit(None).cast("timestamp").alias("ingestion_completed_at"),
        F.struct(
            F.lit("encrypted").alias("status"),
            F.col("crypto_version"),
            F.col("wrapped_dek"),
            F.col("file_iv"),
            F.col("wrap_iv"),
            F.lit(1).alias("key_version"),
            size.alias("content_length"),
            F.coalesce(F.nullif("mime_type", F.lit("")), F.lit("application/pdf")).alias("original_mime_type"),
        ).alias("storage_encryption"),
        now.alias("created_at"),
    )


def delete_documents(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Remove catalogue rows asked for by their owner."""
    return catalog.join(requests.select("document_id", "owner_id"), ["document_id", "owner_id"], "left_anti")


def _matched(catalog: DataFrame, updates: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Left join on document_id; where an update matched its values win, nulls included."""
    joined = catalog.alias("c").join(updates.withColumn("__hit", F.lit(True)).alias("u"), "document_id", "left")
    changed = {n: F.when(F.col("__hit"), value).otherwise(F.col(f"c.{n}")) for n, value in columns.items()}
    return joined.select(*[changed.get(n, F.col(f"c.{n}") if n != "document_id" else F.col(n)).alias(n) for n in catalog.columns])


def mark_processing(catalog: DataFrame, starts: DataFrame, now: Column) -> DataFrame:
    fresh = {
        "ingestion_status": F.lit("processing"),
        "ingestion_error": F.lit(None).cast("string"),
        "ingestion_requested_at": now,
        "ingestion_completed_at": F.lit(None).cast("timestamp"),
    }
    have = {k: v for k, v in fresh.items() if k in catalog.columns}
    return _matched(catalog, starts.select("document_id").distinct(), have)


def one_per_document(updates: DataFrame, order: str | None) -> DataFrame:
    """The last update of each document by ``order``, without one the largest; ties go to the largest row."""
    values = [c for c in updates.columns if c != "document_id"]
    row = F.struct(*([order] if order else []), *values)
    return updates.groupBy("document_id").agg(F.max(row).alias("__u")).select("document_id", *(F.col(f"__u.{c}").alias(c) for c in values if c != order))


def rename_documents(catalog: DataFrame, renames: DataFrame, order: str | None = None) -> DataFrame:
    """New names; of several for a document the last by ``order`` counts."""
    ordered = [order] if order else []
    cleaned = renames.select("document_id", *ordered, text.strip(F.col("new_name")).alias("new_name")).where("new_name <> ''")
    return _matched(catalog, one_per_document(cleaned, order), {"name": F.col("u.new_name")})


def apply_status_updates(catalog: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Status columns of the updates; of several updates of a document the last by ``order`` counts."""
    changed = [n for n in ("ingestion_status", "ingestion_error", "ingestion_requested_at", "ingestion_completed_at")
               if n in updates.columns and n in catalog.columns]
    last = one_per_document(updates.select("document_id", *([order] if order else []), *(n for n in changed if n != order)), order)
    return _matched(catalog, last, {n: F.col(f"u.{n}") for n in changed})


def find_owned_document(catalog: DataFrame, document_id, owner_id) -> DataFrame:
    return catalog.where((F.col("document_id") == document_id) & (F.col("owner_id") == owner_id))


def owned_semi(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests whose document belongs to the asking owner."""
    return requests.join(catalog.select("document_id", "owner_id"), ["document_id", "owner_id"], "left_semi")


def search_documents(catalog: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring search on the name; no wildcards."""
    return catalog.where(F.contains(F.lower("name"), F.lit(term.strip().lower())))


def pending_documents(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("ingestion_status").isin("pending", "processing"))


def accept_pdf_uploads(uploads: DataFrame) -> DataFrame:
    return uploads.where((F.col("mime_type") == "application/pdf") | F.lower("file_name").endswith(".pdf"))


def list_documents(catalog: DataFrame, owner_id) -> DataFrame:
    """An owner's documents, newest first."""
    shown = [c for c in catalog.columns if c != "updated_at"]
    return catalog.where(F.col("owner_id") == owner_id).select(*shown).orderBy(F.desc("created_at"), "document_id")


def gate_indexed(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """``reject_reason`` for requests on unknown, foreign or not yet indexed documents."""
    known = catalog.select("document_id", "owner_id", "ingestion_status")
    joined = requests.join(known, ["document_id", "owner_id"], "left")
    return joined.withColumn(
        "reject_reason",
        F.when(F.col("ingestion_status").isNull(), V.NOT_FOUND).when(
            F.col("ingestion_status") != "indexed", V.NOT_INDEXED
        ),
    )


def tracked_documents(trackers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Documents of each tracker's ordered id list, misses dropped, order kept."""
    ids = trackers.select("tracker_id", F.posexplode("document_ids").alias("position", "document_id"))
    return ids.join(catalog, "document_id")


def ingestion_complete(tracked: DataFrame) -> DataFrame:
    """Per tracker: at least one document and every one in a terminal status."""
    return tracked.groupBy("tracker_id").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.bool_and(F.col("ingestion_status").isin(*V.TERMINAL_STATUSES)).alias("complete"),
    )


def orphan_nodes(nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    return nodes.join(catalog.select("document_id"), "document_id", "left_anti")


# --- status ---------------------------------------------------------------------------------


def gateway_status(status: Column) -> Column:
    """Stages in between all show as processing."""
    return F.when(status.isin("indexed", "failed", "pending"), status).otherwise("processing")


def latest_status(events: DataFrame) -> DataFrame:
    """Last status per document by (ts, event_id), with the completion time of terminal ones.

    ``max_by`` combines map side, so a document with very many events costs one row per task.
    """
    last = F.max_by(F.struct("status", "error", "ts"), F.struct("ts", "event_id"))
    latest = events.groupBy("document_id").agg(last.alias("last"))
    status = gateway_status(F.col("last.status"))
    return latest.select(
        "document_id",
        status.alias("ingestion_status"),
        F.col("last.error").alias("ingestion_error"),
        F.when(status.isin(*V.TERMINAL_STATUSES), F.col("last.ts")).alias("ingestion_completed_at"),
    )


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Newest checkpoint per document."""
    order = F.struct("created_at", "checkpoint_id")
    newest = checkpoints.groupBy("document_id").agg(F.max_by(F.struct("run_id", "stage", "status", "artifact_ref"), order).alias("c"))
    return newest.select("document_id", "c.*")


def stage_artifact(checkpoints: DataFrame) -> DataFrame:
    """Latest completed artifact per (document, run, stage)."""
    done = checkpoints.where(F.col("status") == "completed")
    order = F.struct("created_at", "checkpoint_id")
    return done.groupBy("document_id", "run_id", "stage").agg(F.max_by("artifact_ref", order).alias("artifact_ref"))


def stages(spark) -> DataFrame:
    """The ten pipeline stages; a fixed dimension that is safe to broadcast."""
    rows = [(i, *stage) for i, stage in enumerate(V.STAGES)]
    return spark.createDataFrame(rows, "stage_no int, stage string, checkpoint string, progress int")


def stage_progress(events: DataFrame) -> DataFrame:
    """Timeline rows per run with stage names, progress and time until the next report."""
    named = events.join(F.broadcast(stages(events.sparkSession)), "stage_no")
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000).cast("bigint")
    seen = prefix_scan(
        named.withColumn("__back", -F.unix_micros("ts")),
        ["document_id", "run_id"],
        ["__back", "event_id"],
        -hour,
        lags={"next_ts": F.col("ts")},
    )
    return seen.withColumn("seconds", (F.unix_micros("next_ts") - F.unix_micros("ts")) / F.lit(1e6)).drop("__back")
