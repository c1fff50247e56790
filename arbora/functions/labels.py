"""Display labels, names and metadata lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V
from arbora.functions.text import strip


def lookup(column: Column, mapping: dict[str, str], default: str | None) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, F.coalesce(column, F.lit(""))), F.lit(default))


def label_to_block_type(label: Column) -> Column:
    return lookup(label, V.LABEL_TO_BLOCK_TYPE, "unknown")


def block_type_to_label(block_type: Column) -> Column:
    return lookup(block_type, V.BLOCK_TYPE_TO_LABEL, "TEXT")


def normalize_strategy(strategy: Column) -> Column:
    cleaned = strip(F.upper(F.coalesce(strategy, F.lit(""))))
    return F.when(cleaned.isin(*V.LAYOUT_STRATEGIES), cleaned).otherwise(V.DEFAULT_STRATEGY)


def strategy_label(strategy: Column) -> Column:
    return lookup(strategy, V.STRATEGY_LABELS, V.STRATEGY_LABELS[V.DEFAULT_STRATEGY])


def status_label(status: Column) -> Column:
    return lookup(status, V.STATUS_LABELS, V.DEFAULT_STATUS_LABEL)


def step_state(step: str, status: Column) -> Column:
    """State of one progress step (queued, processing, ready) for a document status."""
    # What each step shows per status; any other status is still queued.
    states = {
        "queued": {"failed": "done", "indexed": "done", "processing": "done", "other": "current"},
        "processing": {"failed": "failed", "indexed": "done", "processing": "current", "other": "pending"},
        "ready": {"failed": "pending", "indexed": "done", "processing": "pending", "other": "pending"},
    }[step]
    return lookup(status, {k: v for k, v in states.items() if k != "other"}, states["other"])


def format_page_range(page_start: Column, page_end: Column) -> Column:
    first, last = F.nullif(page_start, F.lit(0)), F.nullif(page_end, F.lit(0))
    return (
        F.when(first.isNull() & last.isNull(), F.lit("Pages unavailable"))
        .when(first != last, F.format_string("Pages %d-%d", first, last))
        .otherwise(F.format_string("Page %d", F.coalesce(first, last)))
    )


def truthy(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


# Metadata fields and the two spellings each one is accepted in.
METADATA_FIELDS = {
    "layout_strategy": "layoutStrategy",
    "cluster_id": "clusterId",
    "clause_number": "clauseNumber",
    "clause_title": "clauseTitle",
    "party_enclave": "partyEnclave",
    "issue_key": "issueKey",
    "argument_type": "argumentType",
    "section_hierarchy": "sectionHierarchy",
    "section_key": "sectionKey",
    "section_parent_key": "sectionParentKey",
    "structural_depth": "structuralDepth",
    "extraction_source": "extractionSource",
}


def normalize_metadata(metadata_json: Column) -> dict[str, Column]:
    """Typed columns from a JSON object written in either spelling; a zero depth counts as absent."""
    fields = {
        snake: truthy(
            F.get_json_object(metadata_json, f"$.{camel}"), F.get_json_object(metadata_json, f"$.{snake}")
        )
        for snake, camel in METADATA_FIELDS.items()
    }
    fields["section_hierarchy"] = F.coalesce(fields["section_hierarchy"], F.lit("[]"))
    fields["structural_depth"] = F.nullif(fields["structural_depth"].try_cast("int"), F.lit(0))
    return fields


def metadata_chips(fields: dict[str, Column], hierarchy: Column) -> Column:
    """Ordered chips of a node. ``hierarchy`` is an array of (key, title, depth)."""
    strategy = fields["layout_strategy"]
    disputed = strategy == "ADVERSARIAL"
    codified = strategy == "HIERARCHICAL"
    depth = F.nullif(fields["structural_depth"].cast("int"), F.lit(0))
    titles = F.transform(
        F.coalesce(hierarchy, F.array().cast("array<struct<key:string,title:string,depth:int>>")),
        lambda item: truthy(item["title"], item["key"]),
    )
    before = F.array(
        F.concat(F.lit("Clause "), truthy(fields["clause_number"])),
        truthy(fields["clause_title"]),
        F.when(disputed, truthy(fields["party_enclave"])),
        F.when(disputed, F.concat(F.lit("Issue "), truthy(fields["issue_key"]))),
        F.when(disputed, truthy(fields["argument_type"])),
    )
    sections = F.when(codified, titles).otherwise(F.array().cast("array<string>"))
    after = F.array(F.when(codified, F.concat(F.lit("Structural Depth "), depth.cast("string"))))
    chips = F.array_compact(F.concat(before, sections, after))
    fallback = F.array_compact(F.array(truthy(strategy)))
    return F.when(F.size(chips) == 0, fallback).otherwise(chips)


def node_identifier(
    node_id: Column,
    node_type: Column,
    level: Column,
    chunk_index: Column,
    clause_number: Column,
    section_key: Column,
    chips: Column,
) -> Column:
    leaf = F.coalesce(
        F.concat(F.lit("Chunk "), chunk_index.cast("string")),
        F.concat(F.lit("Chunk "), F.substring(truthy(node_id), 1, 8)),
        F.lit("Leaf Chunk"),
    )
    inner = F.coalesce(
        F.concat(F.lit("Clause "), truthy(clause_number)),
        truthy(section_key),
        truthy(F.try_element_at(chips, F.lit(1))),
        F.when(node_type == "root_summary", F.lit("Root Summary")),
        F.concat(F.lit("Level "), level.cast("string")),
    )
    return F.when(node_type == "leaf", leaf).otherwise(inner)


def evidence_label(chunk_id: Column, source_no: Column) -> Column:
    """Last dash-separated part of the chunk id, else the id, else its position."""
    last = F.element_at(F.split(truthy(chunk_id), "-"), -1)
    return F.coalesce(truthy(last), truthy(chunk_id), F.concat(F.lit("source-"), source_no.cast("string")))


def evidence_line(page_start: Column, page_end: Column, label: Column, strategy: Column) -> Column:
    return F.concat_ws(
        " · ", format_page_range(page_start, page_end), F.concat(F.lit("Chunk "), label), truthy(strategy)
    )


# --- files and people ----------------------------------------------------------------


def with_pdf(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def strip_pdf(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf\z", "")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "_")


def storage_path(owner_id: Column, stamp: Column, unique_id: Column, name: Column) -> Column:
    file_name = F.concat_ws("-", stamp.cast("string"), unique_id, F.concat(safe_name(name), F.lit(".enc")))
    return F.concat_ws("/", owner_id.cast("string"), file_name)


def full_name(first: Column, last: Column) -> Column:
    return strip(F.concat(first, F.lit(" "), last))


def email_key(email: Column) -> Column:
    return strip(F.lower(email))


def initials(name: Column) -> Column:
    parts = F.slice(F.filter(F.split(F.coalesce(name, F.lit("")), " "), lambda p: p != ""), 1, 2)
    letters = F.array_join(F.transform(parts, lambda p: F.upper(F.substring(p, 1, 1))), "")
    return F.when(letters == "", F.lit("U")).otherwise(letters)
