"""Chunking: word windows, party enclaves and heading sections.

Input units are rows in document order (pages, paragraphs or lines).  Nothing
here gathers a document: running values come from two-level scans, each unit
emits only the slices of its own words that fall into a window, and a chunk is
assembled from at most one window of words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V
from arbora.functions import parties, text
from arbora.operators.scan import ordinal_segment, page_segment, prefix_scan
from arbora.session import cut_lineage

HIERARCHY = "array<struct<key:string,title:string,depth:int>>"
ORDER = ("page_number", "block_no")
# Heading markers never go deeper than five levels; typed headings may, so the


# --- text units ---------------------------------------------------------------------


def _split_pages(pages: DataFrame, parts: Column) -> DataFrame:
    kept = [c for c in pages.columns if c != "text"]
    return pages.select(*kept, F.posexplode(parts).alias("block_no", "text"))


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """Blank-line separated paragraphs of plain page text."""
    return _split_pages(pages, text.paragraph_blocks(F.col("text")))


def page_lines(pages: DataFrame) -> DataFrame:
    """Physical lines of plain page text."""
    return _split_pages(pages, text.physical_lines(F.col("text")))


def item_paragraphs(items: DataFrame) -> DataFrame:
    """Body items of structured pages as cleaned paragraphs."""
    cleaned = items.where(F.col("label").isin(*V.BODY_LABELS)).withColumn("text", text.clean_inline(F.col("text")))
    return cleaned.where(F.col("text") != "").withColumnsRenamed({"reading_order": "block_no", "label": "component"})


def item_lines(items: DataFrame) -> DataFrame:
    """Body items of structured pages, one row per physical line."""
    body = items.where(F.col("label").isin(*V.BODY_LABELS))
    kept = [c for c in body.columns if c not in ("text", "reading_order")]
    split = body.select(
        *kept, "reading_order", F.posexplode(text.physical_lines(F.col("text"))).alias("line_in_item", "text")
    )
    # both parts are 32-bit integers, so items never overlap
    number = F.col("reading_order").cast("bigint") * (1 << 32) + F.col("line_in_item")
    return split.withColumn("block_no", number).withColumnRenamed("label", "component").drop(
        "reading_order", "line_in_item"
    )


def pages_without_items(pages: DataFrame, items: DataFrame) -> DataFrame:
    keys = ["document_id", "page_number"]
    return pages.join(items.select(*keys).distinct(), keys, "left_anti")


def text_units(pages: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """Paragraphs or lines: structured items where a page has them, its plain text otherwise."""
    from_items = {"paragraph": item_paragraphs, "line": item_lines}[by](items)
    from_text = {"paragraph": page_paragraphs, "line": page_lines}[by](pages_without_items(pages, items))
    columns = ["document_id", "page_number", "block_no", "text", "component", "section_level"]
    return from_items.unionByName(from_text, allowMissingColumns=True).select(*columns)


# --- word windows -------------------------------------------------------------------------


def word_windows(
    units: DataFrame,
    keys: Sequence[str],
    *,
    target: int,
    overlap: int,
    order: Sequence[str] = ORDER,
    segment: Column | None = None,
    whole_up_to: int = 0,
) -> DataFrame:
    """Cut the words of each key into windows of ``target`` words sharing ``overlap`` words.

    With stride ``s = target - overlap`` window i covers words [i*s, i*s + target).
    All full windows are kept; whatever follows the last full stride becomes a
    tail window.  Groups of at most ``whole_up_to`` words stay one chunk with
    their unit texts joined by newlines.

    Returns keys, ``fragment``, ``content``, ``page_start``, ``page_end``.
    """
    if not 0 <= overlap < target:
        raise ValueError("overlap must be at least 0 and smaller than target")
    stride = target - overlap
    segment = page_segment() if segment is None else segment

    counted = units.withColumn("__n", text.word_count(F.col("text")).cast("bigint"))
    slim = counted.select(*dict.fromkeys([*keys, *order, "page_number", "text", "__n"]))
    placed = prefix_scan(
        slim, keys, order, segment, sums={"__end": F.col("__n")}, totals={"__total": F.col("__n")}
    ).where("__n > 0")

    start, end, total = F.col("__end") - F.col("__n"), F.col("__end"), F.col("__total")
    full = F.when(total < target, F.lit(0)).otherwise(F.floor((total - target) / stride) + 1).cast("bigint")
    n_windows = full + F.when(full * stride < total, 1).otherwise(0)
    first = F.greatest(F.lit(0), F.floor((start - target) / stride) + 1).cast("bigint")
    last = F.least(n_windows - 1, F.floor((end - 1) / stride)).cast("bigint")
    whole = total <= whole_up_to

    def piece(i: Column) -> Column:
        begin = F.greatest(F.col("__start"), i * stride)
        stop = F.least(F.col("__end"), i * stride + target)
        part = F.slice(F.col("__words"), (begin - F.col("__start") + 1).cast("int"), (stop - begin).cast("int"))
        return F.struct(i.alias("fragment"), F.array_join(part, " ").alias("piece"))

    pieces = F.when(
        whole, F.array(F.struct(F.lit(0).cast("bigint").alias("fragment"), F.col("text").alias("piece")))
    ).otherwise(F.transform(F.sequence(F.col("__first"), F.col("__last")), piece))
    cut = (
        placed.withColumns(
            {
                "__start": start,
                "__first": first,
                "__last": last,
                "__whole": whole,
                "__words": text.words(F.col("text")),
            }
        )
        .select(*keys, *[o for o in order if o not in keys and o != "page_number"], "page_number", "__whole",
                F.explode(pieces).alias("__p"))
        .select("*", "__p.*")
    )
    gathered = cut.groupBy(*keys, "fragment").agg(
        F.sort_array(F.collect_list(F.struct(*order, "piece"))).alias("__pieces"),
        F.bool_or("__whole").alias("__whole"),
        F.min("page_number").alias("page_start"),
        F.max("page_number").alias("page_end"),
    )
    parts = F.transform("__pieces", lambda p: p["piece"])
    joined = F.when(F.col("__whole"), F.array_join(parts, "\n")).otherwise(F.array_join(parts, " "))
    return gathered.select(
        *keys, F.col("fragment").cast("int").alias("fragment"), text.strip(joined).alias("content"), "page_start", "page_end"
    )


def global_chunk_index(chunks: DataFrame, group: str, key: str = "document_id") -> DataFrame:
    """Number chunks from 0 per document over groups and their fragments."""
    sizes = chunks.groupBy(key, group).agg(F.count(F.lit(1)).alias("__size"))
    upto = prefix_scan(sizes, [key], [group], ordinal_segment(group), sums={"__upto": F.col("__size")})
    base = upto.select(key, group, (F.col("__upto") - F.col("__size")).alias("__before"))
    return chunks.join(base, [key, group]).withColumn(
        "chunk_index", (F.col("__before") + F.col("fragment")).cast("int")
    ).drop("__before")


def transactional_chunks(pages: DataFrame, target: int | None = None, overlap: int | None = None) -> DataFrame:
    """Sliding word windows over page text; a document's words run across its pages."""
    target = V.TRANSACTIONAL_WINDOW[0] if target is None else target
    overlap = V.TRANSACTIONAL_WINDOW[1] if overlap is None else overlap
    windows = word_windows(pages, ["document_id"], target=target, overlap=overlap, order=("page_number",))
    return windows.withColumnRenamed("fragment", "chunk_index").withColumns(
        {"layout_strategy": F.lit("TRANSACTIONAL"), "window_overlap_words": F.lit(overlap)}
    )


# --- parties ----------------------------------------------------------------------------------


def with_leaders(units: DataFrame, rules: parties.Rules = V.PARTY_RULES) -> DataFrame:
    return units.withColumn("leaders", parties.leaders(parties.party_scores(F.col("text"), rules)))


def carry_party(
    units: DataFrame,
    keys: Sequence[str] = ("document_id",),
    order: Sequence[str] = ORDER,
    segment: Column | None = None,
) -> DataFrame:
    """Resolve ``leaders`` to one party per unit.

    A single leader or an empty list decides by itself.  A tie keeps the running
    party while that party is among the leaders and turns neutral otherwise; the
    neutral state lasts until the next unit that decides by itself.  Two carries
    express this: the last deciding unit, then the last event of either kind.
    """
    segment = page_segment() if segment is None else segment
    units = cut_lineage(units)  # scored once, read by both scans
    tied = F.size("leaders") > 1
    decided = F.when(~tied, F.coalesce(F.try_element_at("leaders", F.lit(1)), F.lit(V.NEUTRAL_PARTY)))
    anchored = prefix_scan(units, keys, order, segment, carries={"__anchor": decided})
    holds = F.coalesce(F.array_contains("leaders", F.col("__anchor")), F.lit(False))
    event = F.coalesce(decided, F.when(~holds, F.lit(V.NEUTRAL_PARTY)))
    return prefix_scan(anchored, keys, order, segment, carries={"party": event}).drop("__anchor")


def party_enclaves(
    units: DataFrame,
    keys: Sequence[str] = ("document_id",),
    order: Sequence[str] = ORDER,
    segment: Column | None = None,
) -> DataFrame:
    """Number runs of equal ``party`` from 0 per key."""
    segment = page_segment() if segment is None else segment
    followed = prefix_scan(units, keys, order, segment, lags={"__previous": F.col("party")})
    change = F.when(F.col("__previous").eqNullSafe(F.col("party")), 0).otherwise(1)
    numbered = prefix_scan(followed, keys, order, segment, sums={"__runs": change})
    return numbered.withColumn("enclave_index", (F.col("__runs") - 1).cast("int")).drop("__previous", "__runs")


def adversarial_chunks(
    units: DataFrame,
    rules: parties.Rules = V.PARTY_RULES,
    target: int = V.ADVERSARIAL_WINDOW[0],
    overlap: int = V.ADVERSARIAL_WINDOW[1],
) -> DataFrame:
    """Chunks that never cross a change of speaking party."""
    slim = units.select("document_id", *ORDER, "text")
    voiced = cut_lineage(carry_party(with_leaders(slim, rules)))
    runs = cut_lineage(party_enclaves(voiced))
    windows = word_windows(runs, ["document_id", "enclave_index", "party"], target=target, overlap=overlap)
    return global_chunk_index(windows, "enclave_index").select(
        "document_id",
        "chunk_index",
        "content",
        "page_start",
        "page_end",
        F.lit("ADVERSARIAL").alias("layout_strategy"),
        F.col("party").alias("party_enclave"),
        F.col("party").alias("layout_partition"),
        "enclave_index",
    )


# --- sections --------------------------------------------------------------------------------------


def with_heading_levels(units: DataFrame) -> DataFrame:
    """Add the chunker's heading level (null for plain lines) and the marker's slug."""
    component = F.col("component") if "component" in units.columns else F.lit(None).cast("string")
    level = F.col("section_level") if "section_level" in units.columns else F.lit(None).cast("int")
    return units.withColumns(
        {
            "heading_level": text.chunker_heading_level(component, level, F.col("text")),
            "heading_slug": text.heading_key(F.col("text")),
        }
    )


def assign_sections(
    lines: DataFrame, order: Sequence[str] = ORDER, segment: Column | None = None
) -> DataFrame:
    """``section_no``: how many headings a document has had so far; 0 is the preamble."""
    segment = page_segment() if segment is None else segment
    opens = F.col("heading_level").isNotNull().cast("int")
    scanned = prefix_scan(lines, ["document_id"], order, segment, sums={"section_no": opens})
    return scanned.withColumn("section_no", F.col("section_no").cast("int"))


def synthetic_heading_keys(headings: DataFrame) -> DataFrame:
    """``section_key``: the marker's slug, or a running number among unmarked headings of a level."""
    unmarked = F.col("heading_slug").isNull().cast("int")
    counted = prefix_scan(
        headings,
        ["document_id", "heading_level"],
        ["section_no"],
        ordinal_segment("section_no"),
        sums={"__unmarked": unmarked},
    )
    running = F.format_string("level-%d-%d", F.col("heading_level"), F.col("__unmarked"))
    return counted.withColumn("section_key", F.coalesce("heading_slug", running)).drop("__unmarked")


def heading_stack(headings: DataFrame) -> DataFrame:
    """``section_hierarchy``: open headings when each heading starts.

    A heading of level l cuts the stack to l-1 entries and is pushed, so with
    ordinal r the stack height is ``r + min(0, running min(max(l,1) - r))`` and
    position p holds the last heading whose height was p.  There is a carried
    column for each height that occurs.
    """
    rank, segment = F.col("section_no"), ordinal_segment("section_no")
    level = F.greatest(F.col("heading_level"), F.lit(1))
    low = prefix_scan(headings, ["document_id"], ["section_no"], segment, mins={"__low": level - rank})
    height = (rank + F.least(F.lit(0), F.col("__low"))).cast("int")
    tall = cut_lineage(low.withColumn("stack_height", height).drop("__low"))
    positions = range(1, (tall.agg(F.max("stack_height")).first()[0] or 1) + 1)
    entry = F.struct(
        F.col("section_key").alias("key"), F.col("text").alias("title"), F.col("heading_level").alias("depth")
    )
    stacked = prefix_scan(
        tall,
        ["document_id"],
        ["section_no"],
        segment,
        carries={f"__at{p}": F.when(F.col("stack_height") == p, entry) for p in positions},
    )
    open_now = F.slice(F.array(*[f"__at{p}" for p in positions]), F.lit(1), F.col("stack_height"))
    return stacked.withColumn("section_hierarchy", open_now.cast(HIERARCHY)).drop(*[f"__at{p}" for p in positions])


def section_paths(lines: DataFrame) -> DataFrame:
    """Hierarchy per (document, section) from lines that carry levels and section numbers."""
    headings = lines.where(F.col("heading_level").isNotNull()).select(
        "document_id", "section_no", "heading_level", "heading_slug", "text"
    )
    return heading_stack(cut_lineage(synthetic_heading_keys(headings))).select(
        "document_id", "section_no", "section_hierarchy"
    )


def section_chunks(sectioned: DataFrame) -> DataFrame:
    """Short sections whole, long ones in adjoining windows."""
    target, overlap = V.SECTION_WINDOW
    return word_windows(
        sectioned,
        ["document_id", "section_no"],
        target=target,
        overlap=overlap,
        whole_up_to=V.SECTION_SINGLE_CHUNK_WORDS,
    )


def hierarchical_chunks(units: DataFrame) -> DataFrame:
    """Chunks by section with the path of open headings."""
    leveled = cut_lineage(with_heading_levels(units))
    sectioned = cut_lineage(assign_sections(leveled))
    chunks = global_chunk_index(section_chunks(sectioned), "section_no")
    preamble = F.array(
        F.struct(F.lit("preamble-1").alias("key"), F.lit("Preamble").alias("title"), F.lit(1).alias("depth"))
    ).cast(HIERARCHY)
    pathed = chunks.join(section_paths(sectioned), ["document_id", "section_no"], "left").withColumn(
        "section_hierarchy", F.coalesce("section_hierarchy", preamble)
    )
    path = F.col("section_hierarchy")
    return pathed.select(
        "document_id",
        "chunk_index",
        "content",
        "page_start",
        "page_end",
        F.lit("HIERARCHICAL").alias("layout_strategy"),
        F.element_at(path, 1)["key"].alias("layout_partition"),
        "section_hierarchy",
        F.element_at(path, -1)["key"].alias("section_key"),
        F.try_element_at(path, F.lit(-2))["key"].alias("section_parent_key"),
        F.size(path).alias("structural_depth"),
        F.col("fragment").alias("section_fragment"),
    )


# --- chunk records ---------------------------------------------------------------------------------


def chunk_metadata(chunks: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Add token counts, provenance and the document's extraction confidence."""
    counted = chunks.withColumns(
        {"token_count": text.estimate_tokens(F.col("content")), "extraction_source": F.lit("v2")}
    )
    if quality is None:
        return counted.withColumn("extraction_confidence", F.lit(0.0))
    scores = quality.select("document_id", F.col("confidence").alias("extraction_confidence"))
    return counted.join(scores, "document_id", "left").withColumn(
        "extraction_confidence", F.coalesce("extraction_confidence", F.lit(0.0))
    )
