"""Document blocks: profiling, routing, normalisation and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V
from arbora.functions import geometry, labels, text
from arbora.operators import layout
from arbora.operators.scan import page_segment, prefix_scan
from arbora.session import cut_lineage

PAGE = ["document_id", "page_number"]
BOX_TYPE = "struct<left:double,top:double,right:double,bottom:double,coord_origin:string>"


# --- profiles ----------------------------------------------------------------------------


def page_profile(
    pages: DataFrame, words: DataFrame, chars: DataFrame, images: DataFrame, tables: DataFrame
) -> DataFrame:
    """Density, coverage and layout flags per page. Each input carries document and page."""

    def per_page(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*PAGE).agg(F.count(F.lit(1)).alias(name))

    # words are counted per column first: both sums combine map side, and no word is shuffled
    places = words.groupBy(*PAGE, F.bround(F.col("x0") / V.COLUMN_WIDTH).alias("__column")).agg(F.count(F.lit(1)).alias("n"))
    columns = places.groupBy(*PAGE).agg(F.sum("n").alias("word_count"), F.count("__column").alias("n_columns"))
    joined = pages.select(*PAGE).distinct().join(columns, PAGE, "left")
    for df, name in ((chars, "n_chars"), (images, "n_images"), (tables, "n_tables")):
        joined = joined.join(per_page(df, name), PAGE, "left")
    counted = joined.na.fill(0)
    n_words, n_images = F.col("word_count"), F.col("n_images")
    digital = F.col("n_chars") > 0
    empty = (n_words == 0) & (n_images == 0)
    coverage = F.least(F.lit(1.0), n_images / F.lit(V.PAGE_IMAGES))
    return counted.select(
        *PAGE,
        digital.alias("has_digital_text"),
        F.least(F.lit(1.0), n_words / F.lit(V.PAGE_WORDS)).alias("text_density"),
        coverage.alias("image_coverage"),
        empty.alias("is_empty"),
        (~digital & ~empty).alias("requires_ocr"),
        (F.col("n_tables") > 0).alias("is_table_heavy"),
        (F.col("n_columns") >= V.MIN_COLUMNS).alias("is_complex_layout"),
        (digital & (coverage >= V.MIXED_COVERAGE)).alias("is_mixed"),
        n_words.cast("int").alias("word_count"),
    )


def route_page(profile: DataFrame) -> DataFrame:
    """Extraction method of each page; the first matching rule wins."""
    method = (
        F.when(F.col("requires_ocr"), V.METHOD_OCR)
        .when(F.col("is_table_heavy"), V.METHOD_TABLES)
        .when(F.col("is_complex_layout") | F.col("is_mixed"), V.METHOD_HYBRID)
        .otherwise(V.METHOD_BLOCKS)
    )
    return profile.withColumn("method", method)


def document_profile(profile: DataFrame) -> DataFrame:
    """One row per document. Page lists stay relational, see ``profile_page_lists``."""
    return profile.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.bool_and(F.col("requires_ocr") | F.col("is_empty")).alias("is_scanned"),
        F.bool_or("is_mixed").alias("is_mixed"),
        F.bool_or("is_table_heavy").alias("has_tables"),
        F.bool_or("is_complex_layout").alias("has_complex_layout"),
        F.count_if("requires_ocr").alias("n_ocr_required"),
        F.count_if("is_table_heavy").alias("n_table_heavy"),
        F.count_if("is_empty").alias("n_empty"),
        F.avg("text_density").alias("average_text_density"),
        F.lit(V.PROFILE_CONFIDENCE).alias("confidence"),
    )


def profile_page_lists(profile: DataFrame) -> DataFrame:
    """The profile's page-number lists as rows: (document, list, page)."""
    lists = {"ocr_required_pages": "requires_ocr", "table_heavy_pages": "is_table_heavy", "empty_pages": "is_empty"}
    names = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(name)) for name, flag in lists.items()]))
    return profile.select("document_id", F.explode(names).alias("list_name"), "page_number")


# --- block rows -----------------------------------------------------------------------------


def line_blocks(lines: DataFrame, order: str = "line_no") -> DataFrame:
    return lines.select(
        *PAGE,
        "text",
        geometry.box(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom")).alias("bbox"),
        F.lit("pdfplumber").alias("source"),
        F.lit("paragraph").alias("block_type"),
        "font_size",
        F.col("bold").alias("is_bold"),
        F.lit(V.LINE_CONFIDENCE).alias("confidence"),
        F.col(order).cast("int").alias("reading_order"),
        F.lit(None).cast("int").alias("section_level"),
    )


def table_blocks(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Table rows follow the page's lines in reading order. Lines of other pages do not matter."""
    counts = lines.groupBy(*PAGE).agg(F.count(F.lit(1)).cast("int").alias("__lines"))
    return layout.rendered_tables(tables).join(counts, PAGE, "left").select(
        *PAGE,
        "text",
        geometry.box(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom")).alias("bbox"),
        F.lit("pdfplumber").alias("source"),
        F.lit("table").alias("block_type"),
        F.lit(None).cast("double").alias("font_size"),
        F.lit(False).alias("is_bold"),
        F.lit(V.TABLE_CONFIDENCE).alias("confidence"),
        (F.coalesce("__lines", F.lit(0)) + F.col("table_index")).cast("int").alias("reading_order"),
        F.lit(None).cast("int").alias("section_level"),
    )


def ocr_blocks(pages: DataFrame) -> DataFrame:
    """Placeholder rows for pages that need an OCR engine."""
    return pages.select(
        *PAGE,
        F.lit("").alias("text"),
        F.lit(None).cast(BOX_TYPE).alias("bbox"),
        F.lit("ocr").alias("source"),
        F.lit("unknown").alias("block_type"),
        F.lit(None).cast("double").alias("font_size"),
        F.lit(False).alias("is_bold"),
        F.lit(0.0).alias("confidence"),
        F.lit(0).alias("reading_order"),
        F.lit(None).cast("int").alias("section_level"),
    )


def item_blocks(items: DataFrame) -> DataFrame:
    """Blocks from assembled page items, the fallback for documents whose extraction failed."""
    return items.select(
        *PAGE,
        "text",
        geometry.box(F.col("left"), F.col("top"), F.col("right"), F.col("bottom")).alias("bbox"),
        F.lit("legacy_pdfplumber").alias("source"),
        labels.label_to_block_type(F.col("label")).alias("block_type"),
        F.lit(None).cast("double").alias("font_size"),
        F.lit(False).alias("is_bold"),
        F.lit(V.ITEM_CONFIDENCE).alias("confidence"),
        "reading_order",
        "section_level",
    )


def extract_pages(
    routed: DataFrame,
    lines: DataFrame,
    tables: DataFrame,
    *,
    line_order: str = "line_no",
    failed: DataFrame | None = None,
    dedupe_tables: bool = False,
) -> DataFrame:
    """Raw blocks of every page by its route; ``failed`` documents take the item path."""
    whole = routed
    if failed is not None:
        whole = routed.join(failed.select("document_id").distinct(), "document_id", "left_anti")
    readable = whole.where(F.col("method") != V.METHOD_OCR).select(*PAGE)
    page_lines = lines.join(readable, PAGE, "left_semi")
    page_tables = tables.join(readable, PAGE, "left_semi")
    kept = layout.lines_outside_tables(page_lines, page_tables) if dedupe_tables else page_lines
    blocks = (
        line_blocks(kept, line_order)
        .unionByName(table_blocks(page_tables, lines))
        .unionByName(ocr_blocks(whole.where(F.col("method") == V.METHOD_OCR)))
    )
    if failed is None:
        return blocks
    some = failed.select("document_id").distinct()
    # the lines of failed documents are read several times: written once
    own_lines, own_tables = (cut_lineage(df.join(some, "document_id", "left_semi")) for df in (lines, tables))
    items = layout.assemble_paragraphs(own_lines, own_tables, (line_order,))
    return blocks.unionByName(item_blocks(items))


def extraction_warnings(routed: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    ocr = routed.where(F.col("method") == V.METHOD_OCR).select(
        "document_id",
        F.format_string(V.OCR_WARNING, "page_number").alias("warning"),
    )
    if failed is None:
        return ocr
    fell_back = failed.select("document_id", F.lit(V.FALLBACK_WARNING).alias("warning")).distinct()
    return ocr.join(fell_back, "document_id", "left_anti").unionByName(fell_back)


# --- normalisation ------------------------------------------------------------------------------


def normalize_blocks(raw: DataFrame) -> DataFrame:
    """Trim, drop blank blocks of known type, fill defaults."""
    trimmed = raw.withColumn("text", text.strip(F.coalesce("text", F.lit(""))))
    kept = trimmed.where((F.col("text") != "") | F.coalesce(F.col("block_type") == "unknown", F.lit(False)))
    block_type = F.coalesce(F.nullif("block_type", F.lit("")), F.lit("paragraph"))
    return kept.withColumns(
        {
            "block_type": block_type,
            "source": F.coalesce("source", F.lit("unknown")),
            "confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)),
            "is_bold": F.coalesce("is_bold", F.lit(False)),
            "list_item": block_type == "list_item",
        }
    )


def _candidate() -> Column:
    return geometry.is_furniture_candidate(F.col("bbox.top"), F.col("bbox.bottom"), F.col("block_type"))


def _folded() -> Column:
    return text.collapse(F.lower("text"))


def repeated_block_texts(blocks: DataFrame) -> DataFrame:
    """Folded texts occurring at least twice among a document's furniture candidates."""
    folded = blocks.where(_candidate()).select("document_id", _folded().alias("folded"))
    counts = folded.where(F.col("folded") != "").groupBy("document_id", "folded").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n >= 2")


def remove_repeated_furniture(blocks: DataFrame) -> DataFrame:
    """Anti join of candidates against the repeated texts.

    Other blocks carry a false flag and their own place as key: they never match
    and spread evenly instead of meeting under one empty key.
    """
    repeated = repeated_block_texts(blocks).select("document_id", F.lit(True).alias("edge"), "folded")
    place = F.concat_ws("|", "page_number", "reading_order") if "reading_order" in blocks.columns else F.lit("")
    keyed = blocks.withColumns({"edge": _candidate(), "folded": F.when(_candidate(), _folded()).otherwise(place)})
    return keyed.join(repeated, ["document_id", "edge", "folded"], "left_anti").drop("edge", "folded")


def resolve_reading_order(blocks: DataFrame) -> DataFrame:
    """0-based position per document by page, top, left and old order."""
    placed = blocks.withColumns(
        {
            "__top": F.coalesce("bbox.top", F.lit(0.0)),
            "__left": F.coalesce("bbox.left", F.lit(0.0)),
            "__old": F.col("reading_order"),
        }
    ).drop("reading_order")
    order = ["page_number", "__top", "__left", "__old", "text"]
    numbered = prefix_scan(placed, ["document_id"], order, page_segment(), sums={"__n": F.lit(1)})
    return numbered.withColumn("reading_order", (F.col("__n") - 1).cast("int")).drop("__n", "__top", "__left", "__old")


def document_body_font(blocks: DataFrame) -> DataFrame:
    """Upper median font size per document, from counts of distinct sizes."""
    sizes = blocks.where(F.col("font_size") != 0).groupBy("document_id", "font_size").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = prefix_scan(
        sizes,
        ["document_id"],
        ["font_size"],
        F.floor("font_size"),
        sums={"upto": F.col("n")},
        totals={"total": F.col("n")},
    )
    middle = F.floor(F.col("total") / 2)
    return ranked.where(F.col("upto") > middle).groupBy("document_id").agg(
        F.min("font_size").alias("body_font_size")
    )


def detect_headings(blocks: DataFrame, gap: Column | None = None) -> DataFrame:
    """Mark headings by the layout score against the document's body font."""
    gap = F.lit(0.0) if gap is None else gap
    sized = blocks.join(document_body_font(blocks), "document_id", "left")
    level = text.heading_level(F.col("text"), F.col("font_size"), F.col("is_bold"), gap, F.col("body_font_size"))
    eligible = (F.col("block_type") != "table") & (F.col("text") != "")
    found = F.col("__level").isNotNull()
    return (
        sized.withColumn("__level", F.when(eligible, level))
        .withColumns(
            {
                "block_type": F.when(found, "heading").otherwise(F.col("block_type")),
                "section_level": F.coalesce("__level", "section_level"),
                "section_candidate": found,
            }
        )
        .drop("__level", "body_font_size")
    )


def detect_lists(blocks: DataFrame) -> DataFrame:
    """List markers win over every earlier type."""
    hit = text.is_list_item(F.col("text"))
    return blocks.withColumns(
        {
            "block_type": F.when(hit, "list_item").otherwise(F.col("block_type")),
            "list_item": F.col("list_item") | hit,
        }
    )


def assign_table_ids(blocks: DataFrame) -> DataFrame:
    """``table-{page}-{position}`` for tables without an id; position is the reading order."""
    given = F.col("table_id") if "table_id" in blocks.columns else F.lit(None).cast("string")
    made = F.format_string("table-%d-%d", "page_number", "reading_order")
    return blocks.withColumn("table_id", F.when(F.col("block_type") == "table", F.coalesce(given, made)).otherwise(given))


def normalize_extraction(blocks: DataFrame) -> DataFrame:
    """Furniture out, reading order, headings, lists, table ids, in this order."""
    blocks = cut_lineage(blocks)  # extracted once; furniture and order each read it twice
    ordered = cut_lineage(resolve_reading_order(remove_repeated_furniture(blocks)))
    return assign_table_ids(detect_lists(detect_headings(ordered)))


def extraction_quality(blocks: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """Block and warning counts, block sources and mean confidence per document."""
    by_source = blocks.groupBy("document_id", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(text.strip(F.col("text")) == "").alias("empty"),
        F.sum("confidence").alias("confidence"),
    )
    quality = by_source.groupBy("document_id").agg(
        F.sum("n").alias("block_count"),
        F.sum("empty").alias("empty_blocks"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("source_counts"),
        (F.sum("confidence") / F.sum("n")).alias("confidence"),
    )
    if warnings is None:
        return quality.withColumn("warning_count", F.lit(0).cast("bigint"))
    counts = warnings.groupBy("document_id").agg(F.count(F.lit(1)).alias("warning_count"))
    return quality.join(counts, "document_id", "left").withColumn(
        "warning_count", F.coalesce("warning_count", F.lit(0).cast("bigint"))
    )


def blocks_to_items(blocks: DataFrame) -> DataFrame:
    """Chunker items from blocks: unclassified types become plain text."""
    return blocks.select(
        *PAGE,
        "reading_order",
        labels.block_type_to_label(F.col("block_type")).alias("label"),
        "text",
        "section_level",
    )


def blocks_to_pages(blocks: DataFrame) -> DataFrame:
    """Chunker page text from the body blocks of each page."""
    body = blocks.where(F.col("block_type").isin(*V.BODY_BLOCK_TYPES) & (F.col("text") != ""))
    grouped = body.groupBy(*PAGE).agg(
        F.sort_array(F.collect_list(F.struct("reading_order", "text"))).alias("__texts")
    )
    return grouped.select(*PAGE, F.array_join(F.transform("__texts", lambda r: r["text"]), "\n\n").alias("text"))
