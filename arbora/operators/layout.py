"""Page layout: words to lines, lines to items. All windows stay inside one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V
from arbora.functions import geometry, text

PAGE = ["document_id", "page_number"]
BOX = ("x0", "top", "x1", "bottom")


# --- words to lines -------------------------------------------------------------------


def group_words_into_lines(words: DataFrame, tolerance: float = V.LINE_TOLERANCE) -> DataFrame:
    """Lines of each page from positioned words.

    Words are taken by (top, x0); a word joins the open line while its top lies
    within ``tolerance`` of the median top of that line.  Tops arrive in rising
    order, so the median is read from the middle of the line's slice and the
    running state is only the list of line starts.
    """
    placed = words.groupBy(*PAGE).agg(
        F.sort_array(F.collect_list(F.struct("top", "x0", "x1", "bottom", "text"))).alias("ws")
    ).withColumn("tops", F.transform("ws", lambda w: w["top"]))

    def middle(start: Column, size: Column) -> Column:
        low = F.element_at(F.col("tops"), (start + F.floor((size - 1) / 2) + 1).cast("int"))
        high = F.element_at(F.col("tops"), (start + F.floor(size / 2) + 1).cast("int"))
        return (low + high) / 2

    def step(starts: Column, i: Column) -> Column:
        start = F.element_at(starts, -1)
        near = F.abs(F.element_at(F.col("tops"), i + 1) - middle(start, i - start)) <= tolerance
        return F.when(near, starts).otherwise(F.array_append(starts, i))

    rest = F.when(F.size("ws") > 1, F.sequence(F.lit(1), F.size("ws") - 1)).otherwise(F.array().cast("array<int>"))
    started = placed.withColumn("starts", F.aggregate(rest, F.array(F.lit(0)), step))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("ws")))
    spans = F.zip_with("starts", ends, lambda s, e: F.slice(F.col("ws"), s + 1, e - s))
    lines = started.select(*PAGE, F.posexplode(spans).alias("line_no", "ws"))

    def each(name: str) -> Column:
        return F.transform("ws", lambda w: w[name])

    by_x = F.sort_array(F.transform("ws", lambda w: F.struct(w["x0"], w["top"], w["text"])))
    joined = F.array_join(F.transform(by_x, lambda w: w["text"]), " ")
    return lines.select(
        *PAGE,
        "line_no",
        text.clean_inline(joined).alias("text"),
        F.array_min(each("x0")).alias("x0"),
        F.array_min(each("top")).alias("top"),
        F.array_max(each("x1")).alias("x1"),
        F.array_max(each("bottom")).alias("bottom"),
    ).where(F.col("text") != "")


def gap_before(lines: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """White space above a line; null on the first line of a page."""
    above = F.lag("bottom").over(Window.partitionBy(*PAGE).orderBy(*order))
    gap = F.when(above.isNotNull(), F.greatest(F.lit(0.0), F.col("top") - above))
    return lines.withColumn("gap_before", gap)


def line_font_features(lines: DataFrame, chars: DataFrame, line_key: str = "line_no") -> DataFrame:
    """Median size and boldness of the glyphs under each line.

    Glyphs are streamed past the boxes of their page's lines, which are hashed, and are never sorted. Sizes are counted
    per line before the median, which then sees a row per distinct size.
    """
    heavy = F.lower(F.coalesce("fontname", F.lit(""))).rlike(V.BOLD_FONT)
    line_box = tuple(F.col(f"l.{n}") for n in BOX)
    char_box = tuple(F.col(f"c.{n}") for n in BOX)
    same_page = (F.col("l.document_id") == F.col("c.document_id")) & (F.col("l.page_number") == F.col("c.page_number"))
    touched = (
        chars.select(*PAGE, *BOX, "size", heavy.alias("heavy")).alias("c")
        .join(lines.select(*PAGE, line_key, *BOX).hint("shuffle_hash").alias("l"), same_page & geometry.boxes_overlap(line_box, char_box))
        .select(*[F.col(f"l.{k}").alias(k) for k in (*PAGE, line_key)], "c.size", "c.heavy")
    )
    sizes = touched.groupBy(*PAGE, line_key, "size").agg(F.count(F.lit(1)).alias("n"), F.max("heavy").alias("heavy"))
    features = sizes.groupBy(*PAGE, line_key).agg(
        F.percentile("size", F.lit(0.5), F.col("n")).alias("font_size"), F.max("heavy").alias("bold")
    )
    kept = [c for c in lines.columns if c not in ("font_size", "bold")]
    return lines.select(*kept).join(features, [*PAGE, line_key], "left").withColumn(
        "bold", F.coalesce("bold", F.lit(False))
    )


# --- tables -------------------------------------------------------------------------------


def _clean_cell(cell: Column) -> Column:
    return text.clean_inline(F.coalesce(cell, F.lit("")))


def render_table(rows: Column) -> Column:
    """Cells joined by bars, rows by newlines, rows without text dropped."""
    cleaned = F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.transform(r, _clean_cell))
    kept = F.filter(cleaned, lambda r: F.exists(r, lambda c: c != ""))
    return text.strip(F.array_join(F.transform(kept, lambda r: F.array_join(r, " | ")), "\n"))


def rendered_tables(tables: DataFrame) -> DataFrame:
    """Tables with their ``text``, those without any dropped. Exploded, since a plain filter would render each table twice."""
    shown = F.filter(F.array(render_table(F.col("rows"))), lambda t: t != "")
    return tables.select(*(c for c in tables.columns if c != "text"), F.explode(shown).alias("text"))


def table_cells(tables: DataFrame) -> DataFrame:
    """One row per non-empty cell with its grid position."""
    rows = tables.select(*PAGE, "table_index", F.posexplode("rows").alias("row_start", "row"))
    cells = rows.select(*PAGE, "table_index", "row_start", F.posexplode("row").alias("col_start", "text"))
    return cells.withColumn("text", _clean_cell(F.col("text"))).where(F.col("text") != "").select(
        *PAGE,
        "table_index",
        "text",
        "row_start",
        (F.col("row_start") + 1).alias("row_end"),
        "col_start",
        (F.col("col_start") + 1).alias("col_end"),
        F.lit(1).alias("row_span"),
        F.lit(1).alias("col_span"),
    )


def lines_outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Drop lines that mostly lie inside a table box."""
    left, right = lines.alias("l"), tables.select(*PAGE, *BOX).alias("t")
    line_box = tuple(F.col(f"l.{n}") for n in BOX)
    table_box = tuple(F.col(f"t.{n}") for n in BOX)
    inside = (
        (F.col("l.document_id") == F.col("t.document_id"))
        & (F.col("l.page_number") == F.col("t.page_number"))
        & geometry.boxes_overlap(line_box, table_box)
        & (geometry.vertical_share(line_box[1], line_box[3], table_box[1], table_box[3]) >= V.TABLE_OVERLAP)
    )
    return left.join(right, inside, "left_anti")


def order_page_events(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables and lines of a page in one order by (top, x0); tables first on ties."""
    kinds = rendered_tables(tables).withColumn("event", F.lit("table"))
    events = lines.withColumn("event", F.lit("line")).unionByName(
        kinds.select(*PAGE, "table_index", "event", "text", *BOX), allowMissingColumns=True
    )
    tie = F.when(F.col("event") == "table", F.lit(0)).otherwise(F.lit(1))
    within = F.coalesce(*[F.col(c) for c in ("table_index", "line_no", "line_index") if c in events.columns])
    order = Window.partitionBy(*PAGE).orderBy("top", "x0", tie, within)
    return events.withColumn("event_no", F.row_number().over(order) - 1)


# --- furniture -------------------------------------------------------------------------------


def repeated_furniture_keys(lines: DataFrame) -> DataFrame:
    """Edge-zone texts found on enough pages of a document. ``lines`` need ``height``."""
    zone = geometry.line_zone(F.col("top"), F.col("bottom"), F.col("height"))
    pages = lines.select(*PAGE).distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"))
    keyed = lines.where(zone.isNotNull()).select(*PAGE, text.furniture_key(F.col("text")).alias("furniture_key"))
    counts = (
        keyed.where(F.col("furniture_key") != "")
        .distinct()
        .groupBy("document_id", "furniture_key")
        .agg(F.count(F.lit(1)).alias("n_found"))
    )
    needed = F.greatest(F.lit(2.0), F.bround(F.col("n_pages") * F.lit(V.REPEAT_SHARE)))
    return counts.join(pages, "document_id").where((F.col("n_pages") >= 2) & (F.col("n_found") >= needed)).select(
        "document_id", "furniture_key", F.col("n_found").cast("bigint").alias("n_found")
    )


def classify_furniture(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """``furniture``: PAGE_HEADER or PAGE_FOOTER for repeated edge lines and page numbers."""
    zone = geometry.line_zone(F.col("top"), F.col("bottom"), F.col("height"))
    key = text.furniture_key(F.col("text"))
    # the repeated keys of a page come to its lines, so that the lines stay dealt by page
    edge = lines.where(zone.isNotNull()).select(*PAGE, key.alias("furniture_key")).distinct()
    known = edge.join(keys.select("document_id", "furniture_key"), ["document_id", "furniture_key"])
    matched = lines.join(known.groupBy(*PAGE).agg(F.collect_set("furniture_key").alias("__repeated")), PAGE, "left")
    repeated = F.when(zone.isNotNull() & F.col("__repeated").isNotNull(), F.array_contains("__repeated", key))
    hit = F.coalesce(repeated, F.lit(False)) | text.is_page_number(F.col("text"))
    return matched.withColumn("furniture", F.when(hit, zone)).drop("__repeated")


# --- paragraphs ---------------------------------------------------------------------------------


def page_layout_stats(lines: DataFrame) -> DataFrame:
    """Paragraph gap and body font size per page."""
    gap = F.coalesce(F.median("gap_before") * 1.8, F.lit(10.0))
    return lines.groupBy(*PAGE).agg(
        F.greatest(F.lit(8.0), gap).alias("paragraph_gap"),
        F.median(F.when(F.col("font_size") != 0, F.col("font_size"))).alias("body_font_size"),
    )


def assemble_paragraphs(lines: DataFrame, tables: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Structured items of every page.

    Table, furniture, heading and list lines stand alone; runs of plain lines
    merge until the spacing rules open a new paragraph.
    """
    spaced = gap_before(lines, order)
    stats = page_layout_stats(spaced)
    labelled = classify_furniture(spaced, repeated_furniture_keys(lines))
    events = order_page_events(lines_outside_tables(labelled, tables), tables).join(stats, PAGE, "left")
    level = text.heading_level(
        F.col("text"), F.col("font_size"), F.coalesce("bold", F.lit(False)), F.col("gap_before"), F.col("body_font_size")
    )
    kind = (
        F.when(F.col("event") == "table", "TABLE")
        .when(F.col("furniture").isNotNull(), F.col("furniture"))
        .when(F.col("__level").isNotNull(), "SECTION_HEADER")
        .when(text.is_list_item(F.col("text")), "LIST_ITEM")
        .otherwise("PARAGRAPH")
    )
    typed = events.withColumn("__level", level).withColumn("label", kind)
    page = Window.partitionBy(*PAGE).orderBy("event_no")
    continues = (
        (F.col("label") == "PARAGRAPH")
        & F.coalesce(F.lag("label").over(page) == "PARAGRAPH", F.lit(False))
        & ~geometry.starts_new_paragraph(
            F.col("gap_before"), F.col("x0"), F.lag("x0").over(page), F.lag("text").over(page), F.col("paragraph_gap")
        )
    )
    islands = typed.withColumn("__break", F.when(continues, 0).otherwise(1)).withColumn(
        "reading_order", (F.sum("__break").over(page) - 1).cast("int")
    )
    items = islands.groupBy(*PAGE, "reading_order").agg(
        F.first("label").alias("label"),
        F.sort_array(F.collect_list(F.struct("event_no", "text"))).alias("__lines"),
        F.max(F.when(F.col("label") == "SECTION_HEADER", F.col("__level"))).alias("section_level"),
        *geometry.merge_bboxes(),
    )
    texts = F.transform("__lines", lambda r: r["text"])
    body = F.when(F.col("label") == "PARAGRAPH", text.join_lines(texts)).otherwise(F.element_at(texts, 1))
    return items.select(
        *PAGE, "reading_order", "label", body.alias("text"), "section_level", "left", "top", "right", "bottom"
    )


# --- pages from items -----------------------------------------------------------------------------


def body_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("label").isin(*V.BODY_LABELS))


def component_counts(items: DataFrame) -> DataFrame:
    """Label counts of each page as a map."""
    counts = items.groupBy(*PAGE, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*PAGE).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("component_counts")
    )


def page_text(items: DataFrame) -> DataFrame:
    """Body texts of a page in reading order, separated by blank lines."""
    texts = body_items(items).where(F.col("text") != "").groupBy(*PAGE).agg(
        F.sort_array(F.collect_list(F.struct("reading_order", "text"))).alias("__texts")
    )
    return texts.select(*PAGE, text.strip(F.array_join(F.transform("__texts", lambda r: r["text"]), "\n\n")).alias("text"))


def project_pages(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """Page rows: text, number of items, component counts and page size. The items are read once."""
    shown = F.col("label").isin(*V.BODY_LABELS) & (F.col("text") != "")
    kinds = items.groupBy(*PAGE, "label").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.when(shown, F.struct("reading_order", "text"))).alias("__texts")
    )
    pages = kinds.groupBy(*PAGE).agg(
        F.sum("n").alias("n_items"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("component_counts"),
        F.sort_array(F.flatten(F.collect_list("__texts"))).alias("__texts"),
    )
    body = text.strip(F.array_join(F.transform("__texts", lambda r: r["text"]), "\n\n"))
    return sizes.select(*PAGE, "width", "height").join(pages.withColumn("text", body).drop("__texts"), PAGE, "left").withColumns(
        {"text": F.coalesce("text", F.lit("")), "n_items": F.coalesce("n_items", F.lit(0))}
    )


def drop_empty_pages(pages: DataFrame) -> DataFrame:
    return pages.where((F.length("text") > 0) | (F.col("n_items") > 0))
