"""Text column expressions: repair, words, headings, list items, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V

SPACE = r"(?U)\s+"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace (SQL ``trim`` removes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE, " "))


def repair_text(text: Column) -> Column:
    """Unify line ends and rejoin words hyphenated across a line break."""
    unified = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(unified, r"(?U)(\w+)-\n(\w+)", "$1$2")


def clean_inline(text: Column) -> Column:
    return collapse(repair_text(text))


def join_lines(lines: Column) -> Column:
    """Paragraph text of an ordered array of lines."""
    joined = F.regexp_replace(repair_text(F.array_join(lines, "\n")), "\n", " ")
    return strip(F.regexp_replace(joined, r"[ \t]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(word_count(text) * F.lit(V.TOKENS_PER_WORD))).cast("int")


def first_non_blank_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    return F.try_element_at(lines, F.lit(1))


def shorten(text: Column, limit: int = V.TITLE_CHARS) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def title_from_content(text: Column) -> Column:
    line = first_non_blank_line(F.coalesce(text, F.lit("")))
    return F.when(line.isNull(), "Summary").otherwise(shorten(line))


def preview(text: Column) -> Column:
    compact = collapse(F.coalesce(text, F.lit("")))
    return F.when(compact == "", "No preview available.").otherwise(shorten(compact))


def snippet(text: Column, chars: int = V.SNIPPET_CHARS) -> Column:
    return F.substring(strip(F.coalesce(text, F.lit(""))), 1, chars)


def is_upper(text: Column) -> Column:
    """Has a cased letter and no lower-case one."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def heading_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(V.HEADING_WORD), F.lit(0))


def _share(text: Column, test) -> Column:
    found = heading_words(text)
    hits = F.size(F.filter(found, test))
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(hits.cast("double") / F.size(found))


def uppercase_ratio(text: Column) -> Column:
    return _share(text, lambda w: (F.length(w) > 1) & (F.upper(w) == w))


def titlecase_ratio(text: Column) -> Column:
    return _share(text, lambda w: F.substring(w, 1, 1).rlike("[A-Z]"))


def _depth(marker: Column) -> Column:
    return F.length(marker) - F.length(F.replace(marker, F.lit("."), F.lit(""))) + 1


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.?!]\z")


def heading_level_from_marker(text: Column) -> Column:
    compact = collapse(text)
    number = F.regexp_extract(compact, V.NUMERIC_HEADING, 1)
    return (
        F.when(compact.rlike(V.SECTION_HEADING) | compact.rlike(V.ROMAN_HEADING), F.lit(1))
        .when(number != "", _depth(number))
        .when(compact.rlike(V.PAREN_HEADING), F.lit(4))
    )


def heading_level(
    text: Column, font_size: Column, bold: Column, gap_before: Column, body_font_size: Column
) -> Column:
    """Score a layout line as a heading; null when it is not one."""
    line = strip(text)
    marker = heading_level_from_marker(line)
    all_caps = is_upper(line) & (F.size(heading_words(line)) >= 2)
    mostly_caps = (uppercase_ratio(line) >= 0.45) | (titlecase_ratio(line) >= 0.65)
    larger = (body_font_size != 0) & (font_size != 0) & (font_size >= body_font_size + 1)

    def point(condition: Column, weight: int = 1) -> Column:
        return F.when(condition, weight).otherwise(0)

    score = (
        point(marker.isNotNull(), 3)
        + F.when(all_caps, 2).when(mostly_caps, 1).otherwise(0)
        + point(bold)
        + point(larger)
        + point(gap_before >= 8)
        + point(~ends_sentence(line))
        - point(line.rlike(V.HEADING_VERBS))
    )
    return (
        F.when((line == "") | (word_count(line) > V.HEADING_MAX_WORDS), F.lit(None).cast("int"))
        .when(marker.isNotNull() & (score >= 3), marker)
        .when(score >= 5, F.lit(1))
    )


def is_list_item(text: Column) -> Column:
    return text.rlike(V.LIST_MARKER)


def furniture_key(text: Column) -> Column:
    """Lower-cased text with whole numbers as ``#`` and other symbols as blanks."""
    numbered = F.regexp_replace(F.lower(text), r"(?U)\b\d+\b", "#")
    return F.trim(F.regexp_replace(numbered, r"[^a-z0-9#]+", " "))


def is_page_number(text: Column) -> Column:
    return text.rlike(V.PAGE_NUMBER)


# --- headings on the chunking path ----------------------------------------------


def normalize_heading_candidate(text: Column) -> Column:
    """Undo two common scan errors after collapsing whitespace."""
    letters = F.regexp_replace(collapse(text), r"(?U)\b0(?=[A-Za-z])", "O")
    return F.replace(letters, F.lit("$"), F.lit("S"))


def looks_structural(text: Column) -> Column:
    body = strip(F.regexp_replace(text, V.HEADING_MARKER, ""))
    n_words = F.size(heading_words(body))
    plain = ~ends_sentence(body) & ~body.rlike(V.SECTION_VERBS) & (n_words <= 10)
    return (
        (body != "")
        & n_words.between(1, V.SECTION_MAX_WORDS)
        & (is_upper(body) | (titlecase_ratio(body) >= 0.5) | plain)
    )


def chunker_heading_level(component: Column, section_level: Column, text: Column) -> Column:
    """Heading level on the chunking path: trust labels first, then guarded patterns."""
    compact = normalize_heading_candidate(text)
    by_pattern = (
        F.when(compact.rlike(V.CHUNK_SECTION), F.lit(1))
        .when(compact.rlike(V.CHUNK_NUMERIC), _depth(F.regexp_extract(compact, V.NUMERIC_PREFIX, 1)))
        .when(compact.rlike(V.CHUNK_ROMAN), F.lit(1))
        .when(compact.rlike(V.CHUNK_PAREN), F.lit(4))
    )
    return (
        F.when((component == "SECTION_HEADER") & section_level.isNotNull(), section_level.cast("int"))
        .when(component == "TITLE", F.lit(1))
        .when(by_pattern.isNotNull() & looks_structural(compact), by_pattern)
    )


def heading_key(text: Column) -> Column:
    """Slug of a heading marker; null for headings without one."""
    marker = F.regexp_extract(text, V.HEADING_KEY, 1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(marker), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(marker != "", slug)


# --- text units -------------------------------------------------------------------


def paragraph_blocks(text: Column) -> Column:
    """Blank-line separated blocks of a page, or its lines when it has none."""
    raw = repair_text(F.coalesce(text, F.lit("")))
    blocks = F.filter(F.transform(F.split(raw, r"(?U)\n\s*\n"), collapse), lambda b: b != "")
    return blocks


def physical_lines(text: Column) -> Column:
    raw = repair_text(F.coalesce(text, F.lit("")))
    return F.filter(F.transform(F.split(raw, r"\r\n|[\n\x0b\x0c\x1c\x1d\x1e\x85  ]"), collapse), lambda b: b != "")


def sentences(text: Column) -> Column:
    """Sentence-like runs: text up to and including terminal punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"[^.?!]+[.?!]*"), F.lit(0))
    return F.filter(F.transform(found, collapse), lambda s: s != "")
