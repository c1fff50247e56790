"""SQL text for the twins: the same rules as the column functions, in DuckDB's dialect."""

from __future__ import annotations

W = r"[\p{L}\p{M}\p{N}_]"
NW = r"[^\p{L}\p{M}\p{N}_]"
HEADING_WORD = r"[A-Za-z][A-Za-z0-9/&()''$.:-]*"


def words(t: str) -> str:
    return rf"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"


def n_words(t: str) -> str:
    return f"len({words(t)})"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def collapse(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def repair(t: str) -> str:
    unified = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return rf"regexp_replace({unified}, '({W}+)-\n({W}+)', '\1\2', 'g')"


def has_word(t: str, alternatives: str) -> str:
    return f"regexp_matches({t}, '(?i)(^|{NW})({alternatives})($|{NW})')"


def found(t: str) -> str:
    return f"regexp_extract_all({t}, '{HEADING_WORD}')"


def upper_ratio(t: str) -> str:
    return (
        f"CASE WHEN len({found(t)}) = 0 THEN CAST(0 AS DOUBLE) ELSE "
        f"CAST(len(list_filter({found(t)}, lambda w: len(w) > 1 AND upper(w) = w)) AS DOUBLE) / len({found(t)}) END"
    )


def title_ratio(t: str) -> str:
    return (
        f"CASE WHEN len({found(t)}) = 0 THEN CAST(0 AS DOUBLE) ELSE "
        f"CAST(len(list_filter({found(t)}, lambda w: regexp_matches(w, '^[A-Z]'))) AS DOUBLE) / len({found(t)}) END"
    )


def dots(m: str) -> str:
    return f"len({m}) - len(replace({m}, '.', '')) + 1"


def marker_level(t: str) -> str:
    num = rf"regexp_extract({t}, '^(\d+(?:\.\d+){{0,4}})(?:[.)])?\s+', 1)"
    return (
        rf"CASE WHEN regexp_matches({t}, '(?i)^(section|article|chapter|part|title)\s+[a-z0-9ivx().-]+[:.\- ]') "
        rf"OR regexp_matches({t}, '^[IVXLC]+\.\s+\S+') THEN 1 WHEN {num} <> '' THEN {dots(num)} "
        rf"WHEN regexp_matches({t}, '(?i)^\([a-z0-9ivxlc]+\)\s+\S+') THEN 4 END"
    )


def heading_level(t: str, font: str, bold: str, gap: str, body: str) -> str:
    """Expects ``t`` already stripped; evaluate over a subquery that names it."""
    m = f"({marker_level(collapse(t))})"
    caps = f"(upper({t}) = {t} AND lower({t}) <> {t} AND len({found(t)}) >= 2)"
    score = f"""(CASE WHEN {m} IS NOT NULL THEN 3 ELSE 0 END
      + CASE WHEN {caps} THEN 2 WHEN {upper_ratio(t)} >= 0.45 OR {title_ratio(t)} >= 0.65 THEN 1 ELSE 0 END
      + CASE WHEN {bold} THEN 1 ELSE 0 END
      + CASE WHEN {body} <> 0 AND {font} <> 0 AND {font} >= {body} + 1 THEN 1 ELSE 0 END
      + CASE WHEN {gap} >= 8 THEN 1 ELSE 0 END
      + CASE WHEN NOT regexp_matches({t}, '[.?!]$') THEN 1 ELSE 0 END
      - CASE WHEN {has_word(t, 'is|are|was|were|shall|must|may|should|will|can')} THEN 1 ELSE 0 END)"""
    return f"""CASE WHEN {t} = '' OR {n_words(t)} > 22 THEN NULL WHEN {m} IS NOT NULL AND {score} >= 3 THEN {m}
      WHEN {score} >= 5 THEN 1 END"""


LIST_ITEM = r"'^\s*(?:[-*•]|(?:\d+|[a-zA-Z]|[ivxlcdmIVXLCDM]+)[.)]|\([a-zA-Z0-9ivxlcdmIVXLCDM]+\))\s+'"


def furniture_key(t: str) -> str:
    # \b around digits: RE2 words are ASCII, so spell the boundary out twice to catch neighbours
    once = rf"regexp_replace(lower({t}), '(^|{NW})\d+($|{NW})', '\1#\2', 'g')"
    twice = rf"regexp_replace({once}, '(^|{NW})\d+($|{NW})', '\1#\2', 'g')"
    return rf"trim(regexp_replace({twice}, '[^a-z0-9#]+', ' ', 'g'))"


PAGE_NUMBER = r"'(?i)^\s*(?:page\s*)?\d+(?:\s+of\s+\d+)?\s*$'"


def candidate(t: str) -> str:
    return rf"replace(regexp_replace({collapse(t)}, '(^|{NW})0([A-Za-z])', '\1O\2', 'g'), '$', 'S')"


def structural(t: str) -> str:
    body = (
        rf"trim(regexp_replace({t}, '(?i)^(?:section|article|chapter|part|title)\s+[a-z0-9ivx().-]+[:.\- ]\s*"
        rf"|^\d+(?:\.\d+){{0,4}}\s+|^[IVXLC]+\.\s+|^\([a-z0-9]+\)\s+', ''))"
    )
    plain = (
        f"(NOT regexp_matches({body}, '[.?!]$') AND NOT {has_word(body, 'is|are|was|were|shall|must|may|should')} "
        f"AND len({found(body)}) <= 10)"
    )
    return (
        f"({body} <> '' AND len({found(body)}) BETWEEN 1 AND 18 AND ((upper({body}) = {body} AND lower({body}) <> {body}) "
        f"OR {title_ratio(body)} >= 0.5 OR {plain}))"
    )


def chunker_level(t: str) -> str:
    """Pattern part of the chunker's heading level over an already normalised candidate."""
    num = rf"regexp_extract({t}, '^(\d+(?:\.\d+){{0,4}})', 1)"
    return (
        rf"CASE WHEN NOT {structural(t)} THEN NULL "
        rf"WHEN regexp_matches({t}, '(?i)^(section|article|chapter|part|title)\s+[a-z0-9ivx().-]+[:.\- ]') THEN 1 "
        rf"WHEN regexp_matches({t}, '^\d+(?:\.\d+){{0,4}}\s+[A-Za-z0-9$]') THEN {dots(num)} "
        rf"WHEN regexp_matches({t}, '^[IVXLC]+\.\s+[A-Z]') THEN 1 "
        rf"WHEN regexp_matches({t}, '(?i)^\([a-z0-9]+\)\s+[A-Z]') THEN 4 END"
    )


def heading_key(t: str) -> str:
    m = (
        rf"regexp_extract({t}, '(?i)^((?:section|article|chapter|part|title)\s+[a-z0-9ivx().-]+"
        rf"|\d+(?:\.\d+){{0,4}}|[IVXLC]+\.|\([a-z0-9]+\))', 1)"
    )
    return f"CASE WHEN {m} <> '' THEN trim(regexp_replace(lower({m}), '[^a-z0-9]+', '-', 'g'), '-') END"


def party_score(t: str, keywords: tuple[str, ...]) -> str:
    hits = " + ".join(f"CASE WHEN {has_word(f'lower({t})', k)} THEN 1 ELSE 0 END" for k in keywords)
    lead = rf"regexp_matches({t}, '(?i)^\s*(?:for\s+the\s+)?(?:{'|'.join(keywords)})($|{NW})')"
    return f"({hits} + CASE WHEN {lead} THEN 3 ELSE 0 END)"


PARTY_SCORES = {
    "CLAIMANT": lambda t: party_score(t, ("the", "and")),
    "RESPONDENT": lambda t: party_score(t, ("of", "to")),
    "TRIBUNAL": lambda t: party_score(t, ("in", "is")),
}


def first_line(t: str) -> str:
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')[1]"


def title(t: str) -> str:
    line = first_line(t)
    return f"CASE WHEN {line} IS NULL THEN 'Summary' WHEN len({line}) > 72 THEN left({line}, 69) || '...' ELSE {line} END"


def page_range(a: str, b: str) -> str:
    return (
        f"CASE WHEN nullif({a},0) IS NULL AND nullif({b},0) IS NULL THEN 'Pages unavailable' "
        f"WHEN nullif({a},0) <> nullif({b},0) THEN 'Pages ' || {a} || '-' || {b} "
        f"ELSE 'Page ' || coalesce(nullif({a},0), nullif({b},0)) END"
    )
