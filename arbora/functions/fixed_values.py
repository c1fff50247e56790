"""Word lists, patterns and limits that results depend on.

Patterns are in Java regex syntax; ``(?U)`` makes ``\\w \\b \\s \\d`` Unicode aware.
"""

# --- layout strategies ------------------------------------------------------
LAYOUT_STRATEGIES = ("ADVERSARIAL", "HIERARCHICAL", "TRANSACTIONAL")
DEFAULT_STRATEGY = "TRANSACTIONAL"
STRATEGY_LABELS = {
    "ADVERSARIAL": "Adversarial & Disputed Records",
    "HIERARCHICAL": "Statutory & Codified Frameworks",
    "TRANSACTIONAL": "Linear & Contractual Instruments",
}

# --- item labels and block types ---------------------------------------------
BODY_LABELS = ("SECTION_HEADER", "PARAGRAPH", "LIST_ITEM", "TABLE", "TEXT")
LABEL_TO_BLOCK_TYPE = {
    "SECTION_HEADER": "heading",
    "PARAGRAPH": "paragraph",
    "LIST_ITEM": "list_item",
    "TABLE": "table",
    "PAGE_HEADER": "header",
    "PAGE_FOOTER": "footer",
}
BLOCK_TYPE_TO_LABEL = {
    "heading": "SECTION_HEADER",
    "paragraph": "PARAGRAPH",
    "list_item": "LIST_ITEM",
    "table": "TABLE",
}
BODY_BLOCK_TYPES = ("paragraph", "heading", "list_item", "table")

# --- parties -------------------------------------------------------------------
# (party, keywords, optional lead-in, terms that open a paragraph)
PARTY_RULES = (
    (
        "CLAIMANT",
        ("claimant", "appellant", "petitioner", "applicant"),
        r"for\s+the\s+",
        ("claimant", "appellant", "petitioner", "applicant"),
    ),
    (
        "RESPONDENT",
        ("respondent", "defendant", "appellee", "opponent"),
        r"for\s+the\s+",
        ("respondent", "defendant", "appellee", "opponent"),
    ),
    (
        "TRIBUNAL",
        ("tribunal", "court", "bench", "arbitral", "arbitrator", "judge"),
        r"before\s+the\s+",
        ("tribunal", "court", "bench", r"arbitral\s+tribunal", "arbitrator", "judge"),
    ),
)
LEAD_BONUS = 3
NEUTRAL_PARTY = "NEUTRAL"

# --- heading, list and furniture patterns ------------------------------------------
SECTION_HEADING = r"(?iU)^(section|article|chapter|part|title)\s+[a-z0-9ivx().-]+[:.\- ]"
ROMAN_HEADING = r"(?U)^[IVXLC]+\.\s+\S+"
NUMERIC_HEADING = r"(?U)^(\d+(?:\.\d+){0,4})(?:[.)])?\s+"
PAREN_HEADING = r"(?iU)^\([a-z0-9ivxlc]+\)\s+\S+"
LIST_MARKER = (
    r"(?U)^\s*(?:[-*•]|(?:\d+|[a-zA-Z]|[ivxlcdmIVXLCDM]+)[.)]|\([a-zA-Z0-9ivxlcdmIVXLCDM]+\))\s+"
)
HEADING_WORD = r"[A-Za-z][A-Za-z0-9/&()'$.:-]*"
HEADING_VERBS = r"(?iU)\b(is|are|was|were|shall|must|may|should|will|can)\b"
SECTION_VERBS = r"(?iU)\b(is|are|was|were|shall|must|may|should)\b"
CHUNK_SECTION = r"(?iU)^(section|article|chapter|part|title)\s+[a-z0-9ivx().-]+[:.\- ]"
CHUNK_NUMERIC = r"(?U)^\d+(?:\.\d+){0,4}\s+[A-Za-z0-9$]"
CHUNK_ROMAN = r"(?U)^[IVXLC]+\.\s+[A-Z]"
CHUNK_PAREN = r"(?iU)^\([a-z0-9]+\)\s+[A-Z]"
NUMERIC_PREFIX = r"(?U)^(\d+(?:\.\d+){0,4})"
HEADING_MARKER = (
    r"(?iU)^(?:section|article|chapter|part|title)\s+[a-z0-9ivx().-]+[:.\- ]\s*"
    r"|^\d+(?:\.\d+){0,4}\s+|^[IVXLC]+\.\s+|^\([a-z0-9]+\)\s+"
)
HEADING_KEY = (
    r"(?iU)^((?:section|article|chapter|part|title)\s+[a-z0-9ivx().-]+"
    r"|\d+(?:\.\d+){0,4}|[IVXLC]+\.|\([a-z0-9]+\))"
)
PAGE_NUMBER = r"(?iU)^\s*(?:page\s*)?\d+(?:\s+of\s+\d+)?\s*$"
BOLD_FONT = r"bold|black|heavy|semibold|demi"

# --- limits -----------------------------------------------------------------------
HEADING_MAX_WORDS = 22
SECTION_MAX_WORDS = 18
HEADER_ZONE, FOOTER_ZONE = 0.10, 0.90
REPEAT_SHARE = 0.45
FURNITURE_TOP, FURNITURE_BOTTOM = 80, 720
TABLE_OVERLAP = 0.55
LINE_TOLERANCE = 3
TRANSACTIONAL_WINDOW = (400, 75)
ADVERSARIAL_WINDOW = (340, 40)
SECTION_SINGLE_CHUNK_WORDS = 650
SECTION_WINDOW = (500, 0)
TOKENS_PER_WORD = 1.33
MIN_SUMMARY_WORDS = 100
TINY_GROUP_WORDS = 200
SNIPPET_CHARS = 220
CITATION_CHARS = 280
CITATION_COUNT = 6
SUMMARY_MATCHES, LEAF_MATCHES = 6, 10
TREE_COMPRESSION = 4
TREE_MIN_NODES = 4
MAX_CLUSTER_LEVELS = 8
MAX_STRUCTURAL_LEVELS = 12
EMBED_BATCH_ITEMS, EMBED_BATCH_TOKENS = 15, 7000
PROVIDER_RETRIES = 5
UPLOAD_MAX_FILES = 10
UPLOAD_MAX_BYTES = 25 * 1024 * 1024
IVF_LISTS = 100
TITLE_CHARS = 72
MIN_TEXT_WORDS = 10

# --- catalogue and progress ----------------------------------------------------------
INGESTION_STATUSES = ("pending", "processing", "indexed", "failed")
TERMINAL_STATUSES = ("indexed", "failed")
STATUS_LABELS = {"indexed": "Ready", "processing": "Ingesting...", "failed": "Failed"}
DEFAULT_STATUS_LABEL = "Queued"
STAGES = (
    ("downloading_pdf", "download_complete", 10),
    ("extracting_pdf_structure", "extract_complete", 25),
    ("profiling_document", "profile_complete", 35),
    ("selecting_strategy", "strategy_selected", 40),
    ("chunking_document", "chunk_complete", 55),
    ("validating_chunks", "chunk_validation_complete", 60),
    ("embedding_chunks", "embed_complete", 72),
    ("building_tree", "tree_complete", 84),
    ("validating_tree", "validate_complete", 92),
    ("storing_nodes", "store_complete", 98),
)

# --- extraction -------------------------------------------------------------------------
METHOD_OCR, METHOD_TABLES, METHOD_HYBRID, METHOD_BLOCKS = "OCR", "PDFPLUMBER_TABLE_AWARE", "HYBRID", "PYMUPDF_BLOCKS"
LINE_CONFIDENCE, TABLE_CONFIDENCE, ITEM_CONFIDENCE, PROFILE_CONFIDENCE = 0.96, 0.94, 0.85, 0.9
PAGE_WORDS, PAGE_IMAGES, COLUMN_WIDTH, MIN_COLUMNS, MIXED_COVERAGE = 350.0, 8.0, 40, 3, 0.2

# --- messages -------------------------------------------------------------------------------
NO_TEXT_LAYER = "No readable text layer was found."
NO_BODY_TEXT = "No readable body text was found."
OCR_WARNING = "OCR required for page %d but no OCR engine is configured."
FALLBACK_WARNING = "Fell back to legacy PDF extractor."
NO_CHUNKS = "No chunks were produced."
NOT_EMBEDDED = "Embedding failed."
EMPTY_CHUNK = "Chunk %s is empty."
CHUNK_STRATEGY = "Chunk %s has mismatched layout_strategy."
NO_NODES = "No tree nodes were produced."
DUPLICATE_IDS = "Duplicate node IDs detected."
NO_LEAVES = "No leaf nodes were produced."
MISSING_PARENT = "Node %s references missing parent %s."
PAGE_RANGE = "Node %s has invalid page range."
NODE_STRATEGY = "Node %s has mismatched layout strategy."
NO_CLUSTERS = "No clusters were produced."
BAD_TARGET = "targetClusters must be a positive integer when provided."
BAD_STATUS = "Invalid ingestion status."
BAD_STRATEGY = "layoutStrategy must be ADVERSARIAL, HIERARCHICAL, or TRANSACTIONAL."
TOO_MANY_FILES = "Too many files."
FILE_TOO_LARGE = "File too large."
NO_CRYPTO = "Missing encryption metadata for %s."
NOT_FOUND = "Document not found."
NOT_INDEXED = "Document is not indexed yet."
NO_EMBEDDINGS = "Cluster preview requires leaf embeddings. Re-index this document and try again."
VIRTUAL_ROOT_TITLE = "Document Summary"
VIRTUAL_ROOT_TEXT = "Traceable summary tree for this document."
