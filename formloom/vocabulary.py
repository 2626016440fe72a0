"""Closed vocabularies and fixed values.

Fixed values: the strings, word lists, thresholds and patterns below are part of
the data contract (stored templates and reports carry them), so they are stated
here as plain text.
"""

from __future__ import annotations

# -- element types ---------------------------------------------------------

# -- classifications -------------------------------------------------------
CLASSIFICATIONS = (
    "FIXED", "DYNAMIC_TEXT", "DYNAMIC_DATE", "DYNAMIC_PERSON", "DYNAMIC_ENUM",
    "DYNAMIC_NUMBER", "DYNAMIC_IMAGE", "REPEATABLE_TABLE", "REPEATABLE_SECTION",
    "REPEATABLE_BLOCK", "AUTO_FIELD", "UNKNOWN",
)
DYNAMIC = (
    "DYNAMIC_TEXT", "DYNAMIC_DATE", "DYNAMIC_PERSON", "DYNAMIC_ENUM", "DYNAMIC_NUMBER",
)
REPEATABLE = ("REPEATABLE_TABLE", "REPEATABLE_SECTION", "REPEATABLE_BLOCK")
NEEDS_FIELD = DYNAMIC + REPEATABLE

# -- field types -----------------------------------------------------------
FIELD_TYPES = (
    "text", "multiline_text", "date", "person", "number", "enum", "table",
    "boolean", "image",
)
DEFAULT_FIELD_TYPE = {
    "DYNAMIC_TEXT": "text",
    "DYNAMIC_DATE": "date",
    "DYNAMIC_PERSON": "person",
    "DYNAMIC_ENUM": "enum",
    "DYNAMIC_NUMBER": "number",
    "DYNAMIC_IMAGE": "image",
    "REPEATABLE_TABLE": "table",
    "REPEATABLE_SECTION": "multiline_text",
    "REPEATABLE_BLOCK": "table",
}

# -- other closed lists ----------------------------------------------------
SEVERITIES = ("info", "warning", "error")

# -- value kinds: patterns ---------------------------------------------------
# (?U) gives \b \d \w \s their Unicode meaning.
MONTHS = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?"
DATE_DIGITS = r"(?U)\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b"
DATE_WORDS = (
    rf"(?iU)\b(?:{MONTHS}\s+\d{{1,2}},?\s+\d{{2,4}}|\d{{1,2}}\s+{MONTHS}\s+\d{{2,4}})\b"
)
CURRENCY = (
    r"(?iU)(?:[$€£¥₹]\s?\d[\d,]*(?:\.\d+)?)"
    r"|(?:\b\d[\d,]*(?:\.\d+)?\s?(?:USD|EUR|GBP|AED|SAR|INR)\b)"
)
PERCENT = r"(?U)\b\d+(?:\.\d+)?\s?%"
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
NUMBER = r"(?U)^[-+]?\d[\d,]*(?:\.\d+)?\z"
PERSON = r"(?U)^[A-Z][a-z]+(?:\s+(?:[A-Z]\.|[A-Z][a-z]+)){1,2}$"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"

# -- words -------------------------------------------------------------------
SLUG_STOPWORDS = ("the", "a", "an", "and", "or")
PERSON_LABEL_HINTS = (
    "by", "author", "prepared", "auditor", "manager", "owner",
    "contact", "approver", "reviewer", "officer", "lead", "signed",
)
NUMBER_HEADER_HINTS = (
    "qty", "quantity", "amount", "price", "total", "cost", "count", "rate", "no.",
)
DATE_HEADER_HINTS = ("date", "due")
STRUCTURAL_LABELS = (
    "table of contents", "contents", "revisions", "revision history", "tables",
    "figures", "appendices", "appendix", "references", "bibliography", "index",
    "glossary", "abbreviations", "definitions", "annexes", "annex",
    "list of tables", "list of figures", "table of figures", "document history",
)
STRUCTURAL_STYLE_HINTS = ("contents", "toc", "table of figures", "index")
GENERATED_STYLES = ("toc", "table of figures", "index ", "table of authorities")
FALSE_WORDS = ("", "false", "no", "0", "off")
KIND_SENTENCES = {
    "DYNAMIC_DATE": "A date value",
    "DYNAMIC_PERSON": "A person's name",
    "DYNAMIC_NUMBER": "A numeric value",
    "DYNAMIC_ENUM": "One of a fixed set of choices",
    "REPEATABLE_TABLE": "Repeating rows of data",
    "REPEATABLE_SECTION": "Repeating free-text content",
}
IMAGE_MEDIA_TYPES = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".bmp": "image/bmp",
    ".tiff": "image/tiff",
    ".emf": "image/x-emf",
    ".wmf": "image/x-wmf",
    ".svg": "image/svg+xml",
}

# -- marks kept in a classification's rationale ------------------------------
TAGS_ONLY_MARK = "[tags_only]"
STRUCTURAL_MARK = "[structural]"
GENERATED_MARK = "[generated]"
CRITIQUE_MARK = "[critique]"

# -- thresholds and limits ---------------------------------------------------
MULTILINE_CHARS = 120
FIXED_MATCH = 0.9
HEADER_MATCH = 0.8
LABEL_MATCH = 0.5
LABEL_SLUG_SCORE = 0.9
PROSE_MATCH = 0.34
NAME_MATCH = 0.86
SECTION_NAME_MATCH = 0.8
TABLE_HEADER_MATCH = 0.3
COLUMN_HEADER_MATCH = 0.5
STRUCTURAL_COVERAGE = 0.4
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
ZIP_MAX_ENTRIES = 2000
ZIP_MAX_BYTES = 200 * 1024 * 1024
CLASSIFY_BATCH = 20
CRITIQUE_LIMIT = 24
FEWSHOT_LIMIT = 8

# -- date formats ------------------------------------------------------------
# strptime spellings are what stored rules carry; DATE_PATTERNS gives the
# Spark pattern of each, and LOOSE_DATE_PATTERNS the free-form tail.
RULE_DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%B %d, %Y")
DATE_PATTERNS = {
    "%Y-%m-%d": "yyyy-M-d",
    "%d/%m/%Y": "d/M/yyyy",
    "%m/%d/%Y": "M/d/yyyy",
    "%B %d, %Y": "MMMM d, yyyy",
}
LOOSE_DATE_PATTERNS = (
    "yyyy/M/d", "yyyy.M.d", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy",
    "MMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy",
)

# -- model prices: USD per million tokens (input, output) --------------------
MODEL_PRICES = {
    "gemini-2.5-flash-lite": (0.10, 0.40),
    "gemini-2.5-flash": (0.30, 2.50),
    "gemini-2.5-pro": (1.25, 10.00),
    "gemini-2.0-flash": (0.10, 0.40),
    "gemini-3.1-flash-lite": (0.25, 1.50),
    "gemini-3-flash-preview": (0.50, 3.00),
    "gemini-3.5-flash": (1.50, 9.00),
    "gemini-3.1-pro-preview": (2.00, 12.00),
    "deepseek-v4-flash": (0.09, 0.18),
    "deepseek-chat": (0.14, 0.28),
    "deepseek-reasoner": (0.14, 0.28),
    "gpt-5-nano": (0.05, 0.40),
    "gpt-5-mini": (0.25, 2.00),
    "gpt-4.1-nano": (0.10, 0.40),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "claude-haiku-4-5": (1.00, 5.00),
    "claude-sonnet-4-6": (3.00, 15.00),
    "claude-opus-4-8": (15.00, 75.00),
    "glm-4.6": (0.43, 1.74),
    "glm-4.5": (0.30, 1.10),
}
