"""Row shapes: fragments, words, findings, diagnostics, and the checked string domains."""

from __future__ import annotations

CONTEXT = "struct<source:string,attributes:map<string,string>>"
LOCATION = "struct<path:string,line:int,column:int,logical:string>"
SEGMENT = "struct<out:int,orig:int,len:int>"
OFFSETS = f"array<{SEGMENT}>"
SPAN = "struct<start:int,text:string>"

FRAGMENT = f"fragment_id string, text string, original_text string, language string, context {CONTEXT}, location {LOCATION}, offsets {OFFSETS}, mode string"
DIAGNOSTIC = f"code string, message string, location {LOCATION}"
DICTIONARY = "word string, language string, pos long, source string"
BASELINE = "fingerprint string, word string, type string, language string, context map<string,string>, seen_at string"

MODES = ("prose", "identifier", "docblock")
FINDING_TYPES = ("spelling", "case")
SEVERITIES = ("error", "warning")
DIAGNOSTIC_CODES = (
    "skipped_file", "encoding", "parse_error", "icu_syntax", "missing_dictionary", "unsupported_language", "backend_fallback", "missing_locales", "unparsable_filename", "fatal",
)
FATAL = ("fatal",)

KINDS = ("class_like", "method", "function", "property", "parameter", "constant", "variable", "namespace", "docblock", "comment", "string_literal")
DEFAULT_KINDS = tuple(k for k in KINDS if k not in ("variable", "namespace", "string_literal"))


def kinds_from_names(names: list[str]) -> tuple[str, ...]:
    """Known kinds among names; others are ignored."""
    return tuple(k for k in KINDS if k in names)


def mode_of_kind(kind: str) -> str:
    return {"docblock": "docblock", "comment": "docblock", "string_literal": "prose"}.get(kind, "identifier")
