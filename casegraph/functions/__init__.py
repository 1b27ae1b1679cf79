from casegraph.functions.text import (
    extract_json,
    name_key,
    normalize_name,
    parse_date,
    suffix_number,
    trigram_similarity,
    trigrams,
    trim_unicode,
    truncate_text,
    words,
)

__all__ = [
    "extract_json",
    "name_key",
    "normalize_name",
    "parse_date",
    "suffix_number",
    "trigram_similarity",
    "trigrams",
    "trim_unicode",
    "truncate_text",
    "words",
]
