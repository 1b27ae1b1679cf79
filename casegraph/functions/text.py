"""Text functions as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, SparkSession, functions as F

# Latin letters whose plain form is not their Unicode decomposition.
SINGLE_LETTERS = {
    "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ħ": "H", "ħ": "h",
    "ı": "i", "Ł": "L", "ł": "l", "Ŧ": "T", "ŧ": "t",
}
MULTI_LETTERS = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "ẞ": "SS", "Þ": "TH", "þ": "th",
    "Ĳ": "IJ", "ĳ": "ij",
}
# The characters a Unicode-aware trim removes.
TRIM_CLASS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# Fixed value: what is appended to a text that was cut.
TRUNCATION_NOTE = "\n\n[TRUNCATED - document continues...]"


def _accented_letters() -> tuple[str, str]:
    source, target = [], []
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for code in block:
            letter = chr(code)
            base = unicodedata.normalize("NFD", letter)[0]
            if base != letter and base.isascii():
                source.append(letter)
                target.append(base)
    source.extend(SINGLE_LETTERS)
    target.extend(SINGLE_LETTERS.values())
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accented_letters()


def unaccent(c: Column) -> Column:
    """Plain-letter form of accented Latin text."""
    for letter, plain in MULTI_LETTERS.items():
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return F.translate(c, ACCENTED, PLAIN)


def normalize_name(c: Column) -> Column:
    """Unaccented, alphanumeric-and-space only, single-spaced, lower case; not trimmed."""
    bare = F.regexp_replace(unaccent(c), "[^a-zA-Z0-9 ]", "")
    return F.lower(F.regexp_replace(bare, r"\s+", " "))


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``normalize_name`` callable from SQL text in this session."""
    body = "x"
    for letter, plain in MULTI_LETTERS.items():
        body = f"replace({body}, '{letter}', '{plain}')"
    body = f"regexp_replace(translate({body}, '{ACCENTED}', '{PLAIN}'), '[^a-zA-Z0-9 ]', '')"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalize_name(x STRING) RETURNS STRING "
        f"RETURN lower(regexp_replace({body}, ' +', ' '))"
    )


def name_key(c: Column) -> Column:
    """Case-insensitive key of a name."""
    return F.lower(c)


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits, in text order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_set_key(c: Column) -> Column:
    """Distinct sorted words as one string: names with equal keys have equal trigram sets."""
    return F.array_join(F.array_sort(F.array_distinct(words(c))), " ")


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of the words, each word padded by two spaces before and one after."""
    per_word = F.transform(
        words(c),
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(per_word))


def trigram_list(text: str) -> list[str]:
    """Trigram set of one query literal, for comparing a whole column with it."""
    cleaned = "".join(ch if ch.isalnum() else " " for ch in text.lower())
    grams: dict[str, None] = {}
    for word in cleaned.split():
        padded = f"  {word} "
        for i in range(len(word) + 1):
            grams[padded[i : i + 3]] = None
    return list(grams)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two distinct-element arrays; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0))


def trigram_similarity(a: Column, b: Column | str) -> Column:
    """Trigram Jaccard similarity between a column and another column or a literal text."""
    other = F.array(*[F.lit(g) for g in trigram_list(b)]).cast("array<string>") if isinstance(b, str) else trigrams(b)
    return jaccard(trigrams(a), other)


def trim_unicode(c: Column) -> Column:
    """Trim every Unicode space, including the no-break space and the byte-order mark."""
    return F.regexp_replace(c, f"^{TRIM_CLASS}+|{TRIM_CLASS}+$", "")


def suffix_number(c: Column) -> Column:
    """The digits that end an identifier, as a number; null when there are none."""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("bigint")


def parse_date(c: Column) -> Column:
    """ISO date (a time part may follow); null when the text is not one."""
    return c.try_cast("date")


def truncate_text(c: Column, n: int = 100_000) -> Column:
    """The text, or its first ``n`` characters and a note when it is longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(TRUNCATION_NOTE))).otherwise(c)


def extract_json(c: Column, kind: str = "object") -> Column:
    """The widest ``{...}`` or ``[...]`` stretch in a text; null when there is none."""
    first, last = {"object": "{}", "array": "[]"}[kind]
    begin = F.instr(c, first)
    end = F.length(c) - F.length(F.substring_index(c, last, -1))  # place of the last one, 0 without one
    return F.when((begin > 0) & (end > begin), F.substring(c, begin, end - begin + 1))
