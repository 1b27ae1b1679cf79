"""English stems (the published Porter2 rules), computed once per distinct term."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

# Workers receive these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the published rules.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous",
    "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al",
    "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able",
    "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble",
    "ogi": "og", "li": "",
}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "",
    "ical": "ic", "ness": "", "ful": "",
}
STEP_4 = (
    "ement able ance ence ible ment ant ate ent ion ism iti ive ize ous al er ic".split()
)
VOWEL = "[aeiouy]"
OTHER = "[^aeiouy]"
SHORT_END = re.compile(f"(?:{OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$")
REGION = re.compile(f"{VOWEL}{OTHER}")


def _region(word: str, start: int) -> int:
    found = REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)


def _step_1b(word: str, r1: int) -> str:
    end = _ending(word, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if end in ("eed", "eedly"):
        return word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    if end is None or not re.search(VOWEL, word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
        return word[:-1]
    return word + "e" if r1 >= len(word) and SHORT_END.search(word) else word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(f"^y|(?<={VOWEL})y", "Y", word)
    prefix = re.match("gener|commun|arsen", word)
    r1 = prefix.end() if prefix else _region(word, 0)
    r2 = _region(word, r1)

    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and re.search(VOWEL, word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_PLURAL:
        return word

    word = _step_1b(word, r1)
    if re.search(f".{OTHER}[yY]$", word):
        word = word[:-1] + "i"

    end = _ending(word, STEP_2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        fits = {"ogi": before.endswith("l"), "li": before.endswith(tuple("cdeghkmnrt"))}
        if fits.get(end, True):
            word = before + STEP_2[end]
    end = _ending(word, STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    end = _ending(word, STEP_4)
    if end and len(word) - len(end) >= r2:
        before = word[: -len(end)]
        if end != "ion" or before.endswith(("s", "t")):
            word = before
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(T.StringType())
def _stems(terms: pd.Series) -> pd.Series:
    return terms.map(stem)


def stem_terms(terms: DataFrame) -> DataFrame:
    """(term, stem) for a table of distinct terms."""
    return terms.select("term", _stems("term").alias("stem"))
