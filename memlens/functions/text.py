"""Text functions: query terms, analysers, stemming, tags, prompts and replies."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALNUM = r"[\p{IsAlphabetic}\p{N}]+"


def query_terms(query: Column) -> Column:
    """Terms of a search query: every other character separates."""
    return F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(ALNUM), F.lit(0))


def probe_text(text: Column) -> Column:
    """A memory's own text as a probe: punctuation vanishes without a space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{IsAlphabetic}\p{N}\s]", "")


def plain_tokens(text: Column) -> Column:
    """Unstemmed analyser: lower case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def judge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM), F.lit(0))


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


# -- stemming (Porter, 1980)

_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _shape(stem: str) -> str:
    """The stem as v and c, with y a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


# The suffix tables of the published algorithm, longest first within a step.
_STEP2 = (
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"),
    ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e"), ("logi", "log"), ("bli", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """Stem of a lower-case word; words under three letters or with other characters stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            stem = w[: -len(suffix)]
            if w.endswith(suffix) and "v" in _shape(stem):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix, new in table:
            if w.endswith(suffix):
                w = w[: -len(suffix)] + new if _measure(w[: -len(suffix)]) > 0 else w
                break
    for suffix in _STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(text: str) -> str:
    """Lower case without diacritics."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def analyze_text(text: str | None) -> list[str]:
    return [porter(t) for t in re.findall(r"[^\W_]+", fold(text or ""))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_words(words: pd.Series) -> pd.Series:
    """Terms of the words of each row: every distinct word of the batch is analysed once."""
    size = words.map(len).to_numpy()
    if not size.sum():
        return pd.Series([[] for _ in size], dtype=object)
    code, kinds = pd.factorize(np.concatenate(words.to_list()))
    terms = [analyze_text(w) for w in kinds]
    if all(len(t) == 1 for t in terms):
        flat = np.array([t[0] for t in terms], object)[code]
        return pd.Series(np.split(flat, np.cumsum(size)[:-1]))
    ends = np.cumsum(size)
    return pd.Series([[t for c in code[e - n : e] for t in terms[c]] for e, n in zip(ends, size)])


def stemmed_tokens(text: Column) -> Column:
    """Stemming analyser: fold case and diacritics, split at other characters, Porter stem. Texts are split in the JVM."""
    return _stem_words(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)))


# -- tags

def json_strings(raw: Column) -> Column:
    """A JSON array of strings as an array; null for anything else (an array with a number or null too)."""
    strict = raw.rlike(r'(?s)^\s*\[\s*("([^"\\\x00-\x1f]|\\.)*"\s*(,\s*"([^"\\\x00-\x1f]|\\.)*"\s*)*)?\]\s*$')
    return F.when(strict, F.from_json(raw, "array<string>"))


def normalize_tags(raw: Column) -> Column:
    """Canonical JSON array text of an encoded tag field, null if no tag is left.

    JSON items are kept as they are, comma-separated ones are trimmed; a text without commas is one tag.
    """
    blank = r"^\s*$"
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    listed = F.coalesce(json_strings(raw), F.transform(F.split(raw, ","), trim))
    kept = F.filter(listed, lambda t: ~t.rlike(blank))
    return F.when(F.size(kept) > 0, F.to_json(kept))


def tag_form(raw: Column) -> Column:
    """already_json, rewritten_csv or rewritten_naked; null for a null or empty field."""
    form = F.when(json_strings(raw).isNotNull(), "already_json").when(raw.contains(","), "rewritten_csv").otherwise("rewritten_naked")
    return F.when(raw.isNotNull() & (raw != ""), form)


def has_tags(raw: Column, required: list[str]) -> Column:
    """Whether the field carries all required tags, case aside; no requirement passes everything."""
    if not required:
        return F.lit(True)
    lower = F.transform(json_strings(raw), lambda t: F.lower(t))
    wanted = F.array(*[F.lit(t.lower()) for t in required])
    return F.coalesce(F.size(F.array_except(wanted, lower)) == 0, F.lit(False))


def split_csv(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ","), lambda t: F.trim(t)), lambda t: t != "")


# -- previews, prompts and replies

def preview(text: Column) -> Column:
    """Texts over 80 bytes become their first 77 characters and three dots."""
    return F.when(F.octet_length(text) > 80, F.concat(F.substring(text, 1, 77), F.lit("..."))).otherwise(text)


def strip_thinking(reply: Column) -> Column:
    return F.regexp_replace(F.substring_index(reply, "</think>", -1), r"^\s+|\s+$", "")


def merge_verdict(reply: Column) -> Column:
    """merge if the reply's first word is MERGE in any case, else keep."""
    first = F.split(F.regexp_replace(reply, r"^\s+", ""), r"\s+")[0]
    return F.when(F.upper(first) == "MERGE", "merge").otherwise("keep")


def audit_ids(raw: Column) -> Column:
    """Ids of an audit row: the JSON array, or the raw text as one id."""
    return F.coalesce(json_strings(raw), F.array(raw))
