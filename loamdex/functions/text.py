"""Scalar functions over text, identifiers and paths."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

# What makes a path a test or a compatibility shim.
TEST_PATH = (
    r"(?:^|[\\/])(?:tests?|__tests__|spec|testing)(?:[\\/]|$)|"
    r"test_[^\\/]*\.\w+$|[^\\/]*_test\.\w+$|[^\\/]*Tests?\.\w+$|[^\\/]*_spec\.\w+$"
)
COMPAT_PATH = r"(?:^|[\\/])(?:compat|_compat|legacy)(?:[\\/]|$)"
# A query that asks for tests, and one that has the syntax of an identifier.
TEST_QUERY = r"\b(test|tests|spec|specs)\b"
IDENTIFIER_QUERY = r"[_.:()]|[a-z][A-Z]|\b[A-Z]{2,}\b"
# File extension to language.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go",
    ".rs": "rust", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
}


def split_identifier(c: Column) -> Column:
    """Lower-case parts of an identifier, cut at ``_``, other non-word characters and lower-to-upper changes."""
    cut = F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.filter(F.split(cut, r"(?U)[_\W]+"), lambda t: t != "")


def identifier_parts(text: str) -> list[str]:
    """``split_identifier`` for a query string."""
    return [t for t in re.split(r"[_\W]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text).lower()) if t]


# Fixed value: signs that are no part of a search term.
QUERY_SIGNS = r'["*^~:()./\-_]'


def query_terms(query: str) -> list[str]:
    """Search terms of a query: its words and their identifier parts.

    Case variants stay apart, so ``Flask`` searches twice; the order is alphabetical.
    """
    words = re.sub(QUERY_SIGNS, " ", query).split()
    both = {*words, *(p for w in words for p in identifier_parts(w))}
    return sorted(t for t in (re.sub(r"[^a-zA-Z0-9]", "", w) for w in both if len(w) >= 2) if t)


def query_weights(query: str) -> tuple[float, float]:
    """Lexical and semantic weight: identifiers and short queries look up, sentences ask."""
    q = query.strip()
    return (0.6, 0.4) if re.search(IDENTIFIER_QUERY, q) or len(q.split()) <= 2 else (0.3, 0.7)


def lexical_weight(c: Column) -> Column:
    """``query_weights`` of a column of queries: the lexical weight; null stays null."""
    q = F.trim(c)
    return F.when(q.rlike(IDENTIFIER_QUERY) | (F.size(F.split(q, r"\s+")) <= 2), 0.6).when(c.isNotNull(), 0.3)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def occurrences(c: Column, term: str) -> Column:
    """How often the term stands in the text, without overlaps; case counts."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def language_of(path: Column) -> Column:
    """Language by extension, null for unknown ones."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def same_but_plural(a: Column, b: Column) -> Column:
    """Equal, or one is the other with a final s; words on ss are no plurals."""
    one = lambda x, y: F.endswith(x, F.lit("s")) & ~F.endswith(x, F.lit("ss")) & (F.expr("true") & (F.substr(x, F.lit(1), F.length(x) - 1) == y))
    return (a == b) | one(a, b) | one(b, a)


# ---------------------------------------------------------------- stemming

_VOWEL = set("aeiou")


def _consonant(w: str, i: int) -> bool:
    if w[i] == "y":
        return i == 0 or not _consonant(w, i - 1)
    return w[i] not in _VOWEL


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _short(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


# Suffixes of the published Porter algorithm, steps 2 to 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def porter(w: str) -> str:
    """Stem of a lower-case word by the Porter algorithm; words under three letters stay."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for pair in sorted(table.split(), key=len, reverse=True):
            end, new = pair.split(":")
            if w.endswith(end):
                w = w[: -len(end)] + new if _measure(w[: -len(end)]) else w
                break
    for end in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(ArrayType(StringType()))
def stemmed_tokens(c: pd.Series) -> pd.Series:
    """Tokens without diacritics, stemmed; null gives none."""
    seen: dict[str, str] = {}

    def one(text: str | None) -> list[str]:
        if text is None:
            return []
        plain = "".join(x for x in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(x))
        out = []
        for t in re.findall(r"[^\W_]+", plain):
            if t not in seen:
                seen[t] = porter(t)
            out.append(seen[t])
        return out

    return c.map(one)
