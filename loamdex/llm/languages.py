"""Languages of documents and of their parts, by rank-order n-gram profiles.

A text is reduced to its sentences: listings, headings, markup, identifiers and
numbers have no language. The most frequent n-grams of a sentence, in rank
order, are compared to the profile of each language by the out-of-place
distance; the nearest profile wins and the lead over the next one gives the
confidence. Neighbouring sentences of one language form a segment.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loamdex.session import Stages

#: n-grams of 1 to LONGEST characters; the first PROFILE of a language and the first OWN of a sentence count.
LONGEST, PROFILE, OWN = 4, 6000, 300
#: Bits for the number of an n-gram among all profiles, enough for 170 languages.
KEY_BITS = 20
#: Sentences whose n-grams are held at a time, and distinct ones whose distances a task remembers before it starts afresh.
TOGETHER, REMEMBERED = 500, 200_000
#: Labelled documents per language that the profiles are fitted on, at most.
TRAINING_DOCS = 300
#: A sentence needs this lead over the second language to bring a language into a document of its own.
SURE = 0.02
#: A labelled sentence is left out of the fit if its label's distance exceeds the least by this part.
FOREIGN = 0.15
#: Letters a sentence needs at least; scripts without spaces say as much with fewer.
LETTERS, LETTERS_WIDE = 10, 4
#: Further spellings of the languages' names.
MORE_NAMES = {"jp": "ja", "castellano": "es", "castilian": "es", "flemish": "nl", "vlaams": "nl", "brazilian": "pt"}

#: Fenced listings, strings in triple quotes and block comments that begin a line and are closed,
#: line comments, indented listings, headings and rules; of other lines the quote and list marks.
_STRUCTURE = (
    r"(?m)^[ \t>]*+(```|~~~)(?s:.*?)(?:\n[ \t>]*+\1[^\n]*+|\z)|^[ \t]*+(?:[rRuUbBfF]{0,2}+(\"\"\"|''')(?s:.*?)\2|/\*(?s:.*?)\*/(?![\w*.`]))"
    r"|^(?:[ \t]*+//.*+|(?: {4}|\t)[ \t]*+(?![-*+•>]|\d{1,3}[.)]).++$|[ \t]*+(?:#{1,6}[ \t].*+|=+.*=+[ \t]*|[-=~*_]{3,}[ \t]*+)$"
    r"|[ \t]*+(?:>[ \t]*+)*+(?:(?:[-*+•]|\d{1,3}[.)])[ \t]++)?+)"
)
#: Inline code, marks of tokenizers, links, invisible characters, identifiers, paths, calls and
#: numbers; a line end inside a sentence. Possessive and chosen by the first character, so that a
#: word is looked at once.
_PATH = r"(?:[/.\\]++[A-Za-z0-9_]++)"
_NAME = (
    r"[`<\[​-‏‪-‮⁠﻿](?:(?<=`)[^`\n]*+`|(?<=<)\|[^|>\n]*+\|>|(?<=\[)[A-Z]++\]|(?<![`<\[]))"
    rf"|(?<![A-Za-z0-9])_?(?:[a-z]++(?:[A-Z0-9_][A-Za-z0-9_]*+{_PATH}*+(?:\(\))?|{_PATH}++(?:\(\))?|\(\)|(?<=https?)://\S++)"
    r"|[A-Z][A-Za-z0-9]*+(?:(?:[_/.\\]++[A-Za-z0-9]++)++(?:\(\))?|\(\))|[0-9]++)"
    r"|\n(?<=[\p{L},;]\n)[ \t]*+(?=\p{Ll})"
)
_CODE_SIGNS = r"[{}();=<>\[\]]|:\s*$"
_STOP = (".", "!", "?", "…", "。", "！", "？")
_CLOSE = ('"', "'", "»", "”", "’", ")", "]")


def _lines(text: Column) -> tuple[Column, Callable[[Column], Column]]:
    """Lines of at most one sentence each, without what has no language, and whether such a line is a whole sentence."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.contains("\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, _STRUCTURE, ""), _NAME, " ")
    t = F.regexp_replace(t, r"([.!?…][\"'»”’)\]]*+)\s++|([。！？])", "$1$2\n")

    def whole(s: Column) -> Column:
        last = F.substring(F.rtrim(s), -1, 1)
        return last.isin(*_STOP) | (last.isin(*_CLOSE) & s.rlike(r"[.!?…。！？][\"'»”’)\]]++\s*+$"))

    return F.split(t, "\n"), whole


def sentences(text: Column) -> Column:
    """Whole sentences of a text in order, without what has no language. Null gives none."""
    lines, whole = _lines(text)
    return F.filter(lines, whole)


def _units(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with ``s``, the whole sentences of a text or, where it has none, its lines with letters and without the signs of code, and ``whole``.

    Step by step, so that Spark works each column out once.
    """
    lines, whole = _lines(text)
    rest = lambda x: x.rlike(r"\p{L}") & ~x.rlike(_CODE_SIGNS)
    found = rows.withColumn("__lines", lines).withColumn("__found", F.filter("__lines", whole))
    return found.select(*rows.columns, F.when(F.size("__found") > 0, F.col("__found")).otherwise(F.filter("__lines", rest)).alias("s"), (F.size("__found") > 0).alias("whole"))


def label_names(codes: DataFrame) -> dict[str, str]:
    """Lower-case spelling to lang, from the (fixed, small) table of languages."""
    names = dict(MORE_NAMES)
    for r in codes.select("lang", "english_name", "native_name", "aliases").collect():
        for n in (r["lang"], r["english_name"], r["native_name"], *(r["aliases"] or [])):
            if n:
                names[n.strip().lower()] = r["lang"]
    return names


def named_language(label: Column, names: dict[str, str]) -> Column:
    """The language that a label names in any spelling, with or without a country; null if none.

    The whole label is looked up first, then its words from the left.
    """
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    clean = F.lower(F.trim(label))
    words = F.split(clean, r"[^\p{L}]+")
    hit = F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(table, clean), F.try_element_at(hit, F.lit(1)))


_NO_LETTER = re.compile(r"[^\w\s']|[\d_]")
_ASCII = {i: " " for i in range(128) if not chr(i).isalpha() and chr(i) != "'"}


def _clean(s: str) -> str:
    if "Ã" in s or "Â" in s or "Ð" in s or "ã" in s:
        try:  # UTF-8 that was read as Latin-1
            s = s.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    if s.isascii():
        s = s.lower().translate(_ASCII)
    else:
        s = _NO_LETTER.sub(" ", unicodedata.normalize("NFKC", s).lower())
    return f" {' '.join(s.split())} "


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of each n-gram of the cleaned texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    who, what = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
        one = owner[:m] == owner[n - 1 :]
        if n == 1:
            one &= codes[:m] != 32
        who.append(owner[:m][one])
        what.append(h[one])
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(who), np.concatenate(what)


class Profiles:
    """Rank of every n-gram in every language's profile."""

    def __init__(self, ranked: dict[str, np.ndarray]):
        self.langs = sorted(ranked)
        self.keys = np.unique(np.concatenate([ranked[x] for x in self.langs]))
        if len(self.keys) >= 1 << KEY_BITS:
            raise ValueError(f"{len(self.keys)} n-grams in all profiles, {1 << KEY_BITS} are one too many")
        self.rank = np.full((len(self.langs), len(self.keys)), PROFILE, np.int32)
        for i, x in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.keys, ranked[x])] = np.arange(len(ranked[x]))
        # By the first bits of its hash each key is found at once; where two share them, one is searched for.
        self.slot = np.zeros(1 << 21, np.int32)
        self.slot[self._slot(self.keys)] = np.arange(len(self.keys))
        self.hidden = self.keys[self.keys[self.slot[self._slot(self.keys)]] != self.keys]

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(43)).astype(np.int64)

    def _find(self, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each n-gram among the keys, and whether it is one."""
        at = self.slot[self._slot(what)].astype(np.int64)
        known = self.keys[at] == what
        if len(self.hidden):
            other = np.flatnonzero(~known)
            other = other[np.isin(what[other], self.hidden)]
            at[other] = np.searchsorted(self.keys, what[other])
            known[other] = True
        return at, known

    def distances(self, texts: list[str]) -> np.ndarray:
        """Mean out-of-place distance of each cleaned text to each language, 0 to 1.

        n-grams that no profile has are as far from every language and are left out.
        """
        parts = [self._distances(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER)]
        return np.concatenate(parts) if parts else np.ones((0, len(self.langs)))

    def _distances(self, texts: list[str]) -> np.ndarray:
        out = np.ones((len(texts), len(self.langs)))
        who, what = grams(texts)
        at, known = self._find(what)
        pair, count = np.unique(who[known] << KEY_BITS | at[known], return_counts=True)
        if not len(pair):
            return out
        # In the order of a text's most frequent n-grams; the count is below 2^15 or as good as that.
        often = 32767 - np.minimum(count, 32767)
        keys = (1 << KEY_BITS) - 1
        pair = np.sort((pair >> KEY_BITS) << KEY_BITS + 15 | often << KEY_BITS | pair & keys)
        who, at = pair >> KEY_BITS + 15, pair & keys
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.concatenate([first, [len(who)]])))
        own = rank < OWN
        who, at, rank = who[own], at[own], rank[own].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        size = np.diff(np.concatenate([first, [len(who)]]))
        for i, ranks in enumerate(self.rank):
            place = ranks[at]
            far = np.where(place < PROFILE, np.abs(place - rank), PROFILE)
            out[who[first], i] = np.add.reduceat(far, first) / size / PROFILE
        return out


def _best(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest language and its lead over the second, of each row of distances."""
    if d.shape[1] < 2:
        return np.zeros(len(d), np.int64), np.ones(len(d))
    two = np.partition(d, 1, axis=1)
    return d.argmin(axis=1), (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-9)


def _enough(s: str) -> bool:
    n = len(s) - s.count(" ")
    return n >= LETTERS or n >= LETTERS_WIDE and any(ord(c) > 0x2E80 for c in s)


def _ranked(counts: DataFrame) -> dict[str, np.ndarray]:
    """Profiles from ``lang, gram, n``: PROFILE rows per language reach the driver."""
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", rank).where(F.col("rank") <= PROFILE)
    rows = top.orderBy("lang", "rank").toPandas()
    return {x: g["gram"].to_numpy().astype(np.int64).view(np.uint64) for x, g in rows.groupby("lang")}


def train(documents: DataFrame, codes: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Profiles:
    """Profiles of the languages in ``codes``, fitted on ``TRAINING_DOCS`` labelled documents of each at most.

    Labels can be wrong and texts mixed. The first profiles take every sentence
    at its label, where what is wrong is spread thin; the second ones leave out
    the sentences that are clearly nearer to another language's first profile.
    The samples in ``codes`` count always. A sentence that occurs n times counts
    as the root of n, so that set phrases neither vanish nor rule. Each also
    counts without its accents, as accents get lost.
    """
    names = label_names(codes)
    lang = named_language(F.col(label), names)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64(key), key))
    chosen = documents.select(key, lang.alias("lang")).where(F.col("lang").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= TRAINING_DOCS)
    docs = documents.select(key, text).join(F.broadcast(chosen.drop("rank")), key)  # TRAINING_DOCS rows per language at most
    parts = docs.select("lang", F.explode(sentences(F.col(text))).alias("s")).groupBy("lang", "s").count()
    parts = Stages(documents.sparkSession, "languages").save(parts)
    seeds = codes.select("lang", F.explode(F.split("sample", r"(?<=[.!?。！？])\s*")).alias("s"), F.lit(1).cast("long").alias("count"))

    def count(agree: Profiles | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for x, g in b.groupby("lang"):
                    texts = g["s"].map(_clean)
                    fits = texts.map(_enough).to_numpy()
                    if agree and len(texts):
                        far = agree.distances(texts.tolist())
                        fits &= far[:, agree.langs.index(x)] <= far.min(axis=1) * (1 + FOREIGN)
                    kept, weight = texts[fits].tolist(), np.sqrt(g["count"].to_numpy()[fits])
                    for i in range(0, len(kept), TOGETHER):
                        some, w = kept[i : i + TOGETHER], weight[i : i + TOGETHER]
                        who, what = grams(some + [*map(_plain, some)])
                        what, at = np.unique(what, return_inverse=True)
                        n = np.bincount(at, np.concatenate([w, w])[who], len(what))
                        yield pd.DataFrame({"lang": x, "gram": what.view(np.int64), "n": n})

        return run

    schema = "lang string, gram long, n double"
    profiles = None
    for _ in range(2):
        both = parts.mapInPandas(count(profiles), schema).union(seeds.mapInPandas(count(None), schema))
        profiles = Profiles(_ranked(both))
    return profiles


class _Seen:
    """Distances, nearest language, lead and letters of the distinct sentences that a task has met."""

    def __init__(self, profiles: Profiles):
        self.p = profiles
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.far, self.letters, self.enough = np.zeros((0, len(self.p.langs))), np.zeros(0, np.int64), np.zeros(0, bool)

    def rows(self, texts: list[str]) -> np.ndarray:
        if len(self.row) > REMEMBERED:
            self.clear()
        new = [t for t in texts if t not in self.row]
        if new:
            clean = [_clean(t) for t in new]
            for t in new:
                self.row[t] = len(self.row)
            self.far = np.concatenate([self.far, self.p.distances(clean)])
            self.letters = np.concatenate([self.letters, np.array([len(t) - t.count(" ") for t in clean], np.int64)])
            self.enough = np.concatenate([self.enough, np.array([_enough(t) for t in clean], bool)])
        return np.fromiter(map(self.row.__getitem__, texts), np.int64, len(texts))


def segments(documents: DataFrame, profiles: Profiles, text: str = "text", key: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """``key, segment_no, lang, confidence, n_sentences, n_letters`` of every document, and the string columns ``keep``.

    A sentence that is nearest to a language only by a hair takes the language
    among those the document's clear sentences are in. Where a document has no whole
    sentence, as a title without a stop, its lines of ``LETTERS`` letters and more that are not
    code are looked at instead and n_sentences is 0. A document without either (null, empty, only listings) has one row
    with segment_no 0 and null lang.
    """
    keep = keep or {}
    shared = documents.sparkSession.sparkContext.broadcast(profiles)
    rows = documents.select(F.col(key), *(c.alias(n) for n, c in keep.items()), F.col(text).alias("__text"))
    units = _units(rows, F.col("__text")).drop("__text")
    schema = f"{key} {documents.schema[key].dataType.simpleString()}, " + "".join(f"{n} string, " for n in keep) + "segment_no int, lang string, confidence double, n_sentences int, n_letters int"

    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Profiles = shared.value
        seen = _Seen(p)
        for b in batches:
            lists = b.column("s")
            coded = lists.flatten().dictionary_encode()
            row = seen.rows(coded.dictionary.to_pylist())
            far, letters, ok = seen.far[row], seen.letters[row], seen.enough[row]
            near, lead = _best(far)
            index = np.asarray(coded.indices, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
            rows: list[tuple] = []
            for d, (s, e, whole) in enumerate(zip(ends[:-1], ends[1:], b.column("whole").to_pylist())):
                mine = index[s:e]
                mine = mine[ok[mine]]
                if not len(mine):
                    rows.append((d, 0, None, 0.0, 0, 0))
                    continue
                lang, sure = near[mine], lead[mine] >= SURE
                if sure.any() and not sure.all():
                    known = np.unique(lang[sure])
                    lang = lang.copy()
                    lang[~sure] = known[far[mine[~sure]][:, known].argmin(axis=1)]
                cut = np.flatnonzero(np.concatenate([[True], lang[1:] != lang[:-1], [True]]))
                for no, (i, j) in enumerate(zip(cut, cut[1:])):
                    w = letters[mine[i:j]]
                    rows.append((d, no, p.langs[lang[i]], float((lead[mine[i:j]] * w).sum() / w.sum()), int(j - i) if whole else 0, int(w.sum())))
            at, *rest = zip(*rows) if rows else ([],) * 6
            cols = [b.column(c).take(pa.array(at, pa.int64())) for c in names]
            cols += [pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "segment_no", "lang", "confidence", "n_sentences", "n_letters"])

    return units.mapInArrow(run, schema)


def label_documents(documents: DataFrame, codes: DataFrame, profiles: Profiles, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """``key, given, lang, share, confidence, n_sentences``: each language of a document and what its label names.

    ``share`` is the language's part of the letters. Documents without a
    language have one row with null lang; see ``segments``. Keys are unique.
    """
    given = {"given": named_language(F.col(label), label_names(codes))}
    n = F.col("n_letters")
    per = segments(documents, profiles, text, key, given).groupBy(key, "given", "lang").agg(
        F.sum(n).alias("n"), (F.sum(F.col("confidence") * n) / F.sum(F.when(n > 0, n))).alias("confidence"), F.sum("n_sentences").alias("n_sentences")
    )
    total = F.sum("n").over(W.partitionBy(key))
    return per.withColumn("share", F.when(total > 0, F.col("n") / total)).select(key, "given", "lang", "share", "confidence", "n_sentences")
