"""Corpus encoding with a public byte-level BPE, by merge replay.

Merges of one word never depend on another word, so each slice of the corpus
(the Arrow batches of one task) replays the merges for its own distinct words:
an inverted index from token pair to positions is kept over all of them, the
merges that occur are applied in rank order, and each application touches only
the positions listed under its pair and their neighbours. Nothing is shuffled,
and no vocabulary of the whole corpus is gathered anywhere.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

DEFAULT_VOCABULARY = os.environ.get("LOAMDEX_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: how the tokenizer cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Text is cut before a space between two visible characters. The pattern always
#: has a word boundary there, so the parts can be encoded one by one.
UNIT_SPLIT = r"(?<=\S)(?= \S)"

#: Units that a task remembers before it starts afresh.
MAX_REMEMBERED = 1_000_000


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def vocabulary(source: str | bytes) -> tuple[dict[bytes, int], list[bytes]]:
    """Rank of every token, and every token by rank, from a vocabulary file or what it holds."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (source if isinstance(source, bytes) else _file(source)).splitlines())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    return ranks, tokens


def replay_merges(words: list[bytes], path: str | bytes) -> list[list[int]]:
    """Token ids of each word. Words must be distinct only for speed."""
    ranks, tokens = vocabulary(path)
    tok: list[int] = []
    after: list[int] = []
    before: list[int] = []
    starts = []
    for w in words:
        at = len(tok)
        starts.append(at)
        n = len(w)
        tok += [ranks[w[i : i + 1]] for i in range(n)]
        before += [-1, *range(at, at + n - 1)][:n]
        after += [*range(at + 1, at + n), -1][:n]
    merged: dict[tuple[int, int], int] = {}
    where: dict[tuple[int, int], list[int]] = {}
    heap: list[tuple[int, tuple[int, int]]] = []

    def post(i: int) -> None:
        pair = (tok[i], tok[after[i]])
        r = merged.get(pair)
        if r is None:
            r = merged[pair] = ranks.get(tokens[pair[0]] + tokens[pair[1]], -1)
        if r >= 0:
            if pair in where:
                where[pair].append(i)
            else:
                where[pair] = [i]
                heapq.heappush(heap, (r, pair))

    for i, j in enumerate(after):
        if j >= 0:
            post(i)
    while heap:
        r, pair = heapq.heappop(heap)
        a, b = pair
        for i in sorted(where.pop(pair)):
            j = after[i]
            if j < 0 or tok[i] != a or tok[j] != b:
                continue
            tok[i], tok[j] = r, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                post(i)
            if before[i] >= 0:
                post(before[i])
    out = []
    for w, i in zip(words, starts):
        ids = []
        if w:
            while i >= 0:
                ids.append(tok[i])
                i = after[i]
        out.append(ids)
    return out


class _Memory:
    """Ids of the units a task has met, as one flat array with offsets."""

    def __init__(self, path: str | bytes):
        self.path, self.words = path, regex.compile(PATTERN)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def rows(self, units: list[str]) -> np.ndarray:
        """Row number of each unit; new units are encoded together."""
        if len(self.known) > MAX_REMEMBERED:
            self.clear()
        new = [u for u in units if u not in self.known]
        if new:
            cut = [self.words.findall(u) for u in new]
            distinct = list({w: None for ws in cut for w in ws})
            ids = dict(zip(distinct, replay_merges([w.encode("utf-8", "surrogatepass") for w in distinct], self.path)))
            per_unit = [[t for w in ws for t in ids[w]] for ws in cut]
            for u in new:
                self.known[u] = len(self.known)
            self.flat.append(np.fromiter((t for p in per_unit for t in p), np.int32))
            self.lengths.append(np.fromiter(map(len, per_unit), np.int64, len(per_unit)))
            self.flat, self.lengths = [np.concatenate(self.flat)], [np.concatenate(self.lengths)]
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the offsets of the rows, of a column of unit lists."""
        lists = column.flatten().dictionary_encode()
        counts = np.asarray(column.value_lengths().fill_null(0))
        unit = self.rows(lists.dictionary.to_pylist())[np.asarray(lists.indices, dtype=np.int64)]
        flat, lengths = self.flat[0], self.lengths[0]
        begin = np.cumsum(lengths) - lengths
        n = lengths[unit]
        total = np.cumsum(n)
        shift = np.repeat(begin[unit] - (total - n), n)
        ids = flat[np.arange(len(shift)) + shift] if len(shift) else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.concatenate([[0], total])[ends]


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str = DEFAULT_VOCABULARY, lengths_only: bool = False) -> DataFrame:
    """``df`` without ``text`` and with ``out``: the token ids of the text, or their number.

    Null and empty texts have the empty list (0 tokens). Strings of special
    tokens are ordinary text. Every other column of ``df`` passes through.
    """
    keep = [c for c in df.columns if c not in (text, out)]
    kind = IntegerType() if lengths_only else ArrayType(IntegerType(), False)
    schema = StructType([*(df.schema[c] for c in keep), StructField(out, kind, False)])
    units = df.select(*keep, F.split(F.coalesce(F.col(text), F.lit("")), UNIT_SPLIT).alias("__units"))

    shared = df.sparkSession.sparkContext.broadcast(_file(path))  # a fixed file; executors need not have it

    def run(batches):
        memory = _Memory(shared.value)
        for b in batches:
            ids, offsets = memory.encode(b.column("__units"))
            if lengths_only:
                col = pa.array(np.diff(offsets).astype(np.int32))
            else:
                col = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), col], names=[*keep, out])

    return units.mapInArrow(run, schema)
