"""References to records that do not exist.

A Bloom filter of the parent keys is sent to every task. A reference whose key
the filter does not know is an orphan for certain; only the keys that the
filter lets through are compared with the parents by an exact join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from loamdex.session import Stages

#: Bits of the filter at most: 8 MB of words. With more keys than fit it lets more
#: references through to the exact join and the result stays the same.
MAX_BITS = 1 << 26
BITS_PER_KEY = 10
HASHES = 7
BY_NAME = r"^(call|symbol|module):"


def canonical_key(c: Column) -> Column:
    """The id with its path in one spelling.

    Blanks around the id, backslashes, empty and ``.`` segments go; ``..`` takes
    the segment before it away. What follows the path (``:name``) and the
    ``file:`` and ``chunk:`` prefixes stay as they are; case counts.
    """
    c = F.trim(F.translate(c, "\t\r\n\u00a0", "    "))
    prefix = F.regexp_extract(c, r"^((?:chunk:)?(?:file:)?)", 1)
    rest = F.substr(c, F.length(prefix) + 1)
    path, name = F.substring_index(rest, ":", 1), F.regexp_extract(rest, r"^[^:]*(:.*)$", 1)
    segments = F.split(F.translate(path, "\\", "/"), "/")
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc)
        .when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x)))
    )
    tidy = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    untidy = path.rlike(r"\\|//|(^|/)\.{1,2}(/|$)|^/|/$")
    return F.concat(prefix, F.when(untidy, tidy).otherwise(path), name)


def ref_path(key: Column) -> Column:
    """The file that a canonical id lies in; null for by-name ids."""
    bare = F.regexp_replace(key, r"^(chunk:)?(file:)?", "")
    return F.when(~key.rlike(BY_NAME), F.substring_index(bare, ":", 1))


def references(symbols: DataFrame, edges: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every reference of the four tables that can be an orphan.

    Null and blank values and ids by name are no references.
    """
    ref = lambda t, field, owner, value, kind, path, to: F.struct(
        F.lit(t).alias("table_name"), F.lit(field).alias("field_name"), owner.alias("owner_id"), value.alias("missing_id"),
        kind.alias("edge_type"), path.alias("path_id"), F.lit(to).alias("parent"),
    )
    none = F.lit("")
    src, tgt, kind = F.col("source_id"), F.col("target_id"), F.coalesce("edge_type", F.lit(""))
    parts = [
        edges.select(F.explode(F.array(
            ref("edges", "target_id", src, tgt, kind, src, "symbols"),
            ref("edges", "source_id", tgt, src, kind, src, "symbols"),
        )).alias("r")),
        symbols.select(ref("symbols", "parent_id", F.col("node_id"), F.col("parent_id"), none, F.col("node_id"), "symbols").alias("r")),
        chunks.select(ref("chunks", "symbol_id", F.col("chunk_id"), F.col("symbol_id"), none, F.coalesce("file_path", "chunk_id"), "symbols").alias("r")),
        vectors.select(ref("chunk_vectors", "chunk_id", F.col("chunk_id"), F.col("chunk_id"), none, F.col("chunk_id"), "chunks").alias("r")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.select("r.*").where(F.col("missing_id").isNotNull() & ~F.col("missing_id").rlike(r"^[\s\u00a0]*$"))
    out = out.where(~F.ltrim("missing_id").rlike(BY_NAME))
    return out.withColumn("key", F.concat(F.col("parent"), F.lit("\x01"), canonical_key(F.col("missing_id"))))


def parent_keys(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    tag = lambda df, c, t: df.where(F.col(c).isNotNull()).select(F.concat(F.lit(f"{t}\x01"), canonical_key(F.col(c))).alias("key"))
    return tag(symbols, "node_id", "symbols").union(tag(chunks, "chunk_id", "chunks"))


def _halves() -> tuple[Column, Column]:
    """Two 31-bit hashes of the key; position i is a + i * b, which cannot overflow."""
    mask = F.lit(0x7FFFFFFF).cast("long")
    return tuple(F.xxhash64(F.lit(seed), F.col("key")).bitwiseAND(mask) for seed in (1, 2))


def bloom_words(keys: DataFrame, n_keys: int) -> np.ndarray:
    """The filter as 64-bit words: positions are hashed and OR-ed by Spark.

    The driver gets the finished words only, ``MAX_BITS / 64`` at most.
    """
    bits = 1 << 10
    while bits < min(MAX_BITS, n_keys * BITS_PER_KEY):
        bits <<= 1
    a, b = _halves()
    at = keys.select(F.explode(F.array(*[(a + F.lit(i) * b).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)])).alias("at"))
    got = (
        at.groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        .toPandas()
    )
    words = np.zeros(bits // 64, dtype=np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    return words


def may_exist(refs: DataFrame, words: np.ndarray) -> DataFrame:
    """``refs`` with the column ``maybe``: False proves that no parent has the key."""
    shared = refs.sparkSession.sparkContext.broadcast(words)
    bits = len(words) * 64

    @F.pandas_udf(BooleanType())
    def probe(a: pd.Series, b: pd.Series) -> pd.Series:
        w, ok = shared.value, np.ones(len(a), dtype=bool)
        x, step = a.to_numpy(), b.to_numpy()
        for i in range(HASHES):
            at = (x + i * step) & (bits - 1)
            ok &= (w[at >> 6] >> (at & 63)) & 1 == 1
        return pd.Series(ok)

    return refs.withColumn("maybe", probe(*_halves()))


def orphan_references(symbols: DataFrame, edges: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct ``table_name, field_name, owner_id, missing_id, edge_type, ref_file`` of all orphans.

    Null, blank and by-name ids are no references; a null edge_type counts as
    ''. A key that appears anywhere in the parent table exists, whenever it
    arrived. Repeated rows give one row. Empty parent tables make every
    reference an orphan.
    """
    spark = symbols.sparkSession
    keys = parent_keys(symbols, chunks)
    words = bloom_words(keys, symbols.count() + chunks.count())
    st = Stages(spark, "orphans")
    refs = st.save(may_exist(references(symbols, edges, chunks, vectors), words))  # made canonical and probed once, read twice
    # What the filter let through: one row per key before the exact comparison.
    passed = refs.where("maybe").select("key").distinct()
    wrong = st.save(passed.join(keys, "key", "left_anti"))
    seen = refs.join(wrong.withColumn("gone", F.lit(True)), "key", "left")
    return (
        seen.where("not maybe or gone")
        .select("table_name", "field_name", "owner_id", "missing_id", "edge_type", ref_path(canonical_key(F.col("path_id"))).alias("ref_file"))
        .distinct()
    )


def file_periods(manifest: DataFrame) -> DataFrame:
    """``ref_file, period``: the month of the last pass over each file; passes without a time don't count."""
    return manifest.groupBy(ref_path(canonical_key(F.col("file_path"))).alias("ref_file")).agg(
        F.date_format(F.date_trunc("month", F.max("indexed_at")), "yyyy-MM").alias("period")
    )


def orphan_report(orphans: DataFrame, manifest: DataFrame) -> DataFrame:
    """Orphans per table, field, edge_type and period of the referring file; period '' where the file has none."""
    return (
        orphans.join(file_periods(manifest), "ref_file", "left")
        .groupBy("table_name", "field_name", "edge_type", F.coalesce("period", F.lit("")).alias("period"))
        .agg(F.count("*").alias("n_orphans"))
    )
