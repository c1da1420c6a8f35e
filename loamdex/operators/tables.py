"""Keyed writes, incremental comparison and statistics of the stored relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def upsert(rows: DataFrame, keys: list[str], seq: list[Column]) -> DataFrame:
    """One row per key, the last by ``seq``. Rows with a null in the key form a group like any other."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in seq)))
    return rows.withColumn("__k", last).where("__k = 1").drop("__k")


def insert_ignore(rows: DataFrame, keys: list[str], seq: list[Column]) -> DataFrame:
    """One row per key, the first by ``seq``."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*(c.asc_nulls_last() for c in seq)))
    return rows.withColumn("__k", first).where("__k = 1").drop("__k")


def remove_files(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """symbols, edges, chunks, chunk_vectors and file_manifest without the files (column ``file_path``).

    An edge goes if either end is a symbol of such a file; symbols are told by their rows.
    """
    gone = tables["symbols"].join(files, "file_path", "left_semi").select("node_id").distinct()
    out = {t: tables[t].join(files, "file_path", "left_anti") for t in ("symbols", "chunks", "file_manifest")}
    e = tables["edges"]
    for end in ("source_id", "target_id"):
        e = e.join(gone.withColumnRenamed("node_id", end), end, "left_anti")
    chunk = tables["chunks"].join(files, "file_path", "left_semi").select("chunk_id").distinct()
    return out | {"edges": e, "chunk_vectors": tables["chunk_vectors"].join(chunk, "chunk_id", "left_anti")}


def manifest_changes(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """``file_path, change``: added, deleted, changed, touched (new time, same content) or same.

    A file of equal size whose time differs by less than 0.0001 s counts as same
    without a look at its hash; nulls never count as equal.
    """
    s = stored.select("file_path", F.col("content_hash").alias("h0"), F.col("mtime").alias("t0"), F.col("size").alias("n0"), F.lit(True).alias("was"))
    n = scanned.select("file_path", F.col("content_hash").alias("h1"), F.col("mtime").alias("t1"), F.col("size").alias("n1"), F.lit(True).alias("now"))
    stat = F.coalesce((F.col("n0") == F.col("n1")) & (F.abs(F.col("t0") - F.col("t1")) < 1e-4), F.lit(False))
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(stat, "same")
        .when(F.coalesce(F.col("h0") == F.col("h1"), F.lit(False)), "touched").otherwise("changed")
    )
    return s.join(n, "file_path", "full_outer").select("file_path", change.alias("change"))


def index_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n_rows`` of each table."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The kinds that the stored relations know.
KINDS = {
    "symbols.kind": ["file", "module", "class", "function", "method", "interface", "variable", "config_key", "endpoint"],
    "edges.edge_type": ["IMPORTS", "CALLS", "DEFINES", "INHERITS", "IMPLEMENTS", "OVERRIDES", "TESTED_BY", "READS_CONFIG", "EXPOSED_BY", "SIMILAR_TO"],
    "chunks.chunk_type": ["code", "docs", "config", "test", "git", "wiki"],
}


def unknown_kinds(tables: dict[str, DataFrame]) -> DataFrame:
    """``column_name, value, n_rows``: values outside the known kinds, null included."""
    out = None
    for name, known in KINDS.items():
        t, c = name.split(".")
        bad = tables[t].where(F.col(c).isNull() | ~F.col(c).isin(*known)).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n_rows"))
        part = bad.select(F.lit(name).alias("column_name"), "value", "n_rows")
        out = part if out is None else out.unionByName(part)
    return out
