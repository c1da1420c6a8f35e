"""Commit logs and evaluation tasks as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def commits(logs: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep..., commit_id, author, committed_at, message``: one row per commit of log texts."""
    keep = keep or []
    parts = F.filter(F.split(F.col(text), r"(?m)^(?=commit [0-9a-f]{7,64})"), lambda x: x.rlike(r"^commit [0-9a-f]{7,64}"))
    one = logs.where(F.col(text).isNotNull()).select(*keep, F.explode(parts).alias("c"))
    at = F.regexp_extract("c", r"(?m)^Date:\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1)
    return one.select(
        *keep, F.regexp_extract("c", r"^commit ([0-9a-f]+)", 1).alias("commit_id"), F.regexp_extract("c", r"(?m)^Author:\s*([^<\n]*?)\s*(<|$)", 1).alias("author"),
        F.try_to_timestamp(at, F.lit("yyyy-MM-dd HH:mm:ss")).alias("committed_at"), F.trim(F.regexp_replace(F.regexp_replace("c", r"(?s)^.*?\r?\n\r?\n", ""), r"(?m)^ {4}", "")).alias("message"),
    )


def file_changes(logs: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep..., commit_id, file_path, added, removed``: the files of each commit, from logs with numbers (``git log --numstat``) or with statistics (``--stat``).

    Counts are null for binary files and in statistics, which have only a sum.
    """
    keep = keep or []
    parts = F.filter(F.split(F.col(text), r"(?m)^(?=commit [0-9a-f]{7,64})"), lambda x: x.rlike(r"^commit [0-9a-f]{7,64}"))
    one = logs.where(F.col(text).isNotNull()).select(*keep, F.explode(parts).alias("c"))
    lines = one.select(*keep, F.regexp_extract("c", r"^commit ([0-9a-f]+)", 1).alias("commit_id"), F.explode(F.split("c", r"\r?\n")).alias("l"))
    numbers, sums = r"^(\d+|-)\t(\d+|-)\t(.+)$", r"^ (\S.*?) +\| +(?:\d+ ?[+-]*|Bin .*)$"
    is_number = F.col("l").rlike(numbers)
    got = lines.where(is_number | F.col("l").rlike(sums))
    count = lambda i: F.when(is_number, F.regexp_extract("l", numbers, i).try_cast("int"))
    path = F.when(is_number, F.regexp_extract("l", numbers, 3)).otherwise(F.regexp_extract("l", sums, 1))
    return got.select(*keep, "commit_id", path.alias("file_path"), count(1).alias("added"), count(2).alias("removed"))


def changed_files(old: DataFrame, new: DataFrame, untracked: DataFrame) -> DataFrame:
    """``file_path``: what a comparison names on either side (``file_path`` of each) and what is not tracked, once each."""
    return old.select("file_path").union(new.select("file_path")).union(untracked.select("file_path")).where("file_path is not null").distinct()


def churn(changes: DataFrame, by: str, commit: str) -> DataFrame:
    """``by, n_commits``: distinct commits per file or author."""
    return changes.where(F.col(by).isNotNull()).groupBy(by).agg(F.countDistinct(commit).alias("n_commits"))


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """``query, category, path, start_line, end_line``: targets of evaluation tasks, given as a path or an object."""
    raw = spark.read.option("multiLine", True).schema("query string, category string, relevant array<string>, secondary array<string>").json(path)
    t = raw.select("query", F.coalesce("category", F.when(F.size(F.split("query", r"\s+")) <= 2, "symbol").otherwise("semantic")).alias("category"), F.explode_outer("relevant").alias("t"))
    at = F.from_json("t", "path string, start_line int, end_line int")
    is_object = F.startswith(F.ltrim("t"), F.lit("{"))
    return t.select("query", "category", F.when(is_object, at["path"]).otherwise(F.col("t")).alias("path"), F.when(is_object, at["start_line"]).alias("start_line"), F.when(is_object, at["end_line"]).alias("end_line"))
