"""Retrieval evaluation: gains, rank of the first hit, latencies, interval matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Lines per cell when intervals are matched by the cells they touch.
CELL = 64


def ndcg(queries: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """``query, ndcg, top1`` of every query (``query, n_targets``) from the ranks of its hits (``query, rank``).

    Two targets first met at one rank count once; ranks beyond k don't count; a query without
    hits or without targets has 0.
    """
    per = hits.select("query", "rank").distinct().groupBy("query").agg(
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.max(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("top1"),
    )
    n = F.coalesce("n_targets", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    score = F.when(n > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0)
    return queries.join(per, "query", "left").select("query", score.alias("ndcg"), F.coalesce("top1", F.lit(0)).alias("top1"))


def first_hits(results: DataFrame, targets: DataFrame) -> DataFrame:
    """``query, target, rank``: the first rank at which each target is met.

    ``results`` has ``query, rank, file_path, start_line, end_line``; ``targets`` has ``query, path,
    start_line, end_line``, of which the lines may be null. A result meets a target if the paths
    are the same, one may be the end of the other, and the lines overlap where the target has any.
    """
    t = targets.where("path is not null").select("query", F.struct("path", "start_line", "end_line").alias("target")).distinct()
    span = F.col("target.start_line").isNull() | F.col("target.end_line").isNull() | ((F.col("start_line") <= F.col("target.end_line")) & (F.col("end_line") >= F.col("target.start_line")))
    met = results.join(t, "query").where(same_path(F.col("file_path"), F.col("target.path")) & F.coalesce(span, F.lit(False)))
    return met.groupBy("query", "target").agg(F.min("rank").alias("rank"))


def evaluation(results: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per query ``query, category, n_targets, ndcg5, ndcg10, top1``, and the means per category and over all (category null)."""
    asked = targets.groupBy("query").agg(F.min("category").alias("category"), F.count_distinct(F.when(F.col("path").isNotNull(), F.struct("path", "start_line", "end_line"))).alias("n_targets"))
    hits = first_hits(results, targets)
    score = lambda k: ndcg(asked, hits, k).select("query", F.col("ndcg").alias(f"ndcg{k}"), *(["top1"] if k == 10 else []))
    per = asked.join(score(5), "query").join(score(10), "query")
    return per, per.rollup("category").agg(F.count("*").alias("n_queries"), F.avg("ndcg5").alias("ndcg5"), F.avg("ndcg10").alias("ndcg10"), F.avg("top1").alias("top1"))


def write_evaluation(summary: DataFrame, path: str) -> None:
    """The means as JSON lines."""
    summary.write.mode("overwrite").json(path)


def same_path(a: Column, b: Column) -> Column:
    """Equal, or one ends with the other after a slash."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def interval_matches(left: DataFrame, right: DataFrame, on: str = "file_path") -> DataFrame:
    """Pairs of rows of one file whose lines overlap, both ends included.

    Both sides carry ``on, id, first, last``. Intervals meet in the cells of
    ``CELL`` lines they touch, so a long file is no single group; a pair is
    kept by the first cell it shares. Intervals without both ends match nothing.
    """
    def cells(df: DataFrame, p: str) -> DataFrame:
        ok = df.where("first is not null and last is not null and last >= first")
        c = F.sequence(F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL))
        return ok.select(on, F.col("id").alias(f"{p}_id"), F.col("first").alias(f"{p}_first"), F.col("last").alias(f"{p}_last"), F.explode(c).alias("cell"))

    m = cells(left, "left").join(cells(right, "right"), [on, "cell"])
    m = m.where("left_first <= right_last and left_last >= right_first")
    return m.where(F.col("cell") == F.floor(F.greatest("left_first", "right_first") / CELL)).select(on, "left_id", "right_id")


def latencies(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median, extremes and interpolated percentiles of a value; nulls don't count."""
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 6)
    return df.groupBy(by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"),
        p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"),
    )


def token_estimate(text: Column) -> Column:
    """Tokens of all texts of a group, by four characters each."""
    return F.floor(F.coalesce(F.sum(F.length(text)), F.lit(0)) / 4)
