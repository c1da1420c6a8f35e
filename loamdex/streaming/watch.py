"""Watching: incremental work driven by Structured Streaming."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from loamdex.session import shared_dir


def watch(engine, repo: str, once: bool = False, seconds: int = 5) -> StreamingQuery:
    """Each tick compares the repository with the index and reads what changed."""
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda batch, no: engine.index(repo)).option("checkpointLocation", f"{shared_dir(engine.spark)}/watch-{hashlib.sha256(repo.encode()).hexdigest()[:16]}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def manifest_stream(passes: DataFrame, late: str = "30 days") -> DataFrame:
    """Passes over files per month, from a stream; passes later than ``late`` are left out."""
    return passes.withWatermark("indexed_at", late).groupBy(F.window("indexed_at", "30 days"), "language").agg(F.count("*").alias("n_passes"), F.sum("size").alias("bytes"))
