"""Session helpers: table loading and durable cuts of long lineages."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: the session's checkpoint folder.

    A machine-local folder is used only when the session names none and runs in
    plain local mode (tests).
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Stages:
    """Tables written to the shared folder to cut lineage between rounds.

    They are ordinary parquet files, so a lost executor costs a re-read and
    not a recomputation. ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_path = path
        return out

    def together(self, parts: list[DataFrame]) -> DataFrame:
        """Saved tables of one schema as a single scan, so that many small ones are read by few tasks."""
        return self.spark.read.schema(parts[0].schema).parquet(*[p.staged_path for p in parts])

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it.

    The archive lies in the shared folder if that is a file system path; else the
    driver makes it and Spark distributes it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_loamdex_shipped", False):
        return
    root, shared = Path(__file__).resolve().parent, shared_dir(spark)
    folder = Path(shared.removeprefix("file://").removeprefix("file:")) if shared.startswith(("file:", "/")) else Path(tempfile.mkdtemp(prefix="spark-"))
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / f"loamdex-{uuid.uuid4().hex}" / "loamdex.zip"
    target.parent.mkdir()
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._loamdex_shipped = True
