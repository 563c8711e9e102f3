"""Session plumbing shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

ROOT = str(Path(__file__).resolve().parents[2])

#: Rows per Arrow batch: keeps a batch of documents within a few MB of Python memory.
ARROW_ROWS = 400


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and hand them small Arrow batches."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    # shuffle files go when the query that wrote them ends; chains of written tables need none of them
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir), or one inside the warehouse where it is unset."""
    return shared_folder(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/memloom/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        at = getattr(df, "stored_at", None)
        for folder in [at] if at else {f for f in map(os.path.dirname, df.inputFiles()) if "/memloom/" in f}:
            drop_table(df.sparkSession, folder)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
