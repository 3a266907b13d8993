"""Tables that a query computes once: written in the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a new folder, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="alarmlens-")
    return folder


def saved(df: DataFrame) -> DataFrame:
    """df, written once. Lost executors cost no recomputation of its lineage, and what isn't determined (ids, ranges) stays as it was."""
    path = f"{shared_folder(df.sparkSession)}/study-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    for table in tables:
        spark = table.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
