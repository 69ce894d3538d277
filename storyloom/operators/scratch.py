"""Where tables that cut lineage are written: one folder of the application, shared by all executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _home(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir()).as_uri()
    return f"{base.rstrip('/')}/storyloom-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, kind: str = "work") -> str:
    """A folder name not used before under spark.checkpoint.dir. Where that is unset, a local folder for a local
    session; on a cluster an error, as each executor would write to its own disk."""
    return f"{_home(spark)}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: short lineage that outlives executors."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what kept() wrote for these tables, once nothing that is still to run reads them."""
    for df in tables:
        _delete(df.sparkSession, df.kept_at)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written here. DataFrames that read it can't be used afterwards."""
    _delete(spark, _home(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
