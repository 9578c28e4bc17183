"""Tables between the rounds of an operator, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folder: dict[str, str] = {}


def _path(spark: SparkSession, name: str) -> str:
    """Under spark.checkpoint.dir; a temporary folder only where that is unset and Spark runs in this one process."""
    app, base = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _folder:
            _folder[app] = tempfile.mkdtemp(prefix="tradewind-rounds-")
        base = _folder[app]
    path = f"{base.rstrip('/')}/{app}/{name}-{uuid.uuid4().hex[:12]}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read back: its lineage is cut, it is computed once, and a lost executor costs nothing of it."""
    path = _path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = sc._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
