"""Snapshots: tables as sorted JSON lines beside a small description, written and read with Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.ranking import mode_of


class RefusedExport(ValueError):
    """The new snapshot is empty, or less than half of the last one."""


def write(offers: DataFrame, path: str, key: list[str], last_count: int | None = None) -> dict:
    """Write offers sorted by key, without the `seen` that most offers of its store have; returns the description.

    The description (count, and the usual `seen` of each store) is a table of its own, a row a store. Range partitioning
    keeps the order over many files.
    """
    usual = mode_of(offers, ["store"], "seen").select("store", F.col("seen").alias("usual"))
    count = offers.count()
    if not count or (last_count is not None and count * 2 < last_count):
        raise RefusedExport(f"{count} rows, {last_count} before")
    usual.write.mode("overwrite").parquet(f"{path}/meta")
    rows = offers.join(usual, "store").withColumn("seen", F.when(~F.col("seen").eqNullSafe(F.col("usual")), F.col("seen"))).drop("usual")
    rows.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").json(f"{path}/rows")
    return {"count": count}


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows with a missing `seen` filled from their store's usual one, and a key derived from the natural key."""
    rows = spark.read.schema(schema).json(f"{path}/rows")
    usual = spark.read.parquet(f"{path}/meta")
    filled = rows.join(usual, "store", "left").withColumn("seen", F.coalesce("seen", "usual")).drop("usual")
    return filled.withColumn("id", F.concat(F.lit("pd_"), F.substring(F.sha1(F.concat_ws("|", F.lit("offer"), F.col("product_id").cast("string"), F.col("store").cast("string"))), 1, 24)))
