"""Merging a new state into a stored one, and comparing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_diff(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """fresh's columns plus `change`: insert, update or same; rows of stored that fresh lacks are left out."""
    values = [c for c in fresh.columns if c != key]
    old = stored.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in values])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in values])
    change = F.when(F.col("__k").isNull(), "insert").when(same, "same").otherwise("update")
    return fresh.join(old, F.col(key) == F.col("__k"), "left").select(*fresh.columns, change.alias("change"))


def merged(stored: DataFrame, fresh: DataFrame, key: str, expired: Column) -> DataFrame:
    """fresh over stored, by key; rows of stored only stay unless `expired` holds for them."""
    rest = stored.join(fresh.select(key), key, "left_anti").where(~expired)
    return fresh.unionByName(rest.select(fresh.columns))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, as multisets, with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def overwrite_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that rows has; the others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert(stored: DataFrame, fresh: DataFrame, key: str, missing: dict[str, Column], prune: Column) -> DataFrame:
    """fresh over stored by key, with the columns of stored: rows only stored take the values of `missing`, or go where `prune` holds.

    One full outer join. Null keys never match: both sides keep theirs.
    """
    old = stored.select(F.struct(*stored.columns).alias("old"), F.col(key).alias("k"))
    new = fresh.select(F.struct(*stored.columns).alias("new"), F.col(key).alias("k"))
    rows = old.join(new, "k", "full")
    kept = rows.select(F.col("new").isNotNull().alias("here"), *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(missing.get(c, F.col(f"old.{c}"))).alias(c) for c in stored.columns])
    return kept.where(F.col("here") | ~F.coalesce(prune, F.lit(False))).drop("here")


class RefusedOverwrite(ValueError):
    """The new table is empty, or has less than the share of the old rows that was asked for."""


def overwrite_table(fresh: DataFrame, path: str, least_share: float = 0.0) -> int:
    """Replaces all of a stored table, and returns its rows. fresh may be computed from the stored one.

    It is written beside it first and counted there; the old one goes only when the new one is complete, so a job that fails leaves
    it as it was. An empty table, or one of less than least_share of the old rows, is refused.
    """
    spark = fresh.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    fs, beside = place(path).getFileSystem(conf), f"{path.rstrip('/')}.next"
    fresh.write.mode("overwrite").parquet(beside)
    rows = spark.read.parquet(beside).count()
    before = spark.read.parquet(path).count() if fs.exists(place(path)) else 0
    if not rows or rows < before * least_share:
        fs.delete(place(beside), True)
        raise RefusedOverwrite(f"{rows} rows, {before} before")
    fs.delete(place(path), True)
    fs.rename(place(beside), place(path))
    return rows


def distinct_slugs(rows: DataFrame, key: str, slug: str, most: int = 130) -> DataFrame:
    """rows, of one key each, with slugs that no two share: the smallest key keeps one, the others get `most` letters of it and a hash of their own key.

    A row is better under an ugly address than lost to another's. Keys are counted per slug; only rows of shared ones are changed.
    """
    owner = rows.groupBy(slug).agg(F.min(key).alias("__owner"))
    tail = F.lower(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 36))
    named = F.when(F.col(key) == F.col("__owner"), F.col(slug)).otherwise(F.concat(F.substring(slug, 1, most), F.lit("-"), tail))
    return rows.join(owner, slug).withColumn(slug, named).select(rows.columns)
