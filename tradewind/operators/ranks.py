"""Exact ranks over a whole table, and samples cut by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.ranking import first_per
from tradewind.sources.scratch import settled


def with_rank(df: DataFrame, order: list[Column], rank: str = "rank", total: str = "total") -> DataFrame:
    """df plus the rank of each row from 1 in a full order, and the number of rows.

    The rows are range-partitioned and sorted, the sizes of the partitions give each its offset, and a row's rank is its offset and
    its place. No task holds more than a partition, and nothing but one row a partition is gathered.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = settled(ordered.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    w = Window.orderBy("__part")
    offsets = sizes.select("__part", (F.sum("__n").over(w) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias(total))
    place = F.col("__at") - F.shiftleft(F.col("__part"), 33) + 1
    # one row a partition of the table
    return ordered.withColumn("__part", part).join(offsets, "__part").withColumn(rank, F.col("__before") + place).drop("__at", "__part", "__before")


def with_tile(df: DataFrame, order: list[Column], tiles: int, tile: str = "tile") -> DataFrame:
    """df plus the number, from 1, of its share of the order; the first shares have one row more where they are not even."""
    ranked = with_rank(df, order, "__rank", "__total")
    small, extra, at = F.floor(F.col("__total") / tiles), F.col("__total") % tiles, F.col("__rank") - 1
    wide = extra * (small + 1)
    number = F.when(at < wide, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - wide) / F.greatest(small, F.lit(1)))) + 1
    return ranked.withColumn(tile, number.cast("int")).drop("__rank", "__total")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone: 52 bits of their md5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def weighted_sample(df: DataFrame, by: list[str], weight: Column, key: Column, n: int, seed: str, place: str = "place") -> DataFrame:
    """n rows of each group without replacement, each drawn with a chance in proportion to its weight among those left.

    Every row gets an exponential waiting time of its weight, from a hash of its key; the n shortest are the sample, which is
    a top-k a group, cut before the shuffle. Rows of weight 0 or less, or null, are never drawn.
    """
    waits = df.withColumn("__w", weight.cast("double")).where("__w > 0").withColumn("__t", -F.ln(uniform(key, seed)) / F.col("__w"))
    return first_per(waits, by, [F.col("__t"), key], n, place).drop("__w", "__t")
