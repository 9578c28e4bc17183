"""One fact from several reads: the name a product takes, a barcode that is its own, the items quoted along a ladder of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def picked_names(reads: DataFrame, key: list[str]) -> DataFrame:
    """(key, name): the first name that a marketplace gives, else the most common one, the earliest read on a tie, then the smallest.

    reads (key, name, marketplace, at); rows without a name do not count. Names are counted before the shuffle, none are gathered.
    """
    market = F.min(F.when(F.col("marketplace"), F.struct(F.col("at").isNull(), "at"))).alias("market")
    names = reads.where("name is not null").groupBy(*key, "name").agg(F.count("*").alias("n"), F.min("at").alias("first"), market)
    best = F.struct(F.col("market").isNull(), "market", F.when(F.col("market").isNull(), -F.col("n")), F.col("first").isNull(), "first", "name")
    return names.groupBy(*key).agg(F.min(best).alias("b")).select(*key, F.col("b.name").alias("name"))


def own_codes(rows: DataFrame, code: str) -> DataFrame:
    """rows with `code` null where two or more rows have it. Rows without one are set aside, so that nulls are no key of the join."""
    shared = rows.where(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("__n")).where("__n > 1")
    coded = rows.where(F.col(code).isNotNull()).join(shared, code, "left")
    kept = coded.withColumn(code, F.when(F.col("__n").isNull(), F.col(code))).select(*rows.columns)
    return kept.unionByName(rows.where(F.col(code).isNull()))


def ladder_plan(candidates: DataFrame, place: str, item: str, price: str, rungs: list[int], reach: float = 1.6) -> DataFrame:
    """(place, turn, item, price): what to quote in each place: the cheapest item, then for each rung the cheapest at or over it, at most `reach` times as dear.

    An item stands once, at its first turn; a rung that nothing reaches is passed over, and turns are those of the ladder, the cheapest
    at 0. Prices of zero, below or null do not count, ties go to the smaller item. One aggregate with a minimum for each rung.
    """
    cheapest = lambda fits: F.min(F.when(fits & (F.col(price) > 0), F.struct(price, item)))
    steps = [cheapest(F.lit(True)), *[cheapest((F.col(price) >= r) & (F.col(price) <= r * reach)) for r in rungs]]
    found = candidates.groupBy(place).agg(F.array(*steps).alias("steps")).select(place, F.posexplode("steps").alias("turn", "s")).where("s is not null")
    return found.groupBy(place, F.col(f"s.{item}").alias(item), F.col(f"s.{price}").alias(price)).agg(F.min("turn").alias("turn")).select(place, "turn", item, price)
