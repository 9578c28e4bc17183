"""What a strip shows of several searches: each in turn or cheapest first, nothing twice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_unlike(df: DataFrame, feed: str, item: str, photo: str, order: list[Column], most: int, place: str = "place") -> DataFrame:
    """(feed, item, place): up to `most` rows of each feed in a full order, passing over what shares its item or its photo with one taken.

    A row passed over does not count against later ones, so this is a walk, not two distincts. A feed is streamed in order through a
    task, which remembers what it took and no more. A null photo is like no other.
    """
    rows = df.select(F.col(feed).alias("f"), F.col(item).alias("i"), F.col(photo).alias("p"), F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)]).alias("o"))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, items, photos = None, set(), set()
        for part in parts:
            out = []
            for f, i, p in zip(part["f"], part["i"], part["p"]):
                if f != now:
                    now, items, photos = f, set(), set()
                if len(items) < most and i not in items and (p is None or p not in photos):
                    items.add(i)
                    photos.add(p)
                    out.append((f, i, len(items)))
            yield pd.DataFrame(out, columns=["f", "i", "place"])

    kinds = df.schema[feed].dataType.simpleString(), df.schema[item].dataType.simpleString()
    found = rows.repartition("f").sortWithinPartitions("f", "o").mapInPandas(walk, f"f {kinds[0]}, i {kinds[1]}, place int")
    return found.select(F.col("f").alias(feed), F.col("i").alias(item), F.col("place").alias(place))


def selected_feed(df: DataFrame, feed: str, search: str, item: str, photo: str, rank: list[Column], price: str, by_price: Column, most: int) -> DataFrame:
    """(feed, item, place): feeds for which `by_price` holds (a column of the feed) show their cheapest items, the others the first of each
    search, then the second of each, and so on."""
    turned = df.withColumn("__turn", F.row_number().over(Window.partitionBy(feed, search).orderBy(*rank, item)))
    first = F.when(by_price, F.col(price)).otherwise(F.col("__turn"))
    second = F.when(by_price, F.lit(None)).otherwise(F.col(search))
    return first_unlike(turned, feed, item, photo, [first, second, F.col(item), F.col("__turn")], most)
