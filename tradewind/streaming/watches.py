"""Notices of stock as a stream: one small state for each watch, armed until it is told and again when the item sells out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def notices(readings: DataFrame, watchers: DataFrame) -> DataFrame:
    """readings (place, item: long, day: date, stores: long, price: long), watchers (watcher, place, item, since) -> (watcher, place, item, day, price).

    The batch twin is operators.holdings.notices. readings is a stream with a row for each item and day, as a daily run leaves them, and
    watchers a table that is read anew with each batch. The first reading in stock on or after `since` is told, then the first after one
    that is sold out; before `since` nothing arms or tells. A reading not after the last day of its watch is late and dropped, one without
    a day too. Readings meet the table before any state, so items that nobody watches leave none.
    """
    ask = watchers.groupBy("watcher", "place", "item").agg(F.min("since").alias("since"))
    seen = readings.join(ask, ["place", "item"]).where("day >= since").select("watcher", "place", "item", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("day"), "stores", "price")

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed, last = state.get if state.exists else (True, None)
        out = []
        rows = pd.concat(list(parts)).sort_values("day", kind="stable")
        for day, stores, price in zip(rows["day"].tolist(), rows["stores"].tolist(), rows["price"].tolist()):
            if last is not None and day <= last:
                continue
            last, open_now = day, stores > 0
            if open_now and armed:
                out.append((*key, day, price))
            armed = not open_now
        state.update((armed, last))
        found = pd.DataFrame(out, columns=["watcher", "place", "item", "day", "price"])
        yield found.astype({"price": "Int64"})

    told = seen.groupBy("watcher", "place", "item").applyInPandasWithState(
        fold, "watcher string, place string, item long, day int, price long", "armed boolean, last int", "append", GroupStateTimeout.NoTimeout
    )
    return told.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")))
