"""Structured Streaming forms of the stateful operators; each has a batch twin in operators.history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by event type and tumbling window; events later than the watermark are left out, closed windows are emitted once."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def price_changes(prices: DataFrame) -> DataFrame:
    """(market, product_id, day, price) -> the rows at which a series changes. State: the last day and price of a key.

    Rows of a batch are ordered by day; a row not after the last day of its key is late and dropped. State of one key is two
    numbers; keys are dealt over the partitions by hash.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_day, last_price = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(["day", "price"])
        out = []
        for day, price in zip(rows["day"], rows["price"], strict=True):
            if last_day is not None and day <= last_day:
                continue
            if price != last_price:
                out.append((*key, day, price))
            last_day, last_price = day, price
        state.update((last_day, int(last_price)))
        yield pd.DataFrame(out, columns=["market", "product_id", "day", "price"])

    return prices.groupBy("market", "product_id").applyInPandasWithState(
        fold, "market string, product_id long, day int, price long", "day int, price long", "append", GroupStateTimeout.NoTimeout
    )


def rate_limited(calls: DataFrame, most: int, seconds: int) -> DataFrame:
    """(key, at: seconds as long) -> at and whether the call is allowed: `most` in a window that opens at its first call.

    The window is not a calendar one, so this is state, not a window function.
    """

    def admit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values("at")
        allowed = []
        for at in rows["at"]:
            if opened is None or at >= opened + seconds:
                opened, used = int(at), 0
            used += 1
            allowed.append(used <= most)
        state.update((opened, used))
        yield pd.DataFrame({"key": key[0], "at": rows["at"], "allowed": allowed})

    return calls.groupBy("key").applyInPandasWithState(admit, "key long, at long, allowed boolean", "opened long, used long", "append", GroupStateTimeout.NoTimeout)
