"""Posting what has become true: how each event stands against a ledger of earlier runs, what is posted, and the ledger after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.ranking import first_per

#: An event rests this many days after it was posted; it is forgotten when it has rested and was not seen in KEPT_RUNS runs.
REST_DAYS, KEPT_RUNS = 7, 60


def found_events(summaries: DataFrame, points: DataFrame, through: Column, deal: Column, returns: Column) -> DataFrame:
    """(key, kind, market, product_id, cents, score): the deals and the returns to stock that hold now.

    summaries has a row for each product and market with lowest, in_stock_stores and median_open; points the change points
    (market, product_id, day, price, stores) of their series. A `deal` is a summary for which the condition of that name holds; it scores
    the percent it is under the median. A `return` is an open summary for which `returns` holds and whose latest point is of the day
    `through` with stores in stock, the one before it without any; it scores 1,000 and its stores, before every deal. The last two points of
    a series are one grouped top-2, so no series is gathered.
    """
    key = lambda kind: F.concat_ws("|", F.lit(kind), "market", F.col("product_id").cast("string")).alias("key")
    under = F.floor((1 - F.col("lowest") / F.col("median_open")) * 100 + 0.5).cast("long")
    deals = summaries.where(deal).select(key("deal"), F.lit("deal").alias("kind"), "market", "product_id", F.col("lowest").alias("cents"), under.alias("score"))
    latest = first_per(points, ["market", "product_id"], [F.desc("day")], 2, "__n")
    two = latest.groupBy("market", "product_id").agg(
        F.max(F.when(F.col("__n") == 1, F.col("day"))).alias("day"), F.max(F.when(F.col("__n") == 1, F.col("stores"))).alias("now"), F.max(F.when(F.col("__n") == 2, F.col("stores"))).alias("was")
    ).where((F.col("day") == through) & (F.col("now") > 0) & (F.col("was") == 0))
    back = summaries.where((F.col("in_stock_stores") > 0) & returns).join(two.select("market", "product_id"), ["market", "product_id"], "left_semi")
    back = back.select(key("return"), F.lit("return").alias("kind"), "market", "product_id", F.col("lowest").alias("cents"), (1000 + F.col("in_stock_stores")).alias("score"))
    return deals.unionByName(back)


def with_standing(events: DataFrame, ledger: DataFrame, run: int, today: int, rest_days: int = REST_DAYS) -> DataFrame:
    """events (key, ..) plus `standing` in run number `run`, on the day of number `today`.

    ledger has (key, seen_run, posted_day), posted_day null for what was seen and never posted. `new`: not in the ledger; `unposted`:
    seen before, but no run had room for it; `going on`: true in the run before as well; `resting`: it had ended, and was posted less
    than rest_days ago; `returned`: it had ended, and has rested.
    """
    known = ledger.select("key", F.col("seen_run").alias("__run"), F.col("posted_day").alias("__day"))
    standing = (
        F.when(F.col("__run").isNull(), "new")
        .when(F.col("__day").isNull(), "unposted")
        .when(F.col("__run") >= run - 1, "going on")
        .when(F.lit(today) - F.col("__day") < rest_days, "resting")
        .otherwise("returned")
    )
    return events.join(known, "key", "left").withColumn("standing", standing).drop("__run", "__day")


def due_posts(events: DataFrame, ledger: DataFrame, run: int, today: int, room: int, rest_days: int = REST_DAYS) -> DataFrame:
    """The `room` events of highest score (ties: smallest key) that are new, unposted or returned. Run 1 only fills the ledger."""
    if run <= 1:
        return events.limit(0)
    due: Column = F.col("standing").isin("new", "unposted", "returned")
    return with_standing(events, ledger, run, today, rest_days).where(due).orderBy(F.desc("score"), "key").limit(room).select(events.columns)


def next_ledger(ledger: DataFrame, events: DataFrame, posted: DataFrame, run: int, today: int, rest_days: int = REST_DAYS, kept_runs: int = KEPT_RUNS) -> DataFrame:
    """The ledger after a run: what is true now is seen in it, what was posted carries today, and what both expiries pass is gone.

    In run 1 all that is true counts as posted. One full join by key and one left join; keys of events are distinct.
    """
    now = events.select("key", F.lit(run).alias("__now")).join(posted.select("key", F.lit(today).alias("__today")), "key", "left")
    rows = ledger.join(now, "key", "full")
    day = F.coalesce("__today", "posted_day", F.when(F.col("__now").isNotNull() & F.lit(run <= 1), today))
    seen = F.coalesce("__now", "seen_run")
    fresh = (F.lit(run) - seen < kept_runs) | F.coalesce(F.lit(today) - F.col("posted_day") < rest_days, F.lit(False))
    return rows.where(F.col("__now").isNotNull() | fresh).select("key", seen.cast("int").alias("seen_run"), day.cast("int").alias("posted_day"))
