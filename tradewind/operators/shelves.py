"""What a market's pages list from histories: products back in stock, moves of prices, sets worth watching, older sets still in stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.history import moves
from tradewind.operators.ranking import first_per


def returned(points: DataFrame, place: str, item: str, last: Column, days: int = 7, bulk: int = 25, share: float = 0.1) -> DataFrame:
    """(place, item, day, price, stores): what is in stock on `last` and came back within `days` up to it, with the latest such day.

    points (place, item, day, price, stores) are change points; a null price is a day with nothing in stock. The first point of a series
    is no return. Days of a place with more returns than `bulk` and than that share of its series, rounded up, are failed reads of
    the day before and left out. One window and one aggregate a series, counts of days joined.
    """
    w = Window.partitionBy(place, item).orderBy("day")
    turned = F.lag("day").over(w).isNotNull() & F.lag("price").over(w).isNull() & F.col("price").isNotNull()
    rows = points.where(F.col("day") <= last).withColumn("__back", turned & (F.col("day") > F.date_sub(last, days)))
    series = rows.groupBy(place, item).agg(F.max(F.when(F.col("__back"), F.col("day"))).alias("back"), F.max_by(F.struct("price", "stores"), "day").alias("now"))
    found = series.where("back is not null and now.price is not null")
    most = series.groupBy(place).agg(F.greatest(F.lit(bulk), F.ceil(F.count("*") * share)).alias("most"))
    usual = found.groupBy(place, "back").agg(F.count("*").alias("n")).join(most, place).where("n <= most").select(place, "back")
    return found.join(usual, [place, "back"]).select(place, item, F.col("back").alias("day"), "now.price", "now.stores")


def bounded_moves(points: DataFrame, key: list[str], last: Column, days: int = 7, percent: int = 10, cents: int = 500, ratio: float = 2) -> DataFrame:
    """(key, before, after, percent, stores) of series in stock on `last` and `days` before at prices that far apart in both measures, yet within a ratio."""
    found = moves(points, key, last, days)
    rise = F.col("after") - F.col("before")
    moved = found.withColumn("percent", F.floor(rise / F.col("before") * 100 + 0.5).cast("long"))
    kept = moved.where((F.abs("percent") >= percent) & (F.abs(rise) >= cents) & (F.col("after") <= F.col("before") * ratio) & (F.col("before") <= F.col("after") * ratio))
    return kept.select(*key, "before", "after", "percent", F.col("stores_after").alias("stores"))


def watched_sets(sets: DataFrame, stocked: DataFrame, place: str, hot: list[str], today: Column, newest: int = 6, most: int = 8) -> DataFrame:
    """(place, code, turn): the released sets a place watches, from 1: the named ones in order, then the newest, then those it has most of in stock.

    sets (code, day), codes once each; stocked (place, code, n), each pair once. A set that several lists give stands where the first has it. A
    set without a day is not released. Lists of places without stock are not made.
    """
    out = sets.where(F.col("day") <= today)
    named = out.join(F.broadcast(sets.sparkSession.createDataFrame(list(zip(hot, range(len(hot)))), "code string, at int")), "code").select("code", F.lit(0).alias("list"), "at")
    # a few rows by a limit
    recent = out.orderBy(F.desc("day"), "code").limit(newest)
    recent = recent.select("code", F.lit(1).alias("list"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("day"), "code")).alias("at"))
    shared = stocked.select(place).distinct().join(F.broadcast(named.unionByName(recent)))
    own = stocked.where("n > 0").join(out.select("code"), "code")
    own = first_per(own, [place], [F.desc("n"), F.asc("code")], most, "at").select(place, "code", F.lit(2).alias("list"), "at")
    first = shared.unionByName(own).groupBy(place, "code").agg(F.min(F.struct("list", "at")).alias("f"))
    return first.select(place, "code", F.row_number().over(Window.partitionBy(place).orderBy("f")).alias("turn"))


def older_by_set(cards: DataFrame, sets: DataFrame, place: str, cutoff: Column, kinds: list[str]) -> DataFrame:
    """(place, code, set_turn, set_stores, item, item_turn): what stores still have of sets released up to `cutoff`, of the kinds named.

    cards (place, code, item, kind, name, stores). Sets with most stores come first, then newer ones, then by code; in a set items with
    most stores, then by kind as listed, name and item. Rows stay flat: totals are combined before the shuffle, no set is gathered.
    """
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    rows = cards.where((F.col("stores") > 0) & (kind > 0)).join(sets.where(F.col("day") <= cutoff).select("code", "day"), "code")
    totals = rows.groupBy(place, "code", "day").agg(F.sum("stores").alias("set_stores"))
    turn = F.row_number().over(Window.partitionBy(place).orderBy(F.desc("set_stores"), F.desc("day"), "code"))
    within = F.row_number().over(Window.partitionBy(place, "code").orderBy(F.desc("stores"), kind, "name", "item"))
    placed = totals.withColumn("set_turn", turn).select(place, "code", "set_turn", "set_stores")
    return rows.withColumn("item_turn", within).join(placed, [place, "code"]).select(place, "code", "set_turn", "set_stores", "item", "item_turn")
