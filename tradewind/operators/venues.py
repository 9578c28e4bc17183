"""Buying in one place to sell in another: the best side of each, after what the place takes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.ranking import first_per


@dataclass(frozen=True)
class Venue:
    """A kind of place to sell in; `fee` in hundredths of a percent of the price. Of equal nets the smaller `turn` wins."""

    name: str
    fee: int
    turn: int


def net_of(price: Column, venue: Venue) -> Column:
    """What is left of a price, rounded half up."""
    return F.floor(price * (10_000 - venue.fee) / F.lit(10_000.0) + 0.5).cast("long")


def flips(asks: DataFrame, bids: DataFrame, venues: list[Venue], least_buy: int, least_net: int, most_margin: float) -> DataFrame:
    """asks (product_id, store, price) and bids (product_id, venue, store, price) -> (product_id, buy, buy_store, venue, sell_store, sell, net, margin).

    Buy: the lowest ask; sell: per venue the lowest price asked there, since that is what one has to match, and of the venues
    the one that leaves most. margin is net over buy in percent, to one decimal. What costs less than least_buy, leaves less than
    least_net, or promises more than most_margin (two different things, then) is dropped. Stores tie to the smallest. Each
    side is one grouped minimum; nothing is paired within a product.
    """
    side = lambda df, by: df.where("price is not null").groupBy(*by).agg(F.min(F.struct("price", "store")).alias("b"))
    buy = side(asks, ["product_id"]).select("product_id", F.col("b.price").alias("buy"), F.col("b.store").alias("buy_store")).where(F.col("buy") >= least_buy)
    sell = side(bids.where(F.col("venue").isin(*[v.name for v in venues])), ["product_id", "venue"])
    left = turn = None
    for v in venues:
        is_v = F.col("venue") == v.name
        left = F.when(is_v, net_of(F.col("b.price"), v)) if left is None else left.when(is_v, net_of(F.col("b.price"), v))
        turn = F.when(is_v, v.turn) if turn is None else turn.when(is_v, v.turn)
    best = sell.select("product_id", F.struct((-left).alias("less"), turn.alias("turn"), "venue", F.col("b.price").alias("sell"), F.col("b.store").alias("store")).alias("s"))
    best = best.groupBy("product_id").agg(F.min("s").alias("s"))
    rows = buy.join(best, "product_id").select("product_id", "buy", "buy_store", F.col("s.venue").alias("venue"), F.col("s.store").alias("sell_store"), F.col("s.sell").alias("sell"), (-F.col("s.less") - F.col("buy")).alias("net"))
    rows = rows.withColumn("margin", F.floor(F.col("net") * 1000 / F.col("buy") + 0.5) / 10)
    return rows.where((F.col("net") >= least_net) & (F.col("margin") <= most_margin))


def page_of(rows: DataFrame, by: str, page: int, size: int) -> DataFrame:
    """Page `page` from 1, by net or by margin, the other one breaking ties, then the product."""
    order = [F.desc("margin"), F.desc("net")] if by == "margin" else [F.desc("net"), F.desc("margin")]
    return rows.orderBy(*order, "product_id").offset((page - 1) * size).limit(size)


def cheapest_listing(rows: DataFrame, n: int) -> DataFrame:
    """The n cheapest asks of each product, by store where prices are equal."""
    return first_per(rows, ["product_id"], [F.asc("price"), F.asc("store")], n, "place")
