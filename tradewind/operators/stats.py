"""Offers, per-market summaries and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEAL_LOW, DEAL_HIGH, DEAL_STORES = 0.5, 0.9, 3


def best_offers(listing: DataFrame) -> DataFrame:
    """One listing for each product and store: in stock before sold out, then cheapest, then latest.

    A minimum over a struct, which Spark combines before the shuffle; a window would move every listing.
    """
    best = F.min(F.struct((~F.col("in_stock")).alias("out"), "price", (-F.unix_micros(F.col("seen").cast("timestamp"))).alias("age"), "seen")).alias("b")
    return listing.groupBy("product_id", "store").agg(best).select("product_id", "store", F.col("b.price").alias("price"), (~F.col("b.out")).alias("in_stock"), F.col("b.seen").alias("seen"))


def market_summary(offers: DataFrame) -> DataFrame:
    """Per product and market: lowest open price, stores in stock, stores listed, median of open prices where there are two.

    Offers are unique by product and store, so counting rows counts stores. A group has at most one row a store.
    """
    open_price = F.when(F.col("in_stock"), F.col("price"))
    return offers.groupBy("product_id", "market").agg(
        F.min(open_price).alias("lowest"), F.count_if("in_stock").alias("in_stock_stores"), F.count("*").alias("listed_stores"),
        F.when(F.count(open_price) >= 2, F.floor(F.percentile(open_price, 0.5) + 0.5).cast("long")).alias("median_open"),
    )


def full_summary(offers: DataFrame, marketplace: Column, dormant: DataFrame, fresh: Column) -> DataFrame:
    """market_summary() with marketplaces and dormant stores told apart, and `marketplace_open`.

    An offer is open if it is in stock and `fresh` holds. lowest is the cheapest open offer of any kind; stores in stock and the
    median are of independent stores only, and a marketplace sets marketplace_open instead; listed stores leave out marketplaces
    and the stores of `dormant` (store). Offers are unique by product and store.
    """
    asleep = dormant.select("store", F.lit(True).alias("__asleep")).distinct()
    rows = offers.join(asleep, "store", "left").withColumn("__open", F.col("in_stock") & fresh).withColumn("__market", marketplace)
    own = F.when(F.col("__open") & ~F.col("__market"), F.col("price"))
    return rows.groupBy("product_id", "market").agg(
        F.min(F.when(F.col("__open"), F.col("price"))).alias("lowest"), F.count(own).alias("in_stock_stores"), F.count_if(~F.col("__market") & F.col("__asleep").isNull()).alias("listed_stores"),
        F.bool_or(F.col("__open") & F.col("__market")).alias("marketplace_open"), F.when(F.count(own) >= 2, F.floor(F.percentile(own, 0.5) + 0.5).cast("long")).alias("median_open"),
    )


def is_open() -> Column:
    return F.col("in_stock_stores") > 0


def is_comparable() -> Column:
    return is_open() | (F.col("listed_stores") >= 2)


def is_deal() -> Column:
    """In three stores or more, at 50 to 90 percent of the median."""
    return (F.col("in_stock_stores") >= DEAL_STORES) & (F.col("lowest") >= F.col("median_open") * DEAL_LOW) & (F.col("lowest") <= F.col("median_open") * DEAL_HIGH)


def deal_order() -> list[Column]:
    return [(F.col("lowest") / F.col("median_open")).asc(), F.col("lowest").asc(), F.col("slug").asc()]


def deals(cards: DataFrame, market: str, n: int) -> DataFrame:
    """The n best deals of a market: a sort with a limit, which Spark runs as a bounded top-k."""
    return cards.where((F.col("market") == market) & is_deal()).orderBy(*deal_order()).limit(n)


def store_counts(offers: DataFrame) -> DataFrame:
    return offers.groupBy("store", "market").agg(F.count("*").alias("listed"), F.count_if("in_stock").alias("open"))


def dormant_stores(offers: DataFrame, least: int) -> DataFrame:
    """Stores with `least` listings or more, none of them in stock."""
    return store_counts(offers).where((F.col("listed") >= least) & (F.col("open") == 0))


def price_verdict(price: Column, median: Column) -> Column:
    """Where a price stands against the median: bands at 50, 90, 110 and 150 percent."""
    return (
        F.when(median.isNull(), "unknown").when(price * 2 < median, "suspect").when(price * 10 < median * 9, "good")
        .when(price * 10 <= median * 11, "fair").when(price * 2 <= median * 3, "high").otherwise("far over")
    )
