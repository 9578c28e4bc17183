"""What a page shows of its subject, as one nested row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.ranking import first_per

MOST_OFFERS = 200


def product_pages(products: DataFrame, offers: DataFrame, stats: DataFrame, foreign: Column, most: int = MOST_OFFERS) -> DataFrame:
    """products (id, ..) plus `markets`: array<struct<market, lowest, stores, offers: array<struct<store, price, in_stock>>>>, and `abroad`.

    offers has (product_id, market, store, price, in_stock). Of each product and market the first `most` by stock, price and store are
    kept, cut in a window before anything is gathered; those are the only rows of offers that are collected. Offers for which `foreign`
    holds stand apart: the best of a product is `abroad` (struct or null) and none is in `markets`. Markets stand by name,
    offers as they are ranked; a product without offers has an empty array. stats has (product_id, market, lowest, in_stock_stores).
    """
    order = [F.desc("in_stock"), F.asc("price"), F.asc("store")]
    away = F.coalesce(foreign, F.lit(False))
    here = first_per(offers.where(~away), ["product_id", "market"], order, most, "place")
    listed = F.sort_array(F.collect_list(F.struct("place", "store", "price", "in_stock")))
    inner = here.groupBy("product_id", "market").agg(F.transform(listed, lambda x: F.struct(x["store"].alias("store"), x["price"].alias("price"), x["in_stock"].alias("in_stock"))).alias("offers"))
    known = inner.join(stats.select("product_id", "market", "lowest", F.col("in_stock_stores").alias("stores")), ["product_id", "market"], "left")
    outer = known.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("market", "lowest", "stores", "offers"))).alias("markets"))
    best = first_per(offers.where(away), ["product_id"], order).select("product_id", F.struct("market", "store", "price", "in_stock").alias("abroad"))
    rows = products.join(outer.withColumnRenamed("product_id", "id"), "id", "left").join(best.withColumnRenamed("product_id", "id"), "id", "left")
    kind = stats.schema["lowest"].dataType.simpleString(), stats.schema["in_stock_stores"].dataType.simpleString(), offers.schema["store"].dataType.simpleString(), offers.schema["price"].dataType.simpleString()
    none = F.array().cast("array<struct<market:string,lowest:{},stores:{},offers:array<struct<store:{},price:{},in_stock:boolean>>>>".format(*kind))
    return rows.withColumn("markets", F.coalesce("markets", none))
