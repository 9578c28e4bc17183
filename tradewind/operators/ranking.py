"""Top-k within groups, paging orders, interleaving and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group in a full order. Spark cuts groups before the shuffle (WindowGroupLimit)."""
    name = rank or "__rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def mode_of(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most common value of each group; ties go to the largest value. Counts first, so nothing is gathered."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*by).agg(F.max(F.struct("__n", value)).alias("__m")).select(*by, F.col(f"__m.{value}").alias(value), F.col("__m.__n").alias("n"))


def capped(df: DataFrame, by: str, order: list[Column], per_group: int, total: int) -> DataFrame:
    """At most per_group of a group, and `total` in all, in order."""
    return first_per(df, [by], order, per_group).orderBy(*order).limit(total)


def listed_first(col: str, names: list[str]) -> Column:
    """Position in a given list, null (sort it last) for what is not in it."""
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(col)), F.lit(0))


def interleave(df: DataFrame, lists: str, order: list[Column], key: list[str]) -> DataFrame:
    """Round robin: the first of each list, then the second of each; of rows alike in `key` the earliest stays. Adds `turn`."""
    turned = df.withColumn("turn", F.row_number().over(Window.partitionBy(lists).orderBy(*order)))
    return first_per(turned, key, [F.col("turn"), F.col(lists)])


def neighbours(df: DataFrame, by: list[str], order: list[Column], at: Column, width: int) -> DataFrame:
    """`width` rows around the row where `at` holds, without it; the window slides inwards at the ends.

    Groups without such a row give none. The position of the row is one number a group, joined back.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn("__i", F.row_number().over(w))
    here = numbered.groupBy(*by).agg(F.max(F.when(at, F.col("__i"))).alias("__at"), F.count("*").alias("__n"))
    start = F.greatest(F.lit(1), F.least(F.col("__at") - width // 2, F.col("__n") - width))
    near = numbered.join(here, by).where((F.col("__i") >= start) & (F.col("__i") <= start + width) & (F.col("__i") != F.col("__at")))
    return near.drop("__i", "__at", "__n")


def grid_order(sort: str, relevance: list[Column]) -> list[Column]:
    """The order of a grid of cards (lowest, in_stock_stores, median_open, per_pack, released, type_place, marketplace_open).

    `price up` and `price down` put what is not open last; `per pack` and `saving` put last what has none, then go by price;
    `stores` counts stores only, so what only a marketplace has follows, cheapest first; `newest` goes by release, then type. All end in
    the order of relevance, which must be full; `relevance` is that order itself.
    """
    is_open = (F.col("in_stock_stores") > 0) | F.col("marketplace_open")
    price = F.when(is_open, F.col("lowest"))
    saving = F.when(is_open & (F.col("median_open") > 0) & (F.col("lowest") < F.col("median_open")), F.col("lowest") / F.col("median_open"))
    orders = {
        "relevance": [], "price up": [price.asc_nulls_last()], "price down": [price.desc_nulls_last()],
        "per pack": [F.when(is_open, F.col("per_pack")).asc_nulls_last(), price.asc_nulls_last()], "saving": [saving.asc_nulls_last(), price.asc_nulls_last()],
        "stores": [F.desc("in_stock_stores"), price.asc_nulls_last()], "newest": [F.col("released").desc_nulls_last(), F.col("type_place").asc_nulls_last()],
    }
    return orders[sort] + relevance


def alternatives(wanted: DataFrame, cards: DataFrame, fallback: Column, n: int) -> DataFrame:
    """wanted (id, product_type, set_code) and open cards (product_id, product_type, set_code, set_place, lowest) -> (id, product_id, place): n a row.

    Open products of the same type, never the row itself: of its own set first, then by set_place (nulls last), then cheapest. A row whose
    type has none gets the cheapest cards for which `fallback` holds. Only the first n + 1 of each type and set, and of each type, can
    be shown, so cards are cut to those before they meet the wanted rows, and a hot type stays a short list.
    """
    key, order = F.col("product_id"), [F.col("set_place").asc_nulls_last(), F.col("lowest").asc_nulls_last(), F.asc("product_id")]
    own = first_per(cards, ["product_type", "set_code"], order, n + 1).select("product_type", F.col("set_code").alias("s"), "product_id", "set_place", "lowest")
    every = first_per(cards, ["product_type"], order, n + 1).select("product_type", F.col("set_code").alias("s"), "product_id", "set_place", "lowest")
    same = wanted.join(own, ["product_type"]).where((F.col("s") == F.col("set_code")) & (F.col("product_id") != F.col("id")))
    other = wanted.join(every, ["product_type"]).where(F.col("product_id") != F.col("id"))
    both = same.unionByName(other).dropDuplicates(["id", "product_id"])
    found = first_per(both, ["id"], [F.coalesce(F.col("s") == F.col("set_code"), F.lit(False)).desc(), *order], n, "place").select("id", "product_id", "place")
    # n + 1 rows for all that are left
    spare = cards.where(fallback).orderBy(F.col("lowest").asc_nulls_last(), key).limit(n + 1).select("product_id", "lowest")
    rest = wanted.join(found.select("id").distinct(), "id", "left_anti").join(F.broadcast(spare), F.col("product_id") != F.col("id"))
    return found.unionByName(first_per(rest, ["id"], [F.col("lowest").asc_nulls_last(), key], n, "place").select("id", "product_id", "place"))


def kept_in_focus(products: DataFrame, offers: DataFrame, wanted: DataFrame, fresh: Column, minor: Column) -> DataFrame:
    """products (id, slug, product_type, ..) plus `kept` and `goes_to`, the type whose page takes over what is dropped.

    A product stays if its slug is wanted, its set is fresh, two stores or more have it in stock in one market, or it is of no minor type
    and anyone lists it.
    """
    by_market = offers.groupBy("product_id", "market").agg(F.count("*").alias("listed"), F.count_if("in_stock").alias("open"))
    most = by_market.groupBy("product_id").agg(F.sum("listed").alias("listed"), F.max("open").alias("most"))
    rows = products.join(most, F.col("id") == F.col("product_id"), "left").join(wanted.select("slug", F.lit(True).alias("__wanted")).distinct(), "slug", "left")
    kept = F.coalesce("__wanted", F.lit(False)) | F.coalesce(fresh, F.lit(False)) | F.coalesce(F.col("most") >= 2, F.lit(False)) | (~minor & F.coalesce(F.col("listed") > 0, F.lit(False)))
    return rows.select(*products.columns, kept.alias("kept"), F.when(~kept, F.col("product_type")).alias("goes_to"))
