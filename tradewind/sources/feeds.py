"""Store feeds: JSON product lists and product grids in HTML, to one row for each offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.text import decode_entities, money_cents

FEED = """products array<struct<id:bigint, handle:string, title:string, vendor:string,
  variants:array<struct<id:bigint, title:string, price:string, available:boolean>>, images:array<struct<src:string>>>>"""


def read_json_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row for each product of the feed files: handle, title, the cheapest price in stock (else the cheapest) and its availability.

    The schema is given, so files are read once; a broken file gives no products.
    """
    files = spark.read.schema(FEED).option("multiLine", True).json(path)
    products = files.select(F.inline("products"))
    priced = F.transform(F.coalesce("variants", F.array()), lambda v: F.struct((~F.coalesce(v["available"], F.lit(False))).alias("out"), F.floor(v["price"].try_cast("double") * 100 + 0.5).cast("long").alias("cents")))
    best = F.array_min(F.filter(priced, lambda v: v["cents"].isNotNull()))
    return products.select("handle", "title", best["cents"].alias("price"), (~best["out"]).alias("in_stock"), F.get(F.col("images"), F.lit(0))["src"].alias("image"))


def cards_of(html: Column, split: str) -> Column:
    """The pieces of a page that start where `split` matches."""
    return F.filter(F.split(html, f"(?={split})"), lambda part: part.rlike(f"^(?:{split})"))


def parse_grid(pages: DataFrame, split: str = r'<article class="card') -> DataFrame:
    """(url, html) -> (url, title, link, price, in_stock): one row for each card that has a title and a price."""
    card = pages.select("url", F.explode(cards_of(F.col("html"), split)).alias("c"))
    part = lambda pattern: F.nullif(F.regexp_extract("c", pattern, 1), F.lit(""))
    found = card.select(
        "url", part(r'<h[1-6][^>]*>\s*(?:<a[^>]*>)?\s*([^<]+)').alias("raw"), part(r'href="([^"]+)"').alias("link"),
        money_cents(part(r'class="price[^"]*"[^>]*>\s*([^<]+)')).alias("price"), (~F.col("c").rlike("(?i)sold ?out|out of stock")).alias("in_stock"),
    ).where("raw is not null and price is not null")
    return found.withColumn("title", F.trim(decode_entities(F.col("raw")))).drop("raw")


def parse_boxes(pages: DataFrame, split: str = r'<div class="card product-box\b') -> DataFrame:
    """(url, html) -> (url, title, link, price, in_stock), for themes that put title and link into the name's own tag.

    A box without a name, a link or a price is passed over. It is in stock if it can be bought and does not offer to notify.
    """
    box = pages.select("url", F.explode(cards_of(F.col("html"), split)).alias("c"))
    box = box.withColumn("name", F.regexp_extract("c", r"<a\s([^>]*\bproduct-name\b[^>]*)>", 1))
    part = lambda of, pattern: F.nullif(F.regexp_extract(of, pattern, 1), F.lit(""))
    found = box.select(
        "url", part("name", r'\btitle="([^"]*)"').alias("raw"), decode_entities(part("name", r'\bhref="([^"]+)"')).alias("link"),
        money_cents(part("c", r'class="product-price[^>]*>\s*([^<]+)')).alias("price"), (F.col("c").contains("btn-buy") & ~F.col("c").contains("stock-notify")).alias("in_stock"),
    ).where("raw is not null and link is not null and price is not null")
    title = F.trim(F.regexp_replace(decode_entities(F.col("raw")), r"\s+", " "))
    return found.select("url", title.alias("title"), "link", "price", "in_stock")


def link_sources(pages: DataFrame) -> DataFrame:
    """Addresses in <loc> elements of site maps."""
    return pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc"))


#: What is read of a product in the pages of a shop's category.
CATEGORY = """id bigint, name string, permalink string, is_in_stock boolean, prices struct<price:string, currency_code:string, currency_minor_unit:int>,
  images array<struct<src:string>>, categories array<struct<id:bigint, slug:string>>"""


def read_category_feed(spark: SparkSession, path: str, category: str, currency: str | None = None) -> DataFrame:
    """Pages of JSON arrays of products -> (id, title, link, price, in_stock, image) of those in the category.

    Prices come in the smallest unit of their currency, whose digits are given: they become cents. A product without a price, or in
    another currency than the one asked for, is passed over. A product that stands on two pages, because the list moved meanwhile,
    is taken once: in stock before sold out, then cheapest. A broken file gives no products.
    """
    rows = spark.read.schema(CATEGORY).option("multiLine", True).json(path)
    rows = rows.where(F.exists("categories", lambda c: c["slug"] == category) & F.col("id").isNotNull())
    unit = F.coalesce("prices.currency_minor_unit", F.lit(2))
    cents = F.floor(F.col("prices.price").try_cast("double") * F.pow(F.lit(10.0), 2 - unit) + 0.5).cast("long")
    rows = rows.where(F.col("prices.currency_code") == currency) if currency else rows
    priced = rows.select(
        "id", F.trim(decode_entities(F.col("name"))).alias("title"), F.col("permalink").alias("link"), cents.alias("price"),
        F.coalesce("is_in_stock", F.lit(False)).alias("in_stock"), F.get(F.col("images"), F.lit(0))["src"].alias("image"),
    ).where("price is not null")
    best = F.min(F.struct((~F.col("in_stock")).alias("out"), "price", "title", "link", "image")).alias("b")
    return priced.groupBy("id").agg(best).select("id", F.col("b.title").alias("title"), F.col("b.link").alias("link"), F.col("b.price").alias("price"), (~F.col("b.out")).alias("in_stock"), F.col("b.image").alias("image"))


#: What is read of a page of a catalogue.
CATALOGUE = "total bigint, page bigint, items array<struct<productId:bigint, productName:string, setName:string, marketPrice:double, lowestPrice:double, listings:bigint>>"


class BrokenRead(ValueError):
    """The pages lack more of the catalogue than a list that moves while it is read can lose."""


def read_catalogue(spark: SparkSession, path: str, least_share: float = 0.98) -> DataFrame:
    """Pages of a catalogue -> (id, name, set_name, market, lowest, listings), each product as its last page has it.

    The size of the catalogue is the largest total that any page tells, since a broken page tells a smaller one. Fewer products than
    least_share of it, or none, is a BrokenRead: a catalogue without its last pages would pass for one that sells them no more.
    """
    pages = spark.read.schema(CATALOGUE).option("multiLine", True).json(path)
    items = pages.select("page", F.inline("items")).where(F.col("productId").isNotNull())
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    rows = items.select(F.col("productId").alias("id"), F.struct("page", F.col("productName").alias("name"), F.col("setName").alias("set_name"), cents("marketPrice").alias("market"), cents("lowestPrice").alias("lowest"), "listings").alias("r"))
    last = rows.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.name", "r.set_name", "r.market", "r.lowest", "r.listings")
    expected = pages.agg(F.max("total")).first()[0] or 0
    found = last.count()
    if not found or found < expected * least_share:
        raise BrokenRead(f"{found} of {expected} products")
    return last
