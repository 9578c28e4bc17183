"""The domain's tables, derived from the generic ones: stores, products, offers, per-market summaries, price history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.history import daily_lows
from tradewind.operators.query import Catalog, Model, Relation
from tradewind.operators.stats import best_offers, market_summary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x):
    return F.floor(x + 0.5).cast("long")

#: Rows of a table that a task sorts or counts at once; some 50 MB a sort.
ROWS_A_TASK = 500_000


class Views:
    """Each property is a fresh plan over the Parquet tables, so only the columns in use are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def parts(self, name: str) -> int:
        """So many partitions that each has ROWS_A_TASK rows of a table; the count reads only footers of files."""
        return self.raw(name).count() // ROWS_A_TASK + 1

    def more_parts(self, name: str) -> int | None:
        """parts() if they are more than the cores or the session's partitions, else None: few rows are left to adaptive execution."""
        parts = self.parts(name)
        return parts if parts > min(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))) else None

    @property
    def store(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        # nation and region have a fixed number of rows
        places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("r_name").alias("market"))
        return s.join(places, s["s_nationkey"] == places["n_nationkey"]).select(F.col("s_suppkey").alias("store"), "market")

    @property
    def product(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("name"),
            F.col("p_type").alias("product_type"), F.col("p_brand").alias("set_code"), F.col("p_size").alias("size"), cents(F.col("p_retailprice") * 100).alias("msrp"),
        )

    @property
    def listing(self) -> DataFrame:
        """All listings ever seen; several for a product and store."""
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("store"), cents(F.lit(100) * F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            (F.col("l_linestatus") == "O").alias("in_stock"), F.col("l_shipdate").alias("seen"),
        )

    @property
    def offer(self) -> DataFrame:
        return best_offers(self.listing).join(self.store, "store").select("product_id", "store", "market", "price", "in_stock", "seen")

    @property
    def stat(self) -> DataFrame:
        return market_summary(self.offer)

    @property
    def card(self) -> DataFrame:
        """A summary with its product's columns."""
        return self.stat.join(self.product, F.col("product_id") == F.col("id")).drop("id")

    @property
    def listed(self) -> DataFrame:
        """(market, product_id, day, store, price): listings of known stores by day."""
        return self.listing.join(self.store, "store").select("market", "product_id", F.to_date("seen").alias("day"), "store", "price")

    @property
    def history(self) -> DataFrame:
        """(market, product_id, day, price, stores): the lowest price and the number of stores of a day."""
        return daily_lows(self.listed, ["market", "product_id"], parts=self.more_parts("lineitem"))

    @property
    def catalog(self) -> Catalog:
        return Catalog(
            Model("Product", self.product, ["id"], {"offers": Relation("Offer", True, "id", "product_id"), "stats": Relation("Stat", True, "id", "product_id")}),
            Model("Offer", self.offer, ["product_id", "store"], {"product": Relation("Product", False, "product_id", "id")}),
            Model("Stat", self.stat, ["product_id", "market"], {"product": Relation("Product", False, "product_id", "id")}),
            Model("Customer", self.raw("customer"), ["c_custkey"], private=True),
        )


#: The same tables for DuckDB, as common table expressions.
SQL = """
WITH store AS (
  SELECT s_suppkey AS store, r_name AS market FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
product AS (
  SELECT p_partkey AS id, p_name || '-' || p_partkey AS slug, p_name AS name, p_type AS product_type, p_brand AS set_code, p_size AS size,
         CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS msrp FROM part),
listing AS (
  SELECT l_partkey AS product_id, l_suppkey AS store, CAST(floor(100 * l_extendedprice / l_quantity + 0.5) AS BIGINT) AS price,
         l_linestatus = 'O' AS in_stock, l_shipdate AS seen FROM lineitem),
offer AS (
  SELECT product_id, store, market, price, in_stock, seen FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, store ORDER BY in_stock DESC, price, seen DESC) AS rn FROM listing)
  JOIN store USING (store) WHERE rn = 1),
stat AS (
  SELECT product_id, market, min(price) FILTER (in_stock) AS lowest, count(DISTINCT store) FILTER (in_stock) AS in_stock_stores,
         count(DISTINCT store) AS listed_stores,
         CASE WHEN count(*) FILTER (in_stock) >= 2 THEN CAST(floor(quantile_cont(price, 0.5) FILTER (in_stock) + 0.5) AS BIGINT) END AS median_open
  FROM offer GROUP BY 1, 2),
card AS (SELECT stat.*, slug, name, product_type, set_code, size, msrp FROM stat JOIN product ON product_id = id),
history AS (
  SELECT market, product_id, CAST(seen AS DATE) AS day, min(price) AS price, count(DISTINCT store) AS stores
  FROM listing JOIN store USING (store) GROUP BY 1, 2, 3)
"""
