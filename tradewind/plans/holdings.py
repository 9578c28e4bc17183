"""Queries over what customers hold and wait for: worth on every look, typical prices by days, notices of stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.operators import history, holdings
from tradewind.plans.registry import query

KEY = ["market", "product_id"]
#: Stores up to this number are broadcast, some 50 MB; more are joined by a shuffle of all lines.
BROADCAST_STORES = 1_000_000
LAST = "DATE '1998-06-30'"
last = lambda: F.lit("1998-06-30").cast("date")

#: The lowest price in stock of a day and the stores that have it: null and none on days with sold out listings only.
STOCKED = """stocked AS (SELECT market, product_id, CAST(seen AS DATE) AS day, min(price) FILTER (in_stock) AS price,
  count(DISTINCT store) FILTER (in_stock) AS stores FROM listing JOIN store USING (store) GROUP BY 1, 2, 3)"""

#: What a customer orders is held from the day of the order, at the price paid; every seventh price is not known.
LOTS = """lots AS (SELECT o_custkey AS owner, market, l_partkey AS product_id, CAST(o_orderdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS qty,
  CASE WHEN l_orderkey % 7 <> 0 THEN CAST(floor(100 * l_extendedprice / l_quantity + 0.5) AS BIGINT) END AS cents
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN store ON store = l_suppkey)"""


def stocked(v):
    rows = v.listing.join(v.store, "store").withColumn("day", F.to_date("seen"))
    return history.daily_lows(rows, KEY, F.col("in_stock"), parts=v.more_parts("lineitem"))


def paid():
    return F.floor(F.lit(100) * F.col("l_extendedprice") / F.col("l_quantity") + 0.5).cast("long")


def lots(v):
    rows = v.raw("lineitem").join(v.raw("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(v.store, F.col("store") == F.col("l_suppkey"))
    return rows.select(
        F.col("o_custkey").alias("owner"), "market", F.col("l_partkey").alias("product_id"), F.to_date("o_orderdate").alias("day"),
        F.col("l_quantity").cast("long").alias("qty"), F.when(F.col("l_orderkey") % 7 != 0, paid()).alias("cents"),
    )


def placed_lots(v, stores):
    """lots() by place. Lines meet the stores first, so that only what a lot has is shuffled to the orders."""
    lines = v.raw("lineitem").join(stores, F.col("l_suppkey") == F.col("store")).select(
        "l_orderkey", "place", F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("qty"), F.when(F.col("l_orderkey") % 7 != 0, paid()).alias("cents"))
    orders = v.raw("orders").select("o_orderkey", F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("day"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("owner", "place", "product_id", "day", "qty", "cents")


def lows_in_stock(v, stores, parts):
    """(place, product_id, day, price): days on which the lowest price in stock changes. Days with sold out listings only have none, so these are not shuffled."""
    key = ["place", "product_id"]
    rows = v.listing.where("in_stock and price is not null").join(stores, "store").select(*key, F.to_date("seen").alias("day"), "price")
    lows = rows.repartition(*filter(None, [parts]), *key).groupBy(*key, "day").agg(F.min("price").alias("price"))
    return history.change_points(lows, key, values=("price",))


@query(f"""{LOTS},
{STOCKED},
prices AS (SELECT market, product_id, day, price FROM stocked WHERE price IS NOT NULL),
opening AS (SELECT market, product_id, arg_min(price, day) AS opening FROM prices GROUP BY 1, 2),
looks AS (SELECT DISTINCT owner, market, day FROM lots),
seen AS (SELECT k.owner, k.market, k.day, l.product_id, qty, cents FROM looks k JOIN lots l ON l.owner = k.owner AND l.market = k.market AND l.day <= k.day),
valued AS (SELECT s.*, coalesce(p.price, opening) AS price FROM seen s ASOF LEFT JOIN prices p ON p.market = s.market AND p.product_id = s.product_id AND p.day <= s.day
  LEFT JOIN opening o ON o.market = s.market AND o.product_id = s.product_id),
w AS (SELECT owner, market, day, CAST(sum(qty) AS BIGINT) AS units, CAST(coalesce(sum(qty * price), 0) AS BIGINT) AS worth,
  count(DISTINCT CASE WHEN price IS NULL THEN product_id END) AS unpriced,
  CAST(coalesce(sum(qty * cents) FILTER (price IS NOT NULL), 0) AS BIGINT) AS paid, CAST(coalesce(sum(qty * price) FILTER (cents > 0), 0) AS BIGINT) AS worth_paid FROM valued GROUP BY 1, 2, 3),
b AS (SELECT *, lag(day) OVER k AS last_day, lag(worth) OVER k AS last_worth FROM w WINDOW k AS (PARTITION BY owner, market ORDER BY day))
SELECT *, CASE WHEN last_worth > 0 THEN CAST(floor((worth - last_worth) / last_worth * 100 + 0.5) AS BIGINT) END AS percent,
  CASE WHEN paid > 0 THEN CAST(floor((worth_paid - paid) / paid * 100 + 0.5) AS BIGINT) END AS percent_added FROM b""")
def holdings_on_looks(v):
    """What each customer holds in a market is worth, on every day on which they ordered there, against the look before and what was paid."""
    # a place is the number of its market: names would be a third of what is shuffled
    names = F.broadcast(v.raw("region").agg(F.array_sort(F.collect_set("r_name")).alias("names")))
    stores = v.store.join(names).select("store", F.array_position("names", F.col("market")).cast("int").alias("place")).where("place is not null")
    if v.raw("supplier").count() <= BROADCAST_STORES:
        stores = F.broadcast(stores)
    parts = v.more_parts("lineitem")
    worth = holdings.worth_at(placed_lots(v, stores), lows_in_stock(v, stores, parts), None, "owner", "place", "product_id", parts)
    found = holdings.since_last(worth, "owner", "place").join(names)
    return found.select("owner", F.element_at("names", F.col("place")).alias("market"), *[c for c in found.columns if c not in ("owner", "place", "names")])


@query(f"""{STOCKED},
spans AS (SELECT *, lead(day) OVER (PARTITION BY market, product_id ORDER BY day) AS nxt FROM stocked WHERE day <= {LAST}),
days AS (SELECT CAST(unnest(generate_series({LAST} - INTERVAL 359 DAY, {LAST}, INTERVAL 1 DAY)) AS DATE) AS d),
t AS (SELECT market, product_id, CAST(floor(quantile_cont(price, 0.5) + 0.5) AS BIGINT) AS typical, count(*) AS n
  FROM spans JOIN days ON d >= day AND (nxt IS NULL OR d < nxt) WHERE price IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 7),
now AS (SELECT market, product_id, price FROM spans WHERE nxt IS NULL AND price IS NOT NULL),
u AS (SELECT market, product_id, price, typical, CAST(floor((typical - price) / typical * 100 + 0.5) AS BIGINT) AS percent FROM now JOIN t USING (market, product_id))
SELECT * FROM u WHERE percent >= 10 AND price * 2 >= typical""")
def under_own_typical(v):
    """Products in stock a tenth or more under the median of their own daily prices over 360 days."""
    return history.under_typical(history.change_points(stocked(v), KEY), KEY, last(), days=360)


@query(f"""{LOTS},
{STOCKED},
s AS (SELECT *, coalesce(lag(stores > 0) OVER k, false) AS was FROM stocked WINDOW k AS (PARTITION BY market, product_id ORDER BY day)),
turns AS (SELECT market, product_id, day AS opened, stores > 0 AS open, lead(day) OVER (PARTITION BY market, product_id ORDER BY day) AS closed FROM s WHERE (stores > 0) <> was),
ask AS (SELECT owner, market, product_id, min(day) AS since FROM lots GROUP BY 1, 2, 3),
told AS (SELECT owner, a.market, a.product_id, greatest(opened, since) AS day, closed AS rearmed FROM ask a JOIN turns t ON t.market = a.market AND t.product_id = a.product_id AND open AND (closed IS NULL OR closed > since))
SELECT owner, told.market, told.product_id, told.day, stocked.price, rearmed FROM told ASOF JOIN stocked ON stocked.market = told.market AND stocked.product_id = told.product_id AND stocked.day <= told.day""")
def restock_notices(v):
    """Customers wait for what they once ordered: when they are told that it is in stock, at which price, and when their watch is armed again."""
    watchers = lots(v).select("owner", *KEY, F.col("day").alias("since"))
    return holdings.notices(history.change_points(stocked(v), KEY), watchers, "owner", KEY)
