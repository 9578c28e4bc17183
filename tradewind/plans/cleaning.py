"""Queries over the cleaning passes, merges and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import calc
from tradewind.functions import text as tx
from tradewind.operators import matching, merge, quality
from tradewind.plans.registry import query

BY = ["product_id", "market"]

MID = """mid AS (SELECT product_id, market, quantile_cont(price, 0.5) FILTER (in_stock) AS mid, count(*) FILTER (in_stock) AS n FROM offer GROUP BY 1, 2)"""


@query(f"{MID}\nSELECT o.* FROM offer o JOIN mid USING (product_id, market) WHERE NOT coalesce(in_stock AND n >= 3 AND price * 4 < mid, false)")
def low_outliers_dropped(v):
    return quality.drop_low_outliers(v.offer, BY)


@query(f"{MID}\nSELECT o.* FROM offer o JOIN mid USING (product_id, market) WHERE NOT coalesce(n >= 3 AND price > mid * 1.5, false)")
def high_outliers_dropped(v):
    return quality.drop_high_outliers(v.offer, BY, F.lit(1.5))


@query(f"{MID},\nj AS (SELECT store, count(*) AS judged, count(*) FILTER (price * 2 < mid) AS low FROM offer JOIN mid USING (product_id, market) WHERE in_stock AND n >= 3 GROUP BY 1)\nSELECT store, judged, low FROM j WHERE low >= 1 AND low * 100 >= judged * 1")
def suspect_stores(v):
    return quality.suspect_stores(v.offer, BY, 1, 1)


@query(f"""{MID},
j AS (SELECT store, count(*) AS judged, count(*) FILTER (price * 2 < mid) AS low FROM offer JOIN mid USING (product_id, market) WHERE in_stock AND n >= 3 GROUP BY 1)
SELECT product_id, o.store, market, price, in_stock AND coalesce(low * 100 < judged * 3, true) AS in_stock, seen FROM offer o LEFT JOIN j ON o.store = j.store""")
def suspect_stores_demoted(v):
    return quality.demote(v.offer, quality.suspect_stores(v.offer, BY, 0, 3))


@query(f"""{MID}
SELECT product_id, store, market, price, in_stock AND NOT coalesce(regexp_matches(CAST(price AS VARCHAR), '^9+$') AND (price * 2 < mid OR price * 2 > mid * 3), false) AS in_stock, seen FROM offer JOIN mid USING (product_id, market)""")
def placeholders_demoted(v):
    return quality.demote_placeholders(v.offer, BY)


def _two_reads(v):
    """Today's offers, and yesterday's: the stores of one market list no sold-out ones any more."""
    return v.offer.where("in_stock or market <> 'ASIA'"), v.offer


@query("""new AS (SELECT * FROM offer WHERE in_stock OR market <> 'ASIA'),
bad AS (SELECT store FROM (SELECT store, count(*) AS was FROM offer GROUP BY 1) LEFT JOIN (SELECT store, count(*) AS n FROM new GROUP BY 1) USING (store) WHERE coalesce(n, 0) * 100 < was * 50)
SELECT * FROM new WHERE store NOT IN (SELECT store FROM bad) UNION ALL SELECT * FROM offer WHERE store IN (SELECT store FROM bad)""")
def coverage_guarded(v):
    return quality.coverage_guard(*_two_reads(v), "store")


@query("SELECT id, name, msrp + CASE WHEN product_type = 'PROMO' THEN 5 ELSE 0 END AS msrp, CASE WHEN size <= 5 THEN 'insert' WHEN product_type = 'PROMO' THEN 'update' ELSE 'same' END AS change FROM product")
def upsert_diff(v):
    fresh = v.product.select("id", "name", (F.col("msrp") + F.when(F.col("product_type") == "PROMO", 5).otherwise(0)).alias("msrp"))
    return merge.upsert_diff(v.product.where("size > 5").select("id", "name", "msrp"), fresh, "id")


@query("""SELECT id, msrp FROM product WHERE product_type = 'PROMO' UNION ALL SELECT id, msrp - 1 FROM product WHERE product_type <> 'PROMO' AND size <= 30""")
def snapshot_merged(v):
    fresh, stored = v.product.where("product_type = 'PROMO'").select("id", "msrp"), v.product.select("id", (F.col("msrp") - 1).alias("msrp"), "size")
    return merge.merged(stored, fresh, "id", F.col("size") > 30)


@query("""a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT k, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT k, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def multiset_differences(v):
    k = F.col("o_custkey").alias("k")
    return merge.differences(v.raw("orders").where("o_orderstatus = 'O'").select(k), v.raw("orders").where("o_orderstatus = 'F'").select(k))


@query("""v AS (SELECT product_id AS entity, product_id % 50 AS old, CASE WHEN (store * 7 + product_id) % 3 = 0 THEN product_id % 50 ELSE (product_id + 1) % 50 END AS nw FROM offer),
c AS (SELECT entity, old, nw, count(*) AS n FROM v GROUP BY 1, 2, 3), t AS (SELECT entity, count(*) AS total FROM v GROUP BY 1),
w AS (SELECT entity, old, nw, n, row_number() OVER (PARTITION BY nw ORDER BY n DESC, entity) AS rn FROM c JOIN t USING (entity) WHERE n * 2 > total AND nw <> old)
SELECT entity, old, nw AS new FROM w WHERE rn = 1""")
def voted_moves(v):
    p = F.col("product_id")
    new = F.when((F.col("store") * 7 + p) % 3 == 0, p % 50).otherwise((p + 1) % 50)
    return quality.moved_keys(v.offer.select(p.alias("entity"), (p % 50).alias("old"), new.alias("new")))


TITLES = """l AS (SELECT p_partkey AS listing, p_type AS block, list_sort(list_distinct(string_split(lower(p_name || CASE WHEN p_size > 25 THEN ' extra' ELSE '' END), ' '))) AS tokens FROM part),
p AS (SELECT min(p_partkey) AS product, p_type AS block, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS tokens FROM part WHERE p_size <= 30 GROUP BY p_type, list_sort(list_distinct(string_split(lower(p_name), ' '))))"""


@query(f"""{TITLES},
e AS (SELECT listing, product, 'exact' AS how FROM l JOIN p USING (block, tokens)),
f AS (SELECT listing, product, len(p.tokens) AS n FROM l JOIN p ON l.block = p.block AND list_has_all(l.tokens, p.tokens) WHERE listing NOT IN (SELECT listing FROM e)),
m AS (SELECT listing, max(n) AS n FROM f GROUP BY 1),
t AS (SELECT listing, count(*) AS k, min(product) AS product FROM f JOIN m USING (listing, n) GROUP BY 1)
SELECT * FROM e UNION ALL SELECT listing, CASE WHEN k = 1 THEN product END, CASE WHEN k = 1 THEN 'contained' ELSE 'ambiguous' END FROM t""")
def titles_matched(v):
    part = v.raw("part")
    title = F.when(F.col("p_size") > 25, F.concat(F.col("p_name"), F.lit(" extra"))).otherwise(F.col("p_name"))
    listings = part.select(F.col("p_partkey").alias("listing"), F.col("p_type").alias("block"), tx.tokens(title).alias("tokens"))
    products = part.where("p_size <= 30").groupBy(F.col("p_type").alias("block"), tx.tokens(F.col("p_name")).alias("tokens")).agg(F.min("p_partkey").alias("product"))
    return matching.match(listings, products)


@query("""SELECT c_custkey, bought, CAST(floor((least(bought, 100000) * 1300 + greatest(0, least(bought, 20000000) - 100000) * 900 + greatest(0, bought - 20000000) * 200) / 10000 + 0.5) AS BIGINT) + 30 AS fee
FROM (SELECT o_custkey AS c_custkey, CAST(floor(max(o_totalprice) * 100 + 0.5) AS BIGINT) AS bought FROM orders GROUP BY 1)""")
def seller_fees(v):
    spent = v.raw("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(calc.half_up(F.max("o_totalprice") * 100).alias("bought"))
    return spent.withColumn("fee", calc.tiered_fee(F.col("bought"), [(100_000, 1300), (20_000_000, 900), (1 << 50, 200)], 30))


@query("""SELECT product_id, store, CASE WHEN median_open > 0 THEN CAST(floor((price - median_open) * 100 / median_open + 0.5) AS BIGINT) END AS pct,
CASE WHEN abs(price - lowest) * 50 <= greatest(price, lowest) THEN 'even' WHEN lowest > price THEN 'gain' ELSE 'loss' END AS balance FROM offer JOIN stat USING (product_id, market) WHERE lowest IS NOT NULL""")
def offers_against_market(v):
    o = v.offer.join(v.stat, BY).where("lowest is not null")
    return o.select("product_id", "store", calc.percent_of(F.col("price"), F.col("median_open")).alias("pct"), calc.trade_balance(F.col("price"), F.col("lowest")).alias("balance"))


@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) - INTERVAL 6 MONTH AS DATE) + CAST(day(o_orderdate) - 1 AS INT) AS back FROM orders""")
def six_months_back(v):
    return v.raw("orders").select("o_orderkey", calc.js_months_back(F.to_date("o_orderdate"), 6).alias("back"))


@query(f"""{MID},
kept AS (SELECT o.* FROM offer o JOIN mid USING (product_id, market) WHERE in_stock AND NOT coalesce(n >= 3 AND price * 4 < mid * 3, false)),
real AS (SELECT product_id, market, min(price) AS real FROM kept GROUP BY 1, 2)
SELECT market, count(*) AS headlines, count(*) FILTER (lowest < real) AS violations FROM stat JOIN real USING (product_id, market) GROUP BY 1""")
def gate_headline_is_real(v):
    """Headlines below every price that stands near its product's median: each is a violation."""
    near = quality.drop_low_outliers(v.offer.where("in_stock"), BY, 0.75)
    real = near.groupBy(*BY).agg(F.min("price").alias("real"))
    found = v.stat.where("lowest is not null").join(real, BY)
    return found.groupBy("market").agg(F.count("*").alias("headlines"), F.count_if(F.col("lowest") < F.col("real")).alias("violations"))
