"""Queries over the declarative reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.operators.query import Read
from tradewind.plans.registry import query


def read(v):
    return Read(v.catalog)


@query("SELECT id, slug, msrp FROM product WHERE id IN (3, 7, 11, 5000000)")
def read_index_lookup(v):
    return read(v).find_many("Product", {"id": {"in": [3, 7, 11, 5_000_000]}}, select={"id": True, "slug": True, "msrp": True})


@query("SELECT id, name, msrp FROM product WHERE product_type = 'ECONOMY' AND NOT (set_code = 'Brand#13') AND msrp >= 95000 AND msrp < 120000 AND name LIKE '%widget%'")
def read_scalar_filters(v):
    where = {"product_type": "ECONOMY", "set_code": {"not": "Brand#13"}, "msrp": {"gte": 95_000, "lt": 120_000}, "name": {"contains": "widget"}}
    return read(v).find_many("Product", where, select={"id": True, "name": True, "msrp": True})


@query("SELECT id, name FROM product WHERE lower(name) LIKE 'cold%' OR (set_code NOT IN ('Brand#1', 'Brand#2') AND name LIKE '%gear')")
def read_or_insensitive(v):
    where = {"OR": [{"name": {"startsWith": "COLD", "mode": "insensitive"}}, {"set_code": {"notIn": ["Brand#1", "Brand#2"]}, "name": {"endsWith": "gear"}}]}
    return read(v).find_many("Product", where, select={"id": True, "name": True})


@query("SELECT product_id, market FROM stat WHERE NOT (lowest < 100000) AND median_open IS NOT NULL")
def read_not_is_three_valued(v):
    return read(v).find_many("Stat", {"NOT": {"lowest": {"lt": 100_000}}, "median_open": {"not": None}}, select={"product_id": True, "market": True})


@query("SELECT product_id, market, listed_stores FROM stat WHERE lowest IS NULL")
def read_is_null(v):
    return read(v).find_many("Stat", {"lowest": None}, select={"product_id": True, "market": True, "listed_stores": True})


@query("SELECT id FROM product p WHERE EXISTS (SELECT 1 FROM offer o WHERE o.product_id = p.id AND o.in_stock AND o.price < 100000)")
def read_some(v):
    return read(v).find_many("Product", {"offers": {"some": {"in_stock": True, "price": {"lt": 100_000}}}}, select={"id": True})


@query("SELECT id FROM product p WHERE NOT EXISTS (SELECT 1 FROM offer o WHERE o.product_id = p.id AND o.in_stock AND o.price < 100000)")
def read_none(v):
    return read(v).find_many("Product", {"offers": {"none": {"in_stock": True, "price": {"lt": 100_000}}}}, select={"id": True})


@query("SELECT id FROM product p WHERE NOT EXISTS (SELECT 1 FROM stat s WHERE s.product_id = p.id AND NOT coalesce(s.lowest >= 95000, false))")
def read_every(v):
    return read(v).find_many("Product", {"stats": {"every": {"lowest": {"gte": 95_000}}}}, select={"id": True})


@query("SELECT id FROM product p WHERE size < 5 OR NOT EXISTS (SELECT 1 FROM offer o WHERE o.product_id = p.id AND NOT o.in_stock)")
def read_relation_in_or(v):
    return read(v).find_many("Product", {"OR": [{"size": {"lt": 5}}, {"offers": {"none": {"in_stock": False}}}]}, select={"id": True})


@query("SELECT o.product_id, store, price FROM offer o JOIN product p ON o.product_id = p.id WHERE p.set_code = 'Brand#3' AND in_stock")
def read_is(v):
    return read(v).find_many("Offer", {"product": {"is": {"set_code": "Brand#3"}}, "in_stock": True}, select={"product_id": True, "store": True, "price": True})


@query("SELECT o.product_id, store FROM offer o LEFT JOIN product p ON o.product_id = p.id WHERE NOT coalesce(p.product_type = 'ECONOMY', false)")
def read_is_not(v):
    return read(v).find_many("Offer", {"product": {"isNot": {"product_type": "ECONOMY"}}}, select={"product_id": True, "store": True})


@query("SELECT product_id, market, lowest FROM stat WHERE product_id = 7 AND market = 'ASIA'")
def read_compound_key(v):
    return read(v).find_unique("Stat", {"product_id_market": {"product_id": 7, "market": "ASIA"}}, select={"product_id": True, "market": True, "lowest": True})


@query("SELECT product_id, market, median_open FROM stat ORDER BY median_open DESC NULLS FIRST, lowest ASC NULLS LAST, product_id, market LIMIT 40 OFFSET 25")
def read_order_and_page(v):
    return read(v).find_many("Stat", order_by=[{"median_open": "desc"}, {"lowest": "asc"}], skip=25, take=40, select={"product_id": True, "market": True, "median_open": True})


@query("SELECT product_id, store FROM offer JOIN product ON product_id = id ORDER BY msrp DESC, price, product_id, store LIMIT 50")
def read_order_by_relation(v):
    return read(v).find_many("Offer", order_by=[{"product": {"msrp": {"sort": "desc", "nulls": "last"}}}, {"price": "asc"}], take=50, select={"product_id": True, "store": True})


@query("SELECT id, set_code, msrp FROM (SELECT *, row_number() OVER (PARTITION BY set_code ORDER BY msrp DESC, id) AS rn FROM product) WHERE rn = 1")
def read_distinct_on(v):
    return read(v).find_many("Product", order_by={"msrp": {"sort": "desc", "nulls": "last"}}, distinct="set_code", select={"id": True, "set_code": True, "msrp": True})


@query("""SELECT id, (SELECT count(*) FROM offer o WHERE o.product_id = p.id) AS offers_count FROM product p WHERE size > 40""")
def read_count_of_relation(v):
    return read(v).find_many("Product", {"size": {"gt": 40}}, select={"id": True, "_count": {"select": {"offers": True}}})


@query("""SELECT id, (SELECT count(*) FROM offer o WHERE o.product_id = p.id AND in_stock) AS offers_count FROM product p WHERE size <= 2""")
def read_filtered_count_of_relation(v):
    return read(v).find_many("Product", {"size": {"lte": 2}}, select={"id": True, "_count": {"select": {"offers": {"where": {"in_stock": True}}}}})


@query("""SELECT p.id, rn - 1 AS pos, store, price FROM product p JOIN (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, product_id, store) AS rn FROM offer WHERE in_stock) o ON p.id = o.product_id
WHERE rn <= 3 AND size < 10""")
def read_nested_many(v):
    nested = {"where": {"in_stock": True}, "orderBy": {"price": "asc"}, "take": 3, "select": {"store": True, "price": True}}
    found = read(v).find_many("Product", {"size": {"lt": 10}}, select={"id": True, "offers": nested})
    return found.select("id", F.posexplode("offers")).select("id", F.col("pos").cast("long").alias("pos"), "col.store", "col.price")


@query("SELECT product_id, store, name, msrp FROM offer LEFT JOIN product ON product_id = id WHERE price < 95000")
def read_nested_one(v):
    found = read(v).find_many("Offer", {"price": {"lt": 95_000}}, select={"product_id": True, "store": True, "product": {"select": {"name": True, "msrp": True}}})
    return found.select("product_id", "store", "product.name", "product.msrp")


@query("SELECT count(*) AS count FROM stat WHERE in_stock_stores > 0")
def read_count(v):
    return read(v).count("Stat", {"in_stock_stores": {"gt": 0}})


@query("SELECT min(lowest) AS min_lowest, max(lowest) AS max_lowest, CAST(sum(listed_stores) AS BIGINT) AS sum_listed_stores, count(*) AS count_all, count(median_open) AS count_median_open FROM stat WHERE market = 'EUROPE'")
def read_aggregate(v):
    return read(v).aggregate("Stat", {"_min": ["lowest"], "_max": ["lowest"], "_sum": ["listed_stores"], "_count": ["_all", "median_open"]}, {"market": "EUROPE"})


@query("SELECT min(price) AS min_price, max(price) AS max_price, count(*) AS count_all FROM (SELECT price FROM offer ORDER BY price DESC, product_id, store LIMIT 100)")
def read_aggregate_page(v):
    return read(v).aggregate("Offer", {"_min": ["price"], "_max": ["price"], "_count": ["_all"]}, order_by={"price": "desc"}, take=100)


@query("SELECT min(price) AS min_price, CAST(sum(price) AS BIGINT) AS sum_price, count(*) AS count_all FROM offer WHERE price < 0")
def read_aggregate_empty(v):
    return read(v).aggregate("Offer", {"_min": ["price"], "_sum": ["price"], "_count": ["_all"]}, {"price": {"lt": 0}})


@query("SELECT store, in_stock, count(*) AS count_all, min(price) AS min_price FROM offer GROUP BY 1, 2")
def read_group_by(v):
    return read(v).group_by("Offer", ["store", "in_stock"], {"_count": ["_all"], "_min": ["price"]})


@query("SELECT set_code, count(*) AS count_all FROM product GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 10")
def read_group_by_having(v):
    return read(v).group_by("Product", ["set_code"], {"_count": ["_all"]}, having=F.col("count_all") >= 5, order_by=[{"count_all": "desc"}], take=10)
