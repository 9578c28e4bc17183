"""Queries over grids, alternatives, focus, ranges, outliers by type, searches and what is written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.operators import filters, merge, packs, quality, ranking
from tradewind.plans.registry import query
from tradewind.plans.selling import RULES
from tradewind.sources import sinks
from tradewind.sources.scratch import settled

PACKS_SQL = """CASE product_type WHEN 'ECONOMY' THEN 36 WHEN 'LARGE' THEN 216 WHEN 'SMALL' THEN 1 WHEN 'STANDARD' THEN std WHEN 'MEDIUM' THEN std * 10
  WHEN 'PROMO' THEN CASE WHEN regexp_matches(name, '\\bred\\b') THEN 2 WHEN regexp_matches(name, '\\b(ring|bolt)\\b') THEN 3 END END"""
CARDS = f"""g AS (SELECT *, CASE WHEN lowest > 0 THEN CAST(floor(lowest / CAST({PACKS_SQL} AS DOUBLE) + 0.5) AS BIGINT) END AS per_pack
  FROM (SELECT *, product_id % 5 = 0 AS marketplace_open, CASE set_code WHEN 'Brand#2' THEN 10 WHEN 'Brand#25' THEN NULL ELSE CASE length(set_code) - 6 WHEN 1 THEN 8 WHEN 2 THEN 9 END END AS std,
    CASE WHEN product_id % 7 <> 0 THEN DATE '1998-01-01' - CAST(product_id % 900 AS INT) END AS released, list_position(['PROMO', 'SMALL', 'LARGE'], product_type) AS type_place FROM card))"""


def packs_per(df):
    n = packs.pack_count(F.col("product_type"), (F.length("set_code") - 6).cast("string"), F.col("set_code"), F.col("name"), RULES)
    return df.withColumn("per_pack", packs.cents_per_pack(F.col("lowest"), n))


def grid(v):
    released = F.when(F.col("product_id") % 7 != 0, F.date_sub(F.lit("1998-01-01").cast("date"), (F.col("product_id") % 900).cast("int")))
    rows = v.card.withColumn("marketplace_open", F.col("product_id") % 5 == 0).withColumn("released", released)
    return packs_per(rows).withColumn("type_place", ranking.listed_first("product_type", ["PROMO", "SMALL", "LARGE"]))


_OPEN = "(in_stock_stores > 0 OR marketplace_open)"
_PRICE = f"CASE WHEN {_OPEN} THEN lowest END"
SORTS = {
    "relevance": "", "price up": f"{_PRICE} ASC NULLS LAST,", "price down": f"{_PRICE} DESC NULLS LAST,", "per pack": f"CASE WHEN {_OPEN} THEN per_pack END ASC NULLS LAST, {_PRICE} ASC NULLS LAST,",
    "saving": f"CASE WHEN {_OPEN} AND median_open > 0 AND lowest < median_open THEN lowest / CAST(median_open AS DOUBLE) END ASC NULLS LAST, {_PRICE} ASC NULLS LAST,",
    "stores": f"in_stock_stores DESC, {_PRICE} ASC NULLS LAST,", "newest": "released DESC NULLS LAST, type_place ASC NULLS LAST,",
}


@query(f"{CARDS}\n" + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{name}' AS sort, market, product_id, row_number() OVER (PARTITION BY market ORDER BY {order} slug) AS place FROM g) WHERE place <= 20" for name, order in SORTS.items()))
def grid_sorts(v):
    """The first twenty of each market in each of the seven orders of a grid."""
    # computed once, sorted seven times, each sort cut to its page before the shuffle
    rows, out = settled(grid(v), "grid"), None
    for name in SORTS:
        part = ranking.first_per(rows, ["market"], ranking.grid_order(name, [F.asc("slug")]), 20, "place").select(F.lit(name).alias("sort"), "market", "product_id", "place")
        out = part if out is None else out.unionByName(part)
    return out


@query("""w AS (SELECT id, CASE WHEN id % 50 = 3 THEN 'unknown' ELSE product_type END AS product_type, CASE WHEN id % 4 <> 1 THEN set_code END AS set_code FROM product WHERE id NOT IN (SELECT product_id FROM stat WHERE market = 'EUROPE' AND in_stock_stores > 0 AND product_id % 3 = 0)),
o AS (SELECT product_id, product_type, set_code, list_position(['Brand#9', 'Brand#4', 'Brand#21'], set_code) AS set_place, lowest FROM card WHERE market = 'EUROPE' AND in_stock_stores > 0),
c AS (SELECT id, o.product_id, row_number() OVER (PARTITION BY id ORDER BY coalesce(o.set_code = w.set_code, false) DESC, set_place NULLS LAST, lowest NULLS LAST, o.product_id) AS place FROM w JOIN o ON o.product_type = w.product_type AND o.product_id <> w.id),
s AS (SELECT product_id, lowest FROM o WHERE product_type = 'PROMO' ORDER BY lowest NULLS LAST, product_id LIMIT 5),
f AS (SELECT id, product_id, row_number() OVER (PARTITION BY id ORDER BY lowest NULLS LAST, product_id) AS place FROM w JOIN s ON product_id <> id WHERE id NOT IN (SELECT id FROM c))
SELECT * FROM c WHERE place <= 4 UNION ALL SELECT * FROM f WHERE place <= 4""")
def alternatives_in_stock(v):
    """Four open products for each that is not: of its set, of the newest sets, cheapest; types that sell nothing get headline products."""
    gone = v.stat.where("market = 'EUROPE' and in_stock_stores > 0 and product_id % 3 = 0").select("product_id")
    wanted = v.product.join(gone, F.col("id") == F.col("product_id"), "left_anti")
    wanted = wanted.select("id", F.when(F.col("id") % 50 == 3, "unknown").otherwise(F.col("product_type")).alias("product_type"), F.when(F.col("id") % 4 != 1, F.col("set_code")).alias("set_code"))
    cards = v.card.where("market = 'EUROPE' and in_stock_stores > 0").withColumn("set_place", ranking.listed_first("set_code", ["Brand#9", "Brand#4", "Brand#21"]))
    cards = cards.select("product_id", "product_type", "set_code", "set_place", "lowest")
    return ranking.alternatives(wanted, cards, F.col("product_type") == "PROMO", 4)


@query("""b AS (SELECT product_id, market, count(*) AS listed, count(*) FILTER (in_stock) AS open FROM offer WHERE product_id % 8 <> 0 GROUP BY 1, 2),
m AS (SELECT product_id, sum(listed) AS listed, max(open) AS most FROM b GROUP BY 1),
k AS (SELECT id, slug, product_type, id % 31 = 0 OR set_code IN ('Brand#3', 'Brand#5') OR coalesce(most >= 2, false) OR (product_type NOT IN ('SMALL', 'MEDIUM') AND coalesce(listed > 0, false)) AS kept FROM product LEFT JOIN m ON product_id = id)
SELECT id, kept, CASE WHEN NOT kept THEN product_type END AS goes_to FROM k""")
def focused_catalogue(v):
    """What is listed: wanted, fresh, in stock twice in a market, or of a main type and listed at all."""
    wanted = v.product.where("id % 31 = 0").select("slug")
    rows = v.product.select("id", "slug", "product_type", "set_code")
    found = ranking.kept_in_focus(rows, v.offer.where("product_id % 8 <> 0"), wanted, F.col("set_code").isin("Brand#3", "Brand#5"), F.col("product_type").isin("SMALL", "MEDIUM"))
    return found.select("id", "kept", "goes_to")


@query(f"""{CARDS},
o AS (SELECT * FROM g WHERE lowest > 0 AND {_OPEN}),
r AS (SELECT market, product_type, count(*) AS n, min(lowest) AS cheapest, max(lowest) AS dearest, CAST(floor(quantile_cont(lowest, 0.5) + 0.5) AS BIGINT) AS median FROM o GROUP BY 1, 2),
p AS (SELECT market, product_type, slug, per_pack, row_number() OVER (PARTITION BY market, product_type ORDER BY per_pack, lowest, slug) AS rn FROM o WHERE per_pack IS NOT NULL)
SELECT r.*, p.slug AS best_slug, p.per_pack AS best_per_pack FROM r LEFT JOIN p ON p.market = r.market AND p.product_type = r.product_type AND rn = 1""")
def ranges_with_packs(v):
    """Cheapest, dearest and median of a type in a market, and the product that is cheapest by the pack."""
    rows = grid(v).where("lowest > 0 and (in_stock_stores > 0 or marketplace_open)")
    best = F.min(F.when(F.col("per_pack").isNotNull(), F.struct("per_pack", "lowest", "slug"))).alias("b")
    found = rows.groupBy("market", "product_type").agg(F.count("*").alias("n"), F.min("lowest").alias("cheapest"), F.max("lowest").alias("dearest"), F.floor(F.percentile("lowest", 0.5) + 0.5).cast("long").alias("median"), best)
    return found.select("market", "product_type", "n", "cheapest", "dearest", "median", F.col("b.slug").alias("best_slug"), F.col("b.per_pack").alias("best_per_pack"))


@query("""o AS (SELECT offer.*, product_type, set_code, store % 10 = 0 AS mp FROM offer JOIN product ON id = product_id),
m AS (SELECT product_id, market, quantile_cont(price, 0.5) FILTER (in_stock AND NOT mp) AS mid, count(*) FILTER (in_stock AND NOT mp) AS n FROM o GROUP BY 1, 2),
j AS (SELECT o.*, coalesce(n >= 3 AND in_stock AND NOT mp AND price > mid * CASE product_type WHEN 'PROMO' THEN 1.2 WHEN 'SMALL' THEN 1.5 WHEN 'LARGE' THEN 1.3 END AND NOT (product_type = 'LARGE' AND set_code > 'Brand#2'), false) AS bad FROM o JOIN m USING (product_id, market))
SELECT product_id, market, store, price FROM j WHERE NOT bad""")
def high_outliers_by_type(v):
    """A bar for each type, medians of independent stores, marketplaces left alone, and one type judged in recent sets only."""
    rows = v.offer.join(v.product.select(F.col("id").alias("product_id"), "product_type", "set_code"), "product_id")
    kind, shop = F.col("product_type"), F.col("store") % 10 != 0
    bar = F.when(kind == "PROMO", 1.2).when(kind == "SMALL", 1.5).when(kind == "LARGE", 1.3)
    judged = F.col("in_stock") & shop & ~((kind == "LARGE") & (F.col("set_code") > "Brand#2"))
    return quality.drop_high_outliers(rows, ["product_id", "market"], bar, shop, judged).select("product_id", "market", "store", "price")


CHEAP = "SELECT product_id, store, market, CASE WHEN store % 4 = 1 AND product_id % 3 = 0 THEN price // 4 ELSE price END AS price, in_stock, seen FROM offer"


@query(f"""o AS ({CHEAP}), m AS (SELECT product_id, market, quantile_cont(price, 0.5) FILTER (in_stock) AS mid, count(*) FILTER (in_stock) AS n FROM o GROUP BY 1, 2)
SELECT store, count(*) AS judged, count(*) FILTER (price * 2 < mid) AS low FROM o JOIN m USING (product_id, market) WHERE in_stock AND n >= 3 GROUP BY 1 HAVING low >= 5 AND low * 100 >= judged * 20""")
def stores_not_believed(v):
    """Stores with five prices and a fifth of those judged under half the median; every fourth store sells a third of its goods for a quarter."""
    cheap = F.when((F.col("store") % 4 == 1) & (F.col("product_id") % 3 == 0), F.expr("price div 4")).otherwise(F.col("price"))
    return quality.suspect_stores(v.offer.withColumn("price", cheap), ["product_id", "market"])


@query("""p AS (SELECT id, name AS slug, min(id) OVER (PARTITION BY name) AS owner FROM product)
SELECT id, CASE WHEN id = owner THEN slug ELSE substr(slug, 1, 130) || '-' || lower(to_base(CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT), 36)) END AS slug FROM p""")
def slugs_told_apart(v):
    return merge.distinct_slugs(v.product.select("id", F.col("name").alias("slug")), "id", "slug")


@query("""t AS (SELECT p_partkey, lower(p_name) AS a, lower(p_brand) AS b, lower(p_type) AS c, CAST(p_size AS VARCHAR) AS d, CAST(p_partkey AS VARCHAR) AS e, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS bare FROM part)
SELECT p_partkey AS id FROM t WHERE """ + " AND ".join(f"({' OR '.join(f'coalesce(contains({c}, {chr(39)}{t}{chr(39)}), false)' for c in 'abcde')} OR contains(bare, '{p}'))" for t, p in (("red-b", "redb"), ("brand#1", "brand1"), ("2", "2"))))
def six_field_search(v):
    """Each word in the name, brand, type, size or number, or run together in the name."""
    rows = v.raw("part").withColumn("number", F.col("p_partkey").cast("string")).withColumn("wide", F.col("p_size").cast("string"))
    return rows.where(filters.every_term("Red-B brand#1 2", ["p_name", "p_brand", "p_type", "wide", "number"], "p_name")).select(F.col("p_partkey").alias("id"))


@query("""o AS (SELECT product_id, market, price, in_stock, CASE WHEN store % 13 = 0 THEN 'guide_' ELSE 'shop_' END || store AS seller, CASE CAST(store % 4 AS INT) WHEN 0 THEN 'NM' WHEN 1 THEN 'LP' WHEN 2 THEN 'HP' END AS condition FROM offer)
SELECT product_id, market, min(price) AS headline FROM o WHERE in_stock AND NOT starts_with(seller, 'guide_') AND (condition IS NULL OR condition IN ('NM', 'LP')) GROUP BY 1, 2""")
def headline_by_condition(v):
    k = F.col("store") % 4
    rows = v.offer.withColumn("seller", F.concat(F.when(F.col("store") % 13 == 0, "guide_").otherwise("shop_"), F.col("store").cast("string")))
    rows = rows.withColumn("condition", F.when(k == 0, "NM").when(k == 1, "LP").when(k == 2, "HP"))
    return rows.where(filters.headline()).groupBy("product_id", "market").agg(F.min("price").alias("headline"))


@query("""l AS (SELECT product_id, store, price, CASE WHEN in_stock THEN 'ACTIVE' ELSE 'SOLD' END AS status, product_id % 4 AS quantity, CASE WHEN store % 2 = 0 THEN 'NM' ELSE 'LP' END AS condition, name, product_type, set_code FROM offer JOIN product ON id = product_id)
SELECT product_id, store FROM l WHERE status = 'ACTIVE' AND quantity > 0 AND product_type IN ('PROMO', 'SMALL') AND condition IN ('NM') AND (contains(name, 'red') OR contains(product_type, 'red') OR contains(set_code, 'red')) AND price >= 90050 AND price <= 150000""")
def listings_asked_for(v):
    rows = v.offer.join(v.product.select("id", "name", "product_type", "set_code"), F.col("id") == F.col("product_id"))
    rows = rows.withColumn("status", F.when(F.col("in_stock"), "ACTIVE").otherwise("SOLD")).withColumn("quantity", F.col("product_id") % 4).withColumn("condition", F.when(F.col("store") % 2 == 0, "NM").otherwise("LP"))
    return rows.where(filters.market_listings("type=PROMO,SMALL&condition=NM&q=red&min=900.5&max=1500")).select("product_id", "store")


@query("""c AS (SELECT c_custkey, [CAST(c_custkey AS VARCHAR), c_name, CASE WHEN c_custkey % 9 = 0 THEN '=SUM(A1)' WHEN c_custkey % 9 = 1 THEN 'a, "b"' ELSE coalesce(c_mktsegment, '') END] AS cells FROM customer)
SELECT array_to_string(list_transform(list_transform(cells, lambda x: CASE WHEN regexp_matches(x, '^[=+@\\t\\r-]') THEN '''' || x ELSE x END), lambda x: CASE WHEN regexp_matches(x, '[",\\n\\r]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END), ',') AS line FROM c""")
def csv_rows(v):
    k = F.col("c_custkey") % 9
    note = F.when(k == 0, "=SUM(A1)").when(k == 1, 'a, "b"').otherwise(F.col("c_mktsegment"))
    return sinks.csv_lines(v.raw("customer").select("c_custkey", "c_name", note.alias("note")))


@query("""e AS (SELECT product_id AS id, name, market, '"' || market || '":{"cents":' || lowest || ',"url":"https://prices.example/' || lower(replace(market, ' ', '-')) || '/p/' || slug || '"}' AS entry FROM card WHERE lowest > 0)
SELECT id, name, '{' || string_agg(entry, ',' ORDER BY market) || '}' AS prices FROM e GROUP BY 1, 2""")
def price_documents(v):
    return sinks.price_documents(v.card, "https://prices.example").select("id", "name", F.to_json("prices").alias("prices"))


@query("""d AS (SELECT market, slug, lowest AS cents, median_open AS reference, row_number() OVER (PARTITION BY market ORDER BY lowest / CAST(median_open AS DOUBLE), product_id) AS place FROM card WHERE in_stock_stores >= 2 AND lowest * 10 <= median_open * 9)
SELECT * FROM d WHERE place <= 3""")
def alert_deals(v):
    return sinks.alert_deals(v.card, (F.col("in_stock_stores") >= 2) & (F.col("lowest") * 10 <= F.col("median_open") * 9))
