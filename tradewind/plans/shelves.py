"""Queries for a market's pages: back in stock, moves of watched sets, older sets still in stock. Sizes stand for sets, released fifty days apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions.calc import js_months_back
from tradewind.operators import history, shelves, typeahead
from tradewind.plans.holdings import KEY, STOCKED, stocked
from tradewind.plans.registry import query

LAST = "DATE '2000-06-30'"
HOT, KINDS = ["S40", "S31", "S50", "S3"], ["PROMO", "ECONOMY", "LARGE"]
SETS = "sets AS (SELECT DISTINCT 'S' || size AS code, CAST(DATE '1995-01-01' + INTERVAL 50 DAY * size AS DATE) AS day FROM product)"
last = lambda: F.lit("2000-06-30").cast("date")


def sets(v):
    return v.product.select("size").distinct().select(F.concat(F.lit("S"), "size").alias("code"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("size").cast("int") * 50).alias("day"))


def cards(v):
    return v.card.select("market", F.concat(F.lit("S"), "size").alias("code"), F.col("product_id").alias("item"), F.col("product_type").alias("kind"), "name", F.col("in_stock_stores").alias("stores"))


@query(f"""{STOCKED},
t AS (SELECT market, product_id, day, price, stores, lag(day) OVER k AS d, lag(price) OVER k AS p FROM stocked WHERE day <= {LAST} WINDOW k AS (PARTITION BY market, product_id ORDER BY day)),
s AS (SELECT market, product_id, max(day) FILTER (d IS NOT NULL AND p IS NULL AND price IS NOT NULL AND day > {LAST} - INTERVAL 60 DAY) AS back, max(day) AS latest FROM t GROUP BY 1, 2),
f AS (SELECT s.market, s.product_id, back, t.price, t.stores FROM s JOIN t ON t.market = s.market AND t.product_id = s.product_id AND t.day = latest WHERE back IS NOT NULL AND t.price IS NOT NULL),
n AS (SELECT market, back, count(*) AS n FROM f GROUP BY 1, 2), m AS (SELECT market, greatest(2, CAST(ceil(count(*) * 0.0005) AS BIGINT)) AS most FROM s GROUP BY 1)
SELECT market, product_id, back AS day, price, stores FROM f JOIN n USING (market, back) JOIN m USING (market) WHERE n <= most""")
def back_in_stock(v):
    """What came back within sixty days and is in stock; days with more than two returns in a market are taken for failed reads."""
    return shelves.returned(history.change_points(stocked(v), KEY), *KEY, last(), days=60, bulk=2, share=0.0005)


@query(f"""{STOCKED},
{SETS},
inside AS (SELECT market, 'S' || size AS code, CAST(sum(in_stock_stores) AS BIGINT) AS n FROM card GROUP BY 1, 2),
given AS (SELECT code, list_position({HOT}, code) AS pos, 0 AS l FROM sets WHERE day <= {LAST} AND code IN {tuple(HOT)} UNION ALL
  SELECT * FROM (SELECT code, row_number() OVER (ORDER BY day DESC, code), 1 FROM sets WHERE day <= {LAST} ORDER BY day DESC, code LIMIT 6)),
own AS (SELECT market, code, 2 AS l, row_number() OVER (PARTITION BY market ORDER BY n DESC, code) AS pos FROM inside JOIN sets USING (code) WHERE n > 0 AND day <= {LAST}),
u AS (SELECT market, code, l, pos FROM given, (SELECT DISTINCT market FROM inside) UNION ALL SELECT market, code, l, pos FROM own WHERE pos <= 8),
w AS (SELECT market, code, row_number() OVER (PARTITION BY market ORDER BY l, pos) AS turn FROM (SELECT DISTINCT ON (market, code) * FROM u ORDER BY market, code, l, pos)),
a AS (SELECT market, product_id, arg_max(struct_pack(p := price, s := stores), day) AS now, arg_max(struct_pack(p := price), day) FILTER (day <= {LAST} - INTERVAL 180 DAY) AS was FROM stocked WHERE day <= {LAST} GROUP BY 1, 2),
m AS (SELECT market, product_id, was.p AS before, now.p AS after, now.s AS stores, CAST(floor((now.p - was.p) / was.p * 100 + 0.5) AS BIGINT) AS percent FROM a WHERE was.p IS NOT NULL AND now.p IS NOT NULL)
SELECT m.*, code, turn FROM m JOIN product ON id = product_id JOIN w ON w.market = m.market AND code = 'S' || size
WHERE abs(percent) >= 10 AND abs(after - before) >= 500 AND after <= before * 2 AND before <= after * 2""")
def moves_of_watched_sets(v):
    """Moves of a half year in the sets that each market watches, with the set's turn there."""
    found = cards(v).groupBy("market", "code").agg(F.sum("stores").alias("n"))
    watched = shelves.watched_sets(sets(v), found, "market", HOT, last())
    moved = shelves.bounded_moves(history.change_points(stocked(v), KEY), KEY, last(), days=180)
    coded = moved.join(v.product.select(F.col("id").alias("product_id"), F.concat(F.lit("S"), "size").alias("code")), "product_id")
    return coded.join(watched, ["market", "code"])


@query(f"""{SETS},
c AS (SELECT market, 'S' || size AS code, product_id AS item, list_position({KINDS}, product_type) AS kind, name, in_stock_stores AS stores, day FROM card JOIN sets ON code = 'S' || size
  WHERE in_stock_stores > 0 AND product_type IN {tuple(KINDS)} AND day <= DATE '1998-12-30'),
t AS (SELECT market, code, row_number() OVER (PARTITION BY market ORDER BY sum(stores) DESC, day DESC, code) AS set_turn, CAST(sum(stores) AS BIGINT) AS set_stores FROM c GROUP BY market, code, day)
SELECT market, code, set_turn, set_stores, item, row_number() OVER (PARTITION BY market, code ORDER BY stores DESC, kind, name, item) AS item_turn FROM c JOIN t USING (market, code)""")
def older_sets_in_stock(v):
    """Sets released eighteen months ago or more of which stores still have something, with their items in order."""
    return shelves.older_by_set(cards(v), sets(v), "market", js_months_back(last(), 18), KINDS)


TYPED = """CASE c_custkey % 6 WHEN 0 THEN substr(p_name, 2, 5) WHEN 1 THEN upper(p_brand) WHEN 2 THEN ' ' || (c_custkey % 100) WHEN 3 THEN '#!' WHEN 4 THEN substr(p_type, 1, 2) ELSE replace(p_name, ' ', '-') END"""


@query(f"""searches AS (SELECT c_custkey AS search, trim({TYPED}) AS q FROM customer JOIN part ON p_partkey = c_custkey),
asked AS (SELECT search, q, regexp_replace(lower(q), '[^a-z0-9]', '', 'g') AS plain FROM searches WHERE length(q) >= 2),
c AS (SELECT CAST(product_id AS VARCHAR) AS id, name || ' ' || set_code AS name, CAST(product_id AS VARCHAR) AS number, lowest AS price FROM card WHERE market = 'EUROPE'),
g AS (SELECT product_type || '|' || set_code AS id, set_code || ' ' || product_type AS name, product_type AS label, set_code AS code, min(id) AS place FROM product GROUP BY 1, 2, 3, 4),
a AS (SELECT search, 'card' AS kind, row_number() OVER (PARTITION BY search ORDER BY price DESC NULLS LAST, name, id) AS turn, id FROM asked JOIN c ON contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), plain) OR contains(number, q)),
b AS (SELECT search, 'group' AS kind, row_number() OVER (PARTITION BY search ORDER BY place, id) AS turn, id FROM asked JOIN g ON contains(lower(name), lower(q)) OR contains(lower(label), lower(q)) OR contains(lower(code), lower(q)))
SELECT * FROM a WHERE turn <= 8 UNION ALL SELECT * FROM b WHERE turn <= 4""")
def searches_answered(v):
    """What each customer types, answered with the first eight products of a market and the first four kinds of a brand."""
    typed = v.raw("customer").select("c_custkey").join(v.raw("part").select("p_partkey", "p_name", "p_brand", "p_type"), F.col("p_partkey") == F.col("c_custkey"))
    searches = typed.select(F.col("c_custkey").alias("search"), F.expr(TYPED).alias("text"))
    number = F.col("product_id").cast("string")
    items = v.card.where("market = 'EUROPE'").select(number.alias("id"), F.concat_ws(" ", "name", "set_code").alias("name"), number.alias("number"), F.col("lowest").alias("price"))
    kinds = v.product.groupBy("product_type", "set_code").agg(F.min("id").alias("place"))
    kinds = kinds.select(F.concat_ws("|", "product_type", "set_code").alias("id"), F.concat_ws(" ", "set_code", "product_type").alias("name"), F.col("product_type").alias("label"), F.col("set_code").alias("code"), "place")
    return typeahead.answered(searches, items, kinds)
