"""Queries over titles, pages and documents' text functions, orders and the order book."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.functions import text as tx
from tradewind.plans.registry import query


@query(r"""SELECT id, regexp_replace(regexp_replace(lower(name || ' (' || set_code || ')'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM product""")
def slugs(v):
    return v.product.select("id", tx.slug(F.concat("name", F.lit(" ("), "set_code", F.lit(")"))).alias("slug"))


@query("""SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(name || ' ' || set_code), '[^a-z0-9]+'), lambda w: w <> ''))), ' ') AS tokens FROM product""")
def title_tokens(v):
    return v.product.select("id", F.array_join(tx.tokens(F.concat_ws(" ", "name", "set_code")), " ").alias("tokens"))


@query("""t AS (SELECT unnest(list_distinct(string_split(lower(name), ' '))) AS token, product_type, id FROM product)
SELECT product_type, token, count(*) AS n, min(id) AS first_id FROM t GROUP BY 1, 2""")
def inverted_index(v):
    return v.product.select("product_type", "id", F.explode(tx.tokens(F.col("name"))).alias("token")).groupBy("product_type", "token").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""SELECT id, name FROM product WHERE (name LIKE 'co%' OR name LIKE '% co%') AND (name LIKE 'wi%' OR name LIKE '% wi%')""")
def prefix_search(v):
    hit = lambda t: F.exists(F.split("name", " "), lambda w: w.startswith(t))
    return v.product.where(hit("co") & hit("wi")).select("id", "name")


@query("SELECT id, 'pd_' || substring(sha1(slug || '|' || set_code), 1, 24) AS key FROM product")
def stable_ids(v):
    return v.product.select("id", tx.stable_id("pd_", F.col("slug"), F.col("set_code")).alias("key"))


@query("SELECT id, left(md5(regexp_replace(slug, '-', ' ', 'g')), 16) AS ref FROM product")
def listing_refs(v):
    return v.product.select("id", F.left(F.md5(F.regexp_replace("slug", "-", " ")), F.lit(16)).alias("ref"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS chars FROM pages""")
def visible_text_lengths(v):
    return v.raw("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length(tx.visible_text(F.col("html"))).cast("long").alias("chars"))


@query("""l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT link) AS distinct_links FROM l GROUP BY 1""")
def page_links(v):
    found = v.raw("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return found.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("link").alias("distinct_links"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90""")
def json_props(v):
    parsed = F.from_json("props", "k int")
    return v.raw("events").select("event_id", parsed["k"].alias("k")).where("k >= 90")


@query("""SELECT id, CASE WHEN regexp_matches(name, '\\bwidget\\b') AND size > 30 THEN 'case' WHEN regexp_matches(name, '\\bwidget\\b') THEN 'box' WHEN regexp_matches(name, 'gear|bolt') THEN 'pack' WHEN regexp_matches(name, '^(cold|hot)') THEN 'tin' END AS kind FROM product""")
def type_cascade(v):
    sized = F.concat_ws("#", "name", F.when(F.col("size") > 30, "large").otherwise("small"))
    rules = [(r"\bwidget\b.*#large$", "case"), (r"\bwidget\b", "box"), ("gear|bolt", "pack"), ("^(?:cold|hot)", "tin")]
    return v.product.select("id", tx.rule_cascade(sized, rules).alias("kind"))


@query("""SELECT doc_id, length(text) AS chars, CASE WHEN regexp_matches(text, '^[=+@\\t\\r-]') THEN '''' || text ELSE text END AS cell FROM documents""")
def csv_cells(v):
    return v.raw("documents").select("doc_id", F.length("text").cast("long").alias("chars"), tx.csv_safe(F.col("text")).alias("cell"))


@query("""m AS (SELECT product_id, market, lowest FROM stat WHERE lowest IS NOT NULL) SELECT product_id, count(*) AS markets, string_agg(market || '=' || lowest, ',' ORDER BY market) AS prices FROM m GROUP BY 1""")
def price_map_sink(v):
    pairs = F.sort_array(F.collect_list(F.concat_ws("=", "market", F.col("lowest").cast("string"))))
    return v.stat.where("lowest is not null").groupBy("product_id").agg(F.count("*").alias("markets"), F.array_join(pairs, ",").alias("prices"))


@query("""b AS (SELECT o_custkey AS buyer, o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cost, sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS spent FROM orders),
c AS (SELECT c_custkey AS buyer, CAST(floor(c_acctbal * 10000 + 0.5) AS BIGINT) AS balance FROM customer)
SELECT buyer, o_orderkey, cost, balance - CAST(spent AS BIGINT) AS "left" FROM b JOIN c USING (buyer) WHERE spent <= balance""")
def escrow_by_running_sum(v):
    o = v.raw("orders").select(F.col("o_custkey").alias("buyer"), "o_orderkey", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cost"))
    c = v.raw("customer").select(F.col("c_custkey").alias("buyer"), F.floor(F.col("c_acctbal") * 10000 + 0.5).cast("long").alias("balance"))
    spent = F.sum("cost").over(Window.partitionBy("buyer").orderBy("o_orderkey"))
    return o.withColumn("spent", spent).join(c, "buyer").where("spent <= balance").select("buyer", "o_orderkey", "cost", (F.col("balance") - F.col("spent")).alias("left"))


@query("""ask AS (SELECT l_partkey AS product, l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS BIGINT) AS qty, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cost FROM lineitem),
r AS (SELECT *, CAST(sum(qty) OVER (PARTITION BY product ORDER BY l_orderkey, l_linenumber, l_suppkey, qty, cost ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM ask)
SELECT product, l_orderkey, l_linenumber, l_suppkey, qty, cost, greatest(0, least(qty, 100 - (upto - qty))) AS filled FROM r WHERE upto - qty < 100""")
def bids_filled_in_turn(v):
    ask = v.raw("lineitem").select(F.col("l_partkey").alias("product"), "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("long").alias("qty"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("cost"))
    w = Window.partitionBy("product").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "qty", "cost").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("upto") - F.col("qty")
    return ask.withColumn("upto", F.sum("qty").over(w)).where(before < 100).select("product", "l_orderkey", "l_linenumber", "l_suppkey", "qty", "cost", F.greatest(F.lit(0), F.least(F.col("qty"), 100 - before)).alias("filled"))
