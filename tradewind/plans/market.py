"""Market queries: summaries, deals, ranks, joins and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.operators import ranking, stats
from tradewind.plans.registry import query

TODAY = "(SELECT max(seen) FROM listing)"


@query("SELECT * FROM offer")
def offers(v):
    return v.offer


@query("SELECT * FROM stat")
def market_summary(v):
    return v.stat


@query("SELECT slug, market, lowest, median_open, in_stock_stores FROM card WHERE market = 'ASIA' AND in_stock_stores >= 3 AND lowest >= median_open * 0.5 AND lowest <= median_open * 0.9 ORDER BY lowest / median_open, lowest, slug LIMIT 48")
def deals_in_market(v):
    return stats.deals(v.card, "ASIA", 48).select("slug", "market", "lowest", "median_open", "in_stock_stores")


@query("SELECT market, product_type, slug, lowest FROM (SELECT *, row_number() OVER (PARTITION BY market, product_type ORDER BY lowest / median_open, lowest, slug) AS rn FROM card WHERE in_stock_stores >= 3 AND lowest >= median_open * 0.5 AND lowest <= median_open * 0.9) WHERE rn <= 5")
def deals_by_section(v):
    found = ranking.first_per(v.card.where(stats.is_deal()), ["market", "product_type"], stats.deal_order(), 5)
    return found.select("market", "product_type", "slug", "lowest")


@query("SELECT slug, market, lowest, msrp FROM card WHERE lowest < msrp AND lowest * 2 >= msrp ORDER BY lowest / msrp, slug, market LIMIT 60")
def below_list_price(v):
    return v.card.where((F.col("lowest") < F.col("msrp")) & (F.col("lowest") * 2 >= F.col("msrp"))).orderBy(F.col("lowest") / F.col("msrp"), "slug", "market").limit(60).select("slug", "market", "lowest", "msrp")


@query("""SELECT slug, market, lowest, list_cents FROM card JOIN (VALUES ('ECONOMY', 120000), ('STANDARD', 150000), ('PROMO', 110000)) AS l(product_type, list_cents) USING (product_type)
WHERE lowest < list_cents AND in_stock_stores > 0""")
def below_given_prices(v):
    given = v.spark.createDataFrame([("ECONOMY", 120_000), ("STANDARD", 150_000), ("PROMO", 110_000)], "product_type string, list_cents int")
    # a list in the program, so small by construction
    return v.card.join(F.broadcast(given), "product_type").where((F.col("lowest") < F.col("list_cents")) & stats.is_open()).select("slug", "market", "lowest", "list_cents")


@query("SELECT market, product_type, slug, lowest, CAST(floor(lowest / size + 0.5) AS BIGINT) AS per_unit FROM (SELECT *, row_number() OVER (PARTITION BY market, product_type ORDER BY lowest / size, slug) AS rn FROM card WHERE lowest IS NOT NULL) WHERE rn = 1")
def cheapest_per_unit(v):
    found = ranking.first_per(v.card.where("lowest is not null"), ["market", "product_type"], [F.col("lowest") / F.col("size"), F.col("slug")])
    return found.select("market", "product_type", "slug", "lowest", F.floor(F.col("lowest") / F.col("size") + 0.5).cast("long").alias("per_unit"))


@query("SELECT market, set_code, count(*) AS products, count(*) FILTER (in_stock_stores > 0) AS open FROM card WHERE in_stock_stores > 0 OR listed_stores >= 2 GROUP BY 1, 2")
def set_counts(v):
    return v.card.where(stats.is_comparable()).groupBy("market", "set_code").agg(F.count("*").alias("products"), F.count_if(stats.is_open()).alias("open"))


@query("SELECT product_type, count(*) AS n FROM card WHERE in_stock_stores > 0 OR listed_stores >= 2 GROUP BY 1 HAVING count(*) >= 10")
def types_with_enough(v):
    return v.card.where(stats.is_comparable()).groupBy("product_type").agg(F.count("*").alias("n")).where("n >= 10")


@query("SELECT market, count(*) FILTER (in_stock_stores > 0) AS open, count(*) FILTER (in_stock_stores = 0) AS sold, min(lowest) AS lowest, max(in_stock_stores) AS widest FROM stat GROUP BY 1")
def region_overview(v):
    return v.stat.groupBy("market").agg(F.count_if(stats.is_open()).alias("open"), F.count_if(~stats.is_open()).alias("sold"), F.min("lowest").alias("lowest"), F.max("in_stock_stores").alias("widest"))


@query("SELECT market, max(seen) AS checked, count(*) AS offers FROM offer GROUP BY 1")
def last_checked(v):
    return v.offer.groupBy("market").agg(F.max("seen").alias("checked"), F.count("*").alias("offers"))


@query("SELECT store, market, count(*) AS listed, count(*) FILTER (in_stock) AS open FROM offer GROUP BY 1, 2")
def store_counts(v):
    return stats.store_counts(v.offer)


@query("""SELECT store, market, count(*) AS listed, count(*) FILTER (in_stock) AS open FROM offer WHERE price BETWEEN 300000 AND 310000
GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (in_stock) = 0""")
def dormant_stores(v):
    """Of the offers in one band of prices, where some stores have none in stock."""
    return stats.dormant_stores(v.offer.where("price between 300000 and 310000"), 2)


@query("SELECT market, store, open FROM (SELECT market, store, count(*) AS open, row_number() OVER (PARTITION BY market ORDER BY count(*) DESC, store) AS rn FROM offer WHERE in_stock GROUP BY 1, 2) WHERE rn <= 12")
def top_stores(v):
    return ranking.first_per(v.offer.where("in_stock").groupBy("market", "store").agg(F.count("*").alias("open")), ["market"], [F.desc("open"), F.asc("store")], 12)


@query("SELECT store, seen, n FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY n DESC, seen DESC) AS rn FROM (SELECT store, CAST(seen AS DATE) AS seen, count(*) AS n FROM offer GROUP BY 1, 2)) WHERE rn = 1")
def usual_seen_day(v):
    """Offers of a store are counted in partitions that go by the listings: few bytes of a shuffle are many days to count."""
    days = stats.best_offers(v.listing).select("store", F.to_date("seen").alias("seen")).repartition(*filter(None, [v.more_parts("lineitem")]), "store")
    return ranking.mode_of(days.join(v.store.select("store"), "store"), ["store"], "seen")


@query("""SELECT market, product_type, array_to_string(list_sort(list(DISTINCT set_code)), ',') AS sets, array_to_string(list_sort(list(DISTINCT set_code) FILTER (in_stock_stores > 0)), ',') AS open_sets FROM card GROUP BY 1, 2""")
def sets_by_type(v):
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    opened = F.collect_set(F.when(stats.is_open(), F.col("set_code")))
    return v.card.groupBy("market", "product_type").agg(joined(F.collect_set("set_code")).alias("sets"), F.when(F.size(opened) > 0, joined(opened)).alias("open_sets"))


@query("SELECT set_code, count(DISTINCT store) AS stores, count(DISTINCT market) AS markets FROM offer JOIN product ON product_id = id WHERE in_stock GROUP BY 1")
def reach_of_sets(v):
    found = v.offer.where("in_stock").join(v.product, F.col("product_id") == F.col("id"))
    return found.groupBy("set_code").agg(F.countDistinct("store").alias("stores"), F.countDistinct("market").alias("markets"))


@query("""SELECT market, product_type, min(lowest) AS cheapest, max(lowest) AS dearest, CAST(floor(quantile_cont(lowest, 0.5) + 0.5) AS BIGINT) AS median,
  arg_min(slug, lowest * 1000000 + product_id) AS cheapest_slug FROM card WHERE lowest IS NOT NULL GROUP BY 1, 2""")
def type_ranges(v):
    open_cards = v.card.where("lowest is not null")
    return open_cards.groupBy("market", "product_type").agg(
        F.min("lowest").alias("cheapest"), F.max("lowest").alias("dearest"), F.floor(F.percentile("lowest", 0.5) + 0.5).cast("long").alias("median"),
        F.min(F.struct("lowest", "product_id", "slug"))["slug"].alias("cheapest_slug"),
    )


@query("SELECT market, store, wins, saving, slug FROM (SELECT market, store, count(*) OVER (PARTITION BY market, store) AS wins, median_open - price AS saving, slug, row_number() OVER (PARTITION BY market, store ORDER BY median_open - price DESC, slug) AS rn FROM offer JOIN card USING (product_id, market) WHERE in_stock AND price = lowest AND median_open IS NOT NULL) WHERE rn = 1")
def store_summary(v):
    best = v.offer.join(v.card, ["product_id", "market"]).where("in_stock and price = lowest and median_open is not null")
    best = best.withColumn("saving", F.col("median_open") - F.col("price"))
    top = F.min(F.struct((-F.col("saving")).alias("s"), "slug"))
    return best.groupBy("market", "store").agg(F.count("*").alias("wins"), (-top["s"]).alias("saving"), top["slug"].alias("slug"))


@query("SELECT o.product_id, o.store, o.price, s.lowest, s.median_open FROM offer o JOIN product p ON o.product_id = p.id LEFT JOIN stat s ON s.product_id = o.product_id AND s.market = o.market WHERE o.store = 3")
def store_page(v):
    o = v.offer.where("store = 3")
    return o.join(v.product.select("id"), F.col("product_id") == F.col("id")).join(v.stat, ["product_id", "market"], "left").select("product_id", "store", "price", "lowest", "median_open")


@query("SELECT product_id, store, price, in_stock FROM offer WHERE store = 5 ORDER BY in_stock DESC, price, product_id LIMIT 48 OFFSET 48")
def store_offers_page(v):
    return v.offer.where("store = 5").orderBy(F.desc("in_stock"), "price", "product_id").offset(48).limit(48).select("product_id", "store", "price", "in_stock")


@query("SELECT product_id, market, store, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id, market ORDER BY in_stock DESC, price, store) AS rn FROM offer) WHERE rn = 1 AND in_stock")
def headline_offers(v):
    best = F.min(F.struct("price", "store"))
    return v.offer.where("in_stock").groupBy("product_id", "market").agg(best.alias("b")).select("product_id", "market", "b.store", "b.price")


@query("SELECT slug, market, lowest FROM card WHERE in_stock_stores > 0 ORDER BY CASE set_code WHEN 'Brand#7' THEN 1 WHEN 'Brand#2' THEN 2 WHEN 'Brand#19' THEN 3 END NULLS LAST, product_type, name, slug, market LIMIT 48 OFFSET 96")
def browse_page(v):
    rank = ranking.listed_first("set_code", ["Brand#7", "Brand#2", "Brand#19"])
    return v.card.where(stats.is_open()).orderBy(rank.asc_nulls_last(), "product_type", "name", "slug", "market").offset(96).limit(48).select("slug", "market", "lowest")


@query("SELECT slug, market, set_code, lowest FROM (SELECT *, row_number() OVER (PARTITION BY set_code ORDER BY lowest, slug, market) AS rn FROM card WHERE lowest IS NOT NULL) WHERE rn <= 3 ORDER BY lowest, slug, market LIMIT 40")
def capped_by_set(v):
    return ranking.capped(v.card.where("lowest is not null"), "set_code", [F.asc("lowest"), F.asc("slug"), F.asc("market")], 3, 40).select("slug", "market", "set_code", "lowest")


@query("""SELECT id, product_type, turn FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY turn, product_type) AS again FROM (
  SELECT id, name, product_type, row_number() OVER (PARTITION BY product_type ORDER BY msrp, id) AS turn FROM product)) WHERE again = 1""")
def interleaved(v):
    found = ranking.interleave(v.product, "product_type", [F.asc("msrp"), F.asc("id")], ["name"])
    return found.select("id", "product_type", "turn")


@query("""n AS (SELECT id, product_type, size, row_number() OVER (PARTITION BY product_type ORDER BY msrp, id) AS i, count(*) OVER (PARTITION BY product_type) AS n FROM product),
spot AS (SELECT product_type, i AS a, n AS c FROM n WHERE size = 50),
one AS (SELECT product_type, max(a) AS a, max(c) AS c FROM spot GROUP BY 1)
SELECT id, n.product_type FROM n JOIN one USING (product_type) WHERE i <> a AND i >= greatest(1, least(a - 3, c - 6)) AND i <= greatest(1, least(a - 3, c - 6)) + 6""")
def same_type_neighbours(v):
    return ranking.neighbours(v.product, ["product_type"], [F.asc("msrp"), F.asc("id")], F.col("size") == 50, 6).select("id", "product_type")


@query("SELECT id FROM product WHERE set_code = 'Brand#5' UNION SELECT product_id FROM stat WHERE in_stock_stores >= 10")
def union_distinct(v):
    return v.product.where("set_code = 'Brand#5'").select("id").union(v.stat.where("in_stock_stores >= 10").select("product_id")).distinct()


@query("SELECT product_id FROM stat WHERE market = 'ASIA' AND in_stock_stores > 0 INTERSECT SELECT product_id FROM stat WHERE market = 'EUROPE' AND in_stock_stores > 0")
def in_both_markets(v):
    opened = lambda m: v.stat.where((F.col("market") == m) & stats.is_open()).select("product_id")
    return opened("ASIA").intersect(opened("EUROPE"))


@query("SELECT id FROM product WHERE id NOT IN (SELECT product_id FROM stat WHERE in_stock_stores > 0 AND market = 'ASIA')")
def never_open(v):
    return v.product.select("id").join(v.stat.where(stats.is_open() & (F.col("market") == "ASIA")), F.col("id") == F.col("product_id"), "left_anti")


@query("SELECT a.product_id, a.market AS buy_market, b.market AS sell_market, b.lowest - a.lowest AS gap FROM stat a JOIN stat b ON a.product_id = b.product_id AND a.market < b.market WHERE b.lowest > a.lowest * 2")
def cross_market_gaps(v):
    a, b = v.stat.select("product_id", F.col("market").alias("buy_market"), F.col("lowest").alias("low")), v.stat.select("product_id", F.col("market").alias("sell_market"), F.col("lowest").alias("high"))
    return a.join(b, "product_id").where("buy_market < sell_market and high > low * 2").select("product_id", "buy_market", "sell_market", (F.col("high") - F.col("low")).alias("gap"))


@query("""SELECT product_id, market, lowest, CASE WHEN median_open IS NULL THEN 'unknown' WHEN lowest * 2 < median_open THEN 'suspect' WHEN lowest * 10 < median_open * 9 THEN 'good'
  WHEN lowest * 10 <= median_open * 11 THEN 'fair' WHEN lowest * 2 <= median_open * 3 THEN 'high' ELSE 'far over' END AS verdict FROM stat WHERE lowest IS NOT NULL""")
def price_verdicts(v):
    return v.stat.where("lowest is not null").select("product_id", "market", "lowest", stats.price_verdict(F.col("lowest"), F.col("median_open")).alias("verdict"))


@query("""SELECT product_id, market, CASE WHEN in_stock_stores >= 3 THEN 'strong' WHEN in_stock_stores > 0 OR listed_stores >= 2 THEN 'middle' ELSE 'thin' END AS tier FROM stat""")
def index_tiers(v):
    return v.stat.select("product_id", "market", F.when(F.col("in_stock_stores") >= 3, "strong").when(stats.is_comparable(), "middle").otherwise("thin").alias("tier"))


@query("""item AS (SELECT o_custkey AS basket, l_partkey AS product_id, CAST(sum(l_quantity) AS BIGINT) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
best AS (SELECT basket, i.product_id, qty, price, store, row_number() OVER (PARTITION BY basket, i.product_id ORDER BY price, store) AS rn FROM item i JOIN offer o ON o.product_id = i.product_id AND in_stock)
SELECT basket, count(*) AS lines, count(DISTINCT store) AS stores, CAST(sum(price * qty) AS BIGINT) AS total FROM best WHERE rn = 1 GROUP BY 1""")
def best_basket_split(v):
    items = _baskets(v)
    best = F.min(F.struct("price", "store"))
    found = items.join(v.offer.where("in_stock").groupBy("product_id").agg(best.alias("b")), "product_id")
    return found.groupBy("basket").agg(F.count("*").alias("lines"), F.countDistinct("b.store").alias("stores"), F.sum(F.col("b.price") * F.col("qty")).alias("total"))


#: Lines of baskets that a task sums over stores.
LINES_A_TASK = 100_000


def _baskets(v):
    orders, lines = v.raw("orders"), v.raw("lineitem")
    found = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return found.groupBy(F.col("o_custkey").alias("basket"), F.col("l_partkey").alias("product_id")).agg(F.sum("l_quantity").cast("long").alias("qty"))


@query("""item AS (SELECT o_custkey AS basket, l_partkey AS product_id, CAST(sum(l_quantity) AS BIGINT) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
per AS (SELECT basket, store, count(*) AS lines, CAST(sum(price * qty) AS BIGINT) AS total FROM item i JOIN offer o ON o.product_id = i.product_id AND in_stock GROUP BY 1, 2)
SELECT basket, store, lines, total FROM (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY lines DESC, total, store) AS rn FROM per) WHERE rn = 1""")
def best_basket_one_store(v):
    """A basket's lines are brought together with their offers still packed, so one row a line is shuffled and not one for each line and store."""
    offers = v.offer.where("in_stock").groupBy("product_id").agg(F.collect_list(F.struct("store", "price")).alias("offers"))
    lines = _baskets(v).join(offers, "product_id").select("basket", "qty", "offers")
    # so many that the sums of a partition, some dozens of stores a line, fit a task
    parts = max(int(v.spark.conf.get("spark.sql.shuffle.partitions")), v.raw("lineitem").count() // LINES_A_TASK + 1)
    per = lines.repartition(parts, "basket").select("basket", "qty", F.inline("offers")).groupBy("basket", "store").agg(F.count("*").alias("lines"), F.sum(F.col("price") * F.col("qty")).alias("total"))
    best = per.groupBy("basket").agg(F.min(F.struct((-F.col("lines")).alias("lines"), "total", "store")).alias("b"))
    return best.select("basket", "b.store", (-F.col("b.lines")).alias("lines"), "b.total")


@query("""SELECT id, pos FROM (SELECT unnest([901, 3, 44, 7, 12, 3]) AS id, unnest([0, 1, 2, 3, 4, 5]) AS pos) JOIN product USING (id)""")
def lookup_in_given_order(v):
    wanted = v.spark.createDataFrame([(i, n) for n, i in enumerate([901, 3, 44, 7, 12, 3])], "id long, pos int")
    return wanted.join(v.product.select("id"), "id").select("id", "pos").orderBy("pos")


@query("""SELECT market, product_type, units, now, priced FROM (SELECT market, product_type, CAST(sum(size) AS BIGINT) AS units, CAST(sum(lowest * size) AS BIGINT) AS now, count(lowest) AS priced FROM card GROUP BY 1, 2)""")
def portfolio_totals(v):
    return v.card.groupBy("market", "product_type").agg(F.sum("size").cast("long").alias("units"), F.sum(F.col("lowest") * F.col("size")).alias("now"), F.count("lowest").alias("priced"))


@query("""SELECT id, set_code, size FROM (SELECT *, count(*) OVER (PARTITION BY set_code, size) AS n FROM product) WHERE n = 1""")
def shared_values_dropped(v):
    alone = v.product.groupBy("set_code", "size").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return alone.select("id", "set_code", "size")


@query("""hub AS (SELECT unnest(['cold', 'widget', 'gear', 'small']) AS hub)
SELECT hub, count(*) AS products FROM product JOIN hub ON regexp_matches(name, '(?i)\\b' || hub || '\\b') GROUP BY 1""")
def products_by_hub(v):
    hubs = ["cold", "widget", "gear", "small"]
    hit = F.filter(F.array(*[F.when(F.col("name").rlike(rf"(?i)\b{h}\b"), F.lit(h)) for h in hubs]), lambda h: h.isNotNull())
    return v.product.select(F.explode(hit).alias("hub")).groupBy("hub").agg(F.count("*").alias("products"))


@query("""SELECT arm, count(*) AS shown, count(*) FILTER (event_type = 'purchase') AS bought FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, event_type FROM events) GROUP BY 1""")
def ab_counts(v):
    return v.raw("events").select(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("arm"), "event_type").groupBy("arm").agg(F.count("*").alias("shown"), F.count_if(F.col("event_type") == "purchase").alias("bought"))


@query("""SELECT product_id, market, reason FROM (SELECT product_id, market, CASE WHEN in_stock_stores >= 2 THEN 'stores' WHEN product_type IN ('ECONOMY', 'PROMO') THEN 'core' WHEN size > 45 THEN 'new' END AS reason FROM card) WHERE reason IS NOT NULL""")
def cull_kept(v):
    reason = F.when(F.col("in_stock_stores") >= 2, "stores").when(F.col("product_type").isin("ECONOMY", "PROMO"), "core").when(F.col("size") > 45, "new")
    return v.card.select("product_id", "market", reason.alias("reason")).where("reason is not null")


@query("""feed AS (SELECT event_type AS feed, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM events WHERE value > 150),
ranked AS (SELECT feed, count(*) AS n, CASE feed WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS pri FROM feed GROUP BY 1 HAVING count(*) >= 20)
SELECT feed, n FROM (SELECT *, row_number() OVER (ORDER BY pri, feed) AS rn FROM ranked) WHERE rn = 1""")
def first_feed_with_enough(v):
    counts = v.raw("events").where("value > 150").groupBy(F.col("event_type").alias("feed")).agg(F.count("*").alias("n")).where("n >= 20")
    pri = F.coalesce(ranking.listed_first("feed", ["signup", "purchase", "view"]), F.lit(4))
    return counts.orderBy(pri, "feed").limit(1)


@query("""SELECT store, market, count(*) AS n FROM offer WHERE seen >= (SELECT max(seen) FROM listing) - INTERVAL 730 DAY GROUP BY 1, 2""")
def fresh_offers_by_store(v):
    # one row: the latest time of all listings stands for now
    now = v.listing.agg(F.max("seen").alias("now"))
    return v.offer.join(F.broadcast(now)).where(F.col("seen") >= F.col("now") - F.expr("INTERVAL 730 DAY")).groupBy("store", "market").agg(F.count("*").alias("n"))


@query("""SELECT product_id, store, CASE WHEN NOT in_stock THEN 'soldout' WHEN seen < (SELECT max(seen) FROM listing) - INTERVAL 365 DAY THEN 'unknown' ELSE 'open' END AS state FROM offer""")
def freshness_states(v):
    now = v.listing.agg(F.max("seen").alias("now"))
    state = F.when(~F.col("in_stock"), "soldout").when(F.col("seen") < F.col("now") - F.expr("INTERVAL 365 DAY"), "unknown").otherwise("open")
    return v.offer.join(F.broadcast(now)).select("product_id", "store", state.alias("state"))
