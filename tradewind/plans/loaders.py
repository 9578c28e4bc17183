"""Page and batch loaders: rails, ranked offers, pickers, lookups with fallbacks, and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tradewind.operators import ranking, stats
from tradewind.plans.registry import query

OPEN = "lowest IS NOT NULL"
#: Prices, in cents, at which a delivery quote changes, and the quote.
LADDER = [(0, 900), (95_000, 700), (120_000, 450), (180_000, 0)]
LADDER_SQL = "ladder AS (SELECT unnest([0, 95000, 120000, 180000]) AS step, unnest([900, 700, 450, 0]) AS quote)"


def _ladder(v):
    # a list in the program, so small by construction
    return F.broadcast(v.spark.createDataFrame(LADDER, "step long, quote int"))


@query("""SELECT product_id, store, rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN NOT in_stock THEN 2 WHEN seen < TIMESTAMP '1997-01-01' THEN 1 ELSE 0 END, price, store) AS rank FROM offer) WHERE rank <= 200""")
def ranked_offers(v):
    state = F.when(~F.col("in_stock"), 2).when(F.col("seen") < F.lit("1997-01-01").cast("timestamp_ntz"), 1).otherwise(0)
    return ranking.first_per(v.offer, ["product_id"], [state, F.col("price"), F.col("store")], 200, "rank").select("product_id", "store", "rank")


@query("""o AS (SELECT set_code, o.product_id, store, price, row_number() OVER (PARTITION BY o.product_id ORDER BY price, store) AS rn FROM offer o JOIN product ON o.product_id = id WHERE in_stock),
p AS (SELECT set_code, id, row_number() OVER (PARTITION BY set_code ORDER BY msrp, id) AS pn FROM product)
SELECT set_code, product_id, store, price FROM o JOIN (SELECT id FROM p WHERE pn <= 30) ON product_id = id WHERE rn <= 40""")
def set_offer_groups(v):
    chosen = ranking.first_per(v.product, ["set_code"], [F.asc("msrp"), F.asc("id")], 30).select("id", "set_code")
    offers = ranking.first_per(v.offer.where("in_stock"), ["product_id"], [F.asc("price"), F.asc("store")], 40)
    return offers.join(chosen, F.col("product_id") == F.col("id")).select("set_code", "product_id", "store", "price")


@query("SELECT market, product_type, slug, in_stock_stores FROM (SELECT *, row_number() OVER (PARTITION BY market, product_type ORDER BY in_stock_stores DESC, lowest, slug) AS rn FROM card WHERE in_stock_stores > 0) WHERE rn <= 8")
def home_rails(v):
    order = [F.desc("in_stock_stores"), F.asc("lowest"), F.asc("slug")]
    return ranking.first_per(v.card.where(stats.is_open()), ["market", "product_type"], order, 8).select("market", "product_type", "slug", "in_stock_stores")


@query("SELECT market, slug, lowest FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY lowest DESC, slug) AS rn FROM card WHERE in_stock_stores > 0) WHERE rn <= 10")
def dearest_in_stock(v):
    return ranking.first_per(v.card.where(stats.is_open()), ["market"], [F.desc("lowest"), F.asc("slug")], 10).select("market", "slug", "lowest")


@query("""c AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY price, product_id, store) AS rn FROM offer WHERE in_stock)
SELECT market, product_id, store, price FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY seen DESC, product_id, store) AS again FROM c WHERE rn <= 48) WHERE again <= 12""")
def newest_of_cheapest(v):
    cheap = ranking.first_per(v.offer.where("in_stock"), ["market"], [F.asc("price"), F.asc("product_id"), F.asc("store")], 48)
    return ranking.first_per(cheap, ["market"], [F.desc("seen"), F.asc("product_id"), F.asc("store")], 12).select("market", "product_id", "store", "price")


@query("SELECT product_type, set_code, count(*) AS n FROM product GROUP BY 1, 2 HAVING count(*) >= 2")
def facets(v):
    return v.product.groupBy("product_type", "set_code").agg(F.count("*").alias("n")).where("n >= 2")


@query("""r AS (SELECT *, row_number() OVER (PARTITION BY set_code ORDER BY msrp DESC, id) AS dear, row_number() OVER (PARTITION BY set_code ORDER BY msrp, id) AS cheap, row_number() OVER (PARTITION BY set_code ORDER BY id DESC) AS newest FROM product)
SELECT set_code, 'dearest' AS why, id FROM r WHERE dear = 1 UNION ALL SELECT set_code, 'cheapest', id FROM r WHERE cheap = 1 UNION ALL SELECT set_code, 'newest', id FROM r WHERE newest = 1""")
def notable_rows(v):
    found = v.product.groupBy("set_code").agg(
        F.min(F.struct((-F.col("msrp")).alias("m"), "id"))["id"].alias("dearest"), F.min(F.struct("msrp", "id"))["id"].alias("cheapest"), F.max("id").alias("newest")
    )
    return found.unpivot("set_code", ["dearest", "cheapest", "newest"], "why", "id")


@query("SELECT market, set_code, n FROM (SELECT market, set_code, count(*) AS n, row_number() OVER (PARTITION BY market ORDER BY count(*) DESC, set_code) AS rn FROM offer JOIN product ON product_id = id GROUP BY 1, 2) WHERE rn <= 20")
def popular_sets(v):
    counts = v.offer.join(v.product, F.col("product_id") == F.col("id")).groupBy("market", "set_code").agg(F.count("*").alias("n"))
    return ranking.first_per(counts, ["market"], [F.desc("n"), F.asc("set_code")], 20)


@query("""SELECT market, slug, lowest, msrp, rank FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY lowest / msrp, slug) AS rank FROM card WHERE lowest * 100 <= msrp * 99 AND lowest * 100 >= msrp * 30 AND msrp - lowest >= 200) WHERE rank <= 100""")
def under_guide_price(v):
    low, guide = F.col("lowest"), F.col("msrp")
    found = v.card.where((low * 100 <= guide * 99) & (low * 100 >= guide * 30) & (guide - low >= 200))
    return ranking.first_per(found, ["market"], [low / guide, F.col("slug")], 100, "rank").select("market", "slug", "lowest", "msrp", "rank")


@query("SELECT set_code, min(lowest) FILTER (product_type = 'ECONOMY') AS economy, min(lowest) FILTER (product_type = 'PROMO') AS promo FROM card WHERE market = 'ASIA' GROUP BY 1")
def set_calendar(v):
    of = lambda t: F.min(F.when(F.col("product_type") == t, F.col("lowest")))
    return v.card.where("market = 'ASIA'").groupBy("set_code").agg(of("ECONOMY").alias("economy"), of("PROMO").alias("promo"))


@query("""SELECT s.product_id, s.market, coalesce(s.lowest, a.cents) AS reference, CASE WHEN coalesce(s.lowest, a.cents) >= 180000 THEN 'high' WHEN coalesce(s.lowest, a.cents) >= 100000 THEN 'middle' ELSE 'low' END AS tier
FROM stat s JOIN (SELECT product_id, market, min(price) AS cents FROM offer GROUP BY 1, 2) a USING (product_id, market)""")
def reference_tiers(v):
    either = v.offer.groupBy("product_id", "market").agg(F.min("price").alias("any_price"), F.min(F.when(F.col("in_stock"), F.col("price"))).alias("open_price"))
    reference = F.coalesce("open_price", "any_price")
    tier = F.when(reference >= 180_000, "high").when(reference >= 100_000, "middle").otherwise("low")
    return either.select("product_id", "market", reference.alias("reference"), tier.alias("tier"))


@query("SELECT event_type AS feed, min(ts) AS oldest, count(DISTINCT user_id) AS users, count(*) FILTER (props LIKE '%1%') AS marked FROM events GROUP BY 1")
def feed_summary(v):
    return v.raw("events").groupBy(F.col("event_type").alias("feed")).agg(F.min("ts").alias("oldest"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("props").like("%1%")).alias("marked"))


@query("SELECT DISTINCT market FROM stat WHERE product_id IN (SELECT id FROM product WHERE set_code = 'Brand#7')")
def markets_with_set(v):
    return v.stat.join(v.product.where("set_code = 'Brand#7'"), F.col("product_id") == F.col("id"), "left_semi").select("market").distinct()


@query("""SELECT a.id, b.id AS related FROM product a JOIN (SELECT *, row_number() OVER (PARTITION BY set_code ORDER BY msrp, id) AS rn FROM product) b ON a.set_code = b.set_code AND a.id <> b.id WHERE b.rn <= 8""")
def related_products(v):
    """The set's eight cheapest, for every product but itself: a join with at most eight rows a set."""
    top = ranking.first_per(v.product, ["set_code"], [F.asc("msrp"), F.asc("id")], 8).select("set_code", F.col("id").alias("related"))
    return v.product.select("id", "set_code").join(top, "set_code").where("id <> related").select("id", "related")


@query("""cap AS (SELECT unnest(['ASIA', 'EUROPE', 'AMERICA']) AS market, unnest([50, 30, 20]) AS cap)
SELECT market, slug FROM (SELECT market, slug, row_number() OVER (PARTITION BY market ORDER BY in_stock_stores DESC, slug) AS rn FROM card) JOIN cap USING (market) WHERE rn <= cap""")
def top_by_market_cap(v):
    caps = F.create_map(*[F.lit(x) for pair in (("ASIA", 50), ("EUROPE", 30), ("AMERICA", 20)) for x in pair])
    ranked = ranking.first_per(v.card, ["market"], [F.desc("in_stock_stores"), F.asc("slug")], 50, "rn")
    return ranked.where(F.col("rn") <= F.element_at(caps, F.col("market"))).select("market", "slug")


@query("""SELECT name, count(*) AS n, min(msrp) AS low, max(msrp) AS high, CAST(sum(msrp) AS BIGINT) AS total, count(DISTINCT set_code) AS sets, count(DISTINCT product_type) AS types, min(lpad(CAST(length(slug) AS VARCHAR), 4, '0') || slug)[5:] AS shortest FROM product GROUP BY 1""")
def name_stats(v):
    return v.product.groupBy("name").agg(
        F.count("*").alias("n"), F.min("msrp").alias("low"), F.max("msrp").alias("high"), F.sum("msrp").alias("total"), F.countDistinct("set_code").alias("sets"),
        F.countDistinct("product_type").alias("types"), F.min(F.struct(F.length("slug"), "slug"))["slug"].alias("shortest"),
    )


@query("SELECT name, id, set_code FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN product_type = 'STANDARD' THEN 0 ELSE 1 END, msrp, id) AS rn FROM product) WHERE rn = 1")
def preferred_of_name(v):
    best = F.min(F.struct(F.when(F.col("product_type") == "STANDARD", 0).otherwise(1).alias("p"), "msrp", "id", "set_code"))
    return v.product.groupBy("name").agg(best.alias("b")).select("name", "b.id", "b.set_code")


@query(f"""{LADDER_SQL}
SELECT product_id, market, lowest, (SELECT arg_max(quote, step) FROM ladder WHERE step <= lowest) AS below, (SELECT arg_min(quote, step) FROM ladder WHERE step > lowest) AS above FROM stat WHERE {OPEN}""")
def quotes_around_price(v):
    steps = F.array(*[F.struct(F.lit(s).cast("long").alias("step"), F.lit(q).alias("quote")) for s, q in LADDER])
    below = F.array_max(F.filter(steps, lambda x: x["step"] <= F.col("lowest")))["quote"]
    above = F.array_min(F.filter(steps, lambda x: x["step"] > F.col("lowest")))["quote"]
    return v.stat.where("lowest is not null").select("product_id", "market", "lowest", below.alias("below"), above.alias("above"))


@query(f"""{LADDER_SQL},
d AS (SELECT market, step, product_id, abs(lowest - step) AS far, row_number() OVER (PARTITION BY market, step ORDER BY abs(lowest - step), product_id) AS rn FROM stat, ladder WHERE {OPEN})
SELECT market, step, product_id, far FROM d WHERE rn = 1""")
def nearest_to_ladder(v):
    """One product for each rung; the minimum is taken before the shuffle, so the rungs add no rows to it."""
    near = v.stat.where("lowest is not null").join(_ladder(v)).groupBy("market", "step").agg(F.min(F.struct(F.abs(F.col("lowest") - F.col("step")).alias("far"), "product_id")).alias("b"))
    return near.select("market", "step", "b.product_id", "b.far")


@query(f"""{LADDER_SQL}
SELECT product_id, store, price + (SELECT arg_max(quote, step) FROM ladder WHERE step <= price) AS total, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN NOT in_stock THEN 1 ELSE 0 END, price + (SELECT arg_max(quote, step) FROM ladder WHERE step <= price), store) AS rank FROM offer) WHERE rank <= 3""")
def ranked_with_postage(v):
    quote = reduce(lambda found, x: F.when(F.col("price") >= x[0], x[1]).otherwise(found), LADDER[1:], F.lit(LADDER[0][1]))
    found = v.offer.withColumn("total", F.col("price") + quote)
    return ranking.first_per(found, ["product_id"], [F.when(~F.col("in_stock"), 1).otherwise(0), F.col("total"), F.col("store")], 3, "rank").select("product_id", "store", "total", "rank")


@query("SELECT market, array_to_string(list(CAST(store AS VARCHAR) ORDER BY store), ',') AS stores FROM (SELECT DISTINCT market, store FROM offer WHERE in_stock) GROUP BY 1")
def active_stores(v):
    ordered = F.transform(F.sort_array(F.collect_set("store")), lambda s: s.cast("string"))
    return v.offer.where("in_stock").groupBy("market").agg(F.array_join(ordered, ",").alias("stores"))


@query("""old AS (SELECT product_id, market, min(price) AS was FROM offer GROUP BY 1, 2)
SELECT product_id, market, was, lowest AS now FROM old JOIN stat USING (product_id, market) WHERE was IS DISTINCT FROM lowest""")
def lowest_recomputed(v):
    found = v.offer.groupBy("product_id", "market").agg(F.min("price").alias("was"), F.min(F.when(F.col("in_stock"), F.col("price"))).alias("now"))
    return found.where(~F.col("was").eqNullSafe(F.col("now")))


@query("""line AS (SELECT DISTINCT p_name AS line FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part UNION SELECT 'nothing'),
exact AS (SELECT line, min(id) AS id FROM line JOIN product ON name = line GROUP BY 1),
loose AS (SELECT line, min(id) AS id FROM line JOIN product ON split_part(name, ' ', 1) = line WHERE line NOT IN (SELECT line FROM exact) GROUP BY 1)
SELECT line, coalesce(e.id, l.id) AS id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN l.id IS NOT NULL THEN 'first word' ELSE 'none' END AS how FROM line LEFT JOIN exact e USING (line) LEFT JOIN loose l USING (line)""")
def lines_resolved(v):
    """Exact name, else the first word of a name, else nothing; each fallback is an equi-join of grouped rows."""
    name, word = F.col("name"), F.split("name", " ")[0]
    lines = v.product.select(name.alias("line")).union(v.product.select(word.alias("line"))).union(v.spark.createDataFrame([("nothing",)], "line string")).distinct()
    exact = v.product.groupBy(name.alias("line")).agg(F.min("id").alias("exact"))
    loose = v.product.groupBy(word.alias("line")).agg(F.min("id").alias("loose"))
    found = lines.join(exact, "line", "left").join(loose, "line", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "first word").otherwise("none")
    return found.select("line", F.coalesce("exact", "loose").alias("id"), how.alias("how"))


@query("""SELECT product_id, market, CASE WHEN lowest IS NULL OR median_open IS NULL THEN 'unknown' WHEN lowest = median_open THEN 'hit' WHEN lowest * 4 >= median_open * 3 AND lowest * 3 <= median_open * 4 THEN 'close' ELSE 'miss' END AS cell FROM stat""")
def cells_compared(v):
    low, mid = F.col("lowest"), F.col("median_open")
    cell = F.when(low.isNull() | mid.isNull(), "unknown").when(low == mid, "hit").when((low * 4 >= mid * 3) & (low * 3 <= mid * 4), "close").otherwise("miss")
    return v.stat.select("product_id", "market", cell.alias("cell"))


@query("""rate AS (SELECT unnest(['ECONOMY', 'STANDARD', 'PROMO']) AS product_type, unnest([700, 250, 50]) AS per_mille)
SELECT market, CAST(sum(CAST(floor(CAST(total AS DOUBLE) / n * per_mille / 1000 + 0.5) AS BIGINT)) AS BIGINT) AS expected FROM (SELECT market, product_type, sum(lowest) AS total, count(lowest) AS n FROM card WHERE lowest IS NOT NULL GROUP BY 1, 2) JOIN rate USING (product_type) GROUP BY 1""")
def expected_value(v):
    rates = F.create_map(*[F.lit(x) for pair in (("ECONOMY", 700), ("STANDARD", 250), ("PROMO", 50)) for x in pair])
    per = v.card.where("lowest is not null").groupBy("market", "product_type").agg(F.sum("lowest").alias("total"), F.count("lowest").alias("n"))
    part = F.floor(F.col("total").cast("double") / F.col("n") * F.element_at(rates, F.col("product_type")) / 1000 + 0.5).cast("long")
    return per.where(F.col("product_type").isin("ECONOMY", "STANDARD", "PROMO")).groupBy("market").agg(F.sum(part).alias("expected"))


@query("""SELECT CASE WHEN product_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'type' WHEN lowest IS NULL THEN 'closed' WHEN lowest < 95000 THEN 'price floor' ELSE 'kept' END AS reason, count(*) AS n FROM card GROUP BY 1""")
def miss_reasons(v):
    reason = F.when(~F.col("product_type").isin("ECONOMY", "STANDARD", "PROMO"), "type").when(F.col("lowest").isNull(), "closed").when(F.col("lowest") < 95_000, "price floor").otherwise("kept")
    return v.card.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT 'offers' AS kind, count(*) AS n FROM offer UNION ALL SELECT 'stores', count(DISTINCT store) FROM offer UNION ALL SELECT 'products', count(*) FROM product""")
def site_counts(v):
    count = lambda df, kind, n: df.agg(n.alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(v.offer, "offers", F.count("*")).union(count(v.offer, "stores", F.countDistinct("store"))).union(count(v.product, "products", F.count("*")))


@query("""lead AS (SELECT set_code FROM card WHERE in_stock_stores > 0 GROUP BY 1 ORDER BY count(DISTINCT market) DESC, count(*) DESC, set_code LIMIT 1)
SELECT market, product_type, min(lowest) AS lowest FROM card WHERE set_code = (SELECT set_code FROM lead) AND in_stock_stores > 0 GROUP BY 1, 2""")
def lead_set_across_markets(v):
    opened = v.card.where(stats.is_open())
    reach = opened.groupBy("set_code").agg(F.countDistinct("market").alias("m"), F.count("*").alias("n"))
    # one row
    lead = F.broadcast(reach.orderBy(F.desc("m"), F.desc("n"), "set_code").limit(1).select("set_code"))
    return opened.join(lead, "set_code", "left_semi").groupBy("market", "product_type").agg(F.min("lowest").alias("lowest"))


@query("""today AS (SELECT DISTINCT product_id, market FROM history WHERE day > DATE '1998-01-01'), known AS (SELECT DISTINCT product_id, market FROM history WHERE day <= DATE '1998-01-01')
SELECT product_id, market FROM today EXCEPT SELECT product_id, market FROM known""")
def inserted_keys(v):
    """Keys that an insert which skips duplicates would add."""
    after = F.col("day") > F.lit("1998-01-01").cast("date")
    first = v.history.groupBy("product_id", "market").agg(F.min("day").alias("day"))
    return first.where(after).select("product_id", "market")


@query("""t AS (SELECT id, name, set_code, product_type FROM product)
SELECT id FROM t WHERE (name ILIKE '%gear%' OR set_code ILIKE '%gear%' OR product_type ILIKE '%gear%') AND (name ILIKE '%brand#1%' OR set_code ILIKE '%brand#1%' OR product_type ILIKE '%brand#1%')""")
def every_term_somewhere(v):
    hit = lambda term: reduce(lambda a, b: a | b, [F.lower(c).contains(term) for c in ("name", "set_code", "product_type")])
    return v.product.where(reduce(lambda a, b: a & b, map(hit, ["gear", "brand#1"]))).select("id")


@query("""s AS (SELECT product_type, array_to_string(list_sort(list_distinct(string_split(lower(name), ' '))), ' ') AS signature, set_code FROM product)
SELECT product_type, signature, count(DISTINCT set_code) AS sets FROM s GROUP BY 1, 2""")
def sets_of_signature(v):
    signature = F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("name"), " "))), " ")
    return v.product.groupBy("product_type", signature.alias("signature")).agg(F.countDistinct("set_code").alias("sets"))


@query("""SELECT market, store, pos, lines, CAST(total AS BIGINT) AS total FROM (SELECT market, store, min(product_id) AS pos, count(*) AS lines, sum(price) AS total FROM offer WHERE in_stock GROUP BY 1, 2)""")
def carts_by_store(v):
    return v.offer.where("in_stock").groupBy("market", "store").agg(F.min("product_id").alias("pos"), F.count("*").alias("lines"), F.sum("price").alias("total"))


@query("""own AS (SELECT market, product_id, 0 AS pri, lowest FROM card WHERE set_code = 'Brand#7' AND in_stock_stores > 0), more AS (SELECT market, product_id, 1 AS pri, lowest FROM card WHERE in_stock_stores >= 3),
u AS (SELECT market, product_id, min(pri) AS pri, min(lowest) AS lowest FROM (SELECT * FROM own UNION ALL SELECT * FROM more) GROUP BY 1, 2)
SELECT market, product_id FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY pri, lowest, product_id) AS rn FROM u) WHERE rn <= 12""")
def topped_up(v):
    """A set's own open rows, topped up from the well stocked, each product once."""
    pri = F.when(F.col("set_code") == "Brand#7", 0).otherwise(1)
    either = v.card.where((stats.is_open() & (F.col("set_code") == "Brand#7")) | (F.col("in_stock_stores") >= 3))
    return ranking.first_per(either, ["market"], [pri, F.col("lowest"), F.col("product_id")], 12).select("market", "product_id")
