"""Boards and loaders: product pages, charts, demand ranking, alerts, order book, sinks and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.functions import calc
from tradewind.operators import demand, ranking, ranks
from tradewind.plans.registry import query
from tradewind.plans.series import KEY, MOVES, moves

RATES = {"AFRICA": 5, "AMERICA": 100, "ASIA": 70, "EUROPE": 110, "MIDDLE EAST": 27}


def rate():
    """Hundredths of the common currency for one of a market's: a map in the program."""
    pick = None
    for name, x in RATES.items():
        pick = F.when(F.col("market") == name, x) if pick is None else pick.when(F.col("market") == name, x)
    return pick


RATE = "CASE market " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in RATES.items()) + " END"


@query("SELECT * FROM offer WHERE store % 10 <> 7 AND NOT (market = 'ASIA' AND price > 150000)")
def row_policy(v):
    """What a public reader may see: no banned store, no gated offer."""
    banned = v.store.where("store % 10 = 7").select("store")
    return v.offer.join(banned, "store", "left_anti").where("not (market = 'ASIA' and price > 150000)").select("product_id", "store", "market", "price", "in_stock", "seen")


@query("""own AS (SELECT set_code, min(seen) AS released FROM listing JOIN product ON product_id = id WHERE size > 25 GROUP BY 1),
other AS (SELECT set_code, min(seen) AS released FROM listing JOIN product ON product_id = id WHERE product_type = 'PROMO' GROUP BY 1)
SELECT id, coalesce(o.released, t.released) AS released FROM product LEFT JOIN own o USING (set_code) LEFT JOIN other t USING (set_code)""")
def release_dates(v):
    """Release by set from the first list that has it. Sets are a dimension of bounded size."""
    rows = v.listing.select("product_id", "seen").join(v.product.select("id", "set_code", "size", "product_type"), F.col("product_id") == F.col("id"))
    found = rows.groupBy("set_code").agg(F.min(F.when(F.col("size") > 25, F.col("seen"))).alias("own"), F.min(F.when(F.col("product_type") == "PROMO", F.col("seen"))).alias("other"))
    return v.product.select("id", "set_code").join(found, "set_code", "left").select("id", F.coalesce("own", "other").alias("released"))


@query("""SELECT market, slug, CAST(to_json([replace(slug, '-', '~'), market, CAST(lowest AS VARCHAR), CAST(in_stock_stores AS VARCHAR)]) AS VARCHAR) AS cells FROM card WHERE lowest IS NOT NULL""")
def compact_rows(v):
    """A row as a positional list, for readers that know the places."""
    cells = F.array(F.regexp_replace("slug", "-", "~"), "market", F.col("lowest").cast("string"), F.col("in_stock_stores").cast("string"))
    return v.card.where("lowest is not null").select("market", "slug", F.to_json(cells).alias("cells"))


@query("""SELECT id, min(lowest) FILTER (market = CASE CAST(id % 3 AS INT) WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' ELSE 'AMERICA' END) AS price FROM product LEFT JOIN stat ON product_id = id GROUP BY 1""")
def price_of_own_market(v):
    n = F.col("id") % 3
    mine = F.when(n == 0, "ASIA").when(n == 1, "EUROPE").otherwise("AMERICA")
    rows = v.product.select("id").join(v.stat.select("product_id", "market", "lowest"), F.col("id") == F.col("product_id"), "left")
    return rows.groupBy("id").agg(F.min(F.when(F.col("market") == mine, F.col("lowest"))).alias("price"))


@query("""best AS (SELECT product_id, min(lowest) AS buy, arg_min(market, (lowest, market)) AS buy_market, max(CAST(floor(median_open * 0.9 + 0.5) AS BIGINT)) AS sell FROM stat WHERE lowest IS NOT NULL GROUP BY 1)
SELECT product_id, buy, buy_market, sell, sell - buy AS profit FROM best WHERE sell > buy""")
def best_sides(v):
    """Cheapest market to buy in and what the best one pays after a fee of a tenth; ties go to the first name."""
    net = F.floor(F.col("median_open") * 0.9 + 0.5).cast("long")
    best = v.stat.where("lowest is not null").groupBy("product_id").agg(F.min(F.struct("lowest", "market")).alias("b"), F.max(net).alias("sell"))
    rows = best.select("product_id", F.col("b.lowest").alias("buy"), F.col("b.market").alias("buy_market"), "sell")
    return rows.withColumn("profit", F.col("sell") - F.col("buy")).where("profit > 0")


@query("""o AS (SELECT product_id, count(DISTINCT store) AS stores, min(price) FILTER (in_stock) AS cheapest, array_to_string(list(store || ':' || price ORDER BY price, store) FILTER (in_stock), ',') AS offers FROM offer GROUP BY 1)
SELECT id, slug, coalesce(stores, 0) AS stores, cheapest, offers FROM product LEFT JOIN o ON product_id = id""")
def product_page(v):
    """A product with its open offers, cheapest first. A product has at most one offer a store."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("in_stock"), F.struct("price", "store")))), lambda x: F.concat_ws(":", x["store"].cast("string"), x["price"].cast("string"))), ",")
    o = v.offer.groupBy("product_id").agg(F.count("*").alias("stores"), F.min(F.when(F.col("in_stock"), F.col("price"))).alias("cheapest"), F.nullif(listed, F.lit("")).alias("offers"))
    rows = v.product.select("id", "slug").join(o, F.col("id") == F.col("product_id"), "left")
    return rows.select("id", "slug", F.coalesce("stores", F.lit(0)).alias("stores"), "cheapest", "offers")


PCT = "round((after - before) * 100.0 / before, 1)"


def _chart(v, fall: bool):
    pct = F.round((F.col("after") - F.col("before")) * 100.0 / F.col("before"), 1)
    rows = moves(v).withColumn("pct", pct).where(F.col("pct") < 0 if fall else F.col("pct") > 0)
    order = [F.asc("pct") if fall else F.desc("pct"), F.asc("product_id")]
    return ranking.first_per(rows, ["market"], order, 100, "place").select("market", "product_id", "pct", "place")


@query(f"{MOVES}\nSELECT market, product_id, pct, place FROM (SELECT market, product_id, {PCT} AS pct, row_number() OVER (PARTITION BY market ORDER BY {PCT} DESC, product_id) AS place FROM moves WHERE {PCT} > 0) WHERE place <= 100")
def rising_chart(v):
    return _chart(v, fall=False)


@query(f"{MOVES}\nSELECT market, product_id, pct, place FROM (SELECT market, product_id, {PCT} AS pct, row_number() OVER (PARTITION BY market ORDER BY {PCT}, product_id) AS place FROM moves WHERE {PCT} < 0) WHERE place <= 100")
def falling_chart(v):
    return _chart(v, fall=True)


@query("""days AS (SELECT market, CAST(date_trunc('week', day) AS DATE) AS week, count(DISTINCT day) AS days, count(*) AS points FROM history GROUP BY 1, 2)
SELECT market, week, points FROM days WHERE days = 7 AND points >= 40""")
def chart_weeks(v):
    """Weeks of which every day was seen and that have points enough for a chart."""
    by = v.history.groupBy("market", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.countDistinct("day").alias("days"), F.count("*").alias("points"))
    return by.where("days = 7 and points >= 40").select("market", "week", "points")


@query("""qty AS (SELECT market, product_id, 1 + product_id % 3 AS qty FROM (SELECT DISTINCT market, product_id FROM history) WHERE product_id < 60),
m AS (SELECT market, product_id, CAST(date_trunc('month', day) AS DATE) AS month, min(price) AS price FROM history WHERE product_id < 60 GROUP BY 1, 2, 3),
months AS (SELECT DISTINCT month FROM m),
f AS (SELECT q.market, q.product_id, month, qty, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY q.market, q.product_id ORDER BY month),
        first_value(price IGNORE NULLS) OVER (PARTITION BY q.market, q.product_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS price
      FROM qty q JOIN months ON true LEFT JOIN m USING (market, product_id, month))
SELECT market, month, CAST(sum(price * qty) AS BIGINT) AS worth, CAST(sum(qty) AS BIGINT) AS units FROM f GROUP BY 1, 2""")
def portfolio_worth(v):
    """Worth of a portfolio by month: the last known price, before it the first, times the units held."""
    held = v.history.where("product_id < 60")
    m = held.groupBy(*KEY, F.to_date(F.date_trunc("month", "day")).alias("month")).agg(F.min("price").alias("price"))
    # months are a calendar: a few hundred rows
    grid = held.select(*KEY).distinct().crossJoin(F.broadcast(m.select("month").distinct()))
    w = Window.partitionBy(*KEY).orderBy("month")
    filled = F.coalesce(F.last("price", ignorenulls=True).over(w), F.first("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = grid.join(m, [*KEY, "month"], "left").withColumn("price", filled).withColumn("qty", F.col("product_id") % 3 + 1)
    return rows.groupBy("market", "month").agg(F.sum(F.col("price") * F.col("qty")).alias("worth"), F.sum("qty").alias("units"))


DEMAND = """seen AS (SELECT product_id, count(*) AS views, count(*) FILTER (in_stock) AS clicks, count(DISTINCT store) AS stores FROM listing GROUP BY 1),
demand AS (SELECT product_id, views, clicks, round(3 * log2(views + 1) + 2 * log10(clicks + 1) + ln(1 + stores), 6) AS value FROM seen)"""


def _demand(v):
    seen = v.listing.groupBy("product_id").agg(F.count("*").alias("views"), F.count_if("in_stock").alias("clicks"), F.countDistinct("store").alias("stores"))
    return seen.select("product_id", "views", "clicks", F.round(demand.demand_value(F.col("views"), F.col("clicks"), F.col("stores")), 6).alias("value"))


@query(f"{DEMAND}\nSELECT product_id, value FROM demand")
def demand_values(v):
    return _demand(v).select("product_id", "value")


@query(f"""{DEMAND},
page AS (SELECT id, slug, value, clicks > 0 AND id % 5 <> 0 AS known FROM product JOIN demand ON product_id = id ORDER BY id LIMIT 200),
r AS (SELECT *, row_number() OVER (PARTITION BY known ORDER BY value DESC, id) AS r, count(*) FILTER (known) OVER () AS n, count(*) FILTER (NOT known) OVER () AS e FROM page)
SELECT id, CASE WHEN known THEN r + least(e, CASE WHEN r < 3 THEN 0 ELSE 1 + (r - 3) // 7 END) ELSE least(3 + 8 * (r - 1), n + r) END AS slot FROM r""")
def explored_page(v):
    """A page of 200 products by demand, those without a signal at places 3, 11 and so on."""
    rows = v.product.select("id", "slug").join(_demand(v), F.col("id") == F.col("product_id")).orderBy("id").limit(200)
    known = (F.col("clicks") > 0) & (F.col("id") % 5 != 0)
    return demand.explore_slots(rows, known, [F.desc("value"), F.asc("id")]).select("id", "slot")


@query(f"""{DEMAND},
t AS (SELECT market, product_id, value, CASE WHEN in_stock_stores >= 3 THEN 1 WHEN in_stock_stores > 0 THEN 2 ELSE 3 END AS tier FROM stat JOIN demand USING (product_id))
SELECT market, product_id, tier, place FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY tier, value DESC, product_id) AS place FROM t) WHERE place <= 50""")
def daily_budget_ranking(v):
    """Which products a day's budget of reads goes to: tier, demand, id."""
    tier = F.when(F.col("in_stock_stores") >= 3, 1).when(F.col("in_stock_stores") > 0, 2).otherwise(3)
    rows = v.stat.join(_demand(v), "product_id").withColumn("tier", tier)
    return ranking.first_per(rows, ["market"], [F.asc("tier"), F.desc("value"), F.asc("product_id")], 50, "place").select("market", "product_id", "tier", "place")


@query("""c AS (SELECT market, count(*) FILTER (in_stock) AS open FROM offer GROUP BY 1)
SELECT market, open, greatest(150, CAST(floor(1000 * open / sum(open) OVER ()) AS BIGINT)) AS share FROM c""")
def budget_shares(v):
    counts = v.offer.groupBy("market").agg(F.count_if("in_stock").alias("open"))
    return demand.budget_shares(counts, "open", 1000, 150)


@query("""wanted AS (SELECT id, set_code, product_type FROM product WHERE id % 97 = 5),
open AS (SELECT product_id, set_code, product_type, lowest FROM card WHERE market = 'EUROPE' AND in_stock_stores > 0),
c AS (SELECT w.id, o.product_id, lowest, CASE WHEN o.set_code = w.set_code AND o.product_type = w.product_type THEN 1 ELSE 2 END AS pass
      FROM wanted w JOIN open o ON o.set_code = w.set_code AND o.product_id <> w.id)
SELECT id, product_id, pass, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pass, lowest, product_id) AS place FROM c) WHERE place <= 4""")
def alternatives(v):
    """Open products of the same set: of the same type first, then the rest, cheapest first."""
    wanted = v.product.where("id % 97 = 5").select("id", "set_code", F.col("product_type").alias("own_type"))
    open_ = v.card.where("market = 'EUROPE' and in_stock_stores > 0").select("product_id", "set_code", "product_type", "lowest")
    # four beside the product itself: five of a type, and nine of a set, of which at most five are of the product's own type
    cheapest = [F.asc("lowest"), F.asc("product_id")]
    like = ranking.first_per(open_, ["set_code", "product_type"], cheapest, 5)
    rest = ranking.first_per(like, ["set_code"], cheapest, 9)
    same = wanted.join(like, (wanted["set_code"] == like["set_code"]) & (F.col("own_type") == F.col("product_type"))).select("id", "product_id", "lowest", F.lit(1).alias("pass"))
    other = wanted.join(rest, "set_code").where(~F.coalesce(F.col("own_type") == F.col("product_type"), F.lit(False))).select("id", "product_id", "lowest", F.lit(2).alias("pass"))
    rows = same.unionByName(other).where("product_id <> id")
    return ranking.first_per(rows, ["id"], [F.asc("pass"), *cheapest], 4, "place").select("id", "product_id", "pass", "place")


@query("""d AS (SELECT *, row_number() OVER (PARTITION BY name, set_code ORDER BY product_id, market) AS rn FROM card WHERE lowest IS NOT NULL)
SELECT product_id, market, lowest FROM d WHERE rn = 1 ORDER BY lowest, product_id LIMIT 30""")
def lowest_price_first(v):
    """Doubles go in input order, before the sort: the dearer of two alike may be the one that stays."""
    once = ranking.first_per(v.card.where("lowest is not null"), ["name", "set_code"], [F.asc("product_id"), F.asc("market")])
    return once.orderBy("lowest", "product_id").limit(30).select("product_id", "market", "lowest")


@query("""SELECT product_id, market, lowest, round(0.2 * lowest * 3 + 0.5 * lowest * 1.5 + 0.3 * lowest * 0.8, 4) - 2500 - lowest AS gain,
  CASE WHEN 0.2 * lowest * 3 + 0.5 * lowest * 1.5 + 0.3 * lowest * 0.8 - 2500 > lowest * 1.5 THEN 'grade' WHEN 0.2 * lowest * 3 + 0.5 * lowest * 1.5 + 0.3 * lowest * 0.8 - 2500 > lowest THEN 'maybe' ELSE 'keep' END AS verdict
FROM (SELECT product_id, market, CAST(lowest AS DOUBLE) AS lowest FROM stat WHERE lowest IS NOT NULL)""")
def grading_verdicts(v):
    """What grading is worth: chances of three grades, a fee, and a verdict by how far it stands above the raw price."""
    rows = v.stat.where("lowest is not null").select("product_id", "market", F.col("lowest").cast("double").alias("lowest"))
    p = F.col("lowest")
    worth = F.lit(0.2) * p * 3 + F.lit(0.5) * p * 1.5 + F.lit(0.3) * p * 0.8
    verdict = F.when(worth - 2500 > p * 1.5, "grade").when(worth - 2500 > p, "maybe").otherwise("keep")
    return rows.select("product_id", "market", "lowest", (F.round(worth, 4) - 2500 - p).alias("gain"), verdict.alias("verdict"))


@query("""SELECT product_id, market, CAST(floor(lowest * 0.25 * 2 + lowest * 0.75 * 0.5 + 0.5) AS BIGINT) - 500 AS expected, lowest - CAST(floor(lowest * 1000 / 10000.0 + 0.5) AS BIGINT) - 30 - 450 AS net FROM stat WHERE lowest IS NOT NULL""")
def expected_and_net(v):
    """Probability-weighted worth less its cost, and what a sale leaves after fee and postage."""
    low = F.col("lowest")
    fee = calc.tiered_fee(low, [(10**12, 1000)], 30)
    expected = calc.expected_value([(0.25, low * 2), (0.75, low * 0.5)], F.lit(500))
    return v.stat.where("lowest is not null").select("product_id", "market", expected.alias("expected"), calc.net_proceeds(low, fee, F.lit(450)).alias("net"))


@query("""s AS (SELECT store % 2 AS arm, count(*) AS n, count(*) FILTER (in_stock) AS hits FROM offer WHERE price < 120000 GROUP BY 1),
w AS (SELECT max(n) FILTER (arm = 0) AS na, max(hits) FILTER (arm = 0) AS a, max(n) FILTER (arm = 1) AS nb, max(hits) FILTER (arm = 1) AS b FROM s)
SELECT na, a, nb, b, round((a / na - b / nb) / sqrt(((a + b) / (na + nb)) * (1 - (a + b) / (na + nb)) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)), 6) AS z FROM w""")
def ab_test(v):
    """Pooled two-proportion test of the two halves of the stores."""
    arm = lambda k, x: F.count_if((F.col("store") % 2 == k) & x)
    s = v.offer.where("price < 120000").agg(arm(0, F.lit(True)).alias("na"), arm(0, F.col("in_stock")).alias("a"), arm(1, F.lit(True)).alias("nb"), arm(1, F.col("in_stock")).alias("b"))
    return s.withColumn("z", F.round(calc.two_proportion_z(F.col("a"), F.col("na"), F.col("b"), F.col("nb")), 6))


@query(f"SELECT product_id, market, CAST(floor(lowest * {RATE} / 100.0 + 0.5) AS BIGINT) AS common, greatest(CAST(floor(lowest * {RATE} / 100.0 + 0.5) AS BIGINT), 60000) AS floored FROM stat WHERE lowest IS NOT NULL")
def common_currency(v):
    """Prices in one currency by a rate a market, and not below a floor."""
    common = calc.half_up(F.col("lowest") * rate() / 100.0)
    return v.stat.where("lowest is not null").select("product_id", "market", common.alias("common"), F.greatest(common, F.lit(60000)).alias("floored"))


@query("SELECT product_id, min(CAST(floor(lowest * 70 / 100.0 + 0.5) AS BIGINT)) AS converted FROM stat WHERE market = 'ASIA' AND lowest IS NOT NULL GROUP BY 1")
def foreign_minimum(v):
    return v.stat.where("market = 'ASIA' and lowest is not null").groupBy("product_id").agg(F.min(calc.half_up(F.col("lowest") * 70 / 100.0)).alias("converted"))


@query("""SELECT product_id, market, CASE WHEN lowest IS NULL THEN NULL WHEN lowest * 10 <= msrp * 8 THEN 'far below' WHEN lowest < msrp THEN 'below' WHEN lowest * 10 <= msrp * 11 THEN 'at' ELSE 'above' END AS badge FROM card""")
def list_price_badges(v):
    low, top = F.col("lowest"), F.col("msrp")
    return v.card.select("product_id", "market", F.when(low * 10 <= top * 8, "far below").when(low < top, "below").when(low * 10 <= top * 11, "at").when(low.isNotNull(), "above").alias("badge"))


@query("""SELECT id, CASE WHEN name LIKE '%widget%' THEN 24 WHEN product_type = 'SMALL' THEN 6 WHEN product_type = 'PROMO' AND size > 20 THEN 12 WHEN set_code IN ('Brand#1', 'Brand#2') THEN 10 END AS packs FROM product""")
def pack_counts(v):
    rule = F.when(F.contains("name", F.lit("widget")), 24).when(F.col("product_type") == "SMALL", 6).when((F.col("product_type") == "PROMO") & (F.col("size") > 20), 12).when(F.col("set_code").isin("Brand#1", "Brand#2"), 10)
    return v.product.select("id", rule.alias("packs"))


@query("""ask AS (SELECT product_id, market, store, price FROM offer WHERE store % 10 = 0 AND in_stock),
shop AS (SELECT product_id, market, quantile_cont(price, 0.5) AS mid, count(*) AS n FROM offer WHERE store % 10 <> 0 AND in_stock GROUP BY 1, 2)
SELECT a.product_id, a.market, a.store, a.price FROM ask a LEFT JOIN shop s USING (product_id, market) JOIN product p ON p.id = a.product_id
WHERE NOT CASE WHEN n >= 2 THEN price > mid * 1.2 OR price < mid * 0.8 ELSE price > msrp * 1.5 END""")
def placeholder_asks_dropped(v):
    """Marketplace asks far from the shops' median, or from the list price where shops are too few."""
    ask = v.offer.where("store % 10 = 0 and in_stock").select("product_id", "market", "store", "price")
    shop = v.offer.where("store % 10 <> 0 and in_stock").groupBy("product_id", "market").agg(F.percentile("price", 0.5).alias("mid"), F.count("*").alias("n"))
    rows = ask.join(shop, ["product_id", "market"], "left").join(v.product.select("id", "msrp"), F.col("product_id") == F.col("id"))
    far = F.when(F.col("n") >= 2, (F.col("price") > F.col("mid") * 1.2) | (F.col("price") < F.col("mid") * 0.8)).otherwise(F.col("price") > F.col("msrp") * 1.5)
    return rows.where(~far).select("product_id", "market", "store", "price")


@query("""SELECT market, count(*) AS judged, count(*) FILTER (lowest * 10 < median_open * 8) AS suspicious, count(*) FILTER (lowest * 10 < median_open * 8) * 100 > count(*) * 40 AS fails
FROM stat WHERE median_open IS NOT NULL GROUP BY 1""")
def gate_suspicious_share(v):
    low = F.col("lowest") * 10 < F.col("median_open") * 8
    found = v.stat.where("median_open is not null").groupBy("market").agg(F.count("*").alias("judged"), F.count_if(low).alias("suspicious"))
    return found.withColumn("fails", F.col("suspicious") * 100 > F.col("judged") * 40)


@query("""old AS (SELECT id, CAST(size % 4 AS INT) AS runs FROM product WHERE id % 7 <> 0), now AS (SELECT id FROM product WHERE id % 3 <> 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN 0 ELSE o.runs + 1 END AS runs FROM old o FULL JOIN now n ON o.id = n.id WHERE n.id IS NOT NULL OR o.runs + 1 <= 3""")
def state_folded(v):
    """Runs since a product was last seen; what was missing for more than three is forgotten."""
    old = v.product.where("id % 7 <> 0").select("id", (F.col("size") % 4).cast("int").alias("was"))
    now = v.product.where("id % 3 <> 0").select("id", F.lit(True).alias("here"))
    rows = old.join(now, "id", "full").select("id", F.when(F.col("here"), 0).otherwise(F.col("was") + 1).alias("runs"))
    return rows.where("runs <= 3")


@query("""asks AS (SELECT l_orderkey AS listing, l_linenumber AS buyer, CAST(l_quantity AS BIGINT) AS qty FROM lineitem),
t AS (SELECT *, sum(qty) OVER (PARTITION BY listing ORDER BY buyer) AS upto FROM asks)
SELECT listing, buyer, qty, upto <= 60 AS sold, CAST(greatest(0, 60 - upto) AS BIGINT) AS stock FROM t""")
def listings_bought(v):
    """Buyers in turn while the stock of 60 lasts: a running sum a listing."""
    rows = v.raw("lineitem").select(F.col("l_orderkey").alias("listing"), F.col("l_linenumber").alias("buyer"), F.col("l_quantity").cast("long").alias("qty"))
    upto = F.sum("qty").over(Window.partitionBy("listing").orderBy("buyer"))
    return rows.withColumn("upto", upto).select("listing", "buyer", "qty", (F.col("upto") <= 60).alias("sold"), F.greatest(F.lit(0), 60 - F.col("upto")).cast("long").alias("stock"))


@query("""items AS (SELECT l_orderkey AS post, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS qty FROM lineitem),
now AS (SELECT product_id, min(lowest) AS price FROM stat WHERE market = 'AFRICA' GROUP BY 1)
SELECT post, CAST(sum(price * qty) AS BIGINT) AS worth, count(price) AS priced, count(*) AS items FROM items LEFT JOIN now USING (product_id) GROUP BY 1""")
def post_valuations(v):
    """Worth of the items of a post; null if none is priced."""
    items = v.raw("lineitem").select(F.col("l_orderkey").alias("post"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("qty"))
    now = v.stat.where("market = 'AFRICA'").select("product_id", F.col("lowest").alias("price"))
    return items.join(now, "product_id", "left").groupBy("post").agg(F.sum(F.col("price") * F.col("qty")).alias("worth"), F.count("price").alias("priced"), F.count("*").alias("items"))


@query("""own AS (SELECT product_id, min(price) AS price FROM offer WHERE in_stock AND store % 9 = 0 GROUP BY 1),
kind AS (SELECT product_type, set_code, min(price) AS price FROM offer JOIN product ON id = product_id WHERE in_stock AND store % 9 = 0 GROUP BY 1, 2),
every AS (SELECT product_type, min(price) AS price FROM offer JOIN product ON id = product_id WHERE in_stock GROUP BY 1)
SELECT id, coalesce(o.price, k.price, e.price) AS price, CASE WHEN o.price IS NOT NULL THEN 'own' WHEN k.price IS NOT NULL THEN 'set' WHEN e.price IS NOT NULL THEN 'type' END AS feed
FROM product p LEFT JOIN own o ON o.product_id = p.id LEFT JOIN kind k ON k.product_type = p.product_type AND k.set_code = p.set_code LEFT JOIN every e ON e.product_type = p.product_type""")
def feed_cascade(v):
    """The cheapest item of the product's own feed, else of its set and type, else of its type."""
    p = v.product.select("id", "product_type", "set_code")
    rows = v.offer.where("in_stock").join(p, F.col("product_id") == F.col("id"))
    mine = rows.where("store % 9 = 0")
    own = mine.groupBy("id").agg(F.min("price").alias("own"))
    kind = mine.groupBy("product_type", "set_code").agg(F.min("price").alias("kind"))
    every = rows.groupBy("product_type").agg(F.min("price").alias("every"))
    found = p.join(own, "id", "left").join(kind, ["product_type", "set_code"], "left").join(every, "product_type", "left")
    feed = F.when(F.col("own").isNotNull(), "own").when(F.col("kind").isNotNull(), "set").when(F.col("every").isNotNull(), "type")
    return found.select("id", F.coalesce("own", "kind", "every").alias("price"), feed.alias("feed"))


@query("""SELECT market, product_type, slug, lowest FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY CASE product_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END, in_stock_stores = 0, lowest NULLS LAST, slug) AS rn FROM card WHERE set_code = 'Brand#3') WHERE rn = 1""")
def alert_picks(v):
    """What to watch in a set: first type in priority that exists, open first, cheapest."""
    order = [F.when(F.col("product_type") == "PROMO", 1).when(F.col("product_type") == "SMALL", 2).otherwise(3), F.col("in_stock_stores") == 0, F.asc_nulls_last("lowest"), F.asc("slug")]
    return ranking.first_per(v.card.where("set_code = 'Brand#3'"), ["market"], order).select("market", "product_type", "slug", "lowest")


@query("""SELECT market, product_type, store, price FROM (SELECT o.market, product_type, store, price, row_number() OVER (PARTITION BY o.market, product_type ORDER BY price, store, product_id) AS rn FROM offer o JOIN product ON id = product_id WHERE in_stock) WHERE rn = 1""")
def cheapest_store_by_type(v):
    rows = v.offer.where("in_stock").join(v.product.select("id", "product_type"), F.col("product_id") == F.col("id"))
    best = rows.groupBy("market", "product_type").agg(F.min(F.struct("price", "store")).alias("b"))
    return best.select("market", "product_type", F.col("b.store").alias("store"), F.col("b.price").alias("price"))


@query("""o AS (SELECT set_code, market, store, price, seen FROM offer JOIN product ON id = product_id WHERE in_stock AND product_type = 'PROMO')
SELECT set_code, count(DISTINCT store) AS stores, min(price) AS cheapest, arg_min(store, (price, store)) AS store, date_diff('day', DATE '1998-06-30', CAST(max(seen) AS DATE)) AS days_left FROM o GROUP BY 1""")
def preorder_summary(v):
    """By set: stores that take orders, the cheapest of them, days from a date to the last sighting."""
    rows = v.offer.where("in_stock").join(v.product.where("product_type = 'PROMO'").select("id", "set_code"), F.col("product_id") == F.col("id"))
    found = rows.groupBy("set_code").agg(F.countDistinct("store").alias("stores"), F.min(F.struct("price", "store")).alias("b"), F.max("seen").alias("last"))
    left = F.datediff(F.to_date("last"), F.lit("1998-06-30").cast("date"))
    return found.select("set_code", "stores", F.col("b.price").alias("cheapest"), F.col("b.store").alias("store"), left.alias("days_left"))


@query(f"""{MOVES},
short AS (SELECT market, product_id, before, after, row_number() OVER (PARTITION BY market ORDER BY (after - before) / before, product_id) AS rn FROM moves WHERE after < before)
SELECT market, product_id, before, lowest AS now FROM short JOIN stat USING (market, product_id) WHERE rn <= 24 AND in_stock_stores > 0 AND lowest < before""")
def drops_still_true(v):
    """The 24 largest drops of a market by its history, of those the ones that today's cheapest offer bears out."""
    fell = moves(v).where("after < before")
    short = ranking.first_per(fell, ["market"], [((F.col("after") - F.col("before")) / F.col("before")).asc(), F.asc("product_id")], 24)
    return short.join(v.stat.where("in_stock_stores > 0"), KEY).where("lowest < before").select("market", "product_id", "before", F.col("lowest").alias("now"))


@query("""aged AS (SELECT market, product_id, CASE WHEN max(seen) >= TIMESTAMP '1998-06-01' THEN 'month' WHEN max(seen) >= TIMESTAMP '1998-01-01' THEN 'half year' ELSE 'older' END AS shelf, min(price) AS price FROM offer GROUP BY 1, 2)
SELECT market, shelf, product_id, price FROM (SELECT *, row_number() OVER (PARTITION BY market, shelf ORDER BY price, product_id) AS rn FROM aged) WHERE rn = 1""")
def older_shelves(v):
    """The first item of each shelf that has any, by how long ago it was seen."""
    last = F.to_date("last")
    aged = v.offer.groupBy("market", "product_id").agg(F.max("seen").alias("last"), F.min("price").alias("price"))
    shelf = F.when(last >= F.lit("1998-06-01").cast("date"), "month").when(last >= F.lit("1998-01-01").cast("date"), "half year").otherwise("older")
    return ranking.first_per(aged.withColumn("shelf", shelf), ["market", "shelf"], [F.asc("price"), F.asc("product_id")]).select("market", "shelf", "product_id", "price")


@query("""earlier AS (SELECT product_id, arg_max(price, day) AS was FROM history WHERE market = 'EUROPE' AND day <= DATE '1997-12-31' GROUP BY 1),
now AS (SELECT product_id, lowest FROM stat WHERE market = 'EUROPE' AND lowest IS NOT NULL)
SELECT CAST(sum(was) FILTER (lowest IS NOT NULL) AS BIGINT) AS was, CAST(sum(lowest) FILTER (was IS NOT NULL) AS BIGINT) AS now, count(*) FILTER (was IS NOT NULL AND lowest IS NOT NULL) AS pairs, count(*) FILTER (lowest IS NULL) AS gone FROM earlier FULL JOIN now USING (product_id)""")
def since_last_look(v):
    """Totals then and now over what is priced at both times only."""
    then = v.history.where("market = 'EUROPE' and day <= date'1997-12-31'").groupBy("product_id").agg(F.max_by("price", "day").alias("was"))
    now = v.stat.where("market = 'EUROPE' and lowest is not null").select("product_id", "lowest")
    both = then.join(now, "product_id", "full")
    have = F.col("was").isNotNull() & F.col("lowest").isNotNull()
    return both.agg(F.sum(F.when(have, F.col("was"))).alias("was"), F.sum(F.when(have, F.col("lowest"))).alias("now"), F.count_if(have).alias("pairs"), F.count_if(F.col("lowest").isNull()).alias("gone"))


@query("""hits AS (SELECT '/shop/' || lower(market) || '/' || slug AS path, listed_stores AS views, in_stock_stores AS clicks FROM card WHERE product_id % 4 = 0)
SELECT p.id, CAST(sum(views) AS BIGINT) AS views, CAST(sum(clicks) AS BIGINT) AS clicks FROM hits h JOIN product p ON p.slug = regexp_extract(path, '([^/]+)$', 1) GROUP BY 1 HAVING sum(clicks) > 0 OR sum(views) >= 10""")
def demand_by_path(v):
    """Views and clicks by the last part of the path: an equi-join on it."""
    hits = v.card.where("product_id % 4 = 0").select(F.concat(F.lit("/shop/"), F.lower("market"), F.lit("/"), "slug").alias("path"), F.col("listed_stores").alias("views"), F.col("in_stock_stores").alias("clicks"))
    rows = hits.withColumn("slug", F.regexp_extract("path", "([^/]+)$", 1)).join(v.product.select("id", "slug"), "slug")
    return rows.groupBy("id").agg(F.sum("views").alias("views"), F.sum("clicks").alias("clicks")).where("clicks > 0 or views >= 10")


@query("""SELECT set_code, product_type, max(lowest) AS dearest, bool_or(in_stock_stores > 0) AS any_open FROM card WHERE market IN ('EUROPE', 'AMERICA') AND set_code IN (
  SELECT set_code FROM (SELECT set_code, row_number() OVER (ORDER BY count(*) FILTER (in_stock_stores > 0) DESC, set_code) AS rn FROM card GROUP BY 1) WHERE rn <= 5) GROUP BY 1, 2""")
def hot_keys(v):
    """Types of the five sets with the most open products, in the markets of priority."""
    hot = v.card.groupBy("set_code").agg(F.count_if(F.col("in_stock_stores") > 0).alias("open")).orderBy(F.desc("open"), "set_code").limit(5).select("set_code")
    rows = v.card.where("market in ('EUROPE', 'AMERICA')").join(F.broadcast(hot), "set_code", "left_semi")
    return rows.groupBy("set_code", "product_type").agg(F.max("lowest").alias("dearest"), F.bool_or(F.col("in_stock_stores") > 0).alias("any_open"))


@query("""t AS (SELECT id, msrp, slug, ntile(3) OVER (ORDER BY msrp, id) AS third FROM product)
SELECT id, third, place FROM (SELECT id, third, row_number() OVER (PARTITION BY third ORDER BY md5(slug), id) AS place FROM t) WHERE place <= 10""")
def stratified_sample(v):
    """Ten of each third by price, the same ones each time. Thirds are cut by exact ranks over all partitions."""
    rows = ranks.with_tile(v.product.select("id", "msrp", "slug"), [F.asc("msrp"), F.asc("id")], 3, "third")
    return ranking.first_per(rows, ["third"], [F.md5("slug"), F.asc("id")], 10, "place").select("id", "third", "place")


@query("""SELECT market, string_agg(slug || '=' || lowest, ';' ORDER BY lowest, slug) AS deals FROM (
  SELECT market, slug, lowest, row_number() OVER (PARTITION BY market ORDER BY lowest / median_open, lowest, slug) AS rn FROM card WHERE in_stock_stores >= 3 AND lowest >= median_open * 0.5 AND lowest <= median_open * 0.9) WHERE rn <= 3 GROUP BY 1""")
def alert_feed(v):
    """Three best deals of each market in one line."""
    from tradewind.operators import stats

    best = ranking.first_per(v.card.where(stats.is_deal()), ["market"], stats.deal_order(), 3)
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lowest", "slug"))), lambda x: F.concat(x["slug"], F.lit("="), x["lowest"].cast("string"))), ";")
    return best.groupBy("market").agg(line.alias("deals"))


@query("""links AS (SELECT '/collections/' || lower(product_type) || CASE WHEN size > 25 THEN '-sealed' ELSE '' END || '/' || replace(name, ' ', '-') AS link FROM product),
s AS (SELECT DISTINCT link, CASE WHEN link LIKE '%promo%' THEN NULL ELSE (CASE WHEN link LIKE '%sealed%' THEN 3 ELSE 0 END) + (CASE WHEN link LIKE '%widget%' THEN 2 ELSE 0 END) + 1 END AS score FROM links)
SELECT link, score, place FROM (SELECT *, row_number() OVER (ORDER BY score DESC, length(link), link) AS place FROM s WHERE score IS NOT NULL) WHERE place <= 25""")
def ranked_links(v):
    """Links worth reading first: by score, then shortest; those without a score are left out."""
    link = F.concat(F.lit("/collections/"), F.lower("product_type"), F.when(F.col("size") > 25, "-sealed").otherwise(""), F.lit("/"), F.replace(F.col("name"), F.lit(" "), F.lit("-")))
    score = F.when(~F.contains("link", F.lit("promo")), F.when(F.contains("link", F.lit("sealed")), 3).otherwise(0) + F.when(F.contains("link", F.lit("widget")), 2).otherwise(0) + 1)
    rows = v.product.select(link.alias("link")).distinct().withColumn("score", score).where("score is not null")
    best = rows.orderBy(F.desc("score"), F.length("link"), "link").limit(25)
    return best.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), F.length("link"), "link")))


@query("SELECT id FROM product JOIN stat ON product_id = id WHERE market = 'ASIA' AND product_type IN ('PROMO', 'SMALL') AND set_code IS NOT NULL AND lowest >= 95000 AND lowest <= 120000")
def url_filtered(v):
    """Parameters of a link as a filter: lists by comma, bounds on the column of the market."""
    from tradewind.operators.filters import from_url

    return v.card.where("market = 'ASIA'").where(from_url("type=PROMO,SMALL&set=any&min=950&max=1200", price="lowest")).select(F.col("product_id").alias("id"))


@query("""SELECT product_id, store FROM offer JOIN product ON id = product_id WHERE in_stock AND (contains(lower(name), 'ring') OR contains(lower(set_code), 'ring')) AND price <= 110000""")
def listing_filtered(v):
    from tradewind.operators.filters import listing_filter

    rows = v.offer.join(v.product.select("id", "name", "set_code"), F.col("product_id") == F.col("id"))
    return rows.where(listing_filter(status="open", search="Ring", high=110_000)).select("product_id", "store")


@query("""SELECT product_id, day, price FROM history WHERE market = 'AMERICA' AND day > (SELECT max(day) FROM history) - INTERVAL 30 DAY""")
def recent_days(v):
    # one row
    last = v.history.agg(F.max("day").alias("last"))
    return v.history.where("market = 'AMERICA'").join(F.broadcast(last)).where("day > date_sub(last, 30)").select("product_id", "day", "price")


@query("""SELECT CASE WHEN store % 10 = 0 THEN 'marketplace' ELSE 'shop' END AS kind, in_stock, count(*) AS n, min(price) AS lowest FROM listing GROUP BY 1, 2""")
def listings_by_kind(v):
    kind = F.when(F.col("store") % 10 == 0, "marketplace").otherwise("shop")
    return v.listing.groupBy(kind.alias("kind"), "in_stock").agg(F.count("*").alias("n"), F.min("price").alias("lowest"))


@query("""SELECT set_code, min(CAST(seen AS DATE)) AS first_seen FROM listing JOIN product ON id = product_id WHERE product_type = 'PROMO' AND size < 9 GROUP BY 1 HAVING abs(date_diff('day', min(CAST(seen AS DATE)), DATE '1995-01-05')) <= 9""")
def sets_around_a_date(v):
    rows = v.listing.join(v.product.where("product_type = 'PROMO' and size < 9").select("id", "set_code"), F.col("product_id") == F.col("id"))
    first = rows.groupBy("set_code").agg(F.min(F.to_date("seen")).alias("first_seen"))
    return first.where("abs(datediff(first_seen, date'1995-01-05')) <= 9")


@query("""j AS (SELECT id, CASE CAST(id % 4 AS INT) WHEN 0 THEN '{"rates":{"a":' || size || ',"b":' || (size + 5) % 13 || '}}' WHEN 1 THEN '{"error":"closed"}' WHEN 2 THEN '{"rates":{}}' ELSE 'oops' END AS body FROM product)
SELECT id, CASE WHEN NOT json_valid(body) THEN 'invalid' WHEN json_extract_string(body, '$.error') IS NOT NULL THEN 'refused' WHEN json_extract_string(body, '$.rates.a') IS NULL THEN 'no rates' ELSE 'rates' END AS outcome,
  CASE WHEN json_valid(body) THEN least(CAST(json_extract_string(body, '$.rates.a') AS BIGINT), CAST(json_extract_string(body, '$.rates.b') AS BIGINT)) END AS cheapest FROM j""")
def shipping_outcomes(v):
    """An untrusted response: what it says, and the cheapest of its rates by zone."""
    n, size = F.col("id") % 4, F.col("size")
    good = F.concat(F.lit('{"rates":{"a":'), size.cast("string"), F.lit(',"b":'), ((size + 5) % 13).cast("string"), F.lit("}}"))
    body = F.when(n == 0, good).when(n == 1, '{"error":"closed"}').when(n == 2, '{"rates":{}}').otherwise("oops")
    rows = v.product.select("id", F.from_json(body, "rates map<string,long>, error string, _corrupt_record string").alias("r"))
    rates = F.map_values("r.rates")
    outcome = F.when(F.col("r._corrupt_record").isNotNull(), "invalid").when(F.col("r.error").isNotNull(), "refused").when(F.coalesce(F.size(rates), F.lit(0)) <= 0, "no rates").otherwise("rates")
    return rows.select("id", outcome.alias("outcome"), F.array_min(rates).alias("cheapest"))


@query("""pages_ AS (SELECT product_id, store, '<div class="' || CASE WHEN store % 5 = 0 THEN 'gone' WHEN in_stock THEN 'buy' ELSE 'sold-out' END || '"><button' || CASE WHEN in_stock THEN '' ELSE ' disabled' END || '>Add to cart</button></div>' AS html FROM offer)
SELECT product_id, store, CASE WHEN regexp_matches(html, 'class="(sold-out|unavailable)"') THEN 'sold out' WHEN regexp_matches(html, '<button[^>]*disabled') THEN 'sold out' WHEN regexp_matches(html, 'class="buy"') THEN 'in stock' ELSE 'unknown' END AS verdict FROM pages_""")
def page_stock_verdicts(v):
    """What a product page's markup says about stock, first rule first."""
    state = F.when(F.col("store") % 5 == 0, "gone").when(F.col("in_stock"), "buy").otherwise("sold-out")
    html = F.concat(F.lit('<div class="'), state, F.lit('"><button'), F.when(F.col("in_stock"), "").otherwise(" disabled"), F.lit(">Add to cart</button></div>"))
    rows = v.offer.select("product_id", "store", html.alias("html"))
    h = F.col("html")
    verdict = F.when(h.rlike('class="(?:sold-out|unavailable)"'), "sold out").when(h.rlike("<button[^>]*disabled"), "sold out").when(h.rlike('class="buy"'), "in stock").otherwise("unknown")
    return rows.select("product_id", "store", verdict.alias("verdict"))


@query("""SELECT s.store, s.market, coalesce(c.open, 0) AS open, coalesce(c.open, 0) > 0 AS active FROM store s LEFT JOIN (SELECT store, count(*) FILTER (in_stock) AS open FROM offer GROUP BY 1) c USING (store) WHERE s.store % 13 <> 0
UNION ALL SELECT store, market, 0, false FROM store WHERE store % 13 = 0 AND store % 2 = 0""")
def keyed_upsert(v):
    """Fresh store counts over stored ones: known stores updated, new ones added, missing ones switched off, retired ones pruned."""
    from tradewind.operators.merge import upsert

    fresh = v.store.where("store % 13 <> 0").join(v.offer.groupBy("store").agg(F.count_if("in_stock").alias("open")), "store", "left")
    fresh = fresh.select("store", "market", F.coalesce("open", F.lit(0)).alias("open")).withColumn("active", F.col("open") > 0)
    stored = v.store.select("store", "market", F.lit(7).cast("long").alias("open"), F.lit(True).alias("active"))
    return upsert(stored, fresh, "store", missing={"open": F.lit(0).cast("long"), "active": F.lit(False)}, prune=(F.col("store") % 13 == 0) & (F.col("store") % 2 == 1))


@query("""SELECT id, CASE WHEN id % 6 = 0 THEN 'slug' WHEN n = 1 THEN 'name' WHEN pick = id THEN 'variant' ELSE 'ambiguous' END AS pass
FROM (SELECT id, count(*) OVER (PARTITION BY name, set_code) AS n, first_value(id) OVER (PARTITION BY name, set_code ORDER BY size, id) AS pick FROM product)""")
def resolved_in_passes(v):
    """A line finds its product by slug, else by a name that is the only one, else as the smallest variant."""
    w = Window.partitionBy("name", "set_code")
    rows = v.product.select("id", F.count("*").over(w).alias("n"), F.first("id").over(w.orderBy("size", "id")).alias("pick"))
    return rows.select("id", F.when(F.col("id") % 6 == 0, "slug").when(F.col("n") == 1, "name").when(F.col("pick") == F.col("id"), "variant").otherwise("ambiguous").alias("pass"))


@query("""SELECT market, product_id, CAST(timezone(CASE market WHEN 'ASIA' THEN 'Australia/Sydney' WHEN 'AMERICA' THEN 'America/New_York' ELSE 'Europe/Berlin' END, timezone('UTC', CAST(seen AS TIMESTAMP) + INTERVAL 18 HOUR)) AS DATE) AS local_day FROM offer""")
def market_local_days(v):
    """The calendar day in the market's zone at which an offer was seen, 18:00 UTC."""
    zone = F.when(F.col("market") == "ASIA", "Australia/Sydney").when(F.col("market") == "AMERICA", "America/New_York").otherwise("Europe/Berlin")
    at = F.col("seen").cast("timestamp_ntz") + F.expr("interval 18 hours")
    return v.offer.select("market", "product_id", F.to_date(F.convert_timezone(F.lit("UTC"), zone, at)).alias("local_day"))
