"""Queries over places to sell in, feeds, packs, weeks, events and the fuller summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import calc
from tradewind.operators import demand, filters, history, packs, posting, selection, stats, venues
from tradewind.plans.registry import query
from tradewind.plans.series import KEY

VENUES = [venues.Venue("auction", 1325, 1), venues.Venue("market", 1075, 2), venues.Venue("shop", 0, 3)]
LEAST_BUY, LEAST_NET, MOST_MARGIN = 1000, 500, 150.0

FLIPS = f"""side AS (SELECT product_id, store, price, CASE store % 10 WHEN 0 THEN 'auction' WHEN 1 THEN 'market' ELSE 'shop' END AS venue FROM offer WHERE in_stock),
buy AS (SELECT product_id, min(price) AS buy, arg_min(store, struct_pack(p := price, s := store)) AS buy_store FROM side WHERE venue = 'shop' AND store % 3 <> 0 GROUP BY 1 HAVING min(price) >= {LEAST_BUY}),
sell AS (SELECT product_id, venue, min(price) AS sell, arg_min(store, struct_pack(p := price, s := store)) AS sell_store FROM side WHERE venue <> 'shop' OR store % 3 = 0 GROUP BY 1, 2),
left_ AS (SELECT *, CAST(floor(sell * (10000 - CASE venue WHEN 'auction' THEN 1325 WHEN 'market' THEN 1075 ELSE 0 END) / 10000.0 + 0.5) AS BIGINT) AS got, CASE venue WHEN 'auction' THEN 1 WHEN 'market' THEN 2 ELSE 3 END AS turn FROM sell),
won AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY got DESC, turn) AS rn FROM left_),
flips AS (SELECT product_id, buy, buy_store, venue, sell_store, sell, got - buy AS net, floor((got - buy) * 1000 / CAST(buy AS DOUBLE) + 0.5) / 10 AS margin FROM buy JOIN won USING (product_id) WHERE rn = 1)"""


def found_flips(v):
    kind = F.when(F.col("store") % 10 == 0, "auction").when(F.col("store") % 10 == 1, "market").otherwise("shop")
    side = v.offer.where("in_stock").select("product_id", "store", "price", kind.alias("venue"))
    return venues.flips(side.where("venue = 'shop' and store % 3 <> 0"), side.where("venue <> 'shop' or store % 3 = 0"), VENUES, LEAST_BUY, LEAST_NET, MOST_MARGIN)


@query(f"{FLIPS}\nSELECT * FROM flips WHERE net >= {LEAST_NET} AND margin <= {MOST_MARGIN}")
def best_venues(v):
    """Where to sell what is bought in a shop: each kind of place with its fee, the one that leaves most."""
    return found_flips(v)


@query(f"{FLIPS}\nSELECT product_id, net, margin FROM flips WHERE net >= {LEAST_NET} AND margin <= {MOST_MARGIN} ORDER BY margin DESC, net DESC, product_id LIMIT 25 OFFSET 25")
def best_venues_page(v):
    return venues.page_of(found_flips(v), "margin", 2, 25).select("product_id", "net", "margin")


@query("""asleep AS (SELECT store FROM (SELECT store, count(*) AS listed, count(*) FILTER (in_stock AND store % 7 <> 3) AS open FROM offer GROUP BY 1) WHERE listed >= 20 AND open = 0),
o AS (SELECT product_id, market, price, in_stock AND store % 7 <> 3 AND seen >= TIMESTAMP '1993-01-01' AS open, store % 10 = 0 AS mp, store IN (SELECT store FROM asleep) AS asleep FROM offer)
SELECT product_id, market, min(price) FILTER (open) AS lowest, count(*) FILTER (open AND NOT mp) AS in_stock_stores, count(*) FILTER (NOT mp AND NOT asleep) AS listed_stores, bool_or(open AND mp) AS marketplace_open,
  CASE WHEN count(*) FILTER (open AND NOT mp) >= 2 THEN CAST(floor(quantile_cont(price, 0.5) FILTER (open AND NOT mp) + 0.5) AS BIGINT) END AS median_open FROM o GROUP BY 1, 2""")
def summary_with_marketplaces(v):
    """Every tenth store is a marketplace; a seventh sells nothing and sleeps; what was last seen before 1993 counts as closed."""
    rows = v.offer.withColumn("in_stock", F.col("in_stock") & (F.col("store") % 7 != 3))
    return stats.full_summary(rows, F.col("store") % 10 == 0, stats.dormant_stores(rows, 20), F.col("seen") >= F.lit("1993-01-01").cast("timestamp"))


@query("""f AS (SELECT product_id, market, in_stock_stores AS st, lowest / 100.0 AS usd, datediff('day', DATE '1997-01-01' + CAST(product_id % 1500 AS INT), DATE '1998-06-30') AS age, product_id % 4 AS k, (median_open - lowest) / CAST(median_open AS DOUBLE) AS fall FROM stat)
SELECT product_id, market, round(CASE WHEN st > 0 THEN 1 + log2(1 + st) / 4 WHEN k <> 0 AND k <> 1 THEN 0.35 ELSE 1.0 END * (1 + 0.2 * k)
  * CASE WHEN usd > 0 THEN 0.5 + 0.25 * log10(1 + usd) ELSE 1.0 END
  * CASE WHEN k = 3 THEN 1.0 WHEN age < 0 THEN CASE WHEN k = 1 AND age >= -60 THEN 1.3 ELSE 1.05 END WHEN age <= 30 THEN 1.5 WHEN age <= 90 THEN 1.25 WHEN age > 730 THEN 0.85 ELSE 1.0 END
  * CASE WHEN fall > 0 THEN 1 + least(0.5, fall) ELSE 1.0 END * CASE WHEN k = 2 THEN 1.15 ELSE 1.0 END, 6) AS value FROM f""")
def earning_values(v):
    """What a click can earn, with release days dealt over four years and four kinds of products."""
    k, day = F.col("product_id") % 4, F.date_add(F.lit("1997-01-01").cast("date"), (F.col("product_id") % 1500).cast("int"))
    age = F.when(k != 3, F.datediff(F.lit("1998-06-30").cast("date"), day))
    fall = (F.col("median_open") - F.col("lowest")) / F.col("median_open")
    value = demand.earning_value(F.col("in_stock_stores"), k == 0, k == 1, k, F.col("lowest"), age, fall, k == 2)
    return v.stat.select("product_id", "market", F.round(value, 6).alias("value"))


GRADES = [(15, 4.0), (45, 1.6), (30, 0.9)]
_NET = "(CAST(floor(lowest * {m}) AS BIGINT) - CAST(floor(CAST(floor(lowest * {m}) AS BIGINT) * 13 / 100.0 + 0.5) AS BIGINT) - 2600)"


@query(f"""r AS (SELECT product_id, market, lowest - CAST(floor(lowest * 13 / 100.0 + 0.5) AS BIGINT) AS raw_net, {', '.join(f"{_NET.format(m=m)} AS n{i}" for i, (_, m) in enumerate(GRADES))} FROM stat WHERE lowest IS NOT NULL),
w AS (SELECT *, CAST(floor({' + '.join(f'n{i} * {c} / 90.0' for i, (c, _) in enumerate(GRADES))} + 0.5) AS BIGINT) AS weighted_net FROM r)
SELECT product_id, market, raw_net, CAST(ceil((raw_net + 2600) / (1 - 13 / 100.0)) AS BIGINT) AS break_even, weighted_net, weighted_net - raw_net AS against_raw FROM w""")
def grading_outlooks(v):
    """Three grades whose chances add up to 90, a fee of 13 percent and 26.00 of costs."""
    low = F.col("lowest")
    grades = [(F.lit(float(c)), (low * m).cast("long")) for c, m in GRADES]
    out = calc.grading_outlook(low, F.lit(2600), F.lit(13), grades)
    return v.stat.where("lowest is not null").select("product_id", "market", out.alias("o")).select("product_id", "market", "o.*")


RULES = {
    "ECONOMY": packs.PackRule(packs=36), "LARGE": packs.PackRule(of="ECONOMY", times=6), "SMALL": packs.PackRule(packs=1),
    "STANDARD": packs.PackRule(by_series={"1": 8, "2": 9, "3": 10}, by_set={"Brand#2": 10, "Brand#25": None}),
    "MEDIUM": packs.PackRule(of="STANDARD", times=10), "PROMO": packs.PackRule(names=((r"\bred\b", 2), (r"\b(?:ring|bolt)\b", 3))),
}


@query("""s AS (SELECT id, product_type, name, msrp, CASE set_code WHEN 'Brand#2' THEN 10 WHEN 'Brand#25' THEN NULL ELSE CASE length(set_code) - 6 WHEN 1 THEN 8 WHEN 2 THEN 9 END END AS std FROM product),
p AS (SELECT id, msrp, CAST(CASE product_type WHEN 'ECONOMY' THEN 36 WHEN 'LARGE' THEN 216 WHEN 'SMALL' THEN 1 WHEN 'STANDARD' THEN std WHEN 'MEDIUM' THEN std * 10
  WHEN 'PROMO' THEN CASE WHEN regexp_matches(name, '\\bred\\b') THEN 2 WHEN regexp_matches(name, '\\b(ring|bolt)\\b') THEN 3 END END AS INT) AS packs FROM s)
SELECT id, packs, CASE WHEN msrp > 0 AND packs > 0 THEN CAST(floor(msrp / CAST(packs AS DOUBLE) + 0.5) AS BIGINT) END AS per_pack FROM p""")
def packs_by_rule(v):
    """Packs by type, series and set, with a set that has no honest count, cases of boxes, and names that tell."""
    series = (F.length("set_code") - 6).cast("string")
    n = packs.pack_count(F.col("product_type"), series, F.col("set_code"), F.col("name"), RULES)
    return v.product.select("id", n.alias("packs"), packs.cents_per_pack(F.col("msrp"), n).alias("per_pack"))


@query("""RECURSIVE_c AS (SELECT 'f' || (product_id % 12) AS feed, 's' || (store % 3) AS search, product_id * 1000 + store % 5 AS item, CASE WHEN product_id % 9 <> 0 THEN 'p' || (product_id % 400 // 4) END AS photo, price FROM offer WHERE in_stock),
turned AS (SELECT *, row_number() OVER (PARTITION BY feed, search ORDER BY price, item) AS turn FROM c),
lined AS (SELECT feed, item, photo, row_number() OVER (PARTITION BY feed ORDER BY CASE WHEN feed IN ('f1', 'f2') THEN price ELSE turn END, CASE WHEN feed IN ('f1', 'f2') THEN NULL ELSE search END NULLS FIRST, item, turn) AS pos FROM turned),
walk AS (SELECT DISTINCT feed, 0::BIGINT AS pos, []::BIGINT[] AS items, []::VARCHAR[] AS photos, NULL::BIGINT AS item, 0 AS place FROM lined
  UNION ALL
  SELECT feed, pos, CASE WHEN take THEN list_append(items, this) ELSE items END, CASE WHEN take AND photo IS NOT NULL THEN list_append(photos, photo) ELSE photos END, CASE WHEN take THEN this END, CASE WHEN take THEN place + 1 ELSE place END
  FROM (SELECT walk.feed, l.pos, items, photos, place, l.item AS this, l.photo, NOT list_contains(items, l.item) AND (l.photo IS NULL OR NOT list_contains(photos, l.photo)) AS take FROM walk JOIN lined l ON l.feed = walk.feed AND l.pos = walk.pos + 1 WHERE place < 24))
SELECT feed, item, place FROM walk WHERE item IS NOT NULL""")
def feeds_selected(v):
    """Twelve feeds of three searches each: most in turn, two cheapest first, no item and no photo twice."""
    p = F.col("product_id")
    rows = v.offer.where("in_stock").select(
        F.concat(F.lit("f"), (p % 12).cast("string")).alias("feed"), F.concat(F.lit("s"), (F.col("store") % 3).cast("string")).alias("search"), (p * 1000 + F.col("store") % 5).alias("item"),
        F.when(p % 9 != 0, F.concat(F.lit("p"), F.expr("(product_id % 400) div 4").cast("string"))).alias("photo"), "price",
    )
    return selection.selected_feed(rows, "feed", "search", "item", "photo", [F.asc("price")], "price", F.col("feed").isin("f1", "f2"), 24)


@query("""points AS (SELECT market, product_id, day, price, coalesce(lead(day) OVER (PARTITION BY market, product_id ORDER BY day) - 1, DATE '1998-06-30') AS until FROM history WHERE day <= DATE '1998-06-30'),
v AS (SELECT market, product_id, price, unnest(generate_series(day + CAST((7 - dayofweek(day)) % 7 AS INT), until, INTERVAL 7 DAY)) AS sunday FROM points),
m AS (SELECT market, product_id, CAST(sunday AS DATE) AS sunday, price, lag(price) OVER w AS before, lag(CAST(sunday AS DATE)) OVER w AS earlier FROM v WINDOW w AS (PARTITION BY market, product_id ORDER BY sunday))
SELECT market, sunday, count(*) FILTER (price <> before) AS moved, count(*) AS compared FROM m WHERE earlier = sunday - 7 GROUP BY 1, 2 HAVING count(*) FILTER (price <> before) >= 5""")
def published_weeks(v):
    """Sundays by which five or more series of a market moved within the week."""
    seen = v.history.where("day <= '1998-06-30'")
    return history.weekly_moved(seen, KEY, ["market"], F.lit("1998-06-30").cast("date")).where("moved >= 5")


@query("""last_day AS (SELECT max(day) AS d FROM history),
pts AS (SELECT market, product_id, day, price, CASE WHEN product_id % 4 = 0 AND rn = 2 THEN 0 ELSE stores END AS stores, rn FROM (SELECT *, row_number() OVER (PARTITION BY market, product_id ORDER BY day DESC) AS rn FROM history)),
two AS (SELECT market, product_id FROM pts GROUP BY 1, 2 HAVING max(stores) FILTER (rn = 1) > 0 AND max(stores) FILTER (rn = 2) = 0 AND max(day) FILTER (rn = 1) >= (SELECT d - 120 FROM last_day))
SELECT 'deal|' || market || '|' || product_id AS key, 'deal' AS kind, market, product_id, lowest AS cents, CAST(floor((1 - lowest / CAST(median_open AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS score FROM stat WHERE in_stock_stores >= 3 AND lowest <= median_open * 0.9 AND lowest >= median_open * 0.5
UNION ALL SELECT 'return|' || market || '|' || product_id, 'return', market, product_id, lowest, 1000 + in_stock_stores FROM stat JOIN two USING (market, product_id) WHERE in_stock_stores > 0 AND product_id % 3 = 0""")
def events_found(v):
    """Deals, and returns of every third product, whose last point is moved to the last day where it is at most 120 days older."""
    points = v.history.join(F.broadcast(v.history.agg(F.max("day").alias("end"))))
    rank = F.row_number().over(history.Window.partitionBy(*KEY).orderBy(F.desc("day")))
    points = points.withColumn("rn", rank).withColumn("stores", F.when((F.col("product_id") % 4 == 0) & (F.col("rn") == 2), 0).otherwise(F.col("stores")))
    points = points.withColumn("day", F.when((F.col("rn") == 1) & (F.datediff("end", "day") <= 120), F.col("end")).otherwise(F.col("day")))
    end = F.lit(v.history.agg(F.max("day")).first()[0])
    return posting.found_events(v.stat, points, end, stats.is_deal(), F.col("product_id") % 3 == 0)


@query("""SELECT product_id, market FROM card WHERE market IN ('ASIA', 'EUROPE') AND product_type = 'x' IS FALSE AND set_code = 'Brand#13' AND (contains(lower(name), 'red b') OR contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 'redb'))
UNION ALL SELECT product_id, market FROM card WHERE market = 'AFRICA' AND contains(lower(name), 'w')""")
def across_games(v):
    """A search over two games for words run together, and one that names its game and is one letter long."""
    names = {"game": "market", "kind": "product_type", "set_name": "set_code"}
    known = {"ASIA", "EUROPE", "AFRICA", "AMERICA"}
    one = filters.across_games({"q": " Red-B ".replace("-", " "), "set": "Brand#13", "game": "nowhere"}, ["ASIA", "EUROPE"], known, **names)
    two = filters.across_games({"game": "AFRICA", "q": "w", "kind": "any"}, ["ASIA"], known, **names)
    return v.card.where(one).unionAll(v.card.where(two)).select("product_id", "market")


@query("SELECT event_id, strftime(timezone('America/Los_Angeles', timezone('UTC', CAST(ts AS TIMESTAMP))), '%Y-%m-%d') AS budget_day FROM events")
def budget_days(v):
    """The day of an allowance that starts anew at midnight in its own zone."""
    return v.raw("events").select("event_id", calc.day_in_zone(F.col("ts"), "America/Los_Angeles").alias("budget_day"))
