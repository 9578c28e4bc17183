"""Queries over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.operators import history, ranking
from tradewind.plans.registry import query

NOW = "DATE '1998-06-30'"
KEY = ["market", "product_id"]
now = lambda: F.lit("1998-06-30").cast("date")

POINTS = """points AS (SELECT market, product_id, day, price, stores FROM (
  SELECT *, lag(price) OVER w AS p, lag(stores) OVER w AS s, row_number() OVER w AS rn FROM history WINDOW w AS (PARTITION BY market, product_id ORDER BY day))
  WHERE rn = 1 OR p IS DISTINCT FROM price OR s IS DISTINCT FROM stores)"""


@query("SELECT * FROM history")
def price_history(v):
    return v.history


@query(f"{POINTS}\nSELECT * FROM points")
def change_points(v):
    return history.change_points(v.history, KEY)


@query(f"{POINTS},\nlast AS (SELECT market, product_id, max(day) AS d FROM history GROUP BY 1, 2)\nSELECT * FROM points UNION ALL SELECT market, product_id, CAST(d + INTERVAL 1 DAY AS DATE), NULL, 0 FROM last WHERE d < (SELECT max(day) FROM history)")
def closed_series(v):
    return history.closed_change_points(v.history, v.listed, KEY)


@query(f"""{POINTS},
spans AS (SELECT *, lead(day) OVER (PARTITION BY market, product_id ORDER BY day) AS nxt FROM points),
days AS (SELECT CAST(unnest(generate_series({NOW} - INTERVAL 13 DAY, {NOW}, INTERVAL 1 DAY)) AS DATE) AS d)
SELECT market, product_id, d AS day, price, stores FROM spans JOIN days ON d >= day AND (nxt IS NULL OR d < nxt)""")
def daily_series(v):
    points = history.change_points(v.history, KEY)
    return history.densified(points, KEY, F.date_sub(now(), 13), now())


@query(f"SELECT market, product_id, arg_max(price, day) AS price, max(day) AS day FROM history WHERE day <= {NOW} GROUP BY 1, 2")
def value_as_of(v):
    return history.as_of(v.history.select(*KEY, "day", "price"), KEY, now())


@query(f"""SELECT market, product_id, day, price FROM (SELECT *, row_number() OVER (PARTITION BY market, product_id ORDER BY abs(date_diff('day', day, {NOW})), day DESC) AS rn FROM history) WHERE rn = 1""")
def nearest_day_later(v):
    return history.nearest(v.history.select(*KEY, "day", "price"), KEY, now(), later_wins=True)


@query(f"""SELECT market, product_id, day, price FROM (SELECT *, row_number() OVER (PARTITION BY market, product_id ORDER BY abs(date_diff('day', day, {NOW})), day) AS rn FROM history) WHERE rn = 1""")
def nearest_day_earlier(v):
    return history.nearest(v.history.select(*KEY, "day", "price"), KEY, now(), later_wins=False)


MOVES = f"""a AS (SELECT market, product_id, arg_max(price, day) AS after, arg_max(stores, day) AS stores_after FROM history WHERE day <= {NOW} GROUP BY 1, 2),
b AS (SELECT market, product_id, arg_max(price, day) AS before, arg_max(stores, day) AS stores_before FROM history WHERE day <= {NOW} - INTERVAL 180 DAY GROUP BY 1, 2),
moves AS (SELECT * FROM a JOIN b USING (market, product_id))"""


def moves(v):
    return history.moves(v.history, KEY, now(), 180)


@query(f"{MOVES}\nSELECT market, product_id, before, after, stores_before, stores_after FROM moves")
def moves_between_days(v):
    return moves(v)


@query(f"""{MOVES}
SELECT market, product_id, before, after, rank FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY (after - before) / before DESC, product_id) AS rank FROM moves
  WHERE abs(after - before) * 20 >= before AND abs(after - before) * 2 < before) WHERE rank <= 20""")
def top_movers(v):
    bounded = moves(v).where("abs(after - before) * 20 >= before and abs(after - before) * 2 < before")
    order = [((F.col("after") - F.col("before")) / F.col("before")).desc(), F.asc("product_id")]
    return ranking.first_per(bounded, ["market"], order, 20, "rank").select("market", "product_id", "before", "after", "rank")


@query(f"""{MOVES}
SELECT market, CASE WHEN stores_after > stores_before THEN 'wider' WHEN stores_after < stores_before THEN 'narrower' ELSE 'same' END AS move, count(*) AS n FROM moves GROUP BY 1, 2""")
def stock_moves(v):
    kind = F.when(F.col("stores_after") > F.col("stores_before"), "wider").when(F.col("stores_after") < F.col("stores_before"), "narrower").otherwise("same")
    return moves(v).groupBy("market", kind.alias("move")).agg(F.count("*").alias("n"))


@query(f"""{MOVES}
SELECT market, CAST(sum(after) AS BIGINT) AS total_after, CAST(sum(before) AS BIGINT) AS total_before, count(*) AS pairs, count(*) FILTER (after > before) AS up, count(*) FILTER (after < before) AS down FROM moves GROUP BY 1""")
def market_wrap(v):
    return moves(v).groupBy("market").agg(F.sum("after").alias("total_after"), F.sum("before").alias("total_before"), F.count("*").alias("pairs"), F.count_if(F.col("after") > F.col("before")).alias("up"), F.count_if(F.col("after") < F.col("before")).alias("down"))


@query("""weeks AS (SELECT market, product_id, CAST(date_trunc('week', day) AS DATE) AS week, min(price) AS price FROM history GROUP BY 1, 2, 3),
placed AS (SELECT market, product_id, week, row_number() OVER (PARTITION BY market, week ORDER BY price, product_id) AS place FROM weeks),
lagged AS (SELECT market, product_id, week, place, lag(week) OVER (PARTITION BY market, product_id ORDER BY week) AS earlier, lag(place) OVER (PARTITION BY market, product_id ORDER BY week) AS place_then FROM placed)
SELECT market, product_id, week, place, CASE WHEN earlier = week - 7 THEN place_then END AS last_place FROM lagged WHERE place <= 5""")
def weekly_ranks(v):
    """The five lowest prices of a market and week, each with its place of the week before: two windows, no join."""
    weeks = v.history.groupBy(*KEY, F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.min("price").alias("price"))
    placed = weeks.withColumn("place", F.row_number().over(Window.partitionBy("market", "week").orderBy("price", "product_id")))
    w = Window.partitionBy(*KEY).orderBy("week")
    lagged = placed.withColumn("last_place", F.when(F.lag("week").over(w) == F.date_sub("week", 7), F.lag("place").over(w)))
    return lagged.where("place <= 5").select(*KEY, "week", "place", "last_place")


@query("""m AS (SELECT market, product_id, CAST(date_trunc('month', day) AS DATE) AS day, min(price) AS price FROM history GROUP BY 1, 2, 3),
days AS (SELECT DISTINCT day FROM m), keys AS (SELECT DISTINCT market, product_id FROM m),
grid AS (SELECT market, product_id, day, price FROM keys JOIN days ON true LEFT JOIN m USING (market, product_id, day)),
f AS (SELECT market, product_id, day, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY market, product_id ORDER BY day), first_value(price IGNORE NULLS) OVER (PARTITION BY market, product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS price FROM grid)
SELECT market, day, CAST(sum(price) AS BIGINT) AS basket, count(*) AS items FROM f GROUP BY 1, 2""")
def basket_index(v):
    monthly = v.history.groupBy(*KEY, F.to_date(F.date_trunc("month", "day")).alias("day")).agg(F.min("price").alias("price"))
    return history.filled_sums(monthly, KEY, ["market"], "price").select("market", "day", F.col("sum").alias("basket"), F.col("n").alias("items"))


@query(f"""recent AS (SELECT market, product_id, price FROM history WHERE day > {NOW} - INTERVAL 720 DAY AND day <= {NOW}),
typical AS (SELECT market, product_id, quantile_cont(price, 0.5) AS typical, count(*) AS n FROM recent GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT s.market, s.product_id, s.lowest, CAST(floor(typical + 0.5) AS BIGINT) AS typical FROM stat s JOIN typical t USING (market, product_id) WHERE s.lowest <= typical * 0.9 AND s.lowest >= typical * 0.5""")
def under_typical(v):
    recent = v.history.where((F.col("day") > F.date_sub(now(), 720)) & (F.col("day") <= now()))
    typical = recent.groupBy(*KEY).agg(F.percentile("price", 0.5).alias("t"), F.count("*").alias("n")).where("n >= 3")
    return v.stat.join(typical, KEY).where((F.col("lowest") <= F.col("t") * 0.9) & (F.col("lowest") >= F.col("t") * 0.5)).select(*KEY, "lowest", F.floor(F.col("t") + 0.5).cast("long").alias("typical"))


@query("""upper AS (SELECT market, product_id, list_sort(list(price)) AS p FROM history GROUP BY 1, 2),
m AS (SELECT market, product_id, p, p[CAST(len(p) // 2 AS INT) + 1] AS mid FROM upper),
t AS (SELECT market, product_id, mid, list_filter(p, lambda x: x * 2 >= mid) AS p FROM m)
SELECT market, product_id, mid, len(p) AS kept, p[1] AS low, p[len(p)] AS high FROM t WHERE len(p) >= 5 AND p[len(p)] <= p[1] * 2""")
def trimmed_spread(v):
    prices = v.history.groupBy(*KEY).agg(F.sort_array(F.collect_list("price")).alias("p"))
    mid = F.element_at("p", (F.floor(F.size("p") / 2) + 1).cast("int"))
    kept = prices.withColumn("mid", mid).withColumn("p", F.filter("p", lambda x: x * 2 >= F.col("mid")))
    found = kept.select(*KEY, "mid", F.size("p").cast("long").alias("kept"), F.array_min("p").alias("low"), F.array_max("p").alias("high"))
    return found.where("kept >= 5 and high <= low * 2")


STATE = "st AS (SELECT user_id, ts, event_id, event_type IN ('purchase', 'view') AS open FROM events)"


def _states(v):
    return v.raw("events").select("user_id", "ts", "event_id", F.col("event_type").isin("purchase", "view").alias("open"))


@query(f"""{STATE},
f AS (SELECT *, coalesce(lag(open) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS b FROM st),
t AS (SELECT user_id, ts, open, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS closed FROM f WHERE open <> b)
SELECT user_id, ts AS opened, closed FROM t WHERE open""")
def restock_episodes(v):
    return history.episodes(_states(v), ["user_id"], "ts", "event_id", "open")


@query("""e AS (SELECT user_id, ts, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS baseline FROM events WHERE event_type = 'purchase')
SELECT user_id, event_id, value, baseline FROM e WHERE value < baseline""")
def alert_drops(v):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    found = v.raw("events").where("event_type = 'purchase'").withColumn("baseline", F.lag("value").over(w))
    return found.where("value < baseline").select("user_id", "event_id", "value", "baseline")


@query("""e AS (SELECT user_id, ts, event_id, value < 20 AS hit, coalesce(lag(value < 20) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM events)
SELECT user_id, event_id FROM e WHERE hit AND NOT was""")
def alert_rearmed(v):
    hits = v.raw("events").select("user_id", "ts", "event_id", (F.col("value") < 20).alias("hit"))
    return history.flips(hits, ["user_id"], ["ts", "event_id"], "hit").where("hit").select("user_id", "event_id")


@query("""d AS (SELECT market, product_id, min(day) AS day FROM history GROUP BY 1, 2), n AS (SELECT *, count(*) OVER (PARTITION BY day) AS n FROM d)
SELECT market, product_id, day FROM n WHERE n < 12""")
def newly_tracked(v):
    first = v.history.groupBy(*KEY).agg(F.min("day").alias("day"))
    bulk = first.groupBy("day").agg(F.count("*").alias("n")).where("n < 12").select("day")
    return first.join(bulk, "day", "left_semi").select(*KEY, "day")


@query("SELECT market, day, count(*) AS series FROM history GROUP BY 1, 2")
def coverage_by_day(v):
    return v.history.groupBy("market", "day").agg(F.count("*").alias("series"))


@query("""d AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, event_id) AS total FROM events GROUP BY 1, 2)
SELECT user_id, day, total FROM d""")
def day_record(v):
    latest = F.max(F.struct("event_id", "value"))
    return v.raw("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(latest.alias("m")).select("user_id", "day", F.col("m.value").alias("total"))


@query("""m AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT day, event_type, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS so_far FROM m""")
def event_counts_so_far(v):
    daily = v.raw("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return daily.withColumn("so_far", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")))


@query("""SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, dayofweek(o_orderdate) = 0 AS sunday, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS epoch_day FROM orders""")
def calendar_days(v):
    day = F.to_date("o_orderdate")
    return v.raw("orders").select("o_orderkey", "o_custkey", day.alias("day"), (F.dayofweek(day) == 1).alias("sunday"), F.unix_date(day).alias("epoch_day"))
