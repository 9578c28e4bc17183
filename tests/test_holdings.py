"""Worth of holdings, typical prices and notices of stock against plain Python over every day."""

import datetime
import os
import random
import time
from statistics import median

import pytest
from pyspark.sql import functions as F

from tradewind.operators import history, holdings
from tradewind.streaming import watches

D0 = datetime.date(2024, 1, 1)
LOTS, POINTS, LOOKS = "owner string, place string, item int, day date, qty long, cents long", "place string, item int, day date, price long, stores long", "owner string, place string, day date"
KEY = ["place", "item"]


def on(n):
    return D0 + datetime.timedelta(n)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(7)
    points = {}
    for place in "AB":
        for item in range(6):  # the last item has no price at all, the one before it no point
            for day in sorted(rng.sample(range(60), rng.randrange(1, 9))) if item < 5 else []:
                stores = rng.choice([0, 0, 1, 3])
                points[place, item, day] = (rng.randrange(100, 900) if stores and item < 4 else None, stores)
    lots = [(rng.choice("xyz"), rng.choice("AB"), rng.randrange(6), rng.randrange(60), rng.randrange(1, 5), rng.choice([None, 0, 250, 400])) for _ in range(80)]
    lots += lots[:5]  # repeated rows
    return points, lots


def frames(spark, made):
    points, lots = made
    p = spark.createDataFrame([(a, i, on(d), c, n) for (a, i, d), (c, n) in points.items()], POINTS)
    return p, spark.createDataFrame([(o, a, i, on(d), q, c) for o, a, i, d, q, c in lots], LOTS)


def test_worth_on_every_look(spark, made):
    points, lots = made
    looks = sorted({(o, a, d) for o, a, *_ in lots for d in (0, 13, 14, 59, 75)})
    p, held = frames(spark, made)
    asked = spark.createDataFrame([(o, a, on(d)) for o, a, d in looks * 2], LOOKS)
    got = holdings.since_last(holdings.worth_at(held, p, asked, "owner", "place", "item"), "owner", "place")
    got = {(r["owner"], r["place"], r["day"]): tuple(r)[3:] for r in got.collect()}

    def price(a, i, d):
        known = sorted((day, c) for (x, y, day), (c, _) in points.items() if (x, y) == (a, i) and c is not None)
        return max((x for x in known if x[0] <= d), default=known[0])[1] if known else None

    want, last = {}, {}
    for o, a, d in looks:
        mine = [(i, q, c or 0, price(a, i, d)) for x, y, i, day, q, c in lots if (x, y) == (o, a) and day <= d]
        worth = sum(q * now for _, q, _, now in mine if now is not None)
        both = [(q * c, q * now) for _, q, c, now in mine if now is not None and c > 0]
        paid, then = sum(x for x, _ in both), sum(x for _, x in both)
        was = last.get((o, a), (None, None))
        percent = lambda x, y: (y - x) * 100 // x if (y - x) * 100 % x * 2 < x else (y - x) * 100 // x + 1
        want[o, a, on(d)] = (
            sum(q for _, q, _, _ in mine), worth, len({i for i, _, _, now in mine if now is None}), paid, then,
            *was, percent(was[1], worth) if was[1] else None, percent(paid, then) if paid else None,
        )
        last[o, a] = (on(d), worth)
    assert got == want


def test_typical_is_the_median_of_all_days(spark, made):
    points, _ = made
    p, _ = frames(spark, made)
    got = {(r["place"], r["item"]): (r["typical"], r["days"]) for r in history.typical(p, KEY, F.lit(on(50)), 30, 7).collect()}
    want, under = {}, set()
    for key in {(a, i) for a, i, _ in points}:
        mine = sorted((d, *v) for (a, i, d), v in points.items() if (a, i) == key and d <= 50)
        days = [max(x for x in mine if x[0] <= d)[1] for d in range(21, 51) if mine and mine[0][0] <= d]
        values = [x for x in days if x is not None]
        if len(values) >= 7:
            want[key] = (int(median(values) + 0.5), len(values))
            _, price, stores = mine[-1]
            typical = want[key][0]
            if price is not None and stores and int((typical - price) / typical * 100 + 0.5) >= 10 and price * 2 >= typical:
                under.add((*key, price))
    assert got == want and len(want) > 2
    found = history.under_typical(p, KEY, F.lit(on(50)))
    assert {(r["place"], r["item"], r["price"]) for r in found.collect()} == under
    assert "Generate" not in found._jdf.queryExecution().toString()  # no row for each day


def test_notices_once_a_stretch(spark, made):
    points, lots = made
    p, held = frames(spark, made)
    got = holdings.notices(p, held.select("owner", "place", "item", F.col("day").alias("since")), "owner", KEY)
    got = sorted(tuple(r) for r in got.collect())
    want = []
    for o, a, i in sorted({x[:3] for x in lots}):
        since = min(d for x, y, z, d, *_ in lots if (x, y, z) == (o, a, i))
        armed, told = True, None
        for d in range(61):  # one run a day
            before = [(day, *v) for (x, y, day), v in points.items() if (x, y) == (a, i) and day <= d]
            price, stores = max(before)[1:] if before else (None, 0)
            if not stores:
                if told:
                    want.append((*told, on(d)))
                armed, told = True, None
            elif armed and d >= since:
                armed, told = False, (o, a, i, on(d), price)
        if told:
            want.append((*told, None))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order) and len(want) > 20


def test_empty_tables_and_nulls(spark):
    points, lots, looks = spark.createDataFrame([], POINTS), spark.createDataFrame([], LOTS), spark.createDataFrame([], LOOKS)
    assert holdings.worth_at(lots, points, looks, "owner", "place", "item").count() == 0
    assert history.under_typical(points, KEY, F.lit(on(5))).count() == 0
    asked = spark.createDataFrame([("x", "A", on(3)), ("x", None, on(3))], LOOKS)
    none = [tuple(r)[3:] for r in holdings.worth_at(lots, points, asked, "owner", "place", "item").collect()]
    assert none == [(0, 0, 0, 0, 0)] * 2
    odd = spark.createDataFrame([("x", "A", None, on(1), 2, 5), (None, "A", 1, on(1), 2, 5), ("x", "A", 1, None, 2, 5), ("x", "A", 1, on(2), None, 5), ("x", None, 1, on(2), 3, 5)], LOTS)
    priced = spark.createDataFrame([("A", 1, on(0), 10, 1), (None, 1, on(0), 10, 1)], POINTS)
    found = {r["place"]: tuple(r)[3:] for r in holdings.worth_at(odd, priced, asked, "owner", "place", "item").collect()}
    assert found == {"A": (2, 0, 1, 0, 0), None: (3, 0, 1, 0, 0)}
    watchers = spark.createDataFrame([("x", "A", 1, on(4)), ("x", "A", 1, on(2)), (None, "A", 1, on(9))], "owner string, place string, item int, since date")
    told = {r["owner"]: (r["day"], r["price"], r["rearmed"]) for r in holdings.notices(priced, watchers, "owner", KEY).collect()}
    assert told == {"x": (on(2), 10, None), None: (on(9), 10, None)}


def test_worth_on_the_days_of_lots_with_long_numbers(spark):
    points = spark.createDataFrame([("A", 1, None, 3, 1), ("A", 1, on(5), 10, 1), ("A", 1, on(8), 2**33, 1), ("A", 1, on(9), 7, 1), ("A", 2, None, 5, 1)], POINTS)
    lots = [("x", "A", 1, on(2), 2, 4), ("x", "A", 1, on(8), 1, 2**40), ("x", "A", 2, on(9), 2**35, 6), ("x", "A", 2, on(10), 1, None), (None, "A", 1, on(3), 1, 1), ("x", "A", 1, None, 1, 1)]
    held = spark.createDataFrame(lots, LOTS)
    # the price of a day that is not known is never that of a lot
    want = {
        on(2): (2, 20, 0, 8, 20), on(8): (3, 3 * 2**33, 0, 8 + 2**40, 3 * 2**33),
        on(9): (3 + 2**35, 21, 1, 8 + 2**40, 21), on(10): (4 + 2**35, 21, 1, 8 + 2**40, 21),
    }
    for parts in (None, 3):
        found = holdings.worth_at(held, points, None, "owner", "place", "item", parts)
        assert {(r["owner"], r["day"]): tuple(r)[3:] for r in found.collect()} == {("x", day): v for day, v in want.items()}
    asked = spark.createDataFrame([("x", "A", d) for d in want], LOOKS)
    assert {r["day"]: tuple(r)[3:] for r in holdings.worth_at(held, points, asked, "owner", "place", "item").collect()} == want


def test_notices_and_their_stream_tell_alike(spark, tmp_path):
    rng = random.Random(3)
    readings = [("A", i, d, rng.choice([0, 0, 2, 5]), rng.randrange(100, 900)) for d in range(24) for i in range(5)]
    watch = [(w, "A", rng.randrange(6), rng.randrange(20)) for w in "pqrs" for _ in range(4)]
    watchers = spark.createDataFrame([(w, a, i, on(d)) for w, a, i, d in watch + watch[:2]], "watcher string, place string, item long, since date")
    schema = "place string, item long, day date, stores long, price long"
    daily = spark.createDataFrame([(a, i, on(d), n, c if n else None) for a, i, d, n, c in readings], schema)
    want = {tuple(r) for r in holdings.notices(history.change_points(daily, KEY), watchers, "watcher", KEY).drop("rearmed").collect()}
    source, at = str(tmp_path / "in"), time.time() - 1000
    for first in range(0, 24, 6):
        # the last day of a part comes again with the next: late by then
        part = daily.where(F.col("day").between(on(max(0, first - 1)), on(first + 5)))
        part.coalesce(1).write.mode("append").json(source)
        for name in os.listdir(source):
            path = os.path.join(source, name)
            if os.stat(path).st_mtime > time.time() - 500:
                os.utime(path, (at + first, at + first))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.json").json(source)
    run = watches.notices(stream, watchers).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    told = [tuple(r) for r in spark.table("told").collect()]
    assert run.exception() is None and len(run.recentProgress) >= 4
    assert len(told) == len(set(told)) and set(told) == want and len(want) > 15
