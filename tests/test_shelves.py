"""Returns, bounded moves, watched sets and older sets against plain Python."""

import datetime
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tradewind.operators import history, shelves

D0 = datetime.date(2024, 3, 1)
POINTS = "place string, item int, day date, price long, stores long"
KEY = ["place", "item"]


def on(n):
    return D0 + datetime.timedelta(n)


def made():
    rng = random.Random(11)
    days = {}
    for place, n in (("A", 40), ("B", 6)):
        for item in range(n):
            first = rng.randrange(0, 25)
            price, rows = 1000, {}
            for d in range(first, 31):
                price = max(1, price + rng.choice([0, 0, 0, 150, -150, 700]))
                rows[d] = None if rng.random() < 0.25 else price
            if place == "A" and item < 15:  # one day's read of A failed
                rows |= {28: None, 29: 800, 30: 800}
            days[place, item] = rows
    return days


def frame(spark, days):
    rows = [(p, i, on(d), c, 0 if c is None else 2) for (p, i), r in days.items() for d, c in r.items()]
    return history.change_points(spark.createDataFrame(rows, POINTS), KEY)


def test_returns(spark):
    days = made()
    found, per_day = {}, Counter()
    for (p, i), r in days.items():
        back = [d for d in r if d > 30 - 7 and r[d] is not None and d - 1 in r and r[d - 1] is None]
        if back and r[30] is not None:
            found[p, i] = (on(max(back)), r[30], 2)
            per_day[p, max(back)] += 1
    most = {"A": max(3, 10), "B": max(3, 2)}  # a quarter of 40 and of 6 series
    want = {k: v for k, v in found.items() if per_day[k[0], (v[0] - D0).days] <= most[k[0]]}
    got = {(r["place"], r["item"]): tuple(r)[2:] for r in shelves.returned(frame(spark, days), "place", "item", F.lit(on(30)), 7, 3, 0.25).collect()}
    assert got == want and any(k[0] == "A" for k in want) and len(want) < len(found)


def test_bounded_moves(spark):
    days = made()
    want = {}
    for key, r in days.items():
        a, b = r.get(23), r.get(30)
        if a is None or b is None:
            continue
        percent = math.floor((b - a) / a * 100 + 0.5)
        if abs(percent) >= 10 and abs(b - a) >= 200 and b <= 2 * a and a <= 2 * b:
            want[key] = (a, b, percent, 2)
    got = {(r["place"], r["item"]): tuple(r)[2:] for r in shelves.bounded_moves(frame(spark, days), KEY, F.lit(on(30)), 7, 10, 200).collect()}
    assert got == want and want
    edge = spark.createDataFrame([("A", 1, on(0), 1000, 1), ("A", 1, on(7), 2000, 1), ("A", 2, on(0), 1000, 1), ("A", 2, on(7), 2001, 1), ("A", 3, on(0), 1000, 1), ("A", 3, on(7), 1100, 1)], POINTS)
    assert sorted(r["item"] for r in shelves.bounded_moves(edge, KEY, F.lit(on(7)), cents=100).collect()) == [1, 3]


def test_watched_sets(spark):
    sets = spark.createDataFrame([("a", on(1)), ("b", on(2)), ("c", on(3)), ("d", on(3)), ("e", on(9)), ("f", None)], "code string, day date")
    stocked = spark.createDataFrame([("P", "a", 5), ("P", "b", 5), ("P", "e", 50), ("P", "f", 60), ("P", "x", 70), ("Q", "a", 0)], "place string, code string, n long")
    got = shelves.watched_sets(sets, stocked, "place", ["e", "b", "nix", "c"], F.lit(on(5)), newest=2, most=2)
    assert sorted(map(tuple, got.collect())) == [("P", "a", 4), ("P", "b", 1), ("P", "c", 2), ("P", "d", 3), ("Q", "b", 1), ("Q", "c", 2), ("Q", "d", 3)]
    assert shelves.watched_sets(sets.limit(0), stocked, "place", ["e"], F.lit(on(5))).count() == 0


def test_older_by_set(spark):
    cards = [("P", "a", 1, "box", "n", 2), ("P", "a", 2, "tin", "n", 2), ("P", "a", 3, "box", "m", 2), ("P", "b", 4, "box", "n", 6), ("P", "c", 5, "box", "n", 7), ("P", "a", 6, "bag", "n", 9), ("P", "a", 7, "box", "n", 0),
             ("P", "d", 8, "tin", None, 6), ("P", "d", 9, "tin", "z", None), ("P", None, 10, "tin", "z", 3)]
    sets = spark.createDataFrame([("a", on(1)), ("b", on(2)), ("c", on(9)), ("d", on(3))], "code string, day date")
    schema = "place string, code string, item int, kind string, name string, stores long"
    got = shelves.older_by_set(spark.createDataFrame(cards, schema), sets, "place", F.lit(on(5)), ["box", "tin"])
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[2], r[5])) == [("P", "d", 1, 6, 8, 1), ("P", "b", 2, 6, 4, 1), ("P", "a", 3, 6, 3, 1), ("P", "a", 3, 6, 1, 2), ("P", "a", 3, 6, 2, 3)]
    assert shelves.older_by_set(spark.createDataFrame([], schema), sets, "place", F.lit(on(5)), ["box"]).count() == 0
    assert shelves.returned(spark.createDataFrame([], POINTS), "place", "item", F.lit(on(5))).count() == 0
