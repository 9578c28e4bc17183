"""Names, barcodes and ladders of prices by cases."""

import random

from pyspark.sql import functions as F

from tradewind.functions import text as tx
from tradewind.operators import facts


def test_barcodes(spark):
    codes = {"036000291452": "036000291452", "36000291452": "036000291452", "0-36000 29145-2": "036000291452", "036000291453": None, "4006381333931": "4006381333931", "96385074": "96385074",
             "10036000291459": "10036000291459", "000000000000": None, "": None, "12345": None, "abc": None, None: None, "36000291453": None}
    rows = spark.createDataFrame([(c,) for c in codes], "c string").withColumn("g", tx.gtin(F.col("c"))).withColumn("l", tx.gtin_label(F.col("g")))
    got = {r["c"]: (r["g"], r["l"]) for r in rows.collect()}
    label = {8: "GTIN", 12: "UPC", 13: "EAN", 14: "GTIN"}
    assert got == {c: (g, g and label[len(g)]) for c, g in codes.items()}


def test_codes_of_their_own(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "c"), (6, "c")]
    got = facts.own_codes(spark.createDataFrame(rows, "id int, code string"), "code")
    assert sorted(map(tuple, got.collect())) == [(1, None), (2, None), (3, "b"), (4, None), (5, None), (6, None), (6, None)]
    assert facts.own_codes(spark.createDataFrame([], "id int, code string"), "code").count() == 0


def test_names(spark):
    rng = random.Random(2)
    reads = [(rng.randrange(40), rng.choice(["x", "y", "z", None]), rng.random() < 0.1, rng.choice([None, 1, 2, 3, 4])) for _ in range(300)]
    got = {r["k"]: r["name"] for r in facts.picked_names(spark.createDataFrame(reads, "k int, name string, marketplace boolean, at int"), ["k"]).collect()}
    want = {}
    late = lambda at: 99 if at is None else at
    for k in {r[0] for r in reads}:
        mine = [(n, m, late(at)) for x, n, m, at in reads if x == k and n is not None]
        first = lambda name: min(at for n, _, at in mine if n == name)
        told = [(at, first(n), n) for n, m, at in mine if m]
        names = {n for n, _, _ in mine}
        if told:
            want[k] = min(told)[2]
        elif names:
            want[k] = min(names, key=lambda name: (-sum(n == name for n, _, _ in mine), first(name), name))
    assert got == want and len(want) > 30


def test_ladder(spark):
    rows = [("s", 1, 500), ("s", 2, 500), ("s", 3, 1000), ("s", 4, 1600), ("s", 5, 1601), ("s", 6, 0), ("s", 7, None), ("s", 8, -5), ("t", 9, 1601), ("u", 10, None), (None, 11, 700)]
    got = facts.ladder_plan(spark.createDataFrame(rows, "place string, item int, price long"), "place", "item", "price", [400, 1000, 1500, 9000])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("s", 0, 1, 500), ("s", 2, 3, 1000), ("s", 3, 4, 1600), ("t", 0, 9, 1601), (None, 0, 11, 700)], key=str)
    assert facts.ladder_plan(spark.createDataFrame([], "place string, item int, price long"), "place", "item", "price", [400]).count() == 0
