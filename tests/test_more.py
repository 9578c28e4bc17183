"""Ordering of reads, modes, filters, merges, hashes, identity and slots on small tables."""

import pytest
from pyspark.sql import functions as F

from tradewind.functions import hashing
from tradewind.operators import demand, filters, identity, merge
from tradewind.operators.query import Catalog, Model, Read, Relation, UnsupportedQuery


@pytest.fixture(scope="module")
def read(spark):
    items = spark.createDataFrame([(i, n, i % 3) for i, n in enumerate(["abc", "ABC", "Xyz", None, "q", "Abc d"])], "id long, name string, box long")
    boxes = spark.createDataFrame([(0, "red"), (1, "blue"), (2, "green")], "box long, colour string")
    return Read(Catalog(Model("Item", items, ["id"], {"inside": Relation("Box", False, "box", "box")}), Model("Box", boxes, ["box"], {"items": Relation("Item", True, "box", "box")})))


def test_find_many_is_ordered(read):
    down = read.find_many("Item", order_by={"id": "desc"}, select={"id": True})
    assert [r["id"] for r in down.collect()] == [5, 4, 3, 2, 1, 0] and "Sort" in down._jdf.queryExecution().optimizedPlan().toString()
    joined = read.find_many("Item", order_by={"id": "desc"}, skip=1, take=3, select={"id": True, "inside": {"select": {"colour": True}}})
    assert [(r["id"], r["inside"]["colour"]) for r in joined.collect()] == [(4, "blue"), (3, "red"), (2, "green")]


def test_nested_not_keeps_the_mode(read):
    kept = read.find_many("Item", {"name": {"mode": "insensitive", "not": {"equals": "ABC"}}}, select={"id": True})
    assert sorted(r["id"] for r in kept.collect()) == [2, 4, 5]
    with pytest.raises(UnsupportedQuery):
        read.find_many("Item", {"name": {"mode": "loose", "equals": "a"}})


def test_hashes(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "s string")
    assert [r[0] for r in rows.select(hashing.fnv1a(F.col("s"))).collect()] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, None]
    assert [r[0] for r in spark.range(35, 38).select(hashing.base36(F.col("id"))).collect()] == ["z", "10", "11"]


def test_identity_gates(spark):
    sets = spark.createDataFrame([("B1", "Base"), ("B2", "Base Two"), ("F1", "Fall")], "set_code string, set_name string")
    cases = {
        "Base Two Booster": (None, "B2"), "base booster": (None, "B1"), "Base booster 3x": ("quantity", "B1"), "booster pack of 2 fall": ("quantity", "F1"),
        "used Base booster": ("condition", "B1"), "Base booster tin": ("two types", "B1"), "baseball booster": ("no set", None), "Base thing": ("no type", "B1"),
        "Base Fall booster": ("two sets", "B1"), "": ("empty", None), "Base booster Korean": (None, "B1"), None: (None, None),
    }
    titles = spark.createDataFrame(list(enumerate(cases)), "id long, title string")
    got = {r["id"]: r for r in identity.identify(titles, sets, ["Booster", "Tin"]).collect()}
    assert len(got) == len(cases)
    for i, (title, (rejected, code)) in enumerate(cases.items()):
        if title is not None:
            assert (got[i]["rejected"], got[i]["set_code"]) == (rejected, code), title
    assert got[10]["identity"] == "korean|Booster|B1" and got[0]["identity"] == "english|Booster|B2"
    assert identity.identify(titles.limit(0), sets, ["Tin"]).count() == 0


def test_explore_slots(spark):
    rows = spark.createDataFrame([(i, i < 12) for i in range(15)], "id long, known boolean")
    got = {r["slot"]: r["id"] for r in demand.explore_slots(rows, F.col("known"), [F.asc("id")]).collect()}
    assert [got[i] for i in range(1, 16)] == [0, 1, 12, 2, 3, 4, 5, 6, 7, 8, 13, 9, 10, 11, 14]
    few = spark.createDataFrame([(0, True), (1, False), (2, False)], "id long, known boolean")
    assert {r["id"]: r["slot"] for r in demand.explore_slots(few, F.col("known"), [F.asc("id")]).collect()} == {0: 1, 1: 2, 2: 3}


def test_url_filter(spark):
    rows = spark.createDataFrame([(1, "A", "s", 500), (2, "B", None, 900), (3, "C", "t", None)], "id long, product_type string, set_code string, price long")
    ids = lambda q: [r["id"] for r in rows.where(filters.from_url(q, "price")).orderBy("id").collect()]
    assert ids("type=A,B") == [1, 2] and ids("set=none") == [2] and ids("set=s,t") == [1, 3] and ids("min=6") == [2] and ids("max=x&odd=1") == [1, 2, 3]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7), (None, "n", 1)], "k long, name string, n long")
    new = spark.createDataFrame([(2, "B", 9), (4, "d", None)], "k long, name string, n long")
    got = {(r["k"], r["name"], r["n"]) for r in merge.upsert(old, new, "k", {"n": F.lit(0).cast("long")}, F.col("k") == 3).collect()}
    assert got == {(1, "a", 0), (2, "B", 9), (4, "d", None), (None, "n", 0)}


def test_posts(spark):
    from tradewind.operators.posting import due_posts, with_standing

    events = spark.createDataFrame([("new", 1), ("left", 9), ("still", 8), ("warm", 7), ("cold", 9)], "key string, score long")
    ledger = spark.createDataFrame([("left", 4, None), ("still", 4, 10), ("warm", 3, 95), ("cold", 3, 93)], "key string, seen_run int, posted_day int")
    keys = lambda *a: [r["key"] for r in due_posts(events, ledger, *a).collect()]
    assert keys(5, 100, 9) == ["cold", "left", "new"] and keys(5, 100, 2) == ["cold", "left"] and keys(1, 100, 9) == []
    standing = {r["key"]: r["standing"] for r in with_standing(events, ledger, 5, 100).collect()}
    assert standing == {"new": "new", "left": "unposted", "still": "going on", "warm": "resting", "cold": "returned"}


def test_grid_of_boxes(spark):
    from tradewind.sources.feeds import parse_boxes

    box = '<div class="card product-box b"><a href="/p?a=1&amp;b=2" class="product-name" title="Box &amp;  Co">x</a><span class="product-price"> 19,99 </span>{}</div>'
    bad = '<div class="card product-box"><a class="product-name" title="No link">x</a><span class="product-price">5.00</span></div>'
    pages = spark.createDataFrame([("u", box.format("<button class=btn-buy>") + bad + box.format("btn-buy stock-notify")), ("v", ""), ("w", None)], "url string, html string")
    assert [tuple(r) for r in parse_boxes(pages).orderBy("in_stock").collect()] == [("u", "Box & Co", "/p?a=1&b=2", 1999, False), ("u", "Box & Co", "/p?a=1&b=2", 1999, True)]
