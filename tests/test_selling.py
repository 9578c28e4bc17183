"""Places to sell in, feeds, packs, weeks, events, sources and overwriting, on planted cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tradewind.functions import calc
from tradewind.operators import filters, history, merge, packs, posting, selection, stats, venues
from tradewind.sources import feeds

VENUES = [venues.Venue("auction", 1000, 1), venues.Venue("market", 500, 2), venues.Venue("shop", 0, 3)]


def test_flips_sell_where_most_is_left(spark):
    asks = spark.createDataFrame([(1, 5, 1000), (1, 4, 1000), (2, 5, 1000), (3, 5, 90), (4, 5, 1000), (5, 5, 1000)], "product_id long, store long, price long")
    bids = spark.createDataFrame([(1, "auction", 1, 2000), (1, "auction", 2, 1900), (1, "shop", 7, 1710), (1, "market", 6, 1800), (2, "shop", 7, 1010), (3, "shop", 7, 900), (4, "shop", 8, 9000), (5, "elsewhere", 8, 2000), (1, "market", 3, None)], "product_id long, venue string, store long, price long")
    got = venues.flips(asks, bids, VENUES, 100, 50, 500.0).collect()
    # 1900 less a tenth, 1800 less a twentieth and 1710 leave 1710 each; the auction comes first
    assert [tuple(r) for r in got] == [(1, 1000, 4, "auction", 2, 1900, 710, 71.0)]
    assert venues.flips(asks, bids, VENUES, 100, 5, 900.0).count() == 3
    assert [r["store"] for r in venues.cheapest_listing(asks, 1).where("product_id = 1").collect()] == [4]


def walked(rows, most):
    out, items, photos = [], set(), set()
    for item, photo in rows:
        if len(out) < most and item not in items and (photo is None or photo not in photos):
            out.append(item)
            items.add(item)
            photos.add(photo)
    return out


def test_what_is_passed_over_does_not_count_against_later_ones(spark):
    # 2 has the photo of 1, so its own item may come again with another photo; nulls are like no other
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, None), (5, None), (1, "c"), (6, "c")]
    df = spark.createDataFrame([("f", i, n, p) for n, (i, p) in enumerate(rows)] + [("g", 9, 0, "a")], "feed string, item long, n long, photo string")
    for most in (9, 3):
        got = selection.first_unlike(df, "feed", "item", "photo", [F.col("n")], most).where("feed = 'f'").orderBy("place").collect()
        assert [r["item"] for r in got] == walked(rows, most)
    assert walked(rows, 9) == [1, 2, 4, 5, 6] and selection.first_unlike(df.limit(0), "feed", "item", "photo", [F.col("n")], 3).count() == 0


def test_pack_rules(spark):
    rules = {
        "box": packs.PackRule(packs=36), "case": packs.PackRule(of="box", times=6), "kit": packs.PackRule(by_series={"x": 9}, by_set={"odd": None, "ten": 10}),
        "kits": packs.PackRule(of="kit", times=10), "blister": packs.PackRule(names=((r"\b2[ -]?packs?\b", 2), (r"\btriple\b", 3))), "tin": packs.PackRule(),
    }
    rows = [("box", "x", "s", "", 36), ("case", None, None, None, 216), ("kit", "x", "s", "", 9), ("kit", "x", "odd", "", None), ("kit", "y", "ten", "", 10), ("kit", "y", "s", "", None), ("kits", "x", "odd", "", None), ("kits", "x", None, "", 90),
            ("blister", "x", "s", "Checklane 2-Pack", 2), ("blister", "x", "s", "Triple 2 pack", 2), ("blister", "x", "s", "plain", None), ("tin", "x", "s", "", None), ("unknown", "x", "s", "", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, series string, set_code string, name string, want int")
    got = df.select("want", packs.pack_count(F.col("kind"), F.col("series"), F.col("set_code"), F.col("name"), rules).alias("n"))
    assert [r["n"] for r in got.orderBy("i").collect()] == [r[-1] for r in rows]


def test_summary_tells_marketplaces_and_sleepers_apart(spark):
    day = datetime.datetime(2020, 1, 1)
    offers = spark.createDataFrame(
        [(1, "m", 1, 500, True, day), (1, "m", 2, 700, True, day), (1, "m", 10, 300, True, day), (1, "m", 3, 100, False, day), (1, "m", 4, 90, True, day.replace(year=2000)), (2, "m", 10, 50, False, day), (2, "m", 3, 50, False, day)],
        "product_id long, market string, store long, price long, in_stock boolean, seen timestamp",
    )
    got = {r["product_id"]: tuple(r)[2:] for r in stats.full_summary(offers, F.col("store") == 10, offers.where("store = 3").select("store"), F.col("seen") > F.lit("2010-01-01").cast("timestamp")).collect()}
    # lowest, in stock, listed, marketplace open, median
    assert got == {1: (300, 2, 3, True, 600), 2: (None, 0, 0, False, None)}


def test_weeks_hold_the_last_point(spark):
    d = datetime.date
    points = spark.createDataFrame([("a", d(2024, 1, 1), 10), ("a", d(2024, 1, 9), 12), ("a", d(2024, 1, 20), None), ("a", d(2024, 1, 29), 15), ("b", d(2024, 2, 4), 7)], "k string, day date, price long")
    values = history.weekly_values(points, ["k"], F.lit("2024-02-11").cast("date"))
    got = sorted((r["k"], r["sunday"].isoformat(), r["price"]) for r in values.collect())
    assert got == [("a", "2024-01-07", 10), ("a", "2024-01-14", 12), ("a", "2024-01-21", None), ("a", "2024-01-28", None), ("a", "2024-02-04", 15), ("a", "2024-02-11", 15), ("b", "2024-02-04", 7), ("b", "2024-02-11", 7)]
    moves = history.weekly_moves(values, ["k"]).collect()
    assert sorted((r["k"], r["sunday"].isoformat(), r["before"], r["after"]) for r in moves) == [("a", "2024-01-14", 10, 12), ("a", "2024-02-11", 15, 15), ("b", "2024-02-11", 7, 7)]


def test_events_are_deals_and_returns(spark):
    d = datetime.date
    summaries = spark.createDataFrame([("m", 1, 80, 3, 100), ("m", 2, 95, 3, 100), ("m", 3, 70, 2, 100), ("m", 4, None, 0, None), ("m", 5, 20, 1, None)], "market string, product_id long, lowest long, in_stock_stores long, median_open long")
    points = spark.createDataFrame(
        [("m", p, d(2024, 1, n + 1), 10, s) for p, stores in ((2, (4, 0, 2)), (3, (4, 1, 2)), (4, (4, 0, 2)), (5, (0, 3))) for n, s in enumerate(stores)], "market string, product_id long, day date, price long, stores long"
    )
    got = {(r["key"], r["score"]) for r in posting.found_events(summaries, points, F.lit("2024-01-03").cast("date"), stats.is_deal(), F.lit(True)).collect()}
    assert got == {("deal|m|1", 20), ("return|m|2", 1003)}


def test_grading(spark):
    c = lambda x: F.lit(float(x))
    one = lambda *grades, percent=10: spark.range(1).select(calc.grading_outlook(F.lit(1000), F.lit(300), F.lit(percent), list(grades)).alias("o")).first()["o"]
    assert tuple(one((c(50), F.lit(4000)), (c(25), F.lit(1000)))) == (900, 1334, 2400, 1500)
    assert tuple(one((c(0), F.lit(4000)), (c(-5), F.lit(1000)))) == (900, 1334, None, None) and one((c(1), F.lit(1)), percent=100)["break_even"] is None
    days = spark.sql("select timestamp_ntz'2024-07-01 06:59:59' a, timestamp_ntz'2024-07-01 07:00:00' b, timestamp_ntz'2024-12-01 07:30:00' c")
    assert tuple(days.select(*[calc.day_in_zone(F.col(x), "America/Los_Angeles") for x in "abc"]).first()) == ("2024-06-30", "2024-07-01", "2024-11-30")


def test_search_across_games(spark):
    rows = [("a", "single", "S", "Blue-Eyes Dragon"), ("b", "sealed", "S", "Blue Eyes Box"), ("c", "single", "T", "blueprint"), ("a", "single", None, None)]
    df = spark.createDataFrame(rows, "game string, kind string, set_name string, name string")
    found = lambda asked, games=("a", "b"): [r["name"] for r in df.where(filters.across_games(asked, list(games), {"a", "b", "c"})).collect()]
    assert found({"q": "BLUE-EYES"}) == ["Blue-Eyes Dragon", "Blue Eyes Box"] and found({"q": "blue", "game": "c"}) == ["blueprint"]
    assert found({"kind": "sealed"}) == ["Blue Eyes Box"] and found({"set": "T"}) == [] and found({}, ()) == [] and found({"q": "-"}) == ["Blue-Eyes Dragon"] and len(found({"kind": "other"})) == 3


def test_category_pages(spark, tmp_path):
    price = lambda p, unit=2, code="EUR": {"price": p, "currency_code": code, "currency_minor_unit": unit}
    item = lambda i, name, p, stock, *slugs: {"id": i, "name": name, "permalink": f"/p{i}", "is_in_stock": stock, "prices": p, "images": [{"src": f"{i}.jpg"}], "categories": [{"id": 1, "slug": s} for s in slugs]}
    (tmp_path / "1.json").write_text(json.dumps([item(1, "Box &amp; Co ", price("1999"), True, "packs", "new"), item(2, "Yen", price("500", 0), False, "packs"), item(3, "Other", price("100"), True, "toys"), item(4, "No price", price(None), True, "packs")]))
    (tmp_path / "2.json").write_text(json.dumps([item(1, "Box", price("2500"), True, "packs"), item(5, "Dollar", price("700", 2, "USD"), True, "packs"), {"id": 6, "name": "Bare", "prices": price("42"), "categories": [{"slug": "packs"}]}]))
    (tmp_path / "3.json").write_text('[{"id": 7, ')
    got = {r["id"]: tuple(r)[1:] for r in feeds.read_category_feed(spark, str(tmp_path), "packs", "EUR").collect()}
    assert got == {1: ("Box & Co", "/p1", 1999, True, "1.jpg"), 2: ("Yen", "/p2", 50000, False, "2.jpg"), 6: ("Bare", None, 42, False, None)}
    assert 5 in {r["id"] for r in feeds.read_category_feed(spark, str(tmp_path), "packs").collect()}


def test_catalogue_pages(spark, tmp_path):
    def write(folder, pages):
        (tmp_path / folder).mkdir()
        for n, (total, ids) in enumerate(pages):
            items = [{"productId": i, "productName": f"n{i}p{n}", "setName": "s", "marketPrice": 1.255, "lowestPrice": None, "listings": 3} for i in ids]
            (tmp_path / folder / f"{n}.json").write_text(json.dumps({"total": total, "page": n, "items": items}))
        return str(tmp_path / folder)

    whole = feeds.read_catalogue(spark, write("whole", [(100, range(60)), (100, range(59, 99))])).collect()
    assert len(whole) == 99 and {r["id"]: r["name"] for r in whole}[59] == "n59p1" and whole[0]["market"] in (125, 126) and whole[0]["lowest"] is None
    with pytest.raises(feeds.BrokenRead):
        feeds.read_catalogue(spark, write("cut", [(100, range(60)), (60, [])]))
    with pytest.raises(feeds.BrokenRead):
        feeds.read_catalogue(spark, write("none", [(0, [])]))


def test_overwriting_a_table_keeps_it_when_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    assert merge.overwrite_table(spark.range(10), path) == 10
    assert merge.overwrite_table(spark.read.parquet(path).where("id < 6"), path, 0.5) == 6 and spark.read.parquet(path).count() == 6
    for fresh, share in ((spark.range(2), 0.5), (spark.range(0), 0.0)):
        with pytest.raises(merge.RefusedOverwrite):
            merge.overwrite_table(fresh, path, share)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(6)) and [p.name for p in tmp_path.iterdir()] == ["t"]
