import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tradewind.functions import calc
from tradewind.functions import text as tx
from tradewind.operators import history, matching, quality, ranking, stats
from tradewind.operators.query import UNSET, Catalog, Model, Read, Relation, UnsupportedQuery
from tradewind.plans import registry
from tradewind.sources import feeds, snapshot
from tradewind.streaming import changes


@pytest.fixture(scope="module")
def catalog(spark):
    product = spark.createDataFrame([(1, "Red box", "a", 10), (2, "red pack", None, None), (3, "100% blue", "b", 30)], "id long, name string, code string, size int")
    offer = spark.createDataFrame([(1, "x", 500), (1, "y", 400), (3, "x", None), (9, "z", 1)], "product_id long, store string, price long")
    return Catalog(
        Model("Product", product, ["id"], {"offers": Relation("Offer", True, "id", "product_id")}),
        Model("Offer", offer, ["product_id", "store"], {"product": Relation("Product", False, "product_id", "id")}),
        Model("Secret", product, ["id"], private=True),
    )


def ids(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ({"code": None}, [2]), ({"code": {"not": "a"}}, [3]), ({"code": {"notIn": ["a"]}}, [3]), ({"OR": []}, []), ({"AND": []}, [1, 2, 3]),
        ({"NOT": []}, [1, 2, 3]), ({"NOT": {"code": "a"}}, [3]), ({"name": {"contains": "0%"}}, [3]), ({"name": {"startsWith": "RED", "mode": "insensitive"}}, [1, 2]),
        ({"size": UNSET}, [1, 2, 3]), ({"offers": {"some": {"price": {"gt": 450}}}}, [1]), ({"offers": {"none": {}}}, [2]), ({"offers": {"every": {"price": {"gt": 0}}}}, [1, 2]),
        ({"OR": [{"offers": {"some": {"store": "y"}}}, {"code": "b"}]}, [1, 3]), ({"size": {"in": []}}, []),
    ],
)
def test_where(catalog, where, want):
    assert ids(Read(catalog).find_many("Product", where)) == want


def test_to_one_filters(catalog):
    r = Read(catalog)
    assert ids(r.find_many("Offer", {"product": {"is": {"code": "b"}}})) == [3]
    assert ids(r.find_many("Offer", {"product": {"isNot": {"code": "b"}}})) == [1, 1, 9]
    assert ids(r.find_many("Offer", {"product": {"is": None}})) == [9]


@pytest.mark.parametrize("call", [
    lambda r: r.find_many("Secret"), lambda r: r.find_many("Product", {"nope": 1}), lambda r: r.find_many("Product", {"name": {"search": "x"}}),
    lambda r: r.find_many("Product", take=-1), lambda r: r.find_many("Product", {"size": "10"}), lambda r: r.find_many("Product", cursor=1),
])
def test_refusals(catalog, call):
    with pytest.raises(UnsupportedQuery):
        call(Read(catalog))


def test_nulls_order_and_nesting(catalog):
    r = Read(catalog)
    assert [x["id"] for x in r.find_many("Product", order_by={"size": "asc"}, take=3).collect()] == [1, 3, 2]
    assert [x["id"] for x in r.find_many("Product", order_by={"size": "desc"}, take=3).collect()] == [2, 3, 1]
    rows = {x["id"]: x["offers"] for x in r.find_many("Product", select={"id": True, "offers": {"orderBy": {"price": "asc"}, "take": 1, "select": {"store": True}}}).collect()}
    assert [o["store"] for o in rows[1]] == ["y"] and rows[2] == []
    assert {x["store"]: x["product"] and x["product"]["name"] for x in r.find_many("Offer", include={"product": {"select": {"name": True}}}).collect()}["z"] is None


def test_summary_median_and_best_offer(spark):
    rows = [(1, "s", 900, False, dt.datetime(2020, 1, 2)), (1, "s", 950, True, dt.datetime(2020, 1, 1)), (1, "s", 950, True, dt.datetime(2020, 1, 3))]
    best = stats.best_offers(spark.createDataFrame(rows, "product_id long, store string, price long, in_stock boolean, seen timestamp_ntz")).first()
    assert (best["price"], best["in_stock"], best["seen"].day) == (950, True, 3)
    offers = spark.createDataFrame([(1, "m", p, True) for p in (100, 201)] + [(2, "m", 5, True)], "product_id long, market string, price long, in_stock boolean")
    got = {r["product_id"]: r["median_open"] for r in stats.market_summary(offers).collect()}
    assert got == {1: 151, 2: None}


def test_deal_bounds(spark):
    rows = [(p, 3, 10_000) for p in (4999, 5000, 7500, 9000, 9001)] + [(7500, 2, 10_000)]
    got = spark.createDataFrame(rows, "lowest long, in_stock_stores int, median_open long").where(stats.is_deal()).collect()
    assert [r["lowest"] for r in got] == [5000, 7500, 9000]


def test_change_points_close_and_densify(spark):
    day = lambda n: dt.date(2024, 1, n)
    daily = spark.createDataFrame([("m", 1, day(1), 5, 2), ("m", 1, day(2), 5, 2), ("m", 1, day(4), 6, 2), ("m", 2, day(6), 1, 1)], "market string, product_id long, day date, price long, stores long")
    points = history.change_points(daily, ["market", "product_id"])
    assert sorted((r["product_id"], r["day"].day) for r in points.collect()) == [(1, 1), (1, 4), (2, 6)]
    ends = history.closed(points, daily, ["market", "product_id"]).where("stores = 0").collect()
    assert [(r["product_id"], r["day"].day, r["price"]) for r in ends] == [(1, 5, None)]
    dense = history.densified(points, ["market", "product_id"], F.lit("2024-01-03").cast("date"), F.lit("2024-01-06").cast("date"))
    assert sorted((r["product_id"], r["day"].day, r["price"]) for r in dense.collect()) == [(1, 3, 5), (1, 4, 6), (1, 5, 6), (1, 6, 6), (2, 6, 1)]


def test_outlier_passes(spark):
    prices = [59995, 61995, 64995, 8995, 29995]
    rows = spark.createDataFrame([(1, "m", f"s{i}", p, True) for i, p in enumerate(prices)], "product_id long, market string, store string, price long, in_stock boolean")
    assert sorted(r["price"] for r in quality.drop_low_outliers(rows, ["product_id", "market"]).collect()) == sorted(p for p in prices if p != 8995)
    votes = [(1, "a", "b")] * 3 + [(1, "a", "a")] * 2 + [(2, "c", "d"), (2, "c", "c")]
    moved = quality.moved_keys(spark.createDataFrame(votes, "entity long, old string, new string")).collect()
    assert [(r["entity"], r["new"]) for r in moved] == [(1, "b")]


def test_matching_is_exact_then_contained_then_ambiguous(spark):
    products = spark.createDataFrame([(1, "t", ["base", "set"]), (2, "t", ["base", "fossil"]), (3, "t", ["fossil", "set"])], "product long, block string, tokens array<string>")
    listings = spark.createDataFrame([(1, "t", ["base", "set"]), (2, "t", ["base", "new", "set"]), (3, "t", ["base", "fossil", "set"]), (4, "u", ["base", "set"])], "listing long, block string, tokens array<string>")
    got = {r["listing"]: (r["product"], r["how"]) for r in matching.match(listings, products).collect()}
    assert got == {1: (1, "exact"), 2: (1, "contained"), 3: (None, "ambiguous")}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.slug(F.lit("  Crème & Box -- 12!"))) == "cr-me-box-12"
    assert one(tx.fold(F.lit("Pokémon ﬁ"))) == "pokemon fi" and one(tx.decode_entities(F.lit("a &amp; b &#39;"))) == "a & b '"
    assert [one(tx.money_cents(F.lit(x))) for x in ("$1,234.50", "1.234,50 EUR", "free")] == [123450, 123450, None]
    assert one(tx.gtin_ok(F.lit("4006381333931"))) and not one(tx.gtin_ok(F.lit("4006381333932")))
    assert [one(tx.singular(F.lit(x))) for x in ("boxes", "cards", "berries", "glass")] == ["box", "card", "berry", "glass"]
    assert one(tx.csv_safe(F.lit("=1+1"))) == "'=1+1"
    assert str(one(calc.js_months_back(F.lit("2023-08-31").cast("date"), 6))) == "2023-03-03"
    assert one(calc.half_up(F.lit(-2.5))) == -2


def test_interleave_and_neighbours(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "l string, k int")
    got = ranking.interleave(rows, "l", [F.asc("k")], ["k"]).orderBy("turn", "l").collect()
    assert [(r["l"], r["k"]) for r in got] == [("a", 1), ("b", 2), ("b", 3)]
    line = spark.range(10).selectExpr("id", "1 as g")
    assert ids(ranking.neighbours(line, ["g"], [F.asc("id")], F.col("id") == 0, 4).select("id")) == [1, 2, 3, 4]
    assert ids(ranking.neighbours(line, ["g"], [F.asc("id")], F.col("id") == 9, 4).select("id")) == [5, 6, 7, 8]


def test_snapshot_round_trip(spark, tmp_path):
    rows = [(1, "s", 5, dt.datetime(2024, 1, 1)), (2, "s", 6, dt.datetime(2024, 1, 1)), (3, "s", 7, dt.datetime(2024, 1, 2))]
    offers = spark.createDataFrame(rows, "product_id long, store string, price long, seen timestamp_ntz")
    path = str(tmp_path / "snap")
    assert snapshot.write(offers, path, ["product_id"]) == {"count": 3}
    back = snapshot.read(spark, path, "product_id long, store string, price long, seen timestamp_ntz")
    assert sorted(tuple(r)[:4] for r in back.select("product_id", "store", "price", "seen").collect()) == rows
    assert sum("seen" in json.loads(line) for p in (tmp_path / "snap/rows").glob("part*") for line in p.read_text().splitlines()) == 1
    with pytest.raises(snapshot.RefusedExport):
        snapshot.write(offers.limit(1), path, ["product_id"], last_count=3)


def test_feeds(spark, tmp_path):
    feed = {"products": [{"handle": "h", "title": "T", "variants": [{"price": "9.00", "available": False}, {"price": "12.50", "available": True}], "images": [{"src": "i"}]}, {"handle": "n", "title": "N", "variants": []}]}
    (tmp_path / "f.json").write_text(json.dumps(feed))
    got = {r["handle"]: (r["price"], r["in_stock"], r["image"]) for r in feeds.read_json_feed(spark, str(tmp_path / "f.json")).collect()}
    assert got == {"h": (1250, True, "i"), "n": (None, None, None)}
    html = '<div><article class="card"><h4><a href="/p1">Box &amp; Co</a></h4><span class="price now">$19.99</span></article><article class="card"><h4>Gone</h4><b class="price">5,00</b> Sold out</article></div>'
    rows = feeds.parse_grid(spark.createDataFrame([("u", html)], "url string, html string")).orderBy("price").collect()
    assert [(r["title"], r["link"], r["price"], r["in_stock"]) for r in rows] == [("Gone", None, 500, False), ("Box & Co", "/p1", 1999, True)]


def run_stream(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_streams_agree_with_batch(spark, tmp_path):
    schema = "market string, product_id long, day int, price long"
    rows = [("m", k, d, (d // 3 + k) % 4) for k in range(4) for d in range(20)]
    for n, part in enumerate([rows[0::2], [], rows[1::2]]):
        spark.createDataFrame([r for r in rows if r[2] // 10 == n] if n < 2 else [], schema).write.mode("append").parquet(str(tmp_path / "s"))
    got = run_stream(changes.price_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(str(tmp_path / "s"))), "pc")
    batch = history.change_points(spark.createDataFrame(rows, schema), ["market", "product_id"], values=("price",)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    calls = spark.createDataFrame([(1, t) for t in (0, 1, 2, 9, 10, 11)], "key long, at long")
    calls.write.parquet(str(tmp_path / "c"))
    got = run_stream(changes.rate_limited(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "c")), 2, 10), "rl")
    assert [r["allowed"] for r in sorted(got, key=lambda r: r["at"])] == [True, True, False, False, True, True]


def test_windowed_stream(spark):
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    got = run_stream(changes.windowed_counts(events), "wc", "complete")
    want = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("n")).collect()
    assert {(str(r[0]), r[1], r[2]) for r in got} == {(str(r[0]), r[1], r[2]) for r in want}


def test_registry_pairs():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 100


def test_grid_of_many_cards(spark):
    from tradewind.sources.feeds import parse_grid

    card = '<article class="card"><h3><a href="/p">Box</a></h3><span class="price">$5.00</span></article>'
    pages = spark.createDataFrame([("u", "<main>" + card * 10_050), ("v", "no cards"), ("w", None)], "url string, html string")
    assert parse_grid(pages).count() == 10_050
