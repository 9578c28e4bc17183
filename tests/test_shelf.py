"""Orders of results, alternatives, slugs, searches, lists and sinks."""

import csv
import json
import random
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradewind.operators import filters, merge, ranking
from tradewind.operators.query import Catalog, Model, Read, Relation
from tradewind.plans import registry
from tradewind.sources import sinks

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize(
    ("name", "order"),
    [("lowest_price_first", None), ("below_list_price", None), ("store_offers_page", None), ("browse_page", None), ("posts_selected", None), ("read_order_and_page", None),
     ("read_order_by_relation", None), ("best_venues_page", None), ("lookup_in_given_order", "pos"), ("ranked_links", "place")],
)
def test_rows_come_in_order(spark, duck, name, order):
    sql = registry.oracle_sql()[name]
    got = registry.queries()[name](spark, str(SF)).toPandas()
    want = duck.execute(f"SELECT * FROM ({sql}) ORDER BY {order}" if order else sql).df()[list(got.columns)]
    text = lambda df: [tuple("null" if pd.isna(x) else f"{float(x):.9g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x) for x in r) for r in df.itertuples(index=False, name=None)]
    assert len(got) > 1 and text(got) == text(want)


def test_pages_keep_their_order_with_relations_and_lists(spark):
    rng = random.Random(6)
    items = spark.createDataFrame([(i, rng.randrange(5), [f"t{j}" for j in range(i % 4)] if i % 7 else None) for i in range(60)], "id long, rank long, tags array<string>")
    notes = spark.createDataFrame([(n, n % 60, rng.randrange(9)) for n in range(200)], "note long, item long, score long")
    read = Read(Catalog(Model("Item", items, ["id"], {"notes": Relation("Note", True, "id", "item")}), Model("Note", notes, ["note"], {"item": Relation("Item", False, "item", "id")})))
    got = read.find_many("Item", where={"tags": {"has": "t1"}}, include={"notes": {"orderBy": {"score": "desc"}, "take": 2}}, order_by=[{"rank": "desc"}], skip=3, take=9).collect()
    rows = sorted((r for r in items.collect() if r["tags"] and "t1" in r["tags"]), key=lambda r: (-r["rank"], r["id"]))[3:12]
    assert [r["id"] for r in got] == [r["id"] for r in rows]
    mine = {i: sorted((r for r in notes.collect() if r["item"] == i), key=lambda r: (-r["score"], r["note"]))[:2] for i in range(60)}
    assert all([n["note"] for n in r["notes"]] == [n["note"] for n in mine[r["id"]]] for r in got)
    # a null list has nothing, and neither has its negation
    assert read.find_many("Item", where={"NOT": {"tags": {"has": "t1"}}}).count() == sum(r["tags"] is not None and "t1" not in r["tags"] for r in items.collect())
    plan = read.find_many("Item", order_by=[{"rank": "desc"}], take=5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "TakeOrderedAndProject" in plan


def test_alternatives_against_all_pairs(spark):
    rng = random.Random(2)
    cards = [(i, rng.choice("abc"), rng.choice([None, "s1", "s2", "s3"]), rng.choice([None, 1, 2]), rng.choice([None, *range(100, 130)])) for i in range(90)]
    wanted = [(i, rng.choice("abcz"), rng.choice([None, "s1", "s2"])) for i in range(60, 140)]
    df = spark.createDataFrame(cards, "product_id long, product_type string, set_code string, set_place int, lowest long")
    w = spark.createDataFrame(wanted, "id long, product_type string, set_code string")
    got = {}
    for r in ranking.alternatives(w, df, F.col("product_type") == "b", 3).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["product_id"]
    last = 10**9
    for i, kind, mine in wanted:
        same = sorted((c for c in cards if c[1] == kind and c[0] != i), key=lambda c: (c[2] is None or c[2] != mine, last if c[3] is None else c[3], last if c[4] is None else c[4], c[0]))
        if not same:
            same = sorted((c for c in cards if c[1] == "b" and c[0] != i), key=lambda c: (last if c[4] is None else c[4], c[0]))
        assert [got[i][n] for n in sorted(got[i])] == [c[0] for c in same[:3]]


def test_shared_slugs_are_told_apart(spark):
    rows = [(3, "box"), (1, "box"), (2, "box"), (4, "tin"), (5, "x" * 200), (6, "x" * 200)]
    got = {r["id"]: r["slug"] for r in merge.distinct_slugs(spark.createDataFrame(rows, "id long, slug string"), "id", "slug").collect()}
    assert got[1] == "box" and got[4] == "tin" and got[5] == "x" * 200 and len(set(got.values())) == 6
    assert got[2].startswith("box-") and got[6].startswith("x" * 130 + "-") and len(got[6]) <= 140


def test_searches(spark):
    rows = [("Kai'Sa, Daughter", "Origins", None), ("Vi", "Kaisa Set", "rare"), (None, None, None)]
    df = spark.createDataFrame(rows, "name string, set_code string, rarity string")
    found = lambda text: [r["name"] for r in df.where(filters.every_term(text, ["set_code", "rarity"], "name")).collect()]
    assert found("KAISA") == ["Kai'Sa, Daughter", "Vi"] and found("kaisa rare") == ["Vi"] and found("kai'sa orig") == ["Kai'Sa, Daughter"] and len(found("  ")) == 3 and found("none") == []
    offers = spark.createDataFrame([(1, True, "shop", "NM"), (2, True, "guide_x", "NM"), (3, True, "shop", "HP"), (4, True, "shop", None), (5, False, "shop", "NM")], "id int, in_stock boolean, seller string, condition string")
    assert [r["id"] for r in offers.where(filters.headline()).collect()] == [1, 4]


def test_spreadsheets(spark, tmp_path):
    rows = [(1, 'a "quoted", cell', "=1+1"), (2, None, "-5"), (3, "two\nlines", "plain"), (4, "é", "@x")]
    sinks.write_csv(spark.createDataFrame(rows, "id int, note string, f string"), str(tmp_path / "csv"), [F.asc("id")])
    back = []
    for part in sorted((tmp_path / "csv").glob("part-*")):
        header, *cells = csv.reader(part.open(newline="", encoding="utf-8"))
        assert header == ["id", "note", "f"]
        back += cells
    assert back == [["1", 'a "quoted", cell', "'=1+1"], ["2", "", "'-5"], ["3", "two\nlines", "plain"], ["4", "é", "'@x"]]


def test_price_documents_are_written_by_name(spark, tmp_path):
    cards = spark.createDataFrame([(1, "b-1", "B", "MIDDLE EAST", 5), (1, "b-1", "B", "ASIA", 7), (2, "a-2", "A", "ASIA", None), (3, "c-3", "A", "ASIA", 9)], "product_id long, slug string, name string, market string, lowest long")
    sinks.write_price_api(cards, str(tmp_path / "api"), "https://x")
    lines = [json.loads(x) for p in sorted((tmp_path / "api").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [
        {"id": 3, "name": "A", "prices": {"ASIA": {"cents": 9, "url": "https://x/asia/p/c-3"}}},
        {"id": 1, "name": "B", "prices": {"ASIA": {"cents": 7, "url": "https://x/asia/p/b-1"}, "MIDDLE EAST": {"cents": 5, "url": "https://x/middle-east/p/b-1"}}},
    ]
