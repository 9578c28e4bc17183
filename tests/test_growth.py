"""Work that grows with the input and no faster: rows of joins, sizes of plans, whole classes."""

import datetime
import random
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from tradewind.functions import highlight
from tradewind.functions import text as tx
from tradewind.operators import history, phrases, rekey, resolve
from tradewind.plans import discovery, registry, views
from tradewind.plans import holdings as holding_plans

SF = "/root/testdata/sf0.001"


def most_joined(df) -> int:
    """The rows of the largest join of a query, after running it."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        rows = node.metrics().get("numOutputRows")
        here = rows.get().value() if "Join" in name and rows.isDefined() else 0
        below = node.children()
        return max([here, *(walk(below.apply(i)) for i in range(below.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def most_shuffled(df) -> int:
    """The rows of all shuffles of a query, after running it."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        rows = node.metrics().get("shuffleRecordsWritten")
        below = node.children()
        return (rows.get().value() if rows.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_every_product_has_a_class(spark):
    found = registry.queries()["alike_but_for_noise"](spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/part.parquet").count()
    sizes = {}
    for r in found:
        sizes[r["like_id"]] = sizes.get(r["like_id"], 0) + 1
    assert all(sizes[r["like_id"]] == r["n"] and r["like_id"] <= r["id"] for r in found)


def test_no_line_meets_all_items_of_its_number_or_name(spark):
    n = 600
    lines = spark.range(n).selectExpr("id as line", "if(id % 2 = 0, 7L, 8L) as number", "cast(null as string) as set_code", "if(id % 2 = 0, cast(null as string), 'blue ring') as name", "id % 3 = 0 as special")
    items = spark.range(n).selectExpr("id as item", "7L as number", "'a' as set_code", "'blue ring' as name", "id % 5 = 0 as special", "if(id = 3, cast(null as long), 1000 - id) as price")
    found = resolve.resolved(lines, items)
    assert most_joined(found) <= 4 * n
    got = {r["line"]: (r["item"], r["how"], r["choices"]) for r in found.collect()}
    assert got[0] == (599, "number", n) and got[1] == (599, "name", n) and got[3] == (595, "name", n)


def test_sequences_of_texts_are_never_broadcast(spark, monkeypatch):
    texts = spark.range(5).selectExpr("id", "concat('a gold box of set ', id) as t")
    sets = spark.range(200).selectExpr("concat('s', id) as phrase_id", "concat('set ', id) as phrase")
    found = phrases.phrase_hits(texts, sets, "t", ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert sorted((r["id"], r["phrase_id"], r["at"]) for r in found.collect()) == [(i, f"s{i}", 4) for i in range(5)]
    monkeypatch.setattr(phrases, "BROADCAST_PHRASES", 10)
    found = phrases.phrase_hits(texts, sets, "t", "id")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 5


def test_a_printed_code_is_computed_once(spark):
    rows = spark.createDataFrame([("03600029145",), ("036000291452",), ("036000291453",), (None,), ("96385074",)], "c string")
    found = rows.select(tx.gtin(F.concat(F.col("c"), F.lit("MARK"))).alias("g"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MARK") == 1
    assert [r["g"] for r in found.collect()] == [None, "036000291452", None, None, "96385074"]


def test_alternatives_meet_a_short_list(spark, tmp_path):
    for name in ("region", "nation"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    europe = spark.read.parquet(f"{SF}/region.parquet").where("r_name = 'EUROPE'").join(spark.read.parquet(f"{SF}/nation.parquet"), F.col("r_regionkey") == F.col("n_regionkey")).first()["n_nationkey"]
    spark.range(1).selectExpr("id as s_suppkey", f"{europe}L as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    part = spark.range(4000).selectExpr("id as p_partkey", "'x' as p_name", "'Brand#1' as p_brand", "if(id % 3 = 0, 'SMALL', 'LARGE') as p_type", "1 as p_size", "1.0D as p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    line = spark.range(4000).selectExpr("id as l_partkey", "0L as l_suppkey", "100.0D + id as l_extendedprice", "1.0D as l_quantity", "'O' as l_linestatus", "timestamp'1998-01-01 00:00:00' as l_shipdate")
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.queries()["alternatives"](spark, str(tmp_path))
    assert most_joined(found) <= 4000
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], []).append((r["place"], r["product_id"], r["pass"]))
    kind = lambda i: i % 3 == 0
    assert len(got) == len(range(5, 4000, 97))
    for i, rows in got.items():
        assert [p for _, p, _ in sorted(rows)] == [j for j in range(4000) if kind(j) == kind(i) and j != i][:4] and {r[2] for r in rows} == {1}


def walked(rng, days):
    """(k, s, day, price): series of points with gaps and prices that are not known, of two kinds."""
    out = []
    for s in range(30):
        for d in sorted(rng.sample(range(days), rng.randint(1, 9))):
            out.append(("ab"[s % 2], s, datetime.date(2024, 1, 1) + datetime.timedelta(d), rng.choice([None, 5, 5, 7, 9])))
    return out


def test_weeks_are_counted_without_being_written_out(spark):
    points = spark.createDataFrame(walked(random.Random(5), 300), "k string, s long, day date, price long")
    last = F.lit("2024-09-29").cast("date")
    moves = history.weekly_moves(history.weekly_values(points, ["k", "s"], last), ["k", "s"])
    want = moves.groupBy("k", "sunday").agg(F.count_if(F.col("after") != F.col("before")).alias("moved"), F.count("*").alias("compared"))
    got = history.weekly_moved(points, ["k", "s"], ["k"], last)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(sequence") == 1


def test_sums_of_filled_series_are_running_sums(spark):
    rows = walked(random.Random(8), 20)
    points = spark.createDataFrame(rows, "k string, s long, day date, price long")
    grid = points.select("k", "s").distinct().crossJoin(points.select("day").distinct()).join(points, ["k", "s", "day"], "left")
    want = history.filled(grid, ["k", "s"], "price").groupBy("k", "day").agg(F.sum("price").alias("sum"), F.count("*").alias("n"))
    got = history.filled_sums(points, ["k", "s"], ["k"], "price")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # rows of joins are those of kinds and days, not of series and days
    assert most_joined(history.filled_sums(points, ["k", "s"], ["k"], "price")) <= 2 * 20


def test_daily_lows_shuffle_once_and_hash_nothing(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), rng.choice([None, 1, 2]), rng.randint(0, 4), rng.choice([None, 10, 20, 30]), rng.choice([True, False, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, day int, store long, price long, open boolean")
    for which, fits in ((None, lambda r: True), (F.col("open"), lambda r: r[4] is True)):
        found = history.daily_lows(df, ["k"], which)
        want = set()
        for k, day in {(r[0], r[1]) for r in rows}:
            of = [r for r in rows if r[:2] == (k, day) and fits(r)]
            want.add((k, day, min((r[3] for r in of if r[3] is not None), default=None), len({r[2] for r in of})))
        assert {tuple(r) for r in found.collect()} == want
        plan = history.change_points(found, ["k"])._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Exchange") == 1


def test_lines_and_not_their_stores_are_shuffled(spark):
    plan = registry.queries()["best_basket_one_store"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(basket#\d+L, \d+\), REPARTITION", plan) and not re.search(r"hashpartitioning\(basket#\d+L, store", plan)


def test_offers_are_worked_out_once_for_all_runs(spark, monkeypatch):
    made, offer = [], views.Views.offer.fget
    monkeypatch.setattr(views.Views, "offer", property(lambda self: made.append(1) or offer(self)))
    found = registry.queries()["coverage_over_runs"](spark, SF)
    assert len(made) == 1 and found.count() > 0
    assert not any("lineitem" in f for f in found.inputFiles())


def test_groups_of_moves_are_folded_in_batches(spark):
    n = 40
    entities = spark.range(2 * n).selectExpr("id as entity", "concat('k', id) as key", "cast(null as string) as name_key")
    # each even one moves to the key that the odd one behind it gives up
    votes = spark.range(2 * n).selectExpr("id as entity", "if(id % 2 = 0, concat('k', id + 1), concat('f', id)) as key", "true as read")
    moves = rekey.planned_moves(entities, votes)
    assert "FlatMapGroupsInPandas" not in moves._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["entity"], r["old"], r["new"], r["turn"]) for r in moves.collect()}
    assert got == {(i, f"k{i}", f"k{i + 1}" if i % 2 == 0 else f"f{i}", 2 - i % 2) for i in range(2 * n)}


def test_lists_of_groups_are_worked_out_once_for_all_runs(spark, monkeypatch):
    stored, write = [], discovery.settled
    monkeypatch.setattr(discovery, "settled", lambda df, name: stored.append(name) or write(df, name))
    found = registry.queries()["sets_found_over_runs"](spark, SF)
    assert stored == ["groups", "known", "goods", "found", "found"] and found.count() > 0


def test_partitions_of_series_go_by_the_listings(spark, monkeypatch):
    monkeypatch.setattr(views, "ROWS_A_TASK", 1000)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for name in ("closed_series", "daily_series"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\(market#\d+, product_id#\d+L, {lines // 1000 + 1}\)", plan)


def test_series_are_closed_in_the_pass_that_finds_their_changes(spark):
    points = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(walked(random.Random(3), 40)) if r[1] > 1], "k string, s long, day date, price long, stores long")
    odd = spark.createDataFrame([("a", 0, None, 5, 1), ("b", 1, None, None, 0), ("b", 1, datetime.date(2024, 1, 1), None, 0)], points.schema)
    daily = points.unionByName(odd).repartition("k", "s")
    want = history.closed(history.change_points(daily, ["k", "s"]), daily, ["k", "s"])
    got = history.closed_change_points(daily, daily.select("day"), ["k", "s"])
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = registry.queries()["closed_series"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION") == 1 and "Union" not in plan


def test_places_of_a_batch_are_plain_integers(spark):
    n, each = 2000, 40
    texts = pa.array(["de la " * each] * n)
    tracemalloc.start()
    found = highlight.marks(texts, ["de"], {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 8 bytes a place, while arrays grow; a dict and two numbers would be over 200
    assert peak < 30 * n * each
    assert found.to_pylist() == [[{"start": 6 * i, "end": 6 * i + 2} for i in range(each)]] * n
    plan = registry.queries()["highlighted"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "mark(" in plan and highlight.marks(pa.array([None, ""], pa.string()), ["de"], {}).to_pylist() == [[], []]


def test_partitions_of_stores_go_by_the_listings(spark, monkeypatch):
    monkeypatch.setattr(views, "ROWS_A_TASK", 1000)
    parts = spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000 + 1
    found = registry.queries()["usual_seen_day"](spark, SF)
    assert re.search(rf"hashpartitioning\(store#\d+L, {parts}\)", found._jdf.queryExecution().executedPlan().toString())


def test_a_lot_is_shuffled_to_its_order_its_item_and_its_owner(spark, monkeypatch):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = registry.queries()["holdings_on_looks"](spark, SF)
        # besides orders and half of the listings, which are in stock, and some rows of small tables
        assert most_shuffled(found) < 3 * lines + orders + 0.6 * lines + 500
        want = sorted(map(str, found.collect()))
        monkeypatch.setattr(holding_plans, "BROADCAST_STORES", 0)
        apart = registry.queries()["holdings_on_looks"](spark, SF)
        assert "l_suppkey" in "".join(re.findall(r"hashpartitioning\(([^)]*)", apart._jdf.queryExecution().executedPlan().toString()))
        assert sorted(map(str, apart.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_lots_and_their_owners_are_dealt_by_the_listings(spark, monkeypatch):
    monkeypatch.setattr(views, "ROWS_A_TASK", 1000)
    parts = spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000 + 1
    plan = registry.queries()["holdings_on_looks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((?:owner|place)#[^)]*\)", plan)
    assert len(dealt) == 3 and all(x.endswith(f", {parts})") for x in dealt)
