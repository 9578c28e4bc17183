"""Keys, pairs, phrases, lists, ranks, samples, highlights, guards, ledgers, order books and pages, against planted cases and plain Python."""

import collections
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tradewind.functions.highlight import highlight
from tradewind.functions.text import decode_entities
from tradewind.operators import orderbook, pages, pairing, phrases, posting, quality, ranks, rekey, resolve
from tradewind.streaming import ledger as streamed


def replanned(entities, votes, passes=10):
    """Moves by visiting entities in turn, with votes as (entity, key or None, read)."""
    mine = collections.defaultdict(list)
    for e, k, read in votes:
        mine[e].append((k, read))
    held, moved = {k for _, k, _ in entities}, {}
    for _ in range(passes):
        before = len(moved)
        for e, key, name in sorted(entities):
            counts = collections.Counter(k for k, _ in mine[e] if k is not None)
            other = sorted((k for k in counts if k != key), key=lambda k: (-counts[k], k))
            if e in moved or not other:
                continue
            if all(r for _, r in mine[e]) and key not in counts:
                wants = sorted(other, key=lambda k: k != name)
            else:
                wants = other[:1] if counts[other[0]] * 2 > len(mine[e]) else []
            free = [k for k in wants if k not in held]
            if free:
                held.remove(key)
                held.add(free[0])
                moved[e] = (key, free[0])
        if len(moved) == before:
            break
    return {(e, a, b) for e, (a, b) in moved.items()}


def planned(spark, entities, votes):
    e = spark.createDataFrame(entities, "entity long, key string, name_key string")
    v = spark.createDataFrame(votes, "entity long, key string, read boolean")
    return {(r["entity"], r["old"], r["new"]) for r in rekey.planned_moves(e, v).collect()}


def test_keys_move_along_chains_and_swaps_stay(spark):
    entities = [(1, "a", None), (2, "b", None), (3, "c", None), (4, "s", None), (5, "t", None), (6, "u", None), (7, "v", None), (8, "w", "n"), (9, "half", None)]
    votes = [(1, "b", True), (2, "c", True), (3, "free", True), (4, "t", True), (5, "s", True), (6, "one", True), (7, "one", True)]
    # 8 is an orphan: the key of its name comes before the one with most votes; 9 has only half of its listings moved
    votes += [(8, "m", True), (8, "m", True), (8, "n", True), (9, "half", True), (9, "x", True)]
    got = planned(spark, entities, votes)
    assert got == {(1, "a", "b"), (2, "b", "c"), (3, "c", "free"), (6, "u", "one"), (8, "w", "n")} == replanned(entities, votes)


def test_keys_move_as_when_visited_in_turn(spark):
    rng = random.Random(5)
    entities = [(i, f"k{i}", f"k{rng.randrange(70)}" if rng.random() < 0.3 else None) for i in range(60)]
    votes = [(i, rng.choice([None, f"k{i}", f"k{(i * 7 + rng.randrange(4)) % 75}", f"k{(i * 7) % 75}"]), rng.random() < 0.9) for i in range(60) for _ in range(rng.randrange(6))]
    assert planned(spark, entities, votes) == replanned(entities, votes)
    assert planned(spark, [], []) == set()


def paired(rows, low, high, ahead, rounds):
    used, out = set(), []
    for i, a in enumerate(rows):
        if len(out) == rounds or i in used:
            continue
        for j in range(i + 1, min(len(rows), i + ahead)):
            b = rows[j]
            if j not in used and a[0] != b[0] and min(a[1], b[1]) * low <= max(a[1], b[1]) <= min(a[1], b[1]) * high:
                used |= {i, j}
                out.append((len(out) + 1, a[2], b[2]))
                break
    return out if len(out) == rounds else []


def test_pairs_are_drawn_in_turn(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, f"n{rng.randrange(6)}", rng.choice([100, 110, 150, 900, 5000]), f"{g}{i:04}") for g, n in (("a", 300), ("b", 90), ("c", 4)) for i in range(n)]
    # the first rows of d find no partner within reach, so its pairs lie beyond the first draw
    rows += [("d", "same", 100, f"d{i:04}") for i in range(200)] + [("d", f"m{i}", 100 + 60 * (i % 2), f"d{200 + i:04}") for i in range(60)]
    df = spark.createDataFrame(rows, "g string, name string, price long, item string")
    monkeypatch.setattr(pairing, "FIRST_ROWS", 16)
    got = collections.defaultdict(list)
    for r in pairing.drawn_pairs(df, "g", "item", "name", "price", [F.col("item")], 1.25, 4.0, ahead=12, rounds=5).collect():
        got[r["g"]].append((r["round"], r["first"], r["second"]))
    want = {g: paired([r[1:] for r in rows if r[0] == g], 1.25, 4.0, 12, 5) for g in "abcd"}
    assert {g: sorted(got[g]) for g in "abcd"} == want and want["a"] and want["d"] and not want["c"]


def test_phrases_stand_as_whole_words_and_generic_ones_come_last(spark):
    texts = spark.createDataFrame([(1, "The Base Set box, sealed"), (2, "base setting"), (3, "Jungle base set jungle"), (4, None), (5, ""), (6, "promo"), (7, "Promo Base Set Two")], "id long, t string")
    sets = spark.createDataFrame([("b", "Base Set", False), ("b2", "Base Set Two", False), ("j", "Jungle", False), ("p", "Promo cards of all kinds", True), ("q", "promo", True), ("none", " - ", False)], "phrase_id string, phrase string, generic boolean")
    found = phrases.longest_phrase(texts, sets, "t", "id")
    assert {(r["id"], r["phrase_id"], r["n_longest"]) for r in found.collect()} == {(1, "b", 1), (3, "b", 1), (6, "q", 1), (7, "b2", 1)}
    assert [(r["id"], r["at"]) for r in phrases.phrase_hits(texts, sets.where("phrase_id = 'j'"), "t", "id").orderBy("id", "at").collect()] == [(3, 0), (3, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert phrases.longest_phrase(texts, sets.limit(0), "t", "id").count() == 0
    with pytest.raises(ValueError):
        phrases.phrase_hits(texts, spark.createDataFrame([("x", "w " * 13)], "phrase_id string, phrase string"), "t", "id")


def test_lines_are_resolved_in_passes(spark):
    items = spark.createDataFrame(
        [(1, 10, "A", "red dragon", False, 500), (2, 10, "B", "red dragon", False, 300), (3, 11, "A", "red dragon", True, 900), (4, 12, "A", "blue dragon", False, None), (5, 13, "B", "old oak", True, 50), (6, 14, "B", "old oak tree", False, 70)],
        "item long, number long, set_code string, name string, special boolean, price long",
    )
    lines = spark.createDataFrame(
        [
            ("in set", 10, "A", None, False), ("any set", 10, None, "old oak", False), ("wrong set", 10, "C", "blue dragon", False), ("name and number", 99, None, "red dragon", False),
            ("special", None, None, "red dragon", True), ("part", None, None, "lue dr", False), ("plain before special", None, None, "d oak", False), ("special part", None, None, "d oak", True), ("short", None, None, "re", False), ("nothing", None, None, "green", False), ("empty", None, None, None, False),
        ],
        "line string, number long, set_code string, name string, special boolean",
    )
    got = {r["line"]: (r["item"], r["how"], r["choices"]) for r in resolve.resolved(lines, items).collect()}
    assert got == {
        "in set": (1, "number", 1), "any set": (2, "number", 2), "wrong set": (4, "name", 1), "name and number": (2, "name", 3), "special": (3, "name", 3), "part": (4, "part", 1),
        "plain before special": (6, "part", 2), "special part": (5, "part", 2), "short": (None, "none", 0), "nothing": (None, "none", 0), "empty": (None, "none", 0),
    }


def test_ranks_are_exact_over_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(1003)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = {r["b"]: (r["rank"], r["total"]) for r in ranks.with_rank(df, [F.asc("a"), F.asc("b")]).collect()}
    assert got == {b: (i + 1, 1003) for i, (a, b) in enumerate(sorted(rows))}
    tiles = {r["b"]: r["tile"] for r in ranks.with_tile(df, [F.asc("a"), F.asc("b")], 4).collect()}
    assert tiles == {b: 1 + (i // 251 if i < 753 else 3) for i, (a, b) in enumerate(sorted(rows))}
    assert sorted(r["tile"] for r in ranks.with_tile(df.limit(2), [F.asc("a"), F.asc("b")], 3).collect()) == [1, 2]
    assert ranks.with_tile(df.limit(0), [F.asc("a"), F.asc("b")], 3).count() == 0


def test_a_sample_follows_its_weights(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("g"), "id", F.when(F.col("id") < 100, 1).otherwise(4).alias("w"))
    heavy = 0
    for seed in range(12):
        got = ranks.weighted_sample(df, ["g"], F.col("w"), F.col("id"), 10, str(seed)).collect()
        assert collections.Counter(r["g"] for r in got) == {0: 10, 1: 10} and len({r["id"] for r in got}) == 20
        heavy += sum(r["id"] >= 100 for r in got)
    # about 4 of 5 in 240 draws
    assert abs(heavy / 240 - 0.79) < 4 * math.sqrt(0.79 * 0.21 / 240)
    none = ranks.weighted_sample(df.withColumn("w", F.lit(0)), ["g"], F.col("w"), F.col("id"), 10, "x")
    assert none.count() == 0


def test_highlights_are_places_in_the_text_itself(spark):
    rows = [("Pokémon Élite", [(0, 4), (8, 12)]), ("ﬁne ﬁnal", [(0, 1), (4, 5)]), ("spoke poke.poker", [(6, 10), (11, 15)]), ("élite", [(0, 5)]), ("", []), (None, []), ("POKEPOKE", [(0, 4)]), ("&eacute;lite", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r["i"]: [(x["start"], x["end"]) for x in r["r"]] for r in df.select("i", highlight(F.col("t"), ["POKÉ", "elit", "fi"]).alias("r")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}
    decoded = df.where("i = 7").select(highlight(decode_entities(F.col("t")), ["elit"]).alias("r")).first()["r"]
    assert [(x["start"], x["end"]) for x in decoded] == [(0, 4)]
    assert df.select(highlight(F.col("t"), []).alias("r")).where("size(r) > 0").count() == 0


def test_a_short_read_is_believed_the_second_time(spark):
    table = lambda sizes: spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "store long, n long")
    count = lambda df: {r["store"]: r["count"] for r in df.groupBy("store").count().collect()}
    stored, waits, seen = table({1: 10, 2: 10, 3: 10, 10: 10}), None, []
    for read in ({1: 10, 2: 3, 3: 10, 10: 2, 4: 1}, {1: 4, 2: 3, 3: 9, 10: 2}, {1: 9, 2: 3, 10: 2}):
        rows, state = quality.guarded_read(table(read), stored, waits, "store", F.col("store") % 10 == 0, least_percent=50)
        stored, waits = spark.createDataFrame(rows.collect(), rows.schema), spark.createDataFrame(state.collect(), state.schema)
        seen.append((count(stored), {r["store"] for r in waits.where("waits").collect()}))
    assert seen == [({1: 10, 2: 10, 3: 10, 10: 10, 4: 1}, {2, 10}), ({1: 10, 2: 3, 3: 9, 10: 10, 4: 1}, {1, 10, 4}), ({1: 9, 2: 3, 3: 9, 10: 10}, {3, 10})]


def test_the_ledger_and_its_stream_forget_alike(spark, tmp_path):
    rng = random.Random(8)
    days = {d: {f"e{i}": rng.random() < 0.4 for i in range(12) if rng.random() < 0.25} for d in range(1, 26)}
    ledger, gone = spark.createDataFrame([], "key string, seen_run int, posted_day int"), set()
    for day, true in days.items():
        events = spark.createDataFrame([(k, 1) for k in true], "key string, score int")
        posted = spark.createDataFrame([(k,) for k, p in true.items() if p], "key string")
        before = {tuple(r) for r in ledger.collect()}
        after = [tuple(r) for r in posting.next_ledger(ledger, events, posted, day + 1, day, rest_days=4, kept_runs=3).collect()]
        gone |= {(k, s - 1, p) for k, s, p in before if k not in {r[0] for r in after}}
        ledger = spark.createDataFrame(after, "key string, seen_run int, posted_day int")
    for day, true in days.items():
        part = spark.createDataFrame([(k, day, p) for k, p in [*true.items(), ("clock", False)]], "key string, day int, posted boolean")
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        for name in os.listdir(tmp_path / "in"):
            if name.startswith("part") and not (tmp_path / f"done{name}").exists():
                (tmp_path / f"done{name}").touch()
                os.utime(tmp_path / "in" / name, (1_700_000_000 + day, 1_700_000_000 + day))
    events = spark.readStream.schema("key string, day int, posted boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = streamed.forgotten(events, rest_days=4, kept_days=3).writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    got = {(r["key"], r["seen_run"], r["posted_day"]) for r in spark.table("forgotten").collect()}
    assert gone and got == gone


def replayed(orders, listings, wallets):
    stock, balance, out = {k: x[3] for k, x in listings.items()}, collections.defaultdict(int, wallets), []
    for seq, listing, buyer, qty in sorted(orders):
        if listing not in listings or qty is None or qty <= 0:
            out.append((seq, "unknown", 0))
            continue
        _, seller, price, _ = listings[listing]
        cost = price * qty
        how = "gone" if stock[listing] < qty else "own" if seller == buyer else "poor" if balance[buyer] < cost else "sold"
        if how == "sold":
            stock[listing] -= qty
            balance[buyer] -= cost
            balance[seller] += cost
        out.append((seq, how, cost if how == "sold" else 0))
    return out


def test_orders_replay_in_turn(spark):
    rng = random.Random(11)
    listings = {i: (i, rng.randrange(6), rng.randrange(1, 9), rng.randrange(0, 14)) for i in range(8)}
    wallets = {a: rng.randrange(0, 40) for a in range(5)}
    orders = [(i, rng.randrange(9), rng.randrange(7), rng.randrange(0, 5)) for i in range(150)]
    book = (
        spark.createDataFrame(orders, "seq long, listing long, buyer long, qty long"), spark.createDataFrame(list(listings.values()), "listing long, seller long, price long, stock long"),
        spark.createDataFrame(list(wallets.items()), "account long, balance long"),
    )
    got = sorted((r["seq"], r["outcome"], r["paid"]) for r in orderbook.replay(*book).collect())
    want = replayed(orders, listings, wallets)
    assert got == want and {how for _, how, _ in want} == {"unknown", "gone", "own", "poor", "sold"}


def test_pages_cap_before_they_collect(spark):
    products = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, slug string")
    offers = spark.createDataFrame([(1, "X", s, 100 - s, s % 2 == 0) for s in range(9)] + [(1, "Y", 20, 5, True), (1, "Z", 30, 7, False), (1, "Z", 31, 9, True), (2, "Z", 32, 9, True)], "product_id long, market string, store long, price long, in_stock boolean")
    stats = spark.createDataFrame([(1, "X", 92, 5)], "product_id long, market string, lowest long, in_stock_stores long")
    got = {r["id"]: r for r in pages.product_pages(products, offers, stats, F.col("market") == "Z", 3).collect()}
    x, y = got[1]["markets"]
    assert [(o["store"], o["price"], o["in_stock"]) for o in x["offers"]] == [(8, 92, True), (6, 94, True), (4, 96, True)] and (x["lowest"], x["stores"]) == (92, 5)
    assert y["market"] == "Y" and y["lowest"] is None and got[1]["abroad"]["store"] == 31
    assert got[2]["markets"] == [] and got[2]["abroad"]["store"] == 32 and got[3]["markets"] == [] and got[3]["abroad"] is None
