"""Searches answered at once against a scan of all items for each."""

import random
import re

import pytest

from tradewind.operators import typeahead

SEARCH, CARD, GROUP = "search int, text string", "id string, name string, number string, price long", "id string, name string, label string, code string, place int"


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab1") for _ in range(n))
    cards = [(f"c{i:03}", rng.choice([None, f"{word(3)} {word(2).upper()}-{word(3)}"]), rng.choice([None, word(3), "X" + word(2)]), rng.choice([None, 5, 7, 9])) for i in range(150)]
    cards += [(f"d{i}", "Same Name", "77", 5) for i in range(12)]
    groups = [(f"g{i}", rng.choice([None, f"{word(4)} {word(2)}"]), rng.choice(["Box", "box", "Tin"]), rng.choice([None, "AB1", word(2)]), i % 4) for i in range(30)]
    texts = [None, "", "a", " a ", "ab", " AB ", "a b", "--", "a-", "-1b", "same", "SAME name", "7", "77", "bo", "Xa", "xa", "box", "aaaaaaaa", "ab1", "b1", "1a", "é", "éé", "a" * 5000]
    return list(enumerate(texts + texts[4:6])), cards, groups


def scanned(made, first, first_groups):
    searches, cards, groups = made
    plain = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    out = set()
    for search, text in searches:
        q = (text or "").strip(" ")
        if len(q) < 2:
            continue
        hits = [c for c in cards if (c[1] is not None and plain(q) in plain(c[1])) or (c[2] is not None and q in c[2])]
        hits.sort(key=lambda c: (c[3] is None, -(c[3] or 0), c[1] is not None, c[1] or "", c[0]))
        out |= {(search, "card", n, c[0]) for n, c in enumerate(hits[:first], 1)}
        near = sorted((g[4], g[0]) for g in groups if any(x is not None and q.lower() in x.lower() for x in g[1:4]))
        out |= {(search, "group", n, g[1]) for n, g in enumerate(near[:first_groups], 1)}
    return out


@pytest.mark.parametrize("first,first_groups", [(8, 4), (2, 1)])
def test_answers(spark, made, first, first_groups):
    searches, cards, groups = (spark.createDataFrame(rows, schema) for rows, schema in zip(made, (SEARCH, CARD, GROUP)))
    found = typeahead.answered(searches, cards, groups, first, first_groups)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == scanned(made, first, first_groups) and len(rows) > 40
    assert "Cartesian" not in found._jdf.queryExecution().toString()


def test_empty(spark, made):
    none = spark.createDataFrame([], SEARCH), spark.createDataFrame([], CARD), spark.createDataFrame([], GROUP)
    some = spark.createDataFrame(made[0], SEARCH)
    assert typeahead.answered(some, *none[1:]).count() == 0
    assert typeahead.answered(none[0], spark.createDataFrame(made[1], CARD), none[2]).count() == 0
