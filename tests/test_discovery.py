"""Finding new sets: verdicts, names within names, codes and what a run leaves, by cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from tradewind.operators import discovery

D = datetime.date
TODAY = D(2025, 6, 1)
GROUP, KNOWN = "group_id long, name string, abbreviation string, day date", "code string, name string, slug string, day date"
FOUND = "group_id long, code string, name string, slug string, day date, boxed boolean, first_seen date"
KNOWN_ROWS = [("aa1", "First Light", "first-light", D(2020, 1, 1)), ("aa2", "The Sun & Moon Guardians Rising", "guardians", D(2025, 5, 1)), ("zz", "Café d'Or", "cafe-dor", D(2019, 1, 1))]


def today():
    return F.lit("2025-06-01").cast("date")


def judged(spark, groups, known=KNOWN_ROWS):
    rows = discovery.judged_groups(spark.createDataFrame(groups, GROUP), spark.createDataFrame(known, KNOWN), today(), 90, 120, ["aa"], "(?i)promo|deck")
    return {r["group_id"]: r for r in rows.collect()}


def test_verdicts(spark):
    long = " ".join(f"w{i}" for i in range(20))
    groups = [
        (5, "FIRST LIGHT", None, D(2025, 6, 1)),  # known for over a year: the floor
        (3, "Dawn of Tin", "aa03", D(2025, 6, 1)),  # under it
        (4, "Café d’Or", None, D(2025, 6, 1)),
        (6, "Dawn of Iron", "AA007.5", D(2025, 3, 3)), (7, "Dawn of Gold", " aa0PT5 ", D(2025, 3, 2)), (8, "Dawn of Zinc", "x", D(2025, 9, 29)), (9, "Late", "aa9", D(2025, 9, 30)),
        (10, "Winter Promo", None, TODAY), (11, "Guardians", "guardians", TODAY), (12, "Other", "AA2", TODAY), (13, "Tin", "t-1", TODAY), (14, "Moon Guardians", "mg", TODAY),
        (15, "sun and moon", "sm", TODAY), (16, "Moon Rising", "mr", TODAY), (17, "un & moo", None, TODAY), (18, None, "aa5", TODAY), (19, "No Day", "nd", None), (20, long, "lg", TODAY), (21, "!!!!", "", TODAY),
    ]
    got = judged(spark, groups, [*KNOWN_ROWS, ("kk", f"x {long} y", "kk", D(2025, 5, 1))])
    want = {3: "old", 4: "old", 5: "old", 6: "window", 7: "window", 8: "take", 9: "window", 10: "refused", 11: "known", 12: "known", 13: "short", 14: "within", 15: "within", 16: "take", 17: "take",
            18: "refused", 19: "window", 20: "within", 21: "take"}
    want[6] = "take"  # ninety days before is still inside
    assert {k: r["verdict"] for k, r in got.items()} == want
    assert got[14]["within"] == "The Sun & Moon Guardians Rising" and got[4]["slug"] == "cafe-dor"
    assert [got[k]["code"] for k in (3, 6, 7, 8, 13, 21)] == ["aa3", "aa7pt5", "aa0pt5", "dawnofzinc", "t1", ""]


def test_no_floor_and_empty(spark):
    assert {r["verdict"] for r in judged(spark, [(9, "New", "nn", TODAY)], KNOWN_ROWS[1:2]).values()} == {"undated"}
    assert judged(spark, []) == {}
    assert judged(spark, [(9, "Brand New", "nn", TODAY)], [])[9]["verdict"] == "undated"


def test_names_meet_without_nested_loops(spark):
    names = spark.createDataFrame([(1, "moon guardians")], "group_id long, name string")
    plan = discovery.named_within(names, spark.createDataFrame(KNOWN_ROWS, KNOWN))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("empty", [False, True])
def test_what_a_run_leaves(spark, empty):
    seen, now = D(2025, 1, 1), TODAY
    previous = [] if empty else [
        (1, "one", "One", "one", D(2025, 5, 1), True, seen),  # renamed and read
        (2, "two", "Two", "two", D(2025, 5, 2), False, seen),  # read failed
        (3, "three", "Three", "three", D(2025, 5, 3), False, seen),  # sells nothing sealed any more
        (4, "four", "Four", "four", D(2024, 5, 4), True, seen),  # out of the list
        (5, "aa1", "Five", "five", D(2025, 5, 5), True, seen),  # known by now, by code
        (6, "six", "Six", "guardians", D(2025, 5, 6), True, seen),  # and by slug
    ]
    taken = [(1, "new", "New One", "new-one", D(2025, 6, 6)), (2, "zwei", "Zwei", "zwei", D(2025, 6, 7)), (3, "drei", "Drei", "drei", D(2025, 6, 8)), (7, "seven", "Seven", "seven", D(2025, 6, 9)), (8, "eight", "Eight", "eight", None)]
    goods = [(1, "Bundle"), (1, "single"), (3, "single"), (3, None), (7, "BOX of packs"), (7, "box"), (99, "box")]
    got = discovery.found_sets(
        spark.createDataFrame(previous, FOUND), spark.createDataFrame(taken, "group_id long, code string, name string, slug string, day date"), spark.createDataFrame(goods, "group_id long, name string"),
        spark.createDataFrame(KNOWN_ROWS, KNOWN), today(), "(?i)box|bundle", "(?i)box",
    )
    one = (1, "new", "New One", "new-one", D(2025, 6, 6), False, now) if empty else (1, "one", "New One", "one", D(2025, 6, 6), False, seen)
    seven = (7, "seven", "Seven", "seven", D(2025, 6, 9), True, now)
    assert sorted(map(tuple, got.collect())) == sorted([one, seven] + [previous[i] for i in ((1, 3) if not empty else ())])
