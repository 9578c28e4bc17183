"""Many searches answered at once: the first items whose name or number holds what was typed, and the first groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.ranking import first_per
from tradewind.operators.resolve import GRAM, containing

#: What is typed must have this many characters.
LEAST = 2


def bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def holding(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needles (needle) and texts (name), both distinct -> (needle, name) where the text holds the needle, of one character or more."""
    every = lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - (n - 1)), lambda i: F.substring("name", i, F.lit(n)))
    none = F.array().cast("array<string>")
    # pieces too short for the index of grams are posted themselves
    pieces = F.array_distinct(F.flatten(F.array(*[F.when(F.length("name") >= n, every(n)).otherwise(none) for n in range(1, GRAM)])))
    short = texts.select("name", F.explode(pieces).alias("needle")).join(needles.where(F.length("needle") < GRAM), "needle").select("needle", "name")
    return containing(needles, texts).unionByName(short)


def _first_holding(asked: DataFrame, needle: str, rows: DataFrame, text: str, order: list[Column], first: int) -> DataFrame:
    """(q, rest of rows): for each search the first rows whose text holds its needle.

    No row can be among the first of a needle that is not among the first of its own text, so each text keeps that many rows
    before texts meet needles.
    """
    best = first_per(rows.where(F.col(text).isNotNull()), [text], order, first)
    pairs = holding(asked.select(F.col(needle).alias("needle")).where("needle <> ''").distinct(), best.select(F.col(text).alias("name")).distinct())
    # a row may hold a needle in several texts
    once = pairs.select("needle", F.col("name").alias(text)).join(best, text).drop(text).dropDuplicates(["needle", "id"])
    kept = first_per(once, ["needle"], order, first)
    return asked.select("q", F.col(needle).alias("needle")).join(kept, "needle").drop("needle")


def answered(searches: DataFrame, cards: DataFrame, groups: DataFrame, first: int = 8, first_groups: int = 4) -> DataFrame:
    """(search, kind, turn, id): the first cards and groups of each search, in turn from 1.

    searches (search, text): blanks around a text do not count, and one that is null or under LEAST characters long has no answer. cards (id, name,
    number, price): the name holds the text, both by letters and digits alone, or the number holds it as typed; dearest first, without a
    price last, then by name and id. A text without letters or digits stands in every name. groups (id, name, label, code, place): one of the
    three holds the text in either case; in order of place and id. Ids are of one type and unique.
    """
    asked = searches.select("search", F.trim("text").alias("q")).where(F.length("q") >= LEAST)
    texts = asked.select("q").distinct().withColumn("plain", bare(F.col("q"))).withColumn("small", F.lower("q"))

    order = [F.desc_nulls_last("price"), F.asc("shown"), F.asc("id")]
    rows = cards.select("id", F.col("name").alias("shown"), "price")
    named = cards.select("id", F.col("name").alias("shown"), "price", bare(F.col("name")).alias("text"))
    numbered = cards.select("id", F.col("name").alias("shown"), "price", F.col("number").alias("text"))
    # a few rows by a limit
    dearest = F.broadcast(rows.where("shown is not null").orderBy(*order).limit(first))
    hits = _first_holding(texts, "plain", named, "text", order, first).unionByName(_first_holding(texts, "q", numbered, "text", order, first))
    hits = hits.unionByName(texts.where("plain = ''").select("q").join(dearest)).dropDuplicates(["q", "id"])
    found = first_per(hits, ["q"], order, first, "turn").select("q", F.lit("card").alias("kind"), "turn", "id")

    by_place = [F.asc("place"), F.asc("id")]
    fields = groups.select("id", "place", F.explode(F.array_distinct(F.array(*[F.lower(c) for c in ("name", "label", "code")]))).alias("text"))
    listed = _first_holding(texts, "small", fields, "text", by_place, first_groups).dropDuplicates(["q", "id"])
    found = found.unionByName(first_per(listed, ["q"], by_place, first_groups, "turn").select("q", F.lit("group").alias("kind"), "turn", "id"))
    return asked.join(found, "q").select("search", "kind", "turn", "id")
