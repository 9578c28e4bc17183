"""New sets in a marketplace's list of groups: which are worth a read, why others are passed over, and the list of found sets after a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import text as tx
from tradewind.operators.phrases import MOST_WORDS, phrase_hits

#: A name under this many characters is no safe match for a title.
SHORT = 4


def set_slug(name: Column) -> Column:
    return tx.slug(F.regexp_replace(tx.fold(name), "['’]", ""))


def set_words(name: Column) -> Column:
    """The words by which names are compared: folded, `&` as a word, no article."""
    spelled = F.regexp_replace(F.regexp_replace(tx.fold(name), "&", " and "), "['’]", "")
    return F.filter(F.split(spelled, "[^a-z0-9]+"), lambda w: ~w.isin("", "the"))


def set_code(abbreviation: Column, slug: Column, prefixes: list[str]) -> Column:
    """A code from a printed abbreviation: zeros behind a known prefix go and a half is `pt5`; else its letters and digits, else the slug's."""
    printed = F.lower(F.trim(F.coalesce(abbreviation, F.lit(""))))
    form = rf"^({'|'.join(prefixes)})0*([0-9]+)(\.5|pt5)?$"
    known = F.concat(F.regexp_extract(printed, form, 1), F.regexp_extract(printed, form, 2), F.when(F.regexp_extract(printed, form, 3) != "", "pt5").otherwise(""))
    plain = F.regexp_replace(printed, "[^a-z0-9]", "")
    return F.when(printed.rlike(form), known).when(F.length(plain) >= 2, plain).otherwise(F.substring(F.replace(slug, F.lit("-"), F.lit("")), 1, 12))


def named_within(names: DataFrame, known: DataFrame) -> DataFrame:
    """(group_id, within): each of `names` (group_id, name) whose words stand together and in order in a known name; the first such name.

    Names meet known ones in an equi-join of word sequences. A name longer than an index of sequences takes is found by its first words and
    then compared as a whole.
    """
    rows = names.select("group_id", set_words(F.col("name")).alias("w")).where(F.size("w") > 0)
    inner = rows.select(F.col("group_id").alias("phrase_id"), F.array_join("w", " ").alias("inner"), F.array_join(F.slice("w", 1, MOST_WORDS), " ").alias("phrase"))
    outer = known.select(F.col("name").alias("within"), F.array_join(set_words(F.col("name")), " ").alias("outer")).distinct()
    hits = phrase_hits(outer, inner.select("phrase_id", "phrase"), "outer", "outer").select("outer", "phrase_id").distinct()
    whole = F.contains(F.concat(F.lit(" "), F.col("outer"), F.lit(" ")), F.concat(F.lit(" "), F.col("inner"), F.lit(" ")))
    found = hits.join(inner.select("phrase_id", "inner"), "phrase_id").where(whole).join(outer, "outer")
    return found.groupBy(F.col("phrase_id").alias("group_id")).agg(F.min("within").alias("within"))


def judged_groups(groups: DataFrame, known: DataFrame, today: Column, behind: int, ahead: int, prefixes: list[str], refused: str) -> DataFrame:
    """(group_id, name, slug, code, day, verdict, within) of every group: `take`, or why it is passed over.

    groups has (group_id, name, abbreviation, day), group ids once each; known the sets of the catalogue (code, name, slug, day). Ids only grow,
    days can be stamped anew, so the floor is the greatest id among the groups that are sets known for over a year. The first reason
    counts: no floor at all (`undated`), `old` for an id up to it, `window` for a day that is null or not within `behind` days before and
    `ahead` after today, `refused` for a name that is null or fits that pattern, `known` by slug or code, `short`, `within` a known name.
    """
    slug = set_slug(F.col("name"))
    rows = groups.withColumn("slug", slug).withColumn("code", set_code(F.col("abbreviation"), F.col("slug"), prefixes))
    old = known.where(F.col("day") < F.date_sub(today, 365)).select("slug").distinct()
    # one row
    floor = rows.join(old, "slug", "left_semi").agg(F.max("group_id").alias("floor"))
    slugs, codes = known.select("slug").distinct().withColumn("by_slug", F.lit(True)), known.select("code").distinct().withColumn("by_code", F.lit(True))
    facts = rows.join(F.broadcast(floor)).join(slugs, "slug", "left").join(codes, "code", "left")
    reason = (
        F.when(F.col("floor").isNull(), "undated").when(F.col("group_id") <= F.col("floor"), "old")
        .when(F.col("day").isNull() | ~F.col("day").between(F.date_sub(today, behind), F.date_add(today, ahead)), "window")
        .when(F.col("name").isNull() | F.col("name").rlike(refused), "refused").when(F.col("by_slug") | F.col("by_code"), "known").when(F.length("name") < SHORT, "short")
    )
    left = facts.withColumn("reason", reason)
    inside = named_within(left.where("reason is null").select("group_id", "name"), known)
    verdict = F.coalesce("reason", F.when(F.col("within").isNotNull(), "within"), F.lit("take"))
    return left.join(inside, "group_id", "left").select("group_id", "name", "slug", "code", "day", verdict.alias("verdict"), "within")


def found_sets(previous: DataFrame, taken: DataFrame, products: DataFrame, known: DataFrame, today: Column, sealed: str, boxed: str) -> DataFrame:
    """(group_id, code, name, slug, day, boxed, first_seen): the found sets after a run.

    previous is such a table, taken the groups with the verdict `take`, products (group_id, name) what each sells. A taken group with a product that fits
    the pattern `sealed` is a set: it keeps the code, slug and first day it had, and its name and day follow the list; boxed tells whether a
    product fits that pattern. Without such a product it is dropped, without any product row (the read failed) it stays as it was. A set that
    is no longer taken stays; one whose code or slug the catalogue now knows goes.
    """
    fits = lambda pattern: F.max(F.coalesce(F.col("name").rlike(pattern), F.lit(False)))
    facts = products.groupBy("group_id").agg(fits(sealed).alias("sealed"), fits(boxed).alias("has_box"))
    now = taken.select("group_id", *[F.col(c).alias(f"new_{c}") for c in ("code", "name", "slug", "day")], F.lit(True).alias("taken")).join(facts, "group_id", "left")
    both = previous.join(now, "group_id", "full")
    fresh = F.coalesce("sealed", F.lit(False))
    stays = F.col("first_seen").isNotNull() & (F.col("taken").isNull() | F.col("sealed").isNull())
    pick = lambda c: F.when(fresh, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    kept = both.where(fresh | stays).select(
        "group_id", F.coalesce("code", "new_code").alias("code"), pick("name"), F.coalesce("slug", "new_slug").alias("slug"), pick("day"),
        F.when(fresh, F.col("has_box")).otherwise(F.col("boxed")).alias("boxed"), F.coalesce("first_seen", today).alias("first_seen"),
    )
    return kept.join(known.select("code"), "code", "left_anti").join(known.select("slug"), "slug", "left_anti").select("group_id", "code", "name", "slug", "day", "boxed", "first_seen")
