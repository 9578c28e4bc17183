"""What a listing title is: ordered gates, each of which may refuse it, then type, set and key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.phrases import longest_phrase


@dataclass(frozen=True)
class Gate:
    """Refuses a title in which the pattern is found (or, if `lacking`, is not found)."""

    reason: str
    pattern: str
    lacking: bool = False


#: Rules of this library; order decides which reason is given.
GATES = (
    Gate("empty", "[a-z0-9]", lacking=True),
    Gate("condition", r"\b(?:damaged|opened|used|empty box)\b"),
    Gate("bundle", r"\b(?:lot|bundle|job lot)\b"),
    Gate("digital", r"\b(?:digital|code card|online code)\b"),
    Gate("part", r"\b(?:wrapper|sleeve only|insert only)\b"),
)
FOREIGN = r"\b(?:japanese|korean|german|french)\b"
#: Words that say nothing about which product it is.
NOISE = ("new", "sealed", "free", "shipping", "fast", "the", "and")


def quantity(title: Column) -> Column:
    """How many units a title offers: `x 4`, `4x` or `pack of 4`; 1 if it does not say."""
    found = F.regexp_extract(title, r"(?:\bx ?|\bpack of )([0-9]{1,3})\b|\b([0-9]{1,3}) ?x\b", 0)
    return F.coalesce(F.regexp_extract(found, "([0-9]+)", 1).try_cast("int"), F.lit(1))


def refusal(title: Column, gates: tuple[Gate, ...] = GATES) -> Column:
    """Reason of the first gate that refuses a lower-cased title; null if none does."""
    out = None
    for g in gates:
        hit = ~title.rlike(g.pattern) if g.lacking else title.rlike(g.pattern)
        out = F.when(hit, g.reason) if out is None else out.when(hit, g.reason)
    return out


def detect_sets(titles: DataFrame, sets: DataFrame, title: str = "title", key: str = "id") -> DataFrame:
    """(key, set_code, n_longest): the longest set name that stands in the title as whole words; names of equal length leave a tie.

    sets has (set_code, set_name) and may have `generic`: such a name counts only where no other stands. Names and titles meet in
    an equi-join of word sequences, however many sets there are.
    """
    generic = F.col("generic") if "generic" in sets.columns else F.lit(False)
    named = sets.select(F.col("set_code").alias("phrase_id"), F.col("set_name").alias("phrase"), generic.alias("generic"))
    return longest_phrase(titles, named, title, key).withColumnRenamed("phrase_id", "set_code")


def signature(title: Column) -> Column:
    """The distinct words of a lower-cased title without noise, sorted."""
    words = F.split(F.regexp_replace(title, "[^a-z0-9#]+", " "), " ")
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(F.lit(""), *map(F.lit, NOISE))))


def identify(titles: DataFrame, sets: DataFrame, types: list[str], title: str = "title", key: str = "id") -> DataFrame:
    """(key, rejected, language, product_type, set_code, units, identity): identity is null where a gate refused.

    Gates in order: refusal(), more than one type, no type, no set, two sets of equal length, more units than one. A foreign
    language is no refusal: its identity is another product.
    """
    low = F.lower(F.col(title))
    found = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{t.lower()}\b"), t) for t in types]))
    rows = titles.select(key, low.alias("__low"), F.col(title).alias(title), found.alias("__types"))
    rows = rows.join(detect_sets(rows.select(key, title), sets, title, key), key, "left")
    units = quantity(F.col("__low"))
    rejected = F.coalesce(
        refusal(F.col("__low")), F.when(F.size("__types") > 1, "two types"), F.when(F.size("__types") == 0, "no type"),
        F.when(F.col("set_code").isNull(), "no set"), F.when(F.col("n_longest") > 1, "two sets"), F.when(units > 1, "quantity"),
    )
    language = F.when(F.col("__low").rlike(FOREIGN), F.regexp_extract("__low", FOREIGN, 0)).otherwise("english")
    rows = rows.select(key, rejected.alias("rejected"), language.alias("language"), F.get("__types", F.lit(0)).alias("product_type"), "set_code", units.alias("units"))
    return rows.withColumn("identity", F.when(F.col("rejected").isNull(), F.concat_ws("|", "language", "product_type", "set_code")))
