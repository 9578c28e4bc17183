"""Titles of a catalogue by a book of rules: what is refused, its kind, its language, its set, and the key under which it is compared."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.identity import Gate, refusal
from tradewind.operators.phrases import phrase_hits


@dataclass(frozen=True)
class KindRule:
    """A kind (None: no kind that is compared) for titles that hold the pattern and not `lacking`. The first rule that fits decides."""

    kind: str | None
    pattern: str
    lacking: str | None = None


@dataclass(frozen=True)
class Book:
    """The rules of one catalogue. Patterns meet titles in lower case with single spaces.

    set_kinds are told apart by their set alone; all other kinds by their words as well. languages maps a language to what marks it;
    titles without a mark are of `home`, and foreign marks refuse. cases maps a kind of case to the unit counts that it may hold.
    """

    gates: tuple[Gate, ...]
    kinds: tuple[KindRule, ...]
    set_kinds: frozenset[str]
    home: str
    languages: Mapping[str, str] = field(default_factory=dict)
    foreign: str | None = None
    cases: Mapping[str, tuple[int, ...]] = field(default_factory=dict)
    descriptors: tuple[str, ...] = ()
    noise: tuple[str, ...] = ()


def cleaned_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "\\s+", " "))


def kind_of(low: Column, rules: tuple[KindRule, ...]) -> Column:
    """The kind of a cleaned title; null for none and for what a rule refuses."""
    out = None
    for r in rules:
        hit = low.rlike(r.pattern) if r.lacking is None else low.rlike(r.pattern) & ~low.rlike(r.lacking)
        out = F.when(hit, F.lit(r.kind)) if out is None else out.when(hit, F.lit(r.kind))
    return out


def stated_units(low: Column) -> Column:
    """Struct of `times`, the numbers beside an x (`6x`, `x 6`), and `named`, those before or after a word for units (`case of 6`, `4 boxes`, `6-box`)."""
    # one pattern for each way to write it; a zero stands for no match of its group
    times = F.concat(F.regexp_extract_all(low, F.lit(r"\b([0-9]{1,2}) ?x\b"), F.lit(1)), F.regexp_extract_all(low, F.lit(r"\bx ?([0-9]{1,2})\b"), F.lit(1)))
    named = F.concat(F.regexp_extract_all(low, F.lit(r"\bcase of ([0-9]{1,2})\b"), F.lit(1)), F.regexp_extract_all(low, F.lit(r"\b([0-9]{1,2})[ -](?:boxes|displays|bundles|box|display|bundle)\b"), F.lit(1)))
    numbers = lambda c: F.filter(F.transform(c, lambda x: x.cast("int")), lambda n: n > 1)
    return F.struct(numbers(times).alias("times"), numbers(named).alias("named"))


def wrong_units(low: Column, allowed: tuple[int, ...]) -> Column:
    """Whether a title states counts and none of them, nor several `x` counts together, is one of a case's."""
    said = stated_units(low)
    every = F.concat(said["times"], said["named"])
    fits = F.exists(every, lambda n: n.isin(*allowed))
    total = F.aggregate(said["times"], F.lit(0), lambda a, n: a + n)
    return (F.size(every) > 0) & ~fits & ~((F.size(said["times"]) > 1) & total.isin(*allowed))


def named_sets(titles: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """titles (key, low, language) and sets (language, set_code, set_name, printed, generic) -> (key, set_code, generic, n_sets).

    A set stands in a title by its name or by the code printed on it; only sets of the title's language count. Names inside longer
    names that stand there are no names of their own. Generic sets count where no other is left. n_sets tells how many different
    ones remain at the greatest length; set_code is then the first of them.
    """
    spelled = sets.select("language", "set_code", "generic", F.explode(F.array("set_name", "printed")).alias("phrase")).where("phrase is not null")
    spelled = spelled.select(F.concat_ws("|", "language", "set_code", "phrase").alias("phrase_id"), "language", "set_code", "generic", "phrase")
    places = phrase_hits(titles.withColumnRenamed("language", "__l"), spelled.select("phrase_id", "phrase"), "low", [key, "__l"])
    hits = places.join(spelled, "phrase_id").where(F.col("language") == F.col("__l"))
    wide = hits.select(key, "set_code", "generic", "at", (F.col("at") + F.col("n_words")).alias("end"))
    # a place is inside another one if that begins no later and ends no earlier, and is longer
    places = F.collect_set(F.struct("at", "end", "set_code", "generic"))
    whole = wide.groupBy(key).agg(places.alias("p")).select(key, F.filter("p", lambda x: ~F.exists("p", lambda y: (y["at"] <= x["at"]) & (y["end"] >= x["end"]) & (y["end"] - y["at"] > x["end"] - x["at"]))).alias("p"))
    own = F.filter("p", lambda x: ~x["generic"])
    left = whole.select(key, F.when(F.size(own) > 0, own).otherwise(F.col("p")).alias("p"))
    codes = F.array_sort(F.array_distinct(F.transform("p", lambda x: x["set_code"])))
    return left.select(key, codes[0].alias("set_code"), F.get("p", F.lit(0))["generic"].alias("generic"), F.size(codes).alias("n_sets"))


def words_left(low: Column, taken: Column, book: Book) -> Column:
    """The distinct words of a title, sorted, without those of its kind and set and without noise."""
    words = F.filter(F.split(low, "[^a-z0-9#]+"), lambda w: w != "")
    return F.array_sort(F.array_except(F.array_distinct(words), F.concat(taken, F.array(*map(F.lit, book.noise or ("",))))))


def identified(titles: DataFrame, sets: DataFrame, book: Book, title: str = "title", key: str = "id") -> DataFrame:
    """(key, language, kind, set_code, rejected, identity): rejected names the first rule that refuses a title, identity is null then.

    In order: the book's gates; `foreign`, also for marks of two languages; `no kind`; `two sets`; for kinds told apart by their set `no
    set`; `quantity`, for cases that state other counts; for the other kinds `vague`, where neither a set nor a word that describes one
    product is left. There a generic set is dropped from the key as soon as other words tell the product: sellers add and omit it.
    """
    low = cleaned_title(F.col(title))
    marks = [F.when(low.rlike(p), F.lit(name)) for name, p in book.languages.items()]
    marked = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    rows = titles.select(key, low.alias("low"), marked.alias("marks"), kind_of(low, book.kinds).alias("kind"))
    rows = rows.withColumn("language", F.coalesce(F.get("marks", F.lit(0)), F.lit(book.home)))
    found = named_sets(rows.select(key, "low", "language"), sets, key)
    names = sets.groupBy("language", "set_code").agg(F.flatten(F.collect_list(F.array(F.lower("set_name"), F.lower(F.coalesce("printed", F.lit("")))))).alias("spelled"))
    # both sides grow with the titles
    rows = rows.join(found.hint("merge"), key, "left").join(names, ["language", "set_code"], "left")
    kind_words = F.split(F.regexp_replace("low", "[^a-z]+", " "), " ")
    of_kind = F.filter(kind_words, lambda w: w.rlike("^(?:booster|boxe?s?|packs?|cases?|displays?|bundles?|tins?|collections?|of|and|the)$"))
    set_words = F.flatten(F.transform(F.coalesce("spelled", F.array().cast("array<string>")), lambda x: F.split(x, " ")))
    language_words = F.array(*[F.lit(x) for x in (*book.languages, "")])
    left = words_left(F.col("low"), F.concat(of_kind, set_words, language_words), book)
    rows = rows.withColumn("words", left).withColumn("telling", F.array_except("words", F.array(*[F.lit(x) for x in (*book.descriptors, "")])))
    by_set = F.col("kind").isin(*sorted(book.set_kinds))
    wrong = F.lit(False)
    for kind, allowed in book.cases.items():
        wrong = wrong | ((F.col("kind") == kind) & wrong_units(F.col("low"), allowed))
    foreign = F.col("low").rlike(book.foreign) if book.foreign else F.lit(False)
    rejected = F.coalesce(
        refusal(F.col("low"), book.gates), F.when(foreign | (F.size("marks") > 1), "foreign"), F.when(F.col("kind").isNull(), "no kind"), F.when(F.col("n_sets") > 1, "two sets"),
        F.when(by_set & F.col("set_code").isNull(), "no set"), F.when(wrong, "quantity"), F.when(~by_set & (F.size("telling") == 0) & (F.col("set_code").isNull() | F.col("generic")), "vague"),
    )
    set_in_key = F.when(F.col("generic") & ~by_set & (F.size("telling") > 0), F.lit(None)).otherwise(F.col("set_code"))
    named = F.concat_ws("|", "language", "kind", F.coalesce(set_in_key, F.lit("-")), F.array_join("words", "-"))
    identity = F.when(by_set, F.concat_ws("|", "language", "kind", "set_code")).otherwise(named)
    return rows.select(key, "language", "kind", F.coalesce(set_in_key, F.lit("-")).alias("set_code"), rejected.alias("rejected"), F.when(rejected.isNull(), identity).alias("identity"))


def compared(found: DataFrame, key: str = "id") -> DataFrame:
    """(identity, n, first): how many titles share a key, and the smallest of their ids."""
    w = Window.partitionBy("identity")
    taken = found.where("identity is not null").withColumn("n", F.count("*").over(w)).withColumn("first", F.min(key).over(w))
    return taken.where(F.col(key) == F.col("first")).select("identity", "n", "first")
