"""Text functions as Column expressions; the few that Spark cannot express are Arrow UDFs."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column, length: int = 90) -> Column:
    return F.rtrim(F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length), F.lit("-"))


def tokens(c: Column) -> Column:
    """Distinct lower-cased runs of letters and digits, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")))


def singular(c: Column) -> Column:
    return F.when(c.rlike("(?:ches|shes|xes|sses)$"), F.regexp_replace(c, "es$", "")).when(c.rlike("ies$") & (F.length(c) > 4), F.regexp_replace(c, "ies$", "y")).when(c.rlike("[^s]s$") & (F.length(c) > 3), F.regexp_replace(c, "s$", "")).otherwise(c)


def visible_text(c: Column) -> Column:
    """HTML without scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "\\s+", " "))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 24))


def csv_safe(c: Column) -> Column:
    """A value that a spreadsheet would run as a formula gets an apostrophe."""
    return F.when(c.rlike("^[=+@\\t\\r-]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_quoted(c: Column) -> Column:
    """A CSV cell: in quotes, its own doubled, where it has a comma, a quote or a line end; null is an empty cell."""
    return F.coalesce(F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit(""))


def money_cents(c: Column, low: int = 1, high: int = 100_000_000) -> Column:
    """Cents of a text such as `$1,234.50` or `1.234,50 EUR`; null for what is no amount or out of bounds."""
    raw = F.regexp_extract(c, "[0-9][0-9.,]*", 0)
    point = F.when(raw.rlike(",[0-9]{2}$"), F.regexp_replace(F.regexp_replace(raw, "\\.", ""), ",", ".")).otherwise(F.regexp_replace(raw, ",", ""))
    found = F.floor(point.try_cast("double") * 100 + 0.5).cast("long")
    return F.when((found >= low) & (found <= high), found)


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once a row, however often it stands in what `use` returns."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def gtin_ok(c: Column) -> Column:
    """The check digit of an 8, 12, 13 or 14 digit number."""
    total = lambda p: sum((F.substring(p, i + 1, 1).cast("int") * (1 if i % 2 else 3) for i in range(14)), F.lit(0))
    right = lambda w: F.when(w.rlike("^(?:[0-9]{8}|[0-9]{12,14})$"), _once(F.lpad(w, 14, "0"), lambda p: total(p) % 10 == 0)).otherwise(F.lit(False))
    return _once(c, right)


def gtin(c: Column) -> Column:
    """The digits of a barcode whose check digit is right, null for others and for zeros alone; 11 digits get the zero back that a table lost."""
    whole = _once(F.regexp_replace(c, "[^0-9]", ""), lambda d: F.when(F.length(d) == 11, F.concat(F.lit("0"), d)).otherwise(d))
    return _once(whole, lambda w: F.when(~w.rlike("^0*$") & gtin_ok(w), w))


def gtin_label(c: Column) -> Column:
    """How a box prints it."""
    return F.when(F.length(c) == 12, "UPC").when(F.length(c) == 13, "EAN").when(c.isNotNull(), "GTIN")


def _fold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: None if t is None else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)).lower())


def _entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: None if t is None else html.unescape(t))


def fold(c: Column) -> Column:
    """Compatibility decomposition, marks stripped, lower case."""
    return F.pandas_udf(_fold, "string")(c)


def decode_entities(c: Column) -> Column:
    return F.pandas_udf(_entities, "string")(c)


def rule_cascade(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first rule whose pattern is found; null if none is. Order decides."""
    out = None
    for pattern, name in rules:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out


def rewritten_query(c: Column, phrases: dict[str, str], stop: tuple[str, ...]) -> Column:
    """The words of a search as it is run: runs of letters and digits in lower case, phrases replaced (longest first), stop words dropped.

    A search of stop words only keeps them. Phrases are whole words; what replaces one is not looked at again by a shorter one that it
    does not hold.
    """
    out = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""), " "), F.lit(" "))
    for phrase, new in sorted(phrases.items(), key=lambda x: (-len(x[0].split()), -len(x[0]), x[0])):
        out = F.replace(out, F.lit(f" {phrase} "), F.lit(f" {new} "))
    words = F.filter(F.split(out, " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*stop))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def title_cased(c: Column, small: tuple[str, ...], spelled: dict[str, str], filler: str | None = None) -> Column:
    """A name as it is shown: filler stripped, white space collapsed, words capitalized, also behind a hyphen.

    Small words stay small but for the first and the last; words of `spelled`, in lower case there, are written as it says. Only a-z is
    raised, so letters whose capital is two letters stay what they are.
    """
    bare = F.regexp_replace(c, filler, " ") if filler else c
    words = F.filter(F.split(F.trim(F.regexp_replace(bare, "\\s+", " ")), " "), lambda w: w != "")
    up = lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))).otherwise(p)

    def shown(w: Column, i: Column, n: Column) -> Column:
        low = F.lower(w)
        plain = F.array_join(F.transform(F.split(low, "-"), up), "-")
        inner = (i > 0) & (i < n - 1) & low.isin(*small)
        out = F.when(inner, low).otherwise(plain)
        for word, form in spelled.items():
            out = F.when(low == word, F.lit(form)).otherwise(out)
        return out

    # the words are bound once, or they would be split anew for each of them
    every = F.transform(F.array(words), lambda ws: F.transform(ws, lambda w, i: shown(w, i, F.size(ws))))
    return F.array_join(every[0], " ")
