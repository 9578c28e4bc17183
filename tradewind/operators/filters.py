"""Filters from what users type or click: link parameters, listing options."""

from __future__ import annotations

from urllib.parse import parse_qs

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_url(params: str, price: str, type_col: str = "product_type", set_col: str = "set_code") -> Column:
    """`type=A,B` keeps types, `set=any` or `set=none` asks for a set or its lack, else a list of sets; min and max are whole units of `price`, which is in cents.

    Unknown parameters, empty lists and bounds that are no numbers are passed over; rows without a price fail any bound.
    """
    given = {k: v[-1] for k, v in parse_qs(params).items()}
    out = F.lit(True)
    for key, col in (("type", type_col), ("set", set_col)):
        names = [x for x in given.get(key, "").split(",") if x]
        if key == "set" and names in (["any"], ["none"]):
            out = out & (F.col(col).isNotNull() if names == ["any"] else F.col(col).isNull())
        elif names:
            out = out & F.col(col).isin(names)
    for key, low in (("min", True), ("max", False)):
        if given.get(key, "").isdecimal():
            bound = int(given[key]) * 100
            out = out & (F.col(price) >= bound if low else F.col(price) <= bound)
    return out


def listing_filter(status: str | None = None, search: str | None = None, low: int | None = None, high: int | None = None) -> Column:
    """Rows (in_stock, price, name, set_code) that are open or sold, whose name or set holds the search text, within bounds in cents."""
    out = F.lit(True)
    if status in ("open", "sold"):
        out = out & (F.col("in_stock") if status == "open" else ~F.col("in_stock"))
    if search:
        out = out & (F.contains(F.lower("name"), F.lit(search.lower())) | F.contains(F.lower("set_code"), F.lit(search.lower())))
    if low is not None:
        out = out & (F.col("price") >= low)
    if high is not None:
        out = out & (F.col("price") <= high)
    return out


def across_games(asked: dict[str, str], games: list[str], known: set[str], game: str = "game", kind: str = "kind", set_name: str = "set_name", name: str = "name") -> Column:
    """One search over several games: the game asked for if there is such a one, else those of the visitor.

    `kind` (single or sealed) and `set` narrow it. `q` stands in the name, case aside, or, from two characters on without spaces and
    signs, in the name without spaces and signs. Anything else that is asked is passed over; no games, no rows.
    """
    out = F.col(game) == asked["game"] if asked.get("game") in known else F.col(game).isin(games) if games else F.lit(False)
    if asked.get("kind") in ("single", "sealed"):
        out = out & (F.col(kind) == asked["kind"])
    if asked.get("set"):
        out = out & (F.col(set_name) == asked["set"])
    if text := asked.get("q", "").strip():
        bare = "".join(c for c in text.lower() if c.isascii() and c.isalnum())
        hit = F.contains(F.lower(name), F.lit(text.lower()))
        out = out & (hit | F.contains(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), F.lit(bare)) if len(bare) >= 2 else hit)
    return out


def every_term(text: str, fields: list[str], bare: str | None = None) -> Column:
    """Rows of which each word of the text stands in one of the fields, case aside, or without spaces and signs in the `bare` field. No words, all rows."""
    out = F.lit(True)
    for term in text.lower().split():
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(term)), F.lit(False))
        plain = "".join(c for c in term if c.isascii() and c.isalnum())
        if bare and plain:
            hit = hit | F.coalesce(F.contains(F.regexp_replace(F.lower(bare), "[^a-z0-9]", ""), F.lit(plain)), F.lit(False))
        out = out & hit
    return out


def headline(conditions: tuple[str, ...] = ("NM", "LP"), guide: str = "guide_") -> Column:
    """Offers (in_stock, seller, condition) that a headline price may come from: in stock, no price guide, in good or unstated condition."""
    return F.col("in_stock") & ~F.col("seller").startswith(guide) & (F.col("condition").isNull() | F.col("condition").isin(*conditions))


def market_listings(params: str, price: str = "price") -> Column:
    """Listings joined with their products (status, quantity, condition, price, name, product_type, set_code): active ones with stock that the link asks for.

    type, set and condition are lists; q stands in the name, the type or the set; min and max are in whole units, cents after a point.
    """
    given = {k: v[-1] for k, v in parse_qs(params).items()}
    out = (F.col("status") == "ACTIVE") & (F.col("quantity") > 0)
    for key, col in (("type", "product_type"), ("set", "set_code"), ("condition", "condition")):
        if names := [x for x in given.get(key, "").split(",") if x]:
            out = out & F.col(col).isin(names)
    if given.get("q"):
        out = out & (F.contains("name", F.lit(given["q"])) | F.contains("product_type", F.lit(given["q"])) | F.contains("set_code", F.lit(given["q"])))
    for key, low in (("min", True), ("max", False)):
        units, _, rest = given.get(key, "").partition(".")
        if units.isdecimal() and (not rest or rest.isdecimal()):
            bound = int(units) * 100 + int((rest + "00")[:2])
            out = out & (F.col(price) >= bound if low else F.col(price) <= bound)
    return out
