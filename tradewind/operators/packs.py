"""How many packs a product holds, by its type, its series, its set and, for some, its name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackRule:
    """The packs of a type: by set where `by_set` names it (None: no honest count), else by series, else `packs`.

    With `names` (pattern, packs), the first pattern that the lower-cased name holds decides and nothing else. `times` boxes of type
    `of` make a case of them.
    """

    packs: int | None = None
    by_series: Mapping[str, int] = field(default_factory=dict)
    by_set: Mapping[str, int | None] = field(default_factory=dict)
    names: tuple[tuple[str, int], ...] = ()
    of: str | None = None
    times: int = 1


def _looked_up(key: Column, table: Mapping[str, int | None], otherwise: Column) -> Column:
    out = None
    for k, n in table.items():
        out = F.when(key == k, F.lit(n)) if out is None else out.when(key == k, F.lit(n))
    return otherwise if out is None else out.otherwise(otherwise)


def packs_of(rule: PackRule, rules: Mapping[str, PackRule], series: Column, set_code: Column, name: Column) -> Column:
    if rule.of is not None:
        return packs_of(rules[rule.of], rules, series, set_code, name) * rule.times
    if rule.names:
        out = None
        for pattern, n in rule.names:
            hit = F.lower(name).rlike(pattern)
            out = F.when(hit, n) if out is None else out.when(hit, n)
        return out
    return _looked_up(set_code, rule.by_set, _looked_up(series, rule.by_series, F.lit(rule.packs).cast("int"))).cast("int")


def pack_count(kind: Column, series: Column, set_code: Column, name: Column, rules: Mapping[str, PackRule]) -> Column:
    """Packs in one unit, null where the rules do not fix it; one CASE over the types."""
    out = None
    for k, rule in rules.items():
        n = packs_of(rule, rules, series, set_code, name)
        out = F.when(kind == k, n) if out is None else out.when(kind == k, n)
    return out


def cents_per_pack(price: Column, packs: Column) -> Column:
    return F.when((price > 0) & (packs > 0), F.floor(price / packs + 0.5).cast("long"))
