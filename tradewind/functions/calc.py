"""Money arithmetic as Column expressions; amounts are whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, negative ones too."""
    return F.floor(x + 0.5).cast("long")


def tiered_fee(price: Column, tiers: list[tuple[int, int]], fixed: int) -> Column:
    """tiers are (up to cents, basis points), the last one open-ended by a large bound; marginal rates."""
    total, low = F.lit(0).cast("long"), 0
    for top, points in tiers:
        total = total + F.greatest(F.lit(0), F.least(price, F.lit(top)) - low) * points
        low = top
    return half_up(total / 10_000) + fixed


def net_proceeds(price: Column, fee: Column, postage: Column) -> Column:
    return price - fee - postage


def percent_of(value: Column, reference: Column) -> Column:
    """Whole percent above (or below) a reference; null without one."""
    return F.when(reference > 0, half_up((value - reference) * 100 / reference))


def expected_value(outcomes: list[tuple[float, Column]], cost: Column) -> Column:
    return half_up(sum((p * v for p, v in outcomes[1:]), outcomes[0][0] * outcomes[0][1])) - cost


def trade_balance(give: Column, get: Column) -> Column:
    """even within 2 percent of the larger side."""
    return F.when(F.abs(give - get) * 50 <= F.greatest(give, get), "even").when(get > give, "gain").otherwise("loss")


def js_months_back(day: Column, months: int) -> Column:
    """The same day of an earlier month, days that it lacks rolling into the next: 31 August less six months is 3 March in a common year."""
    first = F.add_months(F.trunc(day, "month"), -months)
    return F.date_add(first, F.dayofmonth(day) - 1)


def two_proportion_z(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> Column:
    pooled = (hits_a + hits_b) / (n_a + n_b)
    return (hits_a / n_a - hits_b / n_b) / F.sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b))


def after_fee(cents: Column, percent: Column) -> Column:
    """A price less a fee in percent, held between 0 and 100; the fee is rounded half up."""
    share = F.least(F.lit(100), F.greatest(F.lit(0), percent))
    return cents - half_up(cents * share / 100)


def grading_outlook(raw: Column, costs: Column, percent: Column, grades: list[tuple[Column, Column]]) -> Column:
    """Struct of raw_net, break_even, weighted_net and against_raw for grades of (chance in percent, price).

    break_even is the price at which a graded sale leaves what the raw one does, rounded up; null if the fee takes all. Chances that do
    not add up to 100 are taken in proportion, negative ones as none; without any there is no weighted net.
    """
    none = F.lit(0)
    raw_net, keep = after_fee(F.greatest(none, raw), percent), 1 - F.least(F.lit(100), F.greatest(none, percent)) / 100
    weights = [F.greatest(none, chance) for chance, _ in grades]
    total = sum(weights[1:], weights[0])
    nets = [after_fee(F.greatest(none, price), percent) - costs for _, price in grades]
    weighted = F.when(total > 0, half_up(sum((n * w / total for n, w in zip(nets[1:], weights[1:])), nets[0] * weights[0] / total)))
    even = F.when(keep > 0, F.ceil((raw_net + costs) / keep).cast("long"))
    return F.struct(raw_net.alias("raw_net"), even.alias("break_even"), weighted.alias("weighted_net"), (weighted - raw_net).alias("against_raw"))


def day_in_zone(at: Column, zone: str) -> Column:
    """The calendar day of a UTC time in a zone, as text YYYY-MM-DD."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz")), "yyyy-MM-dd")
