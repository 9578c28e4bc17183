"""Change-point histories and questions over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_lows(rows: DataFrame, key: list[str], which: Column | None = None, day: str = "day", parts: int | None = None) -> DataFrame:
    """(key, day, price, stores): the lowest price of a day and its number of stores, of the rows for which `which` holds; null and 0 without any.

    rows has (key, day, store, price). One shuffle brings a series together and one sort orders it, which also serves windows over
    series behind it. Days of a series are nearly as many as its rows, so a hash of them would be as large and save none. What a task
    sorts is its part of the rows, so `parts` goes by their number; without it Spark chooses.
    """
    taken = F.lit(True) if which is None else F.coalesce(which, F.lit(False))
    rows = rows.select(*key, day, "store", "price", taken.alias("__taken")).repartition(*filter(None, [parts]), *key)
    one = Window.partitionBy(*key, day).orderBy("store", F.desc("__taken"))
    every = Window.partitionBy(*key, day)
    rows = rows.withColumn("__first", F.row_number().over(one) == 1).withColumn("__new", F.col("__taken") & F.col("store").isNotNull() & ~F.col("store").eqNullSafe(F.lag("store").over(one)))
    rows = rows.withColumn("__low", F.min(F.when(F.col("__taken"), F.col("price"))).over(every)).withColumn("stores", F.count_if("__new").over(every))
    return rows.where("__first").select(*key, day, F.col("__low").alias("price"), "stores")


def _unchanged(key: list[str], day: str, values: tuple[str, ...]) -> Column:
    """Whether a row has the values of the row before it of its series; the first one never."""
    w = Window.partitionBy(*key).orderBy(day)
    same = F.row_number().over(w) > 1
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    return same


def change_points(daily: DataFrame, key: list[str], day: str = "day", values: tuple[str, ...] = ("price", "stores")) -> DataFrame:
    """The days on which any of `values` differs from the day before it in the table (null-safe), the first day included."""
    return daily.withColumn("__same", _unchanged(key, day, values)).where("not __same").drop("__same")


def closed_change_points(daily: DataFrame, rows: DataFrame, key: list[str], day: str = "day") -> DataFrame:
    """closed() of change_points() in one pass over daily (key, day, price, stores): the last row of a series gives its closing point.

    The last day of all is that of rows, of which only the day counts: daily itself or what it was made from.
    """
    # one row
    end = rows.agg(F.max(day).alias("__end"))
    last = F.lead(F.lit(True)).over(Window.partitionBy(*key).orderBy(day)).isNull()
    marked = daily.withColumn("__same", _unchanged(key, day, ("price", "stores"))).withColumn("__last", last).where("__last or not __same").join(F.broadcast(end))
    none = F.struct(F.date_add(day, 1).alias(day), F.lit(None).cast("long").alias("price"), F.lit(0).cast("long").alias("stores"))
    both = F.array(F.when(~F.col("__same"), F.struct(day, "price", "stores")), F.when(F.col("__last") & (F.col(day) < F.col("__end")), none))
    return marked.select(*key, F.inline(F.array_compact(both)))


def closed(points: DataFrame, daily: DataFrame, key: list[str], day: str = "day") -> DataFrame:
    """points plus a closing point (null price, 0 stores) the day after a series ends before the last day of all."""
    last = daily.groupBy(*key).agg(F.max(day).alias("__last"))
    # one row
    end = daily.agg(F.max(day).alias("__end"))
    gone = last.join(F.broadcast(end)).where("__last < __end")
    gone = gone.select(*key, F.date_add("__last", 1).alias(day), F.lit(None).cast("long").alias("price"), F.lit(0).cast("long").alias("stores"))
    return points.unionByName(gone)


def densified(points: DataFrame, key: list[str], first: Column, last: Column, day: str = "day") -> DataFrame:
    """One row for each day from `first` to `last`, with the values of the latest point up to that day."""
    w = Window.partitionBy(*key).orderBy(day)
    until = F.coalesce(F.date_sub(F.lead(day).over(w), 1), last)
    spans = points.withColumn("__until", F.least(until, last)).withColumn("__from", F.greatest(F.col(day), first))
    return spans.where("__from <= __until").withColumn(day, F.explode(F.sequence("__from", "__until"))).drop("__from", "__until")


def as_of(points: DataFrame, key: list[str], when: Column, day: str = "day") -> DataFrame:
    """The latest point of each series on or before a day: a grouped maximum, combined before the shuffle."""
    rest = [c for c in points.columns if c not in key]
    best = F.max(F.struct(day, *[c for c in rest if c != day])).alias("b")
    return points.where(F.col(day) <= when).groupBy(*key).agg(best).select(*key, *[F.col(f"b.{c}").alias(c) for c in rest])


def nearest(points: DataFrame, key: list[str], target: Column, later_wins: bool, day: str = "day") -> DataFrame:
    """The point whose day is closest to target; a tie goes to the later day or the earlier one."""
    gap = F.abs(F.datediff(F.col(day), target))
    tie = F.datediff(F.lit("1970-01-01").cast("date"), F.col(day)) if later_wins else F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    rest = [c for c in points.columns if c not in key]
    best = F.min(F.struct(gap.alias("__g"), tie.alias("__t"), *rest)).alias("b")
    return points.groupBy(*key).agg(best).select(*key, *[F.col(f"b.{c}").alias(c) for c in rest])


def moves(points: DataFrame, key: list[str], now: Column, days: int) -> DataFrame:
    """Value as of now and as of `days` before, for series with a price at both: one pass, two conditional maxima."""
    then = F.date_sub(now, days)
    latest = F.max(F.struct("day", "price", "stores"))
    earlier = F.max(F.when(F.col("day") <= then, F.struct("day", "price", "stores")))
    found = points.where(F.col("day") <= now).groupBy(*key).agg(latest.alias("a"), earlier.alias("b"))
    return found.where("a.price is not null and b.price is not null").select(*key, F.col("b.price").alias("before"), F.col("a.price").alias("after"), F.col("b.stores").alias("stores_before"), F.col("a.stores").alias("stores_after"))


def filled(grid: DataFrame, key: list[str], value: str, day: str = "day") -> DataFrame:
    """Forward fill over the rows of grid; leading gaps take the first value there is."""
    w = Window.partitionBy(*key).orderBy(day)
    forward = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return grid.withColumn(value, F.coalesce(forward, back))


def filled_sums(points: DataFrame, key: list[str], by: list[str], value: str, day: str = "day") -> DataFrame:
    """(by, day, sum, n): over the series of each `by` (columns of key) the sum of filled() on every day that `points` has, and their number.

    A series counts with its first value from the start and then by its changes, so the sums are running sums of changes by day: no
    series is repeated for each day. value is a whole number; a sum is null where no series has one.
    """
    w = Window.partitionBy(*key).orderBy(day)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = points.select(*by, day, value, before.alias("__was"), F.row_number().over(w).alias("__rn"))
    changes = rows.groupBy(*by, day).agg(
        F.count_if(F.col("__rn") == 1).alias("__n"), F.sum(F.when(F.col("__was").isNull(), F.col(value))).alias("__base"), F.sum(F.col(value) - F.col("__was")).alias("__change"))
    # from here on one row for each `by` and day
    days = changes.agg(F.collect_set(day).alias("__days"))
    every = changes.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum("__base").alias("__base")).join(F.broadcast(days)).select(*by, "n", "__base", F.explode("__days").alias(day))
    so_far = F.sum(F.coalesce("__change", F.lit(0))).over(Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    return every.join(changes.select(*by, day, "__change"), [*by, day], "left").select(*by, day, (F.col("__base") + so_far).alias("sum"), "n")


def flips(events: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """Rows where a boolean state differs from the row before of the key; the first row counts as a change from false."""
    before = F.coalesce(F.lag(state).over(Window.partitionBy(*key).orderBy(*order)), F.lit(False))
    return events.withColumn("__b", before).where(F.col(state) != F.col("__b")).drop("__b")


def episodes(events: DataFrame, key: list[str], at: str, tie: str, state: str) -> DataFrame:
    """(key, opened, closed): each stretch in which the state is true; closed is null while it lasts."""
    turned = flips(events, key, [at, tie], state)
    w = Window.partitionBy(*key).orderBy(at, tie)
    return turned.withColumn("closed", F.lead(at).over(w)).where(F.col(state)).select(*key, F.col(at).alias("opened"), "closed")


def weekly_values(points: DataFrame, key: list[str], last: Column, day: str = "day", value: str = "price") -> DataFrame:
    """(key, sunday, value): what each series is worth on every Sunday up to `last`, from its change points.

    A point holds until the next one of its series, so it stands for the Sundays between them: one window and one row for each week,
    never a row for each day and never a join of series with weeks.
    """
    until = F.coalesce(F.date_sub(F.lead(day).over(Window.partitionBy(*key).orderBy(day)), 1), last)
    first = F.date_add(F.col(day), F.pmod(F.lit(1) - F.dayofweek(day), F.lit(7)))
    held = points.withColumn("__until", F.least(until, last)).withColumn("__first", first).where("__first <= __until")
    return held.select(*key, F.explode(F.expr("sequence(__first, __until, interval 7 days)")).alias("sunday"), value)


def weekly_moves(values: DataFrame, key: list[str], value: str = "price") -> DataFrame:
    """(key, sunday, before, after) of weeks at both ends of which a series has a value that is not null."""
    w = Window.partitionBy(*key).orderBy("sunday")
    lagged = values.withColumn("__day", F.lag("sunday").over(w)).withColumn("before", F.lag(value).over(w))
    whole = (F.datediff("sunday", "__day") == 7) & F.col("before").isNotNull() & F.col(value).isNotNull()
    return lagged.where(whole).select(*key, "sunday", "before", F.col(value).alias("after"))


def weekly_moved(points: DataFrame, key: list[str], by: list[str], last: Column, day: str = "day", value: str = "price") -> DataFrame:
    """(by, sunday, moved, compared): how many series of weekly_moves() of weekly_values() there are on a Sunday, and how many changed; by are columns of key.

    A series changes only on the first Sunday of a point, and is compared from there to the point's last Sunday. So points leave
    counts of what begins and ends, whose running sum is what is compared: a series is not repeated for each week.
    """
    w = Window.partitionBy(*key).orderBy(day)
    until = F.least(F.coalesce(F.date_sub(F.lead(day).over(w), 1), last), last)
    first = F.date_add(F.col(day), F.pmod(F.lit(1) - F.dayofweek(day), F.lit(7)))
    held = points.select(*key, day, value, first.alias("__first"), until.alias("__until")).where("__first <= __until")
    held = held.withColumn("__last", F.date_sub("__until", F.dayofweek("__until") - 1)).withColumn("__gap", F.datediff("__first", F.lag("__last").over(w))).withColumn("__was", F.lag(value).over(w))
    none = F.lit(0).cast("long")
    met = F.when((F.col("__gap") == 7) & F.col(value).isNotNull() & F.col("__was").isNotNull(), 1).otherwise(none)
    stays = F.when(F.col(value).isNotNull() & (F.col("__last") > F.col("__first")), 1).otherwise(none)
    change = lambda at, moved, step: F.struct(at.alias("sunday"), moved.alias("moved"), step.alias("step"))
    changes = F.array(
        change(F.col("__first"), F.when((met == 1) & (F.col(value) != F.col("__was")), 1).otherwise(none), met),
        change(F.date_add("__first", 7), none, stays - met), change(F.date_add("__last", 7), none, -stays),
    )
    counts = held.select(*by, F.inline(changes)).groupBy(*by, "sunday").agg(F.sum("moved").alias("moved"), F.sum("step").alias("step"))
    # a row for each Sunday on which a series begins or ends a price, and then those up to the next one
    weeks = Window.partitionBy(*by).orderBy("sunday")
    compared = F.sum("step").over(weeks.rowsBetween(Window.unboundedPreceding, 0))
    spans = counts.select(*by, "sunday", "moved", compared.alias("compared"), F.coalesce(F.date_sub(F.lead("sunday").over(weeks), 7), F.col("sunday")).alias("__to")).where("compared > 0")
    every = spans.withColumn("__at", F.explode(F.expr("sequence(sunday, __to, interval 7 days)")))
    return every.select(*by, F.col("__at").alias("sunday"), F.when(F.col("__at") == F.col("sunday"), F.col("moved")).otherwise(none).alias("moved"), "compared")


def held_spans(points: DataFrame, key: list[str], day: str = "day") -> DataFrame:
    """points plus `until`, the day of the next point of the series: a point holds from its day to the day before that one; null for the last."""
    return points.withColumn("until", F.lead(day).over(Window.partitionBy(*key).orderBy(day)))


def typical(points: DataFrame, key: list[str], last: Column, days: int, least: int, day: str = "day", value: str = "price") -> DataFrame:
    """(key, typical, days): the median of a series' daily values over the last `days` up to `last`, rounded half up, and the days with a value.

    Days without a value (null) are left out; series with fewer than `least` of them have no row. Each point is weighed by the days
    for which it holds, so the days themselves are never written out.
    """
    inside = held_spans(points.where(F.col(day) <= last), key, day).withColumn("__from", F.greatest(F.col(day), F.date_sub(last, days - 1)))
    held = inside.withColumn("__n", F.datediff(F.coalesce("until", F.date_add(last, 1)), F.col("__from"))).where((F.col("__n") > 0) & F.col(value).isNotNull())
    found = held.groupBy(*key).agg(F.percentile(value, 0.5, F.col("__n")).alias("__t"), F.sum("__n").alias("days")).where(F.col("days") >= least)
    return found.select(*key, F.floor(F.col("__t") + 0.5).cast("long").alias("typical"), "days")


def under_typical(points: DataFrame, key: list[str], last: Column, days: int = 30, least: int = 7, percent: int = 10) -> DataFrame:
    """(key, price, typical, percent) of series in stock on `last` at a price that many whole percent under their typical one, yet not under its half."""
    now = as_of(points, key, last).where("price is not null and stores > 0").select(*key, "price")
    under = F.floor((F.col("typical") - F.col("price")) / F.col("typical") * 100 + 0.5).cast("long")
    both = now.join(typical(points, key, last, days, least), key).select(*key, "price", "typical", under.alias("percent"))
    return both.where((F.col("percent") >= percent) & (F.col("price") * 2 >= F.col("typical")))
