"""What owners hold: its worth on the days they look, against the look before and the price when added; notices to those who wait for stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.history import held_spans


SUMS = ("units", "worth", "unpriced", "paid", "worth_paid")


def worth_at(lots: DataFrame, points: DataFrame, looks: DataFrame | None, owner: str, place: str, item: str, parts: int | None = None) -> DataFrame:
    """(owner, place, day, units, worth, unpriced, paid, worth_paid) on each look.

    lots (owner, place, item, day, qty, cents) are what was added and at which price, null or 0 where that is not known; points (place, item,
    day, price) the change points of prices; looks (owner, place, day), or None for the days of the lots. A price holds until the next one,
    the first one also before its day; points without a price or a day are passed over. worth is of lots with a price, unpriced counts the
    items that never have one; paid and worth_paid compare like with like, over the lots with a price both then and now. Looks before
    the first lot have zeros, repeated looks and lots of a day are one; a null item or quantity is unpriced or nothing, lots without an
    owner or a day are left out.

    A lot is shuffled twice: to its item, where it takes the price of its day and the later steps along in one row, and to its owner,
    where each step is a change of worth by day and worth is their running sum. So no lot is repeated for each day or look, and no
    step is shuffled as a row. `parts` is the number of partitions of both, and of points if they are to be met where they lie;
    without it Spark chooses.
    """
    key = [place, item]
    dealt = lambda df, *by: df.repartition(*filter(None, [parts]), *by)
    # a series is its days, and days and prices in turn as numbers of 8 and 4 bytes; the latter only if none is longer
    priced = points.where("price is not null and day is not null").select(*key, "day", F.col("price").cast("long").alias("price"))
    series = priced.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("day", "price"))).alias("__all"), (_short(F.min("price")) & _short(F.max("price"))).alias("__short"))
    turns = F.flatten(F.transform("__all", lambda p: F.array(F.unix_date(p["day"]).cast("long"), p["price"])))
    series = series.select(*key, F.transform("__all", lambda p: p["day"]).alias("__days"), turns.alias("__long"), "__short").withColumn("__int", F.when(F.col("__short"), F.col("__long").cast("array<int>")))
    new = F.row_number().over(Window.partitionBy(*key, owner).orderBy("day")) == 1
    held = dealt(lots.where(F.col(owner).isNotNull() & F.col("day").isNotNull()).select(owner, *key, "day", F.col("qty").cast("long").alias("qty"), F.col("cents").cast("long").alias("cents")), *key)
    both = held.withColumn("__new", new).join(series, key, "left")
    # the point that holds on the day, from 1: the latest one, or the first where all are later
    both = both.withColumn("__at", F.greatest(F.lit(1), F.size(F.filter("__days", lambda d: d <= F.col("day")))))
    both = both.withColumn("price", F.get("__long", 2 * F.col("__at") - 1))
    about = [F.unix_date("day"), F.col("qty"), F.col("cents"), F.col("price").isNull() & F.col("__new"), F.col("price")]
    steps = lambda c: F.coalesce(F.slice(c, 2 * F.col("__at") + 1, F.greatest(F.lit(0), F.size(c) - 2 * F.col("__at"))), F.array())
    numbers = lambda kind: F.concat(F.array(*[c.cast(kind) for c in about]), steps(f"__{kind}"))
    short = F.coalesce("__short", F.lit(True)) & _short(F.col("qty")) & _short(F.col("cents"))
    sent = both.select(owner, place, F.when(short, numbers("int")).alias("__int"), F.when(~short, numbers("long")).alias("__long"))
    n = lambda i: F.coalesce(F.get("__int", i).cast("long"), F.get("__long", i))
    day, look = lambda i: F.date_from_unix_date(n(i).cast("int")), F.lit(True)
    on = day(F.lit(0))
    if looks is not None:
        sent = sent.unionByName(looks.select(owner, place, F.col("day").alias("__look")), allowMissingColumns=True)
        on, look = F.coalesce(on, "__look"), F.col("__int").isNull() & F.col("__long").isNull()
    rows = dealt(sent, owner, place).select(
        owner, place, "__int", "__long", on.alias("day"), look.alias("look"), *[n(F.lit(i)).alias(c) for i, c in enumerate(("qty", "cents", "new", "price"), 1)])
    known, none = F.when(F.col("cents") > 0, F.col("qty")), F.lit(0).cast("long")
    change = lambda day, look, *sums: F.struct(day.alias("day"), look.alias("look"), *[F.coalesce(x, none).alias(c) for c, x in zip(SUMS, sums)])
    first = change(F.col("day"), F.col("look"), F.col("qty"), F.col("qty") * F.col("price"), F.col("new"), F.when(F.col("price").isNotNull(), known * F.col("cents")), known * F.col("price"))
    # behind the price of its day, a lot has the day of each step and the price from then on
    size = F.greatest(F.size("__int"), F.size("__long"))
    step = lambda i: change(day(i), F.lit(False), none, F.col("qty") * (n(i + 1) - n(i - 1)), none, none, known * (n(i + 1) - n(i - 1)))
    later = F.when(size > 5, F.transform(F.sequence(F.lit(5), size - 2, F.lit(2)), step))
    by_day = rows.select(owner, place, F.inline(F.concat(F.array(first), F.coalesce(later, F.array())))).groupBy(owner, place, "day").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("look").alias("look"))
    so_far = Window.partitionBy(owner, place).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return by_day.select(owner, place, "day", "look", *[F.sum(c).over(so_far).alias(c) for c in SUMS]).where("look").drop("look")


def _short(c: Column) -> Column:
    """Whether a number has 4 bytes at most; a null has."""
    return F.coalesce(c.between(-(2**31), 2**31 - 1), F.lit(True))


def since_last(worths: DataFrame, owner: str, place: str) -> DataFrame:
    """worths plus last_day and last_worth of the look before, its change in whole percent, and the change since added in whole percent.

    A percentage is null where there is nothing to compare with: no look before, or a total of zero.
    """
    w = Window.partitionBy(owner, place).orderBy("day")
    before = worths.withColumn("last_day", F.lag("day").over(w)).withColumn("last_worth", F.lag("worth").over(w))
    return before.withColumn("percent", percent(F.col("last_worth"), F.col("worth"))).withColumn("percent_added", percent(F.col("paid"), F.col("worth_paid")))


def percent(was: Column, now: Column) -> Column:
    return F.when(was > 0, F.floor((now - was) / was * 100 + 0.5)).cast("long")


def notices(points: DataFrame, watchers: DataFrame, watcher: str, key: list[str]) -> DataFrame:
    """(watcher, key, day, price, rearmed): each time somebody is told that an item is in stock.

    points (key, day, price, stores) are the change points of items, watchers (watcher, key, since) who waits for which from when on. A
    watcher is told once for each stretch of days in stock, on its first day or on the day they began to wait, with the price of
    that day; the day it sells out arms the watch again (null while it lasts). A watcher listed twice counts from the earlier day.
    """
    w = Window.partitionBy(*key).orderBy("day")
    stocked = held_spans(points, key).withColumn("open", F.coalesce(F.col("stores") > 0, F.lit(False)))
    # stretches are numbered by the times that stock ran out before
    run = F.sum(F.when(F.col("open"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = stocked.withColumn("run", run).where("open").select(*key, "run", "day", "until", "price")
    ask = watchers.groupBy(watcher, *key).agg(F.min("since").alias("since"))
    # nothing of a span is before a day that is not known
    both = ask.join(spans, key).where("until is null or until > since").withColumn("at", F.greatest("day", "since"))
    told = both.groupBy(watcher, *key, "run").agg(
        F.min("at").alias("at"), F.min_by("price", "at").alias("price"), F.max(F.coalesce("until", F.lit("9999-12-31").cast("date"))).alias("end"))
    rearmed = F.when(F.col("end") < F.lit("9999-12-31").cast("date"), F.col("end"))
    return told.select(watcher, *key, F.col("at").alias("day"), "price", rearmed.alias("rearmed"))
