"""Price cleaning: robust filters per product and market, each with medians of its own input, and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_SHARE, LOW_LEAST = 0.25, 3
HIGH_TIMES = 3


def with_median(rows: DataFrame, by: list[str], price: str = "price", where: Column | None = None) -> DataFrame:
    """rows plus `mid` and `n`, the median and number of prices of its group (of those in `where`)."""
    counted = F.col(price) if where is None else F.when(where, F.col(price))
    mids = rows.groupBy(*by).agg(F.percentile(counted, 0.5).alias("mid"), F.count(counted).alias("n"))
    return rows.join(mids, by, "left")


def drop_low_outliers(rows: DataFrame, by: list[str], share: float = LOW_SHARE) -> DataFrame:
    """Drops in-stock prices under a share of the group's in-stock median, where it has LOW_LEAST or more."""
    judged = with_median(rows, by, where=F.col("in_stock"))
    bad = F.col("in_stock") & (F.col("n") >= LOW_LEAST) & (F.col("price") < F.col("mid") * share)
    return judged.where(~F.coalesce(bad, F.lit(False))).select(rows.columns)


def drop_high_outliers(rows: DataFrame, by: list[str], times: Column, of: Column | None = None, which: Column | None = None) -> DataFrame:
    """Drops prices of more than `times` the in-stock median, where the group has LOW_LEAST or more.

    The median is of the rows for which `of` holds (independent stores, say), and only rows for which `which` holds are judged; a null
    `times` judges none.
    """
    judged = with_median(rows, by, where=F.col("in_stock") if of is None else F.col("in_stock") & of)
    bad = (F.col("n") >= LOW_LEAST) & (F.col("price") > F.col("mid") * times) & (F.lit(True) if which is None else which)
    return judged.where(~F.coalesce(bad, F.lit(False))).select(rows.columns)


def suspect_stores(rows: DataFrame, by: list[str], least: int = 5, share: int = 20) -> DataFrame:
    """Stores with `least` or more prices, and `share` percent of those judged, under half of the median."""
    judged = with_median(rows, by, where=F.col("in_stock")).where(F.col("in_stock") & (F.col("n") >= LOW_LEAST))
    counts = judged.groupBy("store").agg(F.count("*").alias("judged"), F.count_if(F.col("price") * 2 < F.col("mid")).alias("low"))
    return counts.where((F.col("low") >= least) & (F.col("low") * 100 >= F.col("judged") * share))


def demote(rows: DataFrame, stores: DataFrame) -> DataFrame:
    """All rows of the stores become sold out."""
    marked = stores.select("store", F.lit(True).alias("__bad"))
    return rows.join(marked, "store", "left").withColumn("in_stock", F.col("in_stock") & F.col("__bad").isNull()).select(rows.columns)


def demote_placeholders(rows: DataFrame, by: list[str]) -> DataFrame:
    """A price of nines only, away from the median by half or more, is sold out."""
    judged = with_median(rows, by, where=F.col("in_stock"))
    nines = F.col("price").cast("string").rlike("^9+$") & ((F.col("price") * 2 < F.col("mid")) | (F.col("price") * 2 > F.col("mid") * 3))
    return judged.withColumn("in_stock", F.col("in_stock") & ~F.coalesce(nines, F.lit(False))).select(rows.columns)


def coverage_guard(new: DataFrame, old: DataFrame, by: str, least_percent: int = 50) -> DataFrame:
    """Partitions of `new`, but the old one where the new has fewer than least_percent of its rows, or none."""
    sizes = old.groupBy(by).agg(F.count("*").alias("was")).join(new.groupBy(by).agg(F.count("*").alias("now")), by, "left")
    bad = sizes.where(F.coalesce("now", F.lit(0)) * 100 < F.col("was") * least_percent).select(by)
    return new.join(bad, by, "left_anti").select(new.columns).unionByName(old.join(bad, by, "left_semi").select(new.columns))


def guarded_read(new: DataFrame, old: DataFrame, waits: DataFrame | None, by: str, never: Column, least_percent: int = 50, least_rows: int = 1) -> tuple[DataFrame, DataFrame]:
    """What is stored after a run, and (by, waits): the partitions whose read was short and is not believed yet.

    A partition that had least_rows or more is short with less than least_percent of them. It keeps its old rows and waits; if the run
    before found it short as well, the new read is taken, unless `never` holds (a column of `by`). waits is what the run before
    returned, None for none. Partitions without old rows are taken as they are.
    """
    sizes = old.groupBy(by).agg(F.count("*").alias("had")).join(new.groupBy(by).agg(F.count("*").alias("n")), by, "full")
    if waits is not None:
        sizes = sizes.join(waits.select(by, F.col("waits").alias("waited")), by, "left")
    had, n = F.coalesce("had", F.lit(0)), F.coalesce("n", F.lit(0))
    again = F.coalesce("waited", F.lit(False)) & ~never if waits is not None else F.lit(False)
    state = sizes.select(by, ((had >= least_rows) & (n * 100 < had * least_percent) & ~again).alias("waits"))
    kept = state.where("waits").select(by)
    return new.join(kept, by, "left_anti").select(new.columns).unionByName(old.join(kept, by, "left_semi").select(new.columns)), state


def cleaned(rows: DataFrame, by: list[str]) -> DataFrame:
    """The passes in order: suspect stores, placeholders, low outliers, high outliers. Each sees what the last one left."""
    rows = demote(rows, suspect_stores(rows, by))
    rows = demote_placeholders(rows, by)
    rows = drop_low_outliers(rows, by)
    return drop_high_outliers(rows, by, F.lit(HIGH_TIMES))


def moved_keys(votes: DataFrame) -> DataFrame:
    """(entity, old, new) listings' votes -> entities whose listings mostly carry one new key; a half is not a majority.

    Of entities that want one key, the one with most votes (then the smallest id) gets it.
    """
    counts = votes.groupBy("entity", "old", "new").agg(F.count("*").alias("n"))
    totals = votes.groupBy("entity").agg(F.count("*").alias("all"))
    wins = counts.join(totals, "entity").where("n * 2 > all and new <> old")
    best = F.min(F.struct((-F.col("n")).alias("n"), "entity", "old")).alias("b")
    return wins.groupBy("new").agg(best).select(F.col("b.entity").alias("entity"), F.col("b.old").alias("old"), "new")
