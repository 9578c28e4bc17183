"""Ranking by demand: value of a product, slots for what has no signal yet, shares of a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def demand_value(views: Column, clicks: Column, stores: Column) -> Column:
    """Views count by a logarithm to 2, clicks to 10 and stores by a natural one, so that no single count outweighs the rest."""
    return 3 * F.log2(views + 1) + 2 * F.log10(clicks + 1) + F.log1p(stores.cast("double"))


def earning_value(stores: Column, marketplace: Column, preorder: Column, paid_rows: Column, cents: Column, days_out: Column, drop: Column, restocked: Column) -> Column:
    """What a click on an item can earn, 1 for an ordinary one in stock: a product of factors, each 1 where its input is null.

    More stores in stock count by a logarithm to 2; nothing in stock, no marketplace and no pre-order counts little; up to three paid rows;
    the price by a soft logarithm to 10; days_out is the age of the release, negative before it: an open pre-order within sixty days
    and the first ninety days count more, what is over two years old less; a fall in price as a share, up to a half; a return to stock.
    """
    # fixed values: the weights of the factors
    yes = lambda c: F.coalesce(c, F.lit(False))
    stock, dollars, paid = F.coalesce(stores, F.lit(0)), F.coalesce(cents, F.lit(0)) / 100, F.coalesce(paid_rows, F.lit(0))
    in_stock = F.when(stock > 0, 1 + F.log2(1 + stock) / 4).when(~yes(marketplace) & ~yes(preorder), 0.35).otherwise(1.0)
    price = F.when(dollars > 0, 0.5 + 0.25 * F.log10(1 + dollars)).otherwise(1.0)
    open_order = F.coalesce(preorder, F.lit(True)) & (days_out >= -60)
    age = F.when(days_out.isNull(), F.when(yes(preorder), 1.3).otherwise(1.0)).when(days_out < 0, F.when(open_order, 1.3).otherwise(1.05)).when(days_out <= 30, 1.5).when(days_out <= 90, 1.25).when(days_out > 730, 0.85).otherwise(1.0)
    fallen = F.when(drop > 0, 1 + F.least(F.lit(0.5), drop)).otherwise(1.0)
    return in_stock * (1 + 0.2 * F.least(F.lit(3), F.greatest(F.lit(0), paid))) * price * age * fallen * F.when(yes(restocked), 1.15).otherwise(1.0)


def explore_slots(df: DataFrame, signal: Column, order: list[Column], first: int = 3, every: int = 8) -> DataFrame:
    """df plus `slot`, from 1: rows with a signal in order, and rows without one at `first` and each `every` further.

    Positions follow from the two ranks alone: rows with a signal move down by the slots before them; when they are used up, the rest
    follow without gaps. Both ranks are whole-table windows, so this is for a page's worth of rows, which the caller bounds.
    """
    flagged = df.withColumn("__known", signal)
    ranked = flagged.withColumn("__r", F.row_number().over(Window.partitionBy("__known").orderBy(*order)))
    n = ranked.agg(F.count_if("__known").alias("__n"), F.count_if(~F.col("__known")).alias("__e"))
    # one row
    counted = ranked.join(F.broadcast(n))
    r, before = F.col("__r"), F.when(F.col("__r") < first, 0).otherwise(1 + F.floor((F.col("__r") - first) / (every - 1)))
    known = r + F.least(F.col("__e"), before)
    new = F.least(first + every * (r - 1), F.col("__n") + r)
    return counted.withColumn("slot", F.when(F.col("__known"), known).otherwise(new).cast("long")).drop("__known", "__r", "__n", "__e")


def budget_shares(counts: DataFrame, weight: str, budget: int, least: int) -> DataFrame:
    """counts plus `share`: the budget in proportion to weight, rounded down, `least` at least. One row a group."""
    total = F.sum(weight).over(Window.partitionBy())
    return counts.withColumn("share", F.greatest(F.lit(least), F.floor(F.lit(budget) * F.col(weight) / total)).cast("long"))
