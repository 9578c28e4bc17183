"""Finding the item that a line of a list means, in passes: what one pass settles the next does not see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3


def _grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda i: F.substring(c, i, F.lit(GRAM))))


def containing(needles: DataFrame, names: DataFrame) -> DataFrame:
    """needles (needle) and names (name), both distinct -> (needle, name) where the name holds the needle, of GRAM characters or more.

    Names are posted under their grams. A needle asks only for its rarest one, and is then looked for in what that gives.
    """
    posted = names.where(F.length("name") >= GRAM).select("name", F.explode(_grams(F.col("name"))).alias("gram"))
    rarity = posted.groupBy("gram").agg(F.count("*").alias("n"))
    asked = needles.where(F.length("needle") >= GRAM).select("needle", F.explode(_grams(F.col("needle"))).alias("gram"))
    # a gram that no name has rules the needle out
    counted = asked.join(rarity, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a"))
    return counted.select("needle", F.col("a.gram").alias("gram")).join(posted, "gram").where(F.contains("name", F.col("needle"))).select("needle", "name")


def resolved(lines: DataFrame, items: DataFrame) -> DataFrame:
    """lines (line, number, set_code, name, special) and items (item, number, set_code, name, special, price) -> (line, item, how, choices).

    In this order: `number` (and set, where the line gives one); `name`, exactly: where several items have it, one of the line's number,
    then one as special as the line says, then the cheapest; `part`, where the line's name stands within an item's. Prices that are
    null sort last and equal ones by item. An ordinary line never gets a special item by name or part while an ordinary one fits.
    choices counts the items of the pass that settled it; a line that none settles has how `none` and no item.

    Items that a line cannot tell apart are cut to their first before lines meet them, so no line is joined with all items of its number
    or name.
    """
    order = F.min(F.struct(F.col("price").isNull().alias("unpriced"), "price", "item")).alias("b")
    item = items.select("item", F.col("number").alias("i_number"), F.col("set_code").alias("i_set"), F.col("name").alias("i_name"), F.col("special").alias("i_special"), "price")
    unlike = (F.col("special") != F.col("i_special")).alias("unlike")

    asks = lines.where("number is not null and set_code is null").select("line", "number")
    by_number = item.groupBy("i_number").agg(order, F.count("*").alias("choices"))
    alone = asks.join(by_number, F.col("number") == F.col("i_number"))
    asks = lines.where("number is not null and set_code is not null").select("line", "number", "set_code")
    by_set = item.groupBy("i_number", "i_set").agg(order, F.count("*").alias("choices"))
    in_set = asks.join(by_set, (F.col("number") == F.col("i_number")) & (F.col("set_code") == F.col("i_set")))
    found = alone.select("line", "b", "choices").unionAll(in_set.select("line", "b", "choices")).groupBy("line").agg(F.min("b").alias("b"), F.sum("choices").alias("choices"))
    first = found.select("line", F.col("b.item").alias("item"), F.lit("number").alias("how"), "choices")

    left = lines.where("name is not null").join(first, "line", "left_anti").select("line", "number", "name", "special")
    by_name = item.groupBy("i_name", "i_special").agg(order, F.count("*").alias("n"))
    named = left.join(by_name, F.col("name") == F.col("i_name")).groupBy("line").agg(F.min(F.struct(unlike, "b")).alias("any"), F.sum("n").alias("choices"))
    both = item.groupBy("i_name", "i_number", "i_special").agg(order)
    numbered = left.join(both, (F.col("name") == F.col("i_name")) & (F.col("number") == F.col("i_number"))).groupBy("line").agg(F.min(F.struct(unlike, "b")).alias("own"))
    second = named.join(numbered, "line", "left").select("line", F.coalesce("own", "any")["b"]["item"].alias("item"), F.lit("name").alias("how"), "choices")

    left = left.join(second, "line", "left_anti")
    pairs = containing(left.select(F.col("name").alias("needle")).distinct(), items.select("name").distinct())
    best = pairs.join(by_name, F.col("name") == F.col("i_name")).groupBy("needle", "i_special").agg(F.min("b").alias("b"), F.sum("n").alias("n"))
    best = best.withColumn("choices", F.sum("n").over(Window.partitionBy("needle")))
    part = left.join(best, F.col("name") == F.col("needle")).groupBy("line").agg(F.min(F.struct(unlike, "b")).alias("w"), F.max("choices").alias("choices"))
    third = part.select("line", F.col("w.b.item").alias("item"), F.lit("part").alias("how"), "choices")

    settled = first.unionByName(second).unionByName(third)
    return lines.select("line").join(settled, "line", "left").select("line", "item", F.coalesce("how", F.lit("none")).alias("how"), F.coalesce("choices", F.lit(0)).cast("long").alias("choices"))
