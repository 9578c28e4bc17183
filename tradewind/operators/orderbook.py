"""Replaying purchases against stock and wallets, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.sources.scratch import discard, settled


def replay(orders: DataFrame, listings: DataFrame, wallets: DataFrame) -> DataFrame:
    """orders (seq, listing, buyer, qty), listings (listing, seller, price, stock), wallets (account, balance) -> (seq, outcome, paid).

    Orders are taken by seq, which is unique. One is `sold` if the listing has the stock and the buyer can pay; then the buyer's
    balance falls and the seller's rises by price * qty. Else it is, in this order, `unknown` (no such listing, or no quantity above 0),
    `gone` (too little stock), `own` (the buyer sells it) or `poor`. Accounts without a wallet have 0.

    An outcome depends on the outcomes before it, through running sums of what was sold of the listing and of what the account paid and
    got. So outcomes are guessed, the sums give new ones, and so on until none changes: the first n are right after n rounds at
    the latest, hence the fixed point is the replay itself. An order that fails gives its stock to the next, so a single
    running sum would be wrong. A round is two windows, over the orders of a listing and over the entries of an account.
    """
    rows = orders.join(listings.select("listing", "seller", "price", "stock"), "listing", "left")
    rows = rows.withColumn("cost", F.col("price") * F.col("qty"))
    base = settled(rows.select("seq", "listing", "buyer", "seller", "qty", "cost", "stock"), "orders")
    valid = F.col("seller").isNotNull() & (F.col("qty") > 0)
    now = settled(base.select("seq", F.coalesce(valid & (F.col("seller") != F.col("buyer")), F.lit(False)).alias("sold")), "sold")
    upto = Window.partitionBy("listing").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    of_account = Window.partitionBy("account").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        live = base.join(now, "seq")
        taken = live.withColumn("left", F.col("stock") - F.coalesce(F.sum(F.when(F.col("sold"), F.col("qty")).otherwise(0)).over(upto), F.lit(0)))
        paid = F.when(F.col("sold"), F.col("cost")).otherwise(0)
        entries = live.select("seq", F.explode(F.array(
            F.struct(F.col("buyer").alias("account"), F.lit(0).alias("kind"), (-paid).alias("amount")), F.struct(F.col("seller").alias("account"), F.lit(1).alias("kind"), paid.alias("amount")),
        )).alias("e")).select("seq", "e.*").where("account is not null")
        before = entries.withColumn("moved", F.coalesce(F.sum("amount").over(of_account), F.lit(0))).where("kind = 0").select("seq", F.col("account").alias("buyer_"), "moved")
        judged = taken.join(before, "seq", "left").join(wallets.select(F.col("account").alias("buyer_"), "balance"), "buyer_", "left")
        outcome = (
            F.when(~F.coalesce(valid, F.lit(False)), "unknown")
            .when(F.col("left") < F.col("qty"), "gone")
            .when(F.col("seller").eqNullSafe(F.col("buyer")), "own")
            .when(F.coalesce("balance", F.lit(0)) + F.coalesce("moved", F.lit(0)) < F.col("cost"), "poor")
            .otherwise("sold")
        )
        after = judged.select("seq", outcome.alias("outcome"), "cost", "sold")
        after = settled(after.withColumn("changed", (F.col("outcome") == "sold") != F.col("sold")), "outcomes")
        discard(now)
        if after.where("changed").isEmpty():
            return after.select("seq", "outcome", F.when(F.col("outcome") == "sold", F.col("cost")).otherwise(0).alias("paid"))
        now = settled(after.select("seq", (F.col("outcome") == "sold").alias("sold")), "sold")
        discard(after)
