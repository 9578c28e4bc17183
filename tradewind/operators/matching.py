"""Matching listing titles to products: exact signatures first, then containment within a block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(listings: DataFrame, products: DataFrame) -> DataFrame:
    """listings (listing, block, tokens) and products (product, block, tokens) -> (listing, product, how).

    tokens are sorted sets. An equal set wins. Otherwise a product matches if the listing has all its tokens; the product with
    most tokens wins, and two at the top are ambiguous: product is null. The containment join is not over all pairs of a
    block: products meet a listing in their rarest token, which the listing must have.
    """
    names = listings.select("listing", "block", F.array_join("tokens", " ").alias("sig"))
    keys = products.select("product", "block", F.array_join("tokens", " ").alias("sig")).groupBy("block", "sig").agg(F.min("product").alias("product"), F.count("*").alias("same"))
    exact = names.join(keys, ["block", "sig"]).select("listing", F.when(F.col("same") == 1, F.col("product")).alias("product"), F.when(F.col("same") == 1, "exact").otherwise("ambiguous").alias("how"))

    left = listings.join(exact.select("listing"), "listing", "left_anti")
    spread = products.select("product", "block", "tokens", F.explode("tokens").alias("token"))
    rarity = spread.groupBy("block", "token").agg(F.count("*").alias("df"))
    anchor = spread.join(rarity, ["block", "token"]).groupBy("product", "block").agg(F.min(F.struct("df", "token")).alias("a"), F.first("tokens").alias("need"))
    anchored = anchor.select("product", "block", "need", F.col("a.token").alias("token"))
    held = left.select("listing", "block", "tokens", F.explode("tokens").alias("token")).join(anchored, ["block", "token"])
    fits = held.where(F.size(F.array_except("need", "tokens")) == 0).select("listing", "product", F.size("need").alias("n"))
    top = fits.join(fits.groupBy("listing").agg(F.max("n").alias("n")), ["listing", "n"]).groupBy("listing").agg(F.count("*").alias("k"), F.min("product").alias("product"))
    loose = top.select("listing", F.when(F.col("k") == 1, F.col("product")).alias("product"), F.when(F.col("k") == 1, "contained").otherwise("ambiguous").alias("how"))
    return exact.unionByName(loose)
