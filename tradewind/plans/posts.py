"""Queries over what is posted and written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import text as tx
from tradewind.operators.posting import due_posts
from tradewind.plans.registry import query

RUN, TODAY = 5, 100


@query(r"""SELECT market || '|' || slug AS key, product_id, (median_open - lowest) * 100 // median_open AS score FROM card
WHERE in_stock_stores >= 2 AND lowest * 10 <= median_open * 9 AND lowest * 2 >= median_open AND (product_id % 3 = 0 OR product_id % 3 = 2 AND product_id % 14 >= 7)
ORDER BY score DESC, key LIMIT 6""")
def posts_selected(v):
    """Deals against a state in which a third of the products is new or never posted, a third was seen in the last run, and a third is older."""
    deals = v.card.where("in_stock_stores >= 2 and lowest * 10 <= median_open * 9 and lowest * 2 >= median_open")
    key, p = F.concat_ws("|", "market", "slug"), F.col("product_id")
    events = deals.select(key.alias("key"), "product_id", F.expr("(median_open - lowest) * 100 div median_open").alias("score"))
    seen = F.when(p % 3 == 2, RUN - 2).otherwise(RUN - 1)
    posted = F.when(p % 3 == 1, 50).when(p % 3 == 2, TODAY - p % 14)
    ledger = v.card.where("product_id % 3 <> 0 or product_id % 2 = 0").select(key.alias("key"), seen.alias("seen_run"), posted.alias("posted_day"))
    return due_posts(events, ledger, RUN, TODAY, 6)


@query(r"""c AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[",\n\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END AS cell FROM documents)
SELECT doc_id, sha256(cell) AS digest FROM c""")
def csv_quoted_cells(v):
    return v.raw("documents").select("doc_id", F.sha2(tx.csv_quoted(F.col("text")), 256).alias("digest"))
