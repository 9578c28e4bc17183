"""Queries for one fact from several reads: names, barcodes, a ladder of prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import text as tx
from tradewind.operators import facts
from tradewind.plans.registry import query

RUNGS = [100_000, 150_000, 200_000, 300_000, 900_000]

#: A printed code: a right one, one that lost its zero, one that twelve products share, a wrong digit, zeros.
PRINTED = "CASE id % 6 WHEN 0 THEN 'UPC ' || b || d WHEN 1 THEN substr(b, 2) || d WHEN 2 THEN b || d WHEN 3 THEN b || ((d + 1) % 10) WHEN 4 THEN '0000-0000-0000' END"


@query(f"""body AS (SELECT id, lpad(CAST(CASE WHEN id % 6 = 2 THEN 1000000 + id // 12 ELSE id + 7 END AS VARCHAR), 11, '0') AS b FROM product),
digit AS (SELECT id, b, (10 - list_sum([CAST(substr(b, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END for i in range(1, 12)]) % 10) % 10 AS d FROM body),
code AS (SELECT id, CASE id % 6 WHEN 0 THEN b || CAST(d AS INT) WHEN 1 THEN b || CAST(d AS INT) WHEN 2 THEN b || CAST(d AS INT) END AS code FROM digit),
n AS (SELECT code FROM code WHERE code IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
SELECT id, n.code AS code, CASE WHEN n.code IS NOT NULL THEN 'UPC' END AS label FROM code LEFT JOIN n ON n.code = code.code""")
def barcodes_kept(v):
    """The barcodes of products that are right and their own."""
    number = F.when(F.col("id") % 6 == 2, 1_000_000 + F.expr("id div 12")).otherwise(F.col("id") + 7)
    rows = v.product.select("id", F.lpad(number.cast("string"), 11, "0").alias("b"))
    total = sum((F.substring("b", i, 1).cast("int") * (3 if i % 2 else 1) for i in range(1, 12)), F.lit(0))
    printed = rows.withColumn("d", (10 - total % 10) % 10).select("id", tx.gtin(F.expr(PRINTED)).alias("code"))
    return facts.own_codes(printed, "code").withColumn("label", tx.gtin_label(F.col("code")))


@query("""r AS (SELECT id % 97 AS grp, product_type, set_code AS name, store % 40 = 7 AS marketplace, seen AS day FROM offer JOIN product ON id = product_id),
c AS (SELECT *, row_number() OVER (PARTITION BY grp, product_type ORDER BY n DESC, day, name) AS rn FROM (SELECT grp, product_type, name, count(*) AS n, min(day) AS day FROM r GROUP BY 1, 2, 3)),
f AS (SELECT r.grp, r.product_type, arg_min(r.name, struct_pack(a := r.day, b := c.day, c := r.name)) AS name
  FROM r JOIN c ON c.grp = r.grp AND c.product_type = r.product_type AND c.name = r.name WHERE marketplace GROUP BY 1, 2)
SELECT c.grp, c.product_type, coalesce(f.name, c.name) AS name FROM c LEFT JOIN f ON f.grp = c.grp AND f.product_type = c.product_type WHERE rn = 1""")
def names_picked(v):
    """The brand by which a group of products goes: a marketplace's first word, else what most listings say."""
    rows = v.offer.join(v.product, F.col("id") == F.col("product_id"))
    reads = rows.select((F.col("id") % 97).alias("grp"), "product_type", F.col("set_code").alias("name"), (F.col("store") % 40 == 7).alias("marketplace"), F.col("seen").alias("at"))
    return facts.picked_names(reads, ["grp", "product_type"])


@query("c AS (SELECT store, product_id, price FROM offer WHERE in_stock AND price > 0),\nall_ AS (" + " UNION ALL ".join(
    f"SELECT store, {n} AS turn, min(struct_pack(p := price, i := product_id)) AS b FROM c{where} GROUP BY 1"
    for n, where in enumerate(["", *[f" WHERE price BETWEEN {r} AND {r} * 1.6" for r in RUNGS]])) + """)
SELECT store, min(turn) AS turn, b.i AS product_id, b.p AS price FROM all_ GROUP BY 1, 3, 4""")
def ladder_planned(v):
    """The items of each store by which its postage is asked."""
    return facts.ladder_plan(v.offer.where("in_stock"), "store", "product_id", "price", RUNGS)
