"""Queries that find new sets: products stand for a marketplace's groups, a third of the older ones for the sets of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.operators import discovery
from tradewind.plans.registry import query
from tradewind.sources.scratch import settled

REFUSED, SEALED, BOXED, PREFIXES = "(?i)promo", "(?i)bundle|booster (?:pack|box)", "(?i)booster box", ["gear", "bolt"]
BEHIND, AHEAD, DAYS = 500, 120, ("2000-11-30", "2001-07-31")

#: A group's day is when it was last seen for sale in one of three stores; what it sells is named by the store.
GROUPS = r"""spread AS (SELECT product_id, max(CAST(seen AS DATE)) AS late, min(CAST(seen AS DATE)) AS early FROM offer WHERE store % 3 <> 0 GROUP BY 1),
size_of AS (SELECT max(id) AS top FROM product),
groups AS (SELECT id AS group_id, CASE WHEN id % 17 = 0 THEN 'x' || size WHEN product_type = 'PROMO' THEN name || ' promo ' || id
    WHEN id % 6 = 0 THEN name || ' ' || size || ' ' || id ELSE name || ' ' || size END AS name,
  CASE WHEN id % 5 = 0 THEN 'Gear0' || id || '.5' WHEN id % 5 = 1 THEN 'BOLT' || id WHEN id % 5 = 2 THEN '-' END AS abbreviation, late AS day FROM product LEFT JOIN spread ON product_id = id),
known AS (SELECT 'k' || id AS code, CASE WHEN id % 2 = 0 THEN name || ' ' || size || ' ' || id ELSE 'the ' || product_type || ' & ' || name || ' ' || size || ' edition' END AS name,
  CASE WHEN id % 2 = 0 THEN replace(name, ' ', '-') || '-' || size || '-' || id ELSE 'known-' || id END AS slug, CASE WHEN id * 10 < top THEN early ELSE DATE '2001-07-01' END AS day
  FROM product LEFT JOIN spread ON product_id = id, size_of WHERE id % 3 = 0 AND (id * 10 < top OR id % 30 = 0)),
goods AS (SELECT product_id AS group_id, CASE WHEN product_id % 13 = 0 THEN 'single card' WHEN store % 4 = 0 AND product_id % 4 <> 1 THEN 'Booster Box' WHEN store % 4 = 2 THEN 'a bundle' ELSE 'sleeves' END AS name
  FROM offer WHERE product_id % 11 <> 0)"""


def judged_sql(run: int, today: str) -> str:
    return rf"""slugged{run} AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM groups),
coded{run} AS (SELECT *, CASE WHEN abbreviation LIKE 'Gear%' THEN 'gear' || group_id || 'pt5' WHEN abbreviation LIKE 'BOLT%' THEN 'bolt' || group_id ELSE substr(replace(slug, '-', ''), 1, 12) END AS code FROM slugged{run}),
floor{run} AS (SELECT max(group_id) AS floor FROM coded{run} WHERE slug IN (SELECT slug FROM known WHERE day < DATE '{today}' - INTERVAL 365 DAY)),
judged{run} AS (SELECT group_id, name, slug, code, day, CASE WHEN floor IS NULL THEN 'undated' WHEN group_id <= floor THEN 'old'
    WHEN day IS NULL OR day < DATE '{today}' - INTERVAL {BEHIND} DAY OR day > DATE '{today}' + INTERVAL {AHEAD} DAY THEN 'window' WHEN name LIKE '%promo%' THEN 'refused'
    WHEN slug IN (SELECT slug FROM known) OR code IN (SELECT code FROM known) THEN 'known' WHEN length(name) < 4 THEN 'short' END AS reason FROM coded{run}, floor{run}),
within{run} AS (SELECT group_id, min(k.name) AS within FROM judged{run} j JOIN known k ON contains(' ' || lower(k.name) || ' ', ' ' || j.name || ' ') WHERE reason IS NULL GROUP BY 1)"""


def found_sql(run: int, today: str) -> str:
    before = "SELECT 0 AS group_id, '' AS code, '' AS name, '' AS slug, DATE '1998-01-01' AS day, false AS boxed, DATE '1998-01-01' AS first_seen WHERE false" if run == 1 else f"SELECT * FROM found{run - 1}"
    return f"""{judged_sql(run, today)},
taken{run} AS (SELECT * FROM judged{run} WHERE reason IS NULL AND group_id NOT IN (SELECT group_id FROM within{run}) AND group_id % 7 <> {run}),
before{run} AS ({before}),
facts AS MATERIALIZED (SELECT group_id, bool_or(name <> 'single card' AND name <> 'sleeves') AS sealed, bool_or(name = 'Booster Box') AS box FROM goods GROUP BY 1),
found{run} AS (
  SELECT t.group_id, coalesce(b.code, t.code) AS code, t.name, coalesce(b.slug, t.slug) AS slug, t.day, f.box AS boxed, coalesce(b.first_seen, DATE '{today}') AS first_seen
  FROM taken{run} t JOIN facts f ON f.group_id = t.group_id AND f.sealed LEFT JOIN before{run} b ON b.group_id = t.group_id
  UNION ALL SELECT * FROM before{run} WHERE group_id NOT IN (SELECT group_id FROM taken{run}) OR group_id NOT IN (SELECT group_id FROM facts))""".replace("facts", f"facts{run}")


def tables(v):
    spread = v.offer.where("store % 3 <> 0").groupBy("product_id").agg(F.max(F.to_date("seen")).alias("late"), F.min(F.to_date("seen")).alias("early"))
    rows = v.product.join(spread, F.col("product_id") == F.col("id"), "left")
    plain = F.concat_ws(" ", "name", F.col("size").cast("string"))
    name = F.when(F.col("id") % 17 == 0, F.concat(F.lit("x"), "size")).when(F.col("product_type") == "PROMO", F.concat("name", F.lit(" promo "), "id")).when(F.col("id") % 6 == 0, F.concat_ws(" ", plain, "id")).otherwise(plain)
    printed = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Gear0"), "id", F.lit(".5"))).when(F.col("id") % 5 == 1, F.concat(F.lit("BOLT"), "id")).when(F.col("id") % 5 == 2, "-")
    groups = rows.select(F.col("id").alias("group_id"), name.alias("name"), printed.alias("abbreviation"), F.col("late").alias("day"))
    # one row
    top = v.product.agg(F.max("id").alias("top"))
    first = F.col("id") * 10 < F.col("top")
    sets = rows.where("id % 3 = 0").join(F.broadcast(top)).where(first | (F.col("id") % 30 == 0))
    even, numbered = F.col("id") % 2 == 0, F.concat_ws(" ", plain, "id")
    longer = F.concat(F.lit("the "), "product_type", F.lit(" & "), plain, F.lit(" edition"))
    known = sets.select(
        F.concat(F.lit("k"), "id").alias("code"), F.when(even, numbered).otherwise(longer).alias("name"),
        F.when(even, F.replace(numbered, F.lit(" "), F.lit("-"))).otherwise(F.concat(F.lit("known-"), "id")).alias("slug"),
        F.when(first, F.col("early")).otherwise(day("2001-07-01")).alias("day"),
    )
    kind = F.when(F.col("product_id") % 13 == 0, "single card").when((F.col("store") % 4 == 0) & (F.col("product_id") % 4 != 1), "Booster Box")
    kind = kind.when(F.col("store") % 4 == 2, "a bundle").otherwise("sleeves")
    goods = v.offer.where("product_id % 11 <> 0").select(F.col("product_id").alias("group_id"), kind.alias("name"))
    return groups, known, goods


def day(text):
    return F.lit(text).cast("date")


@query(f"""{GROUPS},
{judged_sql(1, DAYS[1])}
SELECT group_id, j.name, slug, code, day, CASE WHEN reason IS NOT NULL THEN reason WHEN within IS NOT NULL THEN 'within' ELSE 'take' END AS verdict, within FROM judged1 j LEFT JOIN within1 USING (group_id)""")
def groups_judged(v):
    """Every group with what becomes of it: taken as a new set, or the first reason against it."""
    groups, known, _ = tables(v)
    return discovery.judged_groups(groups, known, day(DAYS[1]), BEHIND, AHEAD, PREFIXES, REFUSED)


@query(f"""{GROUPS},
{found_sql(1, DAYS[0])},
{found_sql(2, DAYS[1])}
SELECT * FROM found2 WHERE code NOT IN (SELECT code FROM known) AND slug NOT IN (SELECT slug FROM known)""")
def sets_found_over_runs(v):
    """The found sets after two runs eight months apart, in each of which a seventh of the groups is missing from the list."""
    # both runs read the lists several times, so each is worked out once
    groups, known, goods = (settled(t, n) for t, n in zip(tables(v), ("groups", "known", "goods")))
    found = v.spark.createDataFrame([], "group_id long, code string, name string, slug string, day date, boxed boolean, first_seen date")
    for run, today in enumerate(DAYS, 1):
        judged = discovery.judged_groups(groups, known, day(today), BEHIND, AHEAD, PREFIXES, REFUSED)
        taken = judged.where(f"verdict = 'take' and group_id % 7 <> {run}")
        # what a run leaves is stored, as it would be between runs
        found = settled(discovery.found_sets(found, taken, goods, known, day(today), SEALED, BOXED), "found")
    return found
