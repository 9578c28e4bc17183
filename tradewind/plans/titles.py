"""Queries over listing titles: identity, sets, quantities, refusals, rewriting and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import hashing
from tradewind.operators import identity, ranking
from tradewind.plans.registry import query

TYPES = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]

#: Titles as sellers write them, one a product.
TITLES = """titles AS (
  SELECT id, product_type, set_code, CASE CAST(id % 11 AS INT)
    WHEN 0 THEN 'New ' || set_code || ' ' || name || ' ' || product_type || ' DAMAGED'
    WHEN 1 THEN name || ' ' || product_type || ' ' || set_code || ' x 4'
    WHEN 2 THEN 'Lot of ' || name || ' ' || set_code
    WHEN 3 THEN set_code || ' Japanese ' || name || ' - ' || product_type
    WHEN 4 THEN name || ' free shipping'
    WHEN 5 THEN set_code || ' or Brand#1 ' || name || ' ' || product_type
    WHEN 6 THEN product_type || ' and PROMO ' || set_code
    WHEN 7 THEN 'digital code ' || set_code || ' ' || product_type
    WHEN 8 THEN '...'
    WHEN 9 THEN '3x ' || set_code || ' ' || product_type || ' sealed'
    ELSE 'Sealed ' || set_code || ' ' || name || ' (' || product_type || ')' END AS title
  FROM product),
sets AS (SELECT DISTINCT set_code, set_code AS set_name FROM product)"""


def titles(v):
    n, t, s = F.col("name"), F.col("product_type"), F.col("set_code")
    made = [
        F.concat(F.lit("New "), s, F.lit(" "), n, F.lit(" "), t, F.lit(" DAMAGED")), F.concat(n, F.lit(" "), t, F.lit(" "), s, F.lit(" x 4")),
        F.concat(F.lit("Lot of "), n, F.lit(" "), s), F.concat(s, F.lit(" Japanese "), n, F.lit(" - "), t), F.concat(n, F.lit(" free shipping")),
        F.concat(s, F.lit(" or Brand#1 "), n, F.lit(" "), t), F.concat(t, F.lit(" and PROMO "), s), F.concat(F.lit("digital code "), s, F.lit(" "), t),
        F.lit("..."), F.concat(F.lit("3x "), s, F.lit(" "), t, F.lit(" sealed")), F.concat(F.lit("Sealed "), s, F.lit(" "), n, F.lit(" ("), t, F.lit(")")),
    ]
    pick = F.coalesce(*[F.when(F.col("id") % 11 == i, x) for i, x in enumerate(made)])
    return v.product.select("id", "product_type", "set_code", pick.alias("title"))


def sets(v):
    return v.product.select("set_code", F.col("set_code").alias("set_name")).distinct()


DETECTED = """hits AS (
  SELECT id, s.set_code, length(set_name) AS wide FROM titles t JOIN sets s ON contains(lower(title), lower(set_name))
  WHERE regexp_matches(lower(title), '(^|[^a-z0-9#])' || lower(set_name) || '($|[^a-z0-9])')),
found AS (
  SELECT id, min(set_code) AS set_code, count(*) AS n_longest FROM (SELECT *, max(wide) OVER (PARTITION BY id) AS most FROM hits) WHERE wide = most GROUP BY 1)"""


@query(f"{TITLES},\n{DETECTED}\nSELECT id, set_code, n_longest FROM found")
def sets_detected(v):
    return identity.detect_sets(titles(v).select("id", "title"), sets(v))


UNITS = r"""coalesce(try_cast(regexp_extract(regexp_extract(lower(title), '(\bx ?|\bpack of )([0-9]{1,3})\b|\b([0-9]{1,3}) ?x\b', 0), '([0-9]+)', 1) AS INT), 1)"""
IDENTIFIED = rf"""typed AS (
  SELECT t.id, lower(title) AS low, {UNITS} AS units, f.set_code, n_longest,
         list_filter({TYPES}, lambda x: regexp_matches(lower(title), '\b' || lower(x) || '\b')) AS types
  FROM titles t LEFT JOIN found f USING (id)),
judged AS (
  SELECT id, units, set_code, types[1] AS product_type,
         CASE WHEN regexp_matches(low, '\b(japanese|korean|german|french)\b') THEN regexp_extract(low, '\b(japanese|korean|german|french)\b', 1) ELSE 'english' END AS language,
         CASE WHEN NOT regexp_matches(low, '[a-z0-9]') THEN 'empty'
              WHEN regexp_matches(low, '\b(damaged|opened|used|empty box)\b') THEN 'condition'
              WHEN regexp_matches(low, '\b(lot|bundle|job lot)\b') THEN 'bundle'
              WHEN regexp_matches(low, '\b(digital|code card|online code)\b') THEN 'digital'
              WHEN regexp_matches(low, '\b(wrapper|sleeve only|insert only)\b') THEN 'part'
              WHEN len(types) > 1 THEN 'two types' WHEN len(types) = 0 THEN 'no type'
              WHEN set_code IS NULL THEN 'no set' WHEN n_longest > 1 THEN 'two sets' WHEN units > 1 THEN 'quantity' END AS rejected
  FROM typed)"""


def identified(v):
    return identity.identify(titles(v).select("id", "title"), sets(v), TYPES)


@query(f"""{TITLES},\n{DETECTED},\n{IDENTIFIED}
SELECT id, rejected, language, product_type, set_code, units,
       CASE WHEN rejected IS NULL THEN language || '|' || product_type || '|' || set_code END AS identity FROM judged""")
def title_identity(v):
    return identified(v)


@query(f"{TITLES},\n{DETECTED},\n{IDENTIFIED}\nSELECT coalesce(rejected, 'taken') AS outcome, language, count(*) AS n FROM judged GROUP BY 1, 2")
def identity_outcomes(v):
    return identified(v).groupBy(F.coalesce("rejected", F.lit("taken")).alias("outcome"), "language").agg(F.count("*").alias("n"))


@query(f"{TITLES}\nSELECT id, {UNITS} AS units, product_type, {UNITS} > CASE product_type WHEN 'SMALL' THEN 4 WHEN 'LARGE' THEN 1 ELSE 3 END AS too_many FROM titles")
def case_quantities(v):
    """Units offered against what a case of the type holds."""
    units = identity.quantity(F.lower("title"))
    holds = F.when(F.col("product_type") == "SMALL", 4).when(F.col("product_type") == "LARGE", 1).otherwise(3)
    return titles(v).select("id", units.alias("units"), "product_type", (units > holds).alias("too_many"))


@query(rf"""{TITLES}
SELECT id, title FROM titles WHERE NOT regexp_matches(lower(title), '\b(lot|digital|damaged)\b') AND regexp_matches(lower(title), '\b' || lower(product_type) || '\b')""")
def seller_listings_admitted(v):
    """Neither a junk title nor one that lacks the product's type."""
    low = F.lower("title")
    return titles(v).where(~low.rlike(r"\b(?:lot|digital|damaged)\b") & F.regexp_like(low, F.concat(F.lit(r"\b"), F.lower("product_type"), F.lit(r"\b")))).select("id", "title")


@query(rf"""{TITLES}
SELECT id, regexp_matches(title, '^[^A-Za-z0-9]*$|(?i)\b(free shipping|or brand)\b') AS junk FROM titles""")
def junk_titles(v):
    return titles(v).select("id", F.col("title").rlike(r"^[^A-Za-z0-9]*$|(?i)\b(?:free shipping|or brand)\b").alias("junk"))


@query(f"""{TITLES}
SELECT id, array_to_string(list_sort(list_filter(list_distinct(string_split(regexp_replace(lower(title), '[^a-z0-9#]+', ' ', 'g'), ' ')),
  lambda x: x NOT IN ('', 'new', 'sealed', 'free', 'shipping', 'fast', 'the', 'and'))), ' ') AS signature FROM titles""")
def title_signatures(v):
    return titles(v).select("id", F.array_join(identity.signature(F.lower("title")), " ").alias("signature"))


@query(f"""{TITLES},
w AS (SELECT id, product_type, set_code, array_to_string(list_sort(list_distinct(list_filter(string_split(name, ' '), lambda x: x NOT IN ('small', 'large', 'red', 'blue')))), ' ') AS words FROM product),
g AS (SELECT *, min(id) OVER (PARTITION BY product_type, set_code, words) AS like_id, count(*) OVER (PARTITION BY product_type, set_code, words) AS n FROM w)
SELECT id, like_id, n FROM g""")
def alike_but_for_noise(v):
    """Every product with its class, the first of those of its type and set whose names differ from its own in noise words only, and the class's size.

    A product has n - 1 links: all others of its class, and none beyond it.
    """
    noise = F.array(*map(F.lit, ("small", "large", "red", "blue")))
    words = F.array_join(F.array_sort(F.array_distinct(F.array_except(F.split("name", " "), noise))), " ")
    rows = v.product.select("id", "product_type", "set_code", words.alias("words"))
    groups = rows.groupBy("product_type", "set_code", "words").agg(F.min("id").alias("like_id"), F.count("*").alias("n"))
    return rows.join(groups, ["product_type", "set_code", "words"]).select("id", "like_id", "n")


@query("""codes AS (SELECT upper(regexp_replace(set_code, '[^A-Za-z0-9]', '', 'g')) AS code, count(*) AS products FROM product GROUP BY 1)
SELECT code, products FROM codes c WHERE NOT EXISTS (SELECT 1 FROM codes d WHERE d.code <> c.code AND starts_with(c.code, d.code) AND d.products >= c.products)""")
def sets_discovered(v):
    """Codes derived from set names; a code that only extends a more common one is dropped. Codes are a dimension of bounded size."""
    codes = v.product.groupBy(F.upper(F.regexp_replace("set_code", "[^A-Za-z0-9]", "")).alias("code")).agg(F.count("*").alias("products"))
    prefixes = codes.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("code") - 1), lambda n: F.substring("code", F.lit(1), n))))
    wider = codes.select(F.col("code").alias("prefix"), F.col("products").alias("more"))
    dropped = prefixes.join(wider, "prefix").where("more >= products").select("code").distinct()
    return codes.join(dropped, "code", "left_anti")


@query("""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(name, 'ring', 'hoop', 'g'), '\\b(small|the|of)\\b', '', 'g'), ' +', ' ', 'g')) AS query FROM product""")
def phrases_rewritten(v):
    bare = F.regexp_replace(F.regexp_replace("name", "ring", "hoop"), r"\b(?:small|the|of)\b", "")
    return v.product.select("id", F.trim(F.regexp_replace(bare, " +", " ")).alias("query"))


@query("""SELECT id, array_to_string(list_transform(list_filter(['ring', 'bolt', 'red', 'widget'], lambda t: contains(name, t)),
  lambda t: (strpos(name, t) - 1) || '-' || (strpos(name, t) - 1 + length(t))), ',') AS ranges FROM product""")
def highlight_ranges(v):
    """Where each search term first stands in the name: start and end."""
    terms = F.filter(F.array(*map(F.lit, ("ring", "bolt", "red", "widget"))), lambda t: F.contains(F.col("name"), t))
    at = lambda t: F.instr(F.col("name"), t) - 1
    shown = F.transform(terms, lambda t: F.concat(at(t).cast("string"), F.lit("-"), (at(t) + F.length(t)).cast("string")))
    return v.product.select("id", F.array_join(shown, ",").alias("ranges"))


@query("""SELECT id, array_to_string(list_transform(list_filter(string_split(name, ' '), lambda w: w NOT IN ('small', 'of', 'the')), lambda w: upper(w[1]) || w[2:]), ' ') AS shown FROM product""")
def names_in_title_case(v):
    words = F.filter(F.split("name", " "), lambda w: ~w.isin("small", "of", "the"))
    return v.product.select("id", F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ").alias("shown"))


FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(slug, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


@query(f"SELECT id, {FNV} AS fnv, lower(to_base({FNV}, 36)) AS short FROM product")
def short_hashes(v):
    h = hashing.fnv1a(F.col("slug"))
    return v.product.select("id", h.alias("fnv"), hashing.base36(h).alias("short"))


@query(f"SELECT market, slug, place FROM (SELECT market, slug, row_number() OVER (PARTITION BY market ORDER BY {FNV}, slug) AS place FROM card WHERE in_stock_stores > 0) WHERE place <= 40")
def shuffled_of_the_day(v):
    """The same 40 open products for everybody, in an order that has nothing to do with price or name."""
    order = [hashing.fnv1a(F.col("slug")), F.col("slug")]
    return ranking.first_per(v.card.where("in_stock_stores > 0"), ["market"], order, 40, "place").select("market", "slug", "place")


MONEY = """said AS (SELECT id, CASE CAST(id % 4 AS INT) WHEN 0 THEN 'about $' || size || '.50' WHEN 1 THEN size || '% off' WHEN 2 THEN '$1,' || (100 + size) ELSE 'ask me' END AS said FROM product)"""


@query(rf"""{MONEY}
SELECT id, CAST(floor(try_cast(replace(nullif(regexp_extract(said, '\$([0-9][0-9,]*(\.[0-9]+)?)', 1), ''), ',', '') AS DOUBLE) * 100 + 0.5) AS BIGINT) AS cents,
       try_cast(nullif(regexp_extract(said, '([0-9]+)%', 1), '') AS INT) AS percent FROM said""")
def free_text_money(v):
    n, size = F.col("id") % 4, F.col("size").cast("string")
    said = F.when(n == 0, F.concat(F.lit("about $"), size, F.lit(".50"))).when(n == 1, F.concat(size, F.lit("% off"))).when(n == 2, F.concat(F.lit("$1,"), (F.col("size") + 100).cast("string"))).otherwise("ask me")
    amount = F.replace(F.nullif(F.regexp_extract("said", r"\$([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    percent = F.nullif(F.regexp_extract("said", "([0-9]+)%", 1), F.lit("")).try_cast("int")
    return v.product.select("id", said.alias("said")).select("id", F.floor(amount * 100 + 0.5).cast("long").alias("cents"), percent.alias("percent"))


@query(r"""lines AS (SELECT id, CASE CAST(id % 3 AS INT) WHEN 0 THEN (1 + size % 4) || 'x ' || name || ' (' || set_code || ') ' || size WHEN 1 THEN (1 + size % 4) || ' ' || name ELSE '// ' || name END AS line FROM product),
parsed AS (SELECT id, regexp_extract(line, '^([0-9]+)x? ([^(]+?)( \(([^)]+)\))?( ([0-9]+))?$', ['n', 'name', 'a', 'set_name', 'b', 'number']) AS p FROM lines)
SELECT id, CAST(p['n'] AS INT) AS qty, p['name'] AS name, nullif(p['set_name'], '') AS set_name, try_cast(nullif(p['number'], '') AS INT) AS number FROM parsed WHERE p['n'] <> ''""")
def deck_lines_parsed(v):
    """`4x Name (Set) 12`, `2 Name`; comment lines are passed over."""
    n, qty = F.col("id") % 3, (F.col("size") % 4 + 1).cast("string")
    line = F.when(n == 0, F.concat(qty, F.lit("x "), F.col("name"), F.lit(" ("), F.col("set_code"), F.lit(") "), F.col("size").cast("string")))
    line = line.when(n == 1, F.concat(qty, F.lit(" "), F.col("name"))).otherwise(F.concat(F.lit("// "), F.col("name")))
    part = lambda i: F.nullif(F.regexp_extract("line", r"^([0-9]+)x? ([^(]+?)(?: \(([^)]+)\))?(?: ([0-9]+))?$", i), F.lit(""))
    rows = v.product.select("id", line.alias("line"))
    return rows.select("id", part(1).cast("int").alias("qty"), part(2).alias("name"), part(3).alias("set_name"), part(4).cast("int").alias("number")).where("qty is not null")
