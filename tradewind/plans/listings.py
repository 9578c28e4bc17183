"""Queries over titles by a book of rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import text as tx
from tradewind.operators import rulebook
from tradewind.operators.identity import Gate
from tradewind.operators.rulebook import Book, KindRule
from tradewind.plans.registry import query

BOOK = Book(
    gates=(Gate("empty", "[a-z0-9]", lacking=True), Gate("bundle", r"\b(?:lot of|bundle of|[0-9]+ different)\b"), Gate("accessory", r"\b(?:sleeves|binder|playmat|deck box)\b")),
    kinds=(
        KindRule(None, r"\btrainer box plus\b"), KindRule("case", r"\bcase\b", r"\btins?\b"), KindRule("trainer box", r"\btrainer box(?:es)?\b"), KindRule("box", r"\bbooster box(?:es)?\b"),
        KindRule("pack", r"\bbooster packs?\b"), KindRule("tin", r"\btins?\b"), KindRule("collection", r"\bcollections?\b"),
    ),
    set_kinds=frozenset({"case", "trainer box", "box", "pack"}), home="english", languages={"japanese": r"\bjapanese\b", "french": r"\bfrench\b"}, foreign=r"\b(?:korean|chinese)\b",
    cases={"case": (6, 10)}, descriptors=("special", "premium", "mini", "ex"), noise=("new", "sealed", "trainer", "x6"),
)

#: One title a product, as sellers write them, with the number of its brand as that of a set; the names of two sets nest.
MADE = """t AS (SELECT id, CASE CAST(id % 20 AS INT)
    WHEN 0 THEN 'Series ' || k || ' Booster  Box' WHEN 1 THEN 'NEW Series ' || k || ' booster box case x6' WHEN 2 THEN 'series ' || k || ' booster case (4 boxes)' WHEN 3 THEN 'Series ' || k || ' Trainer Box Plus'
    WHEN 4 THEN 'Japanese Nihon ' || k || ' Booster Box' WHEN 5 THEN 'Japanese jp' || k || ' Nihon ' || j || ' booster pack' WHEN 6 THEN 'Korean series ' || k || ' booster box' WHEN 7 THEN 'Series ' || k || ' ' || name || ' Collection'
    WHEN 8 THEN name || ' tin' WHEN 9 THEN 'Special Collection' WHEN 10 THEN 'lot of 3 series ' || k || ' booster packs' WHEN 11 THEN 'Series ' || k || ' sleeves' WHEN 12 THEN 'Series ' || k || ' or Series ' || j || ' booster box'
    WHEN 13 THEN 'Grand ' || name || ' tin' WHEN 14 THEN 'Grand booster box' WHEN 15 THEN ' - ' WHEN 16 THEN 'Series ' || k || ' Gold Booster Box' WHEN 17 THEN 'Japanese French series ' || k || ' booster box'
    WHEN 18 THEN 'series ' || k || ' booster box case 3x gold 3x silver' ELSE 'Grand special tin' END AS title
  FROM (SELECT id, name, substr(set_code, 7) AS k, CAST(CAST(substr(set_code, 7) AS INT) % 25 + 1 AS VARCHAR) AS j FROM product)),
sets AS (SELECT DISTINCT 'english' AS language, 's' || substr(set_code, 7) AS set_code, 'Series ' || substr(set_code, 7) AS set_name, NULL AS printed, false AS generic FROM product
  UNION ALL SELECT DISTINCT 'english', 'g' || substr(set_code, 7), 'Series ' || substr(set_code, 7) || ' Gold', NULL, false FROM product
  UNION ALL SELECT DISTINCT 'japanese', 'j' || substr(set_code, 7), 'Nihon ' || substr(set_code, 7), 'jp' || substr(set_code, 7), false FROM product
  UNION ALL SELECT 'english', 'grand', 'Grand', NULL, true)"""


def made(v):
    p = v.product.select("id", "name", F.substring("set_code", 7, 9).alias("k")).withColumn("j", (F.col("k").cast("int") % 25 + 1).cast("string"))
    forms = [
        "concat('Series ', k, ' Booster  Box')", "concat('NEW Series ', k, ' booster box case x6')", "concat('series ', k, ' booster case (4 boxes)')", "concat('Series ', k, ' Trainer Box Plus')",
        "concat('Japanese Nihon ', k, ' Booster Box')", "concat('Japanese jp', k, ' Nihon ', j, ' booster pack')", "concat('Korean series ', k, ' booster box')", "concat('Series ', k, ' ', name, ' Collection')",
        "concat(name, ' tin')", "'Special Collection'", "concat('lot of 3 series ', k, ' booster packs')", "concat('Series ', k, ' sleeves')", "concat('Series ', k, ' or Series ', j, ' booster box')",
        "concat('Grand ', name, ' tin')", "'Grand booster box'", "' - '", "concat('Series ', k, ' Gold Booster Box')", "concat('Japanese French series ', k, ' booster box')",
        "concat('series ', k, ' booster box case 3x gold 3x silver')", "'Grand special tin'",
    ]
    titles = p.select("id", F.expr("case id % 20 " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end").alias("title"))
    k = v.product.select(F.substring("set_code", 7, 9).alias("k")).distinct()
    none, no = F.lit(None).cast("string"), F.lit(False)
    sets = k.select(F.lit("english").alias("language"), F.concat(F.lit("s"), "k").alias("set_code"), F.concat(F.lit("Series "), "k").alias("set_name"), none.alias("printed"), no.alias("generic"))
    sets = sets.unionAll(k.select(F.lit("english"), F.concat(F.lit("g"), "k"), F.concat(F.lit("Series "), "k", F.lit(" Gold")), none, no))
    sets = sets.unionAll(k.select(F.lit("japanese"), F.concat(F.lit("j"), "k"), F.concat(F.lit("Nihon "), "k"), F.concat(F.lit("jp"), "k"), no))
    return titles, sets.unionAll(v.spark.range(1).select(F.lit("english"), F.lit("grand"), F.lit("Grand"), none, F.lit(True)))


FOUND = r"""c AS (SELECT id, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS low FROM t),
r AS (SELECT id, low, regexp_matches(low, '\bjapanese\b') AS ja, regexp_matches(low, '\bfrench\b') AS fr,
  CASE WHEN regexp_matches(low, '\btrainer box plus\b') THEN NULL WHEN regexp_matches(low, '\bcase\b') AND NOT regexp_matches(low, '\btins?\b') THEN 'case' WHEN regexp_matches(low, '\btrainer box(es)?\b') THEN 'trainer box'
    WHEN regexp_matches(low, '\bbooster box(es)?\b') THEN 'box' WHEN regexp_matches(low, '\bbooster packs?\b') THEN 'pack' WHEN regexp_matches(low, '\btins?\b') THEN 'tin' WHEN regexp_matches(low, '\bcollections?\b') THEN 'collection' END AS kind,
  list_filter(regexp_split_to_array(low, '[^a-z0-9#]+'), lambda x: x <> '') AS w FROM c),
l AS (SELECT *, CASE WHEN ja THEN 'japanese' WHEN fr THEN 'french' ELSE 'english' END AS language, ' ' || array_to_string(w, ' ') || ' ' AS spaced FROM r),
spelled AS (SELECT language, set_code, generic, lower(unnest([set_name, printed])) AS phrase FROM sets),
h AS (SELECT id, set_code, generic, phrase FROM l JOIN spelled s ON s.language = l.language AND contains(spaced, ' ' || phrase || ' ')),
o AS (SELECT a.* FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.id = a.id AND length(b.phrase) > length(a.phrase) AND starts_with(b.phrase, a.phrase || ' '))),
q AS (SELECT *, bool_and(generic) OVER (PARTITION BY id) AS only_generic FROM o),
f AS (SELECT id, min(set_code) AS set_code, bool_or(generic) AS generic, count(DISTINCT set_code) AS n_sets FROM q WHERE only_generic OR NOT generic GROUP BY 1),
x AS (SELECT l.*, f.set_code, f.generic, n_sets, list_sort(list_distinct(list_filter(w, lambda y: NOT regexp_matches(y, '^(booster|boxe?s?|packs?|cases?|displays?|bundles?|tins?|collections?|of|and|the)$')
    AND y NOT IN ('japanese', 'french', 'new', 'sealed', 'trainer', 'x6') AND NOT list_contains(coalesce(sw, []), y)))) AS words,
  kind IN ('case', 'trainer box', 'box', 'pack') AS by_set
  FROM l LEFT JOIN f USING (id) LEFT JOIN (SELECT language, set_code, list_distinct(flatten(list(string_split(phrase, ' ')))) AS sw FROM spelled WHERE phrase IS NOT NULL GROUP BY 1, 2) n ON n.language = l.language AND n.set_code = f.set_code),
y AS (SELECT *, len(list_filter(words, lambda z: z NOT IN ('special', 'premium', 'mini', 'ex'))) AS telling FROM x),
z AS (SELECT *, CASE WHEN NOT regexp_matches(low, '[a-z0-9]') THEN 'empty' WHEN regexp_matches(low, '\b(lot of|bundle of|[0-9]+ different)\b') THEN 'bundle' WHEN regexp_matches(low, '\b(sleeves|binder|playmat|deck box)\b') THEN 'accessory'
    WHEN regexp_matches(low, '\b(korean|chinese)\b') OR ja AND fr THEN 'foreign' WHEN kind IS NULL THEN 'no kind' WHEN n_sets > 1 THEN 'two sets' WHEN by_set AND set_code IS NULL THEN 'no set' WHEN kind = 'case' AND contains(low, '(4 boxes)') THEN 'quantity'
    WHEN NOT by_set AND telling = 0 AND (set_code IS NULL OR generic) THEN 'vague' END AS rejected, CASE WHEN generic AND NOT by_set AND telling > 0 THEN '-' ELSE coalesce(set_code, '-') END AS in_key FROM y),
found AS (SELECT id, language, kind, in_key AS set_code, rejected, CASE WHEN rejected IS NULL THEN CASE WHEN by_set THEN language || '|' || kind || '|' || set_code ELSE language || '|' || kind || '|' || in_key || '|' || array_to_string(words, '-') END END AS identity FROM z)"""


@query(f"{MADE},\n{FOUND}\nSELECT * FROM found")
def titles_by_rulebook(v):
    return rulebook.identified(*made(v), BOOK)


@query(f"{MADE},\n{FOUND}\nSELECT identity, count(*) AS n, min(id) AS first FROM found WHERE identity IS NOT NULL GROUP BY 1")
def titles_compared(v):
    return rulebook.compared(rulebook.identified(*made(v), BOOK))


PHRASES, STOP = {"of the": "vonder", "in": "inside", "the and": "both", "that the": "thatthe"}, ("the", "a", "and", "of", "le", "la", "de", "der", "die")


def _replaced() -> str:
    out = "' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' '"
    for phrase in ("that the", "the and", "of the", "in"):
        out = f"replace({out}, ' {phrase} ', ' {PHRASES[phrase]} ')"
    return out


@query(f"""r AS (SELECT doc_id, list_filter(string_split({_replaced()}, ' '), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, list_filter(w, lambda x: x NOT IN {STOP}) AS kept FROM r)
SELECT doc_id, sha256(array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE w END, ' ')) AS digest FROM k""")
def searches_rewritten(v):
    """Whole texts taken as searches: phrases replaced, stop words dropped."""
    return v.raw("documents").select("doc_id", F.sha2(tx.rewritten_query(F.col("text"), PHRASES, STOP), 256).alias("digest"))


@query(r"""l AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '\| | \|.*$', ' ', 'g'), '[ 	
]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN lower(x) = 'ip' THEN 'IP' WHEN lower(x) = 'tion' THEN 'tiON' WHEN i > 1 AND i < len(w) AND lower(x) IN ('the', 'of', 'and', 'de', 'la', 'le', 'der') THEN lower(x)
  ELSE array_to_string(list_transform(string_split(lower(x), '-'), lambda p: CASE WHEN regexp_matches(p, '^[a-z]') THEN upper(p[1]) || p[2:] ELSE p END), '-') END), ' ') AS shown FROM l""")
def titles_cased(v):
    """The first line of each text as a name on a page."""
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return v.raw("documents").select("doc_id", tx.title_cased(first, ("the", "of", "and", "de", "la", "le", "der"), {"ip": "IP", "tion": "tiON"}, r"\| | \|.*$").alias("shown"))
