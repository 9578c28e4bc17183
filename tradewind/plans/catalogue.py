"""Queries over keys, phrases, lists, samples, pages and ledgers: what takes passes, state or ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import hashing
from tradewind.functions.highlight import highlight
from tradewind.operators import orderbook, pages, pairing, phrases, posting, quality, ranks, rekey, resolve
from tradewind.plans.registry import query
from tradewind.plans.titles import FNV
from tradewind.sources.scratch import settled

#: Six products make a block whose listings drift: along a chain, in a swap with two more after one key, or with none left behind.
DRIFT = """e AS (SELECT id AS entity, id // 6 AS b, id % 6 AS r, 'k' || id AS key, CASE WHEN id // 6 % 4 = 2 AND id % 2 = 0 THEN 'f' || (id // 6) || 'b' END AS name_key FROM product),
t AS (SELECT e.*, store, store % 13 <> 0 AS read, CASE b % 4
    WHEN 0 THEN CASE WHEN store % 5 = 0 THEN key WHEN r < 5 THEN 'k' || (entity + 1) ELSE 'f' || b || 'a' END
    WHEN 1 THEN CASE WHEN r < 2 THEN 'k' || (entity + 1 - 2 * r) WHEN r < 4 THEN 'f' || b || 'a' WHEN r = 4 THEN 'f' || b || 'b' ELSE 'k' || (entity - 1) END
    WHEN 2 THEN CASE WHEN store % 2 = 0 THEN 'k' || (b * 6 + (r + 1) % 6) WHEN r < 3 THEN 'f' || b || 'a' ELSE 'f' || b || 'b' END
    ELSE key END AS now FROM e JOIN offer ON product_id = entity)"""


def drift(v):
    e = v.product.select(F.col("id").alias("entity"), F.expr("id div 6").alias("b"), (F.col("id") % 6).alias("r"), F.expr("concat('k', id)").alias("key"),
                         F.expr("case when (id div 6) % 4 = 2 and id % 2 = 0 then concat('f', id div 6, 'b') end").alias("name_key"))
    now = F.expr("""case b % 4
        when 0 then case when store % 5 = 0 then key when r < 5 then concat('k', entity + 1) else concat('f', b, 'a') end
        when 1 then case when r < 2 then concat('k', entity + 1 - 2 * r) when r < 4 then concat('f', b, 'a') when r = 4 then concat('f', b, 'b') else concat('k', entity - 1) end
        when 2 then case when store % 2 = 0 then concat('k', b * 6 + (r + 1) % 6) when r < 3 then concat('f', b, 'a') else concat('f', b, 'b') end
        else key end""")
    t = e.join(v.offer.select("product_id", "store"), F.col("product_id") == F.col("entity"))
    votes = t.select("entity", F.when(F.col("store") % 13 != 0, now).alias("key"), (F.col("store") % 13 != 0).alias("read"))
    return e.select("entity", "key", "name_key"), votes


@query(f"""RECURSIVE_{DRIFT},
c AS (SELECT entity, key, name_key, now AS vote, count(*) AS n FROM t WHERE read GROUP BY ALL),
s AS (SELECT entity, count(*) AS total, bool_and(read) AS all_read FROM t GROUP BY 1),
j AS (SELECT entity, any_value(total) AS total, any_value(all_read) AS all_read, bool_or(vote = key) AS keeps,
  list(vote ORDER BY vote IS DISTINCT FROM name_key, n DESC, vote) FILTER (vote <> key) AS orphan, list(vote ORDER BY n DESC, vote) FILTER (vote <> key) AS most, max(n) FILTER (vote <> key) AS top
  FROM c JOIN s USING (entity) GROUP BY 1),
w AS (SELECT entity, CASE WHEN all_read AND NOT keeps THEN orphan WHEN top * 2 > total THEN most[1:1] ELSE [] END AS wants FROM j WHERE most IS NOT NULL),
visit AS (SELECT b, r, entity, key, coalesce(wants, []) AS wants FROM e LEFT JOIN w USING (entity)),
run AS (SELECT b, 0 AS step, list(key) AS held, []::BIGINT[] AS done, NULL::BIGINT AS entity, NULL::VARCHAR AS old, NULL::VARCHAR AS new FROM e GROUP BY b
  UNION ALL
  SELECT b, step + 1, CASE WHEN pick IS NULL THEN held ELSE list_append(list_filter(held, lambda x: x <> key), pick) END, CASE WHEN pick IS NULL THEN done ELSE list_append(done, here) END,
         CASE WHEN pick IS NOT NULL THEN here END, CASE WHEN pick IS NOT NULL THEN key END, pick
  FROM (SELECT run.b, step, held, done, visit.entity AS here, key, CASE WHEN NOT list_contains(done, visit.entity) THEN list_filter(wants, lambda x: NOT list_contains(held, x))[1] END AS pick
        FROM run LEFT JOIN visit ON visit.b = run.b AND visit.r = run.step % 6 WHERE step < 60))
SELECT entity, old, new FROM run WHERE entity IS NOT NULL""")
def rekeyed(v):
    return rekey.planned_moves(*drift(v)).select("entity", "old", "new")


@query(f"""RECURSIVE_open AS (SELECT market, name, slug, lowest AS price, {FNV} AS h FROM card WHERE lowest IS NOT NULL),
pool AS (SELECT market, list(struct_pack(name := name, price := price, slug := slug) ORDER BY h, slug) AS p FROM open GROUP BY 1),
run AS (SELECT market, p, 1 AS i, []::BIGINT[] AS used, 0 AS round, NULL::VARCHAR AS first, NULL::VARCHAR AS second FROM pool
  UNION ALL
  SELECT market, p, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, CASE WHEN j IS NULL THEN round ELSE round + 1 END, CASE WHEN j IS NOT NULL THEN p[i].slug END, p[j].slug
  FROM (SELECT *, CASE WHEN NOT list_contains(used, i) THEN list_filter(range(i + 1, least(i + 40, len(p) + 1)), lambda x: NOT list_contains(used, x) AND p[x].name <> p[i].name
          AND greatest(p[x].price, p[i].price) >= least(p[x].price, p[i].price) * 1.25 AND greatest(p[x].price, p[i].price) <= least(p[x].price, p[i].price) * 4.0)[1] END AS j
        FROM run WHERE i <= len(p) AND round < 10)),
full_ AS (SELECT market FROM run GROUP BY 1 HAVING max(round) = 10)
SELECT market, round, first, second FROM run JOIN full_ USING (market) WHERE first IS NOT NULL""")
def paired_of_the_day(v):
    """Ten pairs a market that are apart in price, the same for everybody."""
    rows = v.card.where("lowest is not null")
    return pairing.drawn_pairs(rows, "market", "slug", "name", "lowest", [hashing.fnv1a(F.col("slug")), F.col("slug")], 1.25, 4.0)


PHRASES = r"""words AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9#]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
phrases AS (SELECT item_id * 2 + k AS phrase_id, array_to_string(w[1:2 + k], ' ') AS phrase, k = 0 AS generic FROM words, (SELECT unnest([0, 1]) AS k) WHERE len(w) >= 3),
texts AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9#]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents)"""


def phrase_table(v):
    words = v.raw("benchmark").where("text is not null").select("item_id", phrases.phrase_words(F.col("text")).alias("w")).where(F.size("w") >= 3)
    both = words.select("item_id", "w", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return both.select((F.col("item_id") * 2 + F.col("k")).alias("phrase_id"), F.array_join(F.slice("w", 1, F.col("k") + 2), " ").alias("phrase"), (F.col("k") == 0).alias("generic"))


@query(rf"""{PHRASES},
hits AS (SELECT doc_id, phrase_id, NOT generic AS named, length(phrase) AS wide FROM texts JOIN phrases ON contains(t, ' ' || phrase || ' ')),
best AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY named DESC, wide DESC) AS rk FROM hits)
SELECT doc_id, min(phrase_id) AS phrase_id, count(*) AS n_longest FROM best WHERE rk = 1 GROUP BY 1""")
def phrases_in_texts(v):
    """The longest opening of a benchmark item that stands in a document; openings of two words are generic and come last."""
    return phrases.longest_phrase(v.raw("documents"), phrase_table(v), "text", "doc_id")


LIST = """items AS (SELECT id AS item, id % 500 AS number, set_code, name, product_type = 'PROMO' AS special, msrp AS price FROM product),
lines AS (SELECT c_custkey AS line, CASE c_custkey % 6 WHEN 0 THEN id % 500 WHEN 1 THEN id % 500 WHEN 2 THEN 900 + id % 500 END AS number, CASE WHEN c_custkey % 6 = 0 THEN set_code END AS set_code,
  CASE c_custkey % 6 WHEN 1 THEN NULL WHEN 4 THEN substring(name, 3, 5) WHEN 5 THEN 'zz' || name ELSE name END AS name, c_custkey % 7 = 0 AS special FROM customer JOIN product ON id = c_custkey)"""


def list_lines(v):
    p = v.product
    items = p.select(F.col("id").alias("item"), (F.col("id") % 500).alias("number"), "set_code", "name", (F.col("product_type") == "PROMO").alias("special"), F.col("msrp").alias("price"))
    k = F.col("c_custkey") % 6
    rows = v.raw("customer").select("c_custkey").join(p, F.col("id") == F.col("c_custkey"))
    lines = rows.select(
        F.col("c_custkey").alias("line"), F.when(k <= 1, F.col("id") % 500).when(k == 2, 900 + F.col("id") % 500).alias("number"), F.when(k == 0, F.col("set_code")).alias("set_code"),
        F.when(k == 1, None).when(k == 4, F.substring("name", 3, 5)).when(k == 5, F.concat(F.lit("zz"), F.col("name"))).otherwise(F.col("name")).alias("name"), (F.col("c_custkey") % 7 == 0).alias("special"),
    )
    return lines, items


@query(f"""{LIST},
a AS (SELECT line, arg_min(item, struct_pack(p := i.price, i := item)) AS item, count(*) AS choices FROM lines l JOIN items i ON l.number = i.number AND (l.set_code IS NULL OR l.set_code = i.set_code) GROUP BY 1),
b AS (SELECT line, arg_min(item, struct_pack(n := coalesce(l.number <> i.number, true), s := l.special <> i.special, p := i.price, i := item)) AS item, count(*) AS choices
  FROM lines l JOIN items i ON l.name = i.name WHERE line NOT IN (SELECT line FROM a) GROUP BY 1),
c AS (SELECT line, arg_min(item, struct_pack(s := l.special <> i.special, p := i.price, i := item)) AS item, count(*) AS choices
  FROM lines l JOIN items i ON contains(i.name, l.name) WHERE length(l.name) >= 3 AND line NOT IN (SELECT line FROM a) AND line NOT IN (SELECT line FROM b) GROUP BY 1)
SELECT line, coalesce(a.item, b.item, c.item) AS item, CASE WHEN a.item IS NOT NULL THEN 'number' WHEN b.item IS NOT NULL THEN 'name' WHEN c.item IS NOT NULL THEN 'part' ELSE 'none' END AS how,
       coalesce(a.choices, b.choices, c.choices, 0) AS choices FROM lines LEFT JOIN a USING (line) LEFT JOIN b USING (line) LEFT JOIN c USING (line)""")
def list_resolved(v):
    """Lines with a number and set, a number alone, a wrong number beside a name, a name, a part of one, and nothing that fits."""
    return resolve.resolved(*list_lines(v))


@query("""u AS (SELECT id, product_type, msrp, (CAST('0x' || substr(md5('pack:' || id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM product WHERE msrp > 0),
t AS (SELECT id, product_type, row_number() OVER (PARTITION BY product_type ORDER BY -ln(u) * msrp, id) AS place FROM u)
SELECT id, product_type, place FROM t WHERE place <= 20""")
def weighted_pack(v):
    """Twenty of each type without replacement, cheap ones more often: the chance is inverse to the price."""
    found = ranks.weighted_sample(v.product.where("msrp > 0"), ["product_type"], 1 / F.col("msrp"), F.col("id"), 20, "pack")
    return found.select("id", "product_type", "place")


WORDS = ("de", "des", "elle", "that")


@query(rf"""folded AS (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents WHERE text IS NOT NULL),
terms AS (SELECT unnest({list(WORDS)}) AS term),
pieces AS (SELECT doc_id, term, unnest(string_split(t, term)) AS piece, generate_subscripts(string_split(t, term), 1) AS i, len(string_split(t, term)) AS n FROM folded, terms WHERE contains(t, term)),
placed AS (SELECT doc_id, term, i, n, piece, sum(length(piece)) OVER (PARTITION BY doc_id, term ORDER BY i) + (i - 1) * length(term) AS pos FROM pieces),
starts AS (SELECT doc_id, pos, max(pos + length(term)) AS stop FROM placed WHERE i < n AND (CASE WHEN length(piece) > 0 THEN NOT regexp_matches(right(piece, 1), '[a-z0-9]') ELSE i = 1 END) GROUP BY 1, 2)
SELECT doc_id, coalesce(string_agg(CAST(pos AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY pos), '') AS ranges, count(pos) AS n FROM documents LEFT JOIN starts USING (doc_id) GROUP BY 1""")
def highlighted(v):
    """Where words of a search begin in whole texts, accents and case aside."""
    found = v.raw("documents").select("doc_id", highlight(F.col("text"), list(WORDS)).alias("r"))
    shown = F.array_join(F.transform("r", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", shown.alias("ranges"), F.size("r").cast("long").alias("n"))


def guard_sql(k: int, was: str, new: str) -> str:
    """Run k: what is stored after it and which stores wait, from the table before it and what was read."""
    return f"""j{k} AS (SELECT store, coalesce(a.h, 0) AS had, coalesce(b.m, 0) AS n, coalesce(s.waits, false) AS waited FROM (SELECT store, count(*) AS h FROM {was} GROUP BY 1) a FULL JOIN (SELECT store, count(*) AS m FROM {new} GROUP BY 1) b USING (store) LEFT JOIN s{k - 1} s USING (store)),
s{k} AS (SELECT store, had >= 3 AND n * 100 < had * 70 AND NOT (waited AND store % 10 <> 0) AS waits, n, had FROM j{k}),
r{k} AS (SELECT * FROM {new} WHERE store IN (SELECT store FROM s{k} WHERE NOT waits) UNION ALL SELECT * FROM {was} WHERE store IN (SELECT store FROM s{k} WHERE waits))"""


@query(f"""s0 AS (SELECT 0 AS store, false AS waits WHERE false), whole AS (SELECT product_id, store, price FROM offer),
short AS (SELECT product_id, store, price FROM offer WHERE NOT (store % 3 = 0 AND product_id % 2 = 0) AND NOT (store % 5 = 0 AND in_stock)),
{guard_sql(1, 'whole', 'short')}, {guard_sql(2, 'r1', 'short')}, {guard_sql(3, 'r2', 'whole')}
SELECT store, s1.waits AS waits_1, s2.waits AS waits_2, s3.waits AS waits_3, coalesce(a.n, 0) AS rows_1, coalesce(b.n, 0) AS rows_2, coalesce(c.n, 0) AS rows_3
FROM s1 JOIN s2 USING (store) JOIN s3 USING (store) LEFT JOIN (SELECT store, count(*) AS n FROM r1 GROUP BY 1) a USING (store)
LEFT JOIN (SELECT store, count(*) AS n FROM r2 GROUP BY 1) b USING (store) LEFT JOIN (SELECT store, count(*) AS n FROM r3 GROUP BY 1) c USING (store)""")
def coverage_over_runs(v):
    """A short read is kept out once and taken the second time; a marketplace's (every tenth) never."""
    # every run reads the offers several times, so they are worked out once
    offers = settled(v.offer.select("product_id", "store", "price", "in_stock"), "offers")
    whole = offers.drop("in_stock")
    short = offers.where("not (store % 3 = 0 and product_id % 2 = 0) and not (store % 5 = 0 and in_stock)").drop("in_stock")
    rows, waits, out = whole, None, None
    for k, read in enumerate((short, short, whole), 1):
        rows, waits = quality.guarded_read(read, rows, waits, "store", F.col("store") % 10 == 0, least_percent=70, least_rows=3)
        # what a run leaves is stored, as it would be between runs
        rows, waits = settled(rows, "stored"), settled(waits, "waits")
        seen = waits.select("store", F.col("waits").alias(f"waits_{k}")).join(rows.groupBy("store").agg(F.count("*").alias("n")), "store", "left")
        seen = seen.select("store", f"waits_{k}", F.coalesce("n", F.lit(0)).alias(f"rows_{k}"))
        out = seen if out is None else out.join(seen, "store")
    return out


RUNS = ((1, 100, "product_id % 2 = 0"), (2, 101, "product_id % 3 = 0"), (3, 104, "product_id % 3 <> 0"), (4, 109, "product_id % 2 = 0"))
ROOM, REST, KEPT = 40, 5, 3


def ledger_sql(run: int, day: int, now: str) -> str:
    due = "false" if run == 1 else f"l.key IS NULL OR l.posted_day IS NULL OR (l.seen_run < {run} - 1 AND {day} - l.posted_day >= {REST})"
    return f"""e{run} AS (SELECT key, score FROM deals WHERE {now}),
p{run} AS (SELECT e.key FROM e{run} e LEFT JOIN l{run - 1} l USING (key) WHERE {due} ORDER BY score DESC, e.key LIMIT {ROOM}),
l{run} AS (SELECT key, CASE WHEN e.score IS NOT NULL THEN {run} ELSE l.seen_run END AS seen_run, CASE WHEN key IN (SELECT key FROM p{run}) THEN {day} WHEN l.posted_day IS NOT NULL THEN l.posted_day WHEN {run} = 1 THEN {day} END AS posted_day
  FROM l{run - 1} l FULL JOIN e{run} e USING (key) WHERE e.score IS NOT NULL OR {run} - l.seen_run < {KEPT} OR coalesce({day} - l.posted_day < {REST}, false))"""


@query(f"""deals AS (SELECT market || '|' || slug AS key, product_id, (median_open - lowest) * 100 // median_open AS score FROM card WHERE in_stock_stores >= 2 AND lowest * 10 <= median_open * 9),
l0 AS (SELECT '' AS key, 0 AS seen_run, 0 AS posted_day WHERE false), {', '.join(ledger_sql(*r) for r in RUNS)}
SELECT key, seen_run, posted_day FROM l{RUNS[-1][0]}""")
def ledger_after_runs(v):
    """Four runs over deals that come and go: what each posts and what is still known after the last."""
    deals = v.card.where("in_stock_stores >= 2 and lowest * 10 <= median_open * 9")
    deals = deals.select(F.concat_ws("|", "market", "slug").alias("key"), "product_id", F.expr("(median_open - lowest) * 100 div median_open").alias("score"))
    ledger = v.spark.createDataFrame([], "key string, seen_run int, posted_day int")
    for run, day, now in RUNS:
        events = deals.where(now)
        posted = posting.due_posts(events, ledger, run, day, ROOM, REST)
        ledger = settled(posting.next_ledger(ledger, events, posted, run, day, REST, KEPT), "ledger")
    return ledger


@query("""RECURSIVE_o AS (SELECT o_orderkey AS seq, o_custkey % 50 AS book, (o_custkey % 50) * 10 + o_orderkey % 10 AS listing, o_custkey AS buyer, 1 + o_orderkey % 4 AS qty, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS turn FROM orders),
size AS (SELECT max(c_custkey // 50) + 1 AS n FROM customer),
wallet AS (SELECT b AS book, list(coalesce(greatest(CAST(floor(c_acctbal) AS BIGINT), 0), 0) ORDER BY k) AS bal FROM (SELECT unnest(range(0, 50)) AS b), (SELECT unnest(range(0, (SELECT n FROM size))) AS k) LEFT JOIN customer ON c_custkey = k * 50 + b GROUP BY 1),
run AS (SELECT book, 0::BIGINT AS turn, bal, [25::BIGINT for x in range(0, 10)] AS stock, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, 0::BIGINT AS paid FROM wallet
  UNION ALL
  SELECT book, turn, CASE WHEN outcome = 'sold' THEN list_transform(bal, lambda x, i: x - CASE WHEN i = buyer // 50 + 1 THEN cost ELSE 0 END + CASE WHEN i = seller // 50 + 1 THEN cost ELSE 0 END) ELSE bal END,
         CASE WHEN outcome = 'sold' THEN list_transform(stock, lambda x, i: x - CASE WHEN i = listing % 10 + 1 THEN qty ELSE 0 END) ELSE stock END, seq, outcome, CASE WHEN outcome = 'sold' THEN cost ELSE 0 END
  FROM (SELECT *, CASE WHEN stock[listing % 10 + 1] < qty THEN 'gone' WHEN seller = buyer THEN 'own' WHEN bal[buyer // 50 + 1] < cost THEN 'poor' ELSE 'sold' END AS outcome
        FROM (SELECT run.book, o.turn, bal, stock, o.seq, listing, buyer, qty, run.book + 50 * (listing % 10) AS seller, (300 + 40 * (listing % 7)) * qty AS cost FROM run JOIN o ON o.book = run.book AND o.turn = run.turn + 1)))
SELECT seq, outcome, paid FROM run WHERE seq IS NOT NULL""")
def orders_replayed(v):
    """Customers buy from ten listings of their book, each kept by one of them: stock and wallets both run out."""
    book = F.col("o_custkey") % 50
    orders = v.raw("orders").select(F.col("o_orderkey").alias("seq"), (book * 10 + F.col("o_orderkey") % 10).alias("listing"), F.col("o_custkey").alias("buyer"), (1 + F.col("o_orderkey") % 4).alias("qty"))
    n = F.col("listing") % 10
    listings = orders.select("listing").distinct().select(
        "listing", (F.expr("listing div 10") + 50 * n).alias("seller"), (300 + 40 * (F.col("listing") % 7)).alias("price"), F.lit(25).cast("long").alias("stock")
    )
    wallets = v.raw("customer").select(F.col("c_custkey").alias("account"), F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("long").alias("balance"))
    return orderbook.replay(orders, listings, wallets).select("seq", "outcome", F.col("paid").cast("long").alias("paid"))


@query("""place AS (SELECT *, row_number() OVER (PARTITION BY product_id, market ORDER BY in_stock DESC, price, store) AS place FROM offer WHERE market <> 'ASIA'),
i AS (SELECT product_id, market, list(struct_pack(store := store, price := price, in_stock := in_stock) ORDER BY place) AS offers FROM place WHERE place <= 2 GROUP BY 1, 2),
m AS (SELECT product_id, list(struct_pack(market := market, lowest := lowest, stores := in_stock_stores, offers := offers) ORDER BY market) AS markets FROM i LEFT JOIN stat USING (product_id, market) GROUP BY 1),
a AS (SELECT product_id, struct_pack(market := market, store := store, price := price, in_stock := in_stock) AS abroad FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY in_stock DESC, price, store) AS rn FROM offer WHERE market = 'ASIA') WHERE rn = 1)
SELECT id, slug, coalesce(CAST(to_json(markets) AS VARCHAR), '[]') AS markets, CAST(to_json(abroad) AS VARCHAR) AS abroad FROM product LEFT JOIN m ON m.product_id = id LEFT JOIN a ON a.product_id = id""")
def product_pages_nested(v):
    """Each product with its markets and their best two offers in them; the best offer from ASIA stands apart. As JSON for the comparison."""
    found = pages.product_pages(v.product.select("id", "slug"), v.offer.drop("seen"), v.stat, F.col("market") == "ASIA", 2)
    return found.select("id", "slug", F.to_json("markets", {"ignoreNullFields": "false"}).alias("markets"), F.to_json("abroad", {"ignoreNullFields": "false"}).alias("abroad"))
