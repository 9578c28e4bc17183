"""Spelling variants, Merkle manifests and neighbour votes: odd rows, plain Python, DuckDB and planted cases."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradewind.llm import langid, merkle, mixing, neighbours, registry, variants

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with odd rows added to documents."""
    path = str(tmp_path_factory.mktemp("sf"))
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(90001, None, None, None, None), (90002, "", None, "src1", 0), (90003, "Straßenbahn straßenbahn ÉCOLES écoles " * 20, "", "src2", 7), (90004, "alone", "xx", None, None), (None, "nobody knows somebody " * 3, "de", "src0", 4), (90005, "日本語 × ÷ naïveté naïvetés", "日", "s", 9)]
    real.unionByName(spark.createDataFrame(odd, real.schema)).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


@pytest.mark.parametrize("name", ["op11_variants", "op12_merkle"])
def test_query_and_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, folder).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    value = lambda x: None if pd.isna(x) else int(x) if isinstance(x, (float, np.integer)) else x
    plain = lambda df: Counter(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    return any(a[:i] + a[i + (len(a) == len(b)) :] == b[:i] + b[i + 1 :] for i in range(len(b)))


def counted(rows):
    n = Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            n[w] += len(w) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def expected(n):
    near = {w: set() for w in n}
    for a, b in combinations(n, 2):
        if one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {w: min(x, key=lambda o: (-n[o], o)) for w, x in near.items() if x}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_against_all_pairs(spark):
    """Few rows, so that all pairs of words can be compared: planted forms, chains, ties, dense lists and very long words."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 12))) for _ in range(60)]
    text = " ".join(w if rng.random() < 0.7 else w[: (i := rng.randrange(len(w)))] + rng.choice("abcé") * rng.randrange(3) + w[i + 1 :] for w in rng.choices(base, k=2500))
    text += " wonderful" * 800 + " wonderfull" * 50 + " wondrfull" * 3 + " tiewordx tiewordx" + " tiewordy" * 30 + " tiewordz" * 30
    rows = [(i, t) for i, t in enumerate(text[k : k + 900] for k in range(0, len(text), 900))]
    long = "x" * 200 + "y" * 300
    rows += [(1000, f"{long}a " * 3 + f"{long}b " * 3 + f"{long} " * 40 + "q" * 20_000 + " " + "q" * 20_000), (1001, None), (1002, ""), (None, "nullids nullids nullidz nullidz"), (None, "nullids"), (1000, "nullids")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as id", "4 as key", "5 as a")
    want = expected(counted([{"doc_id": i, "text": t} for i, t in rows]))
    assert any(f for _, f, *_ in want) and any(r not in (w, f) for w, f, r, *_ in want)
    for dense in (64, 2):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        try:
            got = {tuple(r) for r in variants.spelling_variants(df, dense=dense).select(COLUMNS).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_variants_of_nothing(spark, odd_docs, no_docs):
    assert variants.spelling_variants(no_docs).count() == 0
    assert variants.spelling_variants(odd_docs).columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert variants.near("abc", "abd") and variants.near("abc", "abcd") and variants.near("xabc", "abc") and not variants.near("abc", "abc") and not variants.near("abcd", "ab")


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def side(tree, at):
    out = []
    for level in tree[:-1]:
        out += [level[at ^ 1]] if at ^ 1 < len(level) else []
        at //= 2
    return out


def test_merkle_query_against_plain_trees(spark, folder, docs):
    got = {r["doc_id"]: r for r in merkle.op12_merkle(spark, folder).collect()}
    groups = {}
    for r in docs:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, digest(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]))), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf for _, _, leaf, _ in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    assert set(got) == {r["doc_id"] for r in docs}
    for at, g in enumerate(names):
        for place, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            row, path = got[r["doc_id"]], side(trees[g], place) + side(top, at)
            assert (row["leaf"], row["subroot"], row["root"], row["proof_sha256"]) == (leaf, trees[g][-1][0], top[-1][0], digest(*path))
            touched = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            assert row["verified"] == (not touched) == (row["folded_root"] == row["root"])


def test_merkle_of_odd_tables(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(merkle, "CLIMB", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        many = spark.range(300).selectExpr("id as doc_id", "concat('t', id) as text", "if(id < 290, 'a', null) as lang", "1 as g", "2 as n", "3 as leaf", "4 as place", "5 as root")
        for df in (many, odd_docs, many.where("doc_id < 1"), many.where("doc_id < 3").union(many.where("doc_id < 3"))):
            rows = merkle.proofs(df, ["doc_id", "text"], "lang", "doc_id", {"id": F.col("doc_id"), "t": F.col("text")})
            rows = rows.withColumn("check", merkle.folded("leaf")).collect()
            assert len(rows) == df.count() and all(r["check"]["folded_root"] == r["root"] for r in rows) and len({r["root"] for r in rows}) == 1
            assert all(merkle.fold(digest("tampered"), r["place"], r["leaves"], bytes(r["siblings"])) != r["subroot"] for r in rows)
        ordered = sorted(((r["group_place"], r["place"]), r["leaf"]) for r in merkle.proofs(many, ["doc_id", "text"], "lang", "doc_id", {}).collect())
        want = [levels([digest(field(i), field(f"t{i}")) for i in ids]) for ids in (range(290, 300), range(290))]
        assert [leaf for _, leaf in ordered] == want[0][0] + want[1][0]
        assert merkle.proofs(no_docs, ["doc_id"], "lang", "doc_id", {}).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def voted(model, text):
    """The vote recomputed from the text, a neighbour at a time."""
    x = np.zeros(len(model.weights))
    for f, n in neighbours.tally(text).items():
        if f in model.number:
            x[model.number[f]] = np.sqrt(n)
    x *= model.weights
    for part, length in ((slice(0, model.shapes), 1.0), (slice(model.shapes, None), neighbours.WORD_WEIGHT)):
        norm = np.linalg.norm(x[part])
        x[part] = x[part] / norm * length if norm else x[part]
    z = x @ model.axes
    if not np.linalg.norm(z):
        return model.share
    cosines = model.voters.astype(float) @ (z / np.linalg.norm(z))
    near = np.argsort(-cosines)[: neighbours.NEIGHBOURS]
    weight = np.maximum(cosines[near], 0) ** neighbours.SHARPNESS * model.stands[near]
    return (weight * model.votes[near]).sum() / weight.sum()


def test_votes_against_one_neighbour_at_a_time(spark, folder, docs):
    got = {r["doc_id"]: r for r in neighbours.op13_quality(spark, folder).collect()}
    assert set(got) == {r["doc_id"] for r in docs}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    learned = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    model = neighbours.train(frame, spark.createDataFrame(learned, labels.schema))
    for r in docs:
        row = got[r["doc_id"]]
        assert abs(row["score"] - voted(model, r["text"])) < 2e-3
        assert row["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0)
        assert row["predicted"] == int(row["score"] >= 0.3) and 0 <= row["score"] <= 1


def test_held_out_votes(spark):
    sf = "/root/testdata/sf0.01"
    got = neighbours.op13_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    good, poor = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > poor[None, :]).mean() >= 0.97 and (good >= 0.3).mean() >= 0.98


def test_votes_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 1), (4, 0), (9, 0), (8, None), (77, 1)], "doc_id long, quality int")
    model = neighbours.train(odd_docs, labels)
    found = neighbours.with_quality(odd_docs, model)
    assert found.columns == [*odd_docs.columns, "quality"] and found.count() == odd_docs.count()
    scores = {r["doc_id"]: r["quality"] for r in found.collect()}
    assert scores[3] == scores[5] == pytest.approx(model.share) and all(0 <= x <= 1 for x in scores.values())
    assert neighbours.with_quality(no_docs, model).count() == 0
    for few, share in ((labels.limit(0), 0.0), (labels.where("quality = 1"), 1.0)):
        one = neighbours.train(odd_docs, few)
        assert {r["quality"] for r in neighbours.with_quality(odd_docs, one).collect()} == {share}
    assert neighbours.train(no_docs, labels).share == 0.0


def test_cut_labels_stand_for_all(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("BUY NOW!! $$$ "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("a quiet line of prose number "), F.col("id").cast("string"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    model = neighbours.train(docs, labels, most=60)
    assert len(model.voters) == 60 and model.share == pytest.approx(0.9)
    scores = neighbours.with_quality(docs, model).select("doc_id", "quality").collect()
    assert all((r["quality"] < 0.3) == (r["doc_id"] % 10 == 0) for r in scores)


@pytest.mark.parametrize("share", [[0.6, 0.4], [0.05, 0.95], [0.9, 0.6]])
def test_rates_within_a_box_are_the_minimum(spark, share):
    rng = np.random.default_rng(2)
    tokens, p = rng.integers(1, 40, 30), rng.dirichlet([0.4, 0.4], 30).round(3)
    p[:, 1] = 1 - p[:, 0]
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "n_tokens long, p array<double>")
    a, budget = (p * tokens[:, None]).T, tokens.sum()
    targets = np.array(share) * budget
    rate, reached = mixing.fit_rates(rows, targets.tolist(), most=1.5, strict=False)
    got = [r["r"] for r in rows.select(rate.alias("r")).collect()]
    assert min(got) >= 0 and max(got) <= 1.5 and np.allclose(a @ got, reached)
    best, size = np.ones(30), np.linalg.norm(a @ a.T, 2)
    for _ in range(60_000):
        best = np.clip(best - a.T @ (a @ best - targets) / size, 0, 1.5)
    assert np.linalg.norm(a @ got - targets) <= np.linalg.norm(a @ best - targets) + 2e-3 * budget


def test_rates_that_do_not_settle_give_the_nearest_totals(spark):
    rows = spark.createDataFrame([(10, [0.5, 0.5]), (10, [0.9, 0.1])], "n_tokens long, p array<double>")
    rate, reached = mixing.fit_rates(rows, [1.0, 19.0], steps=0, strict=False)
    assert [r["r"] for r in rows.select(rate.alias("r")).collect()] == [1.0, 1.0] and reached == pytest.approx([14.0, 6.0])


def test_signs_like_letters_are_none(spark):
    model = langid.Languages({"en": ["the of and to in that is was for on"] * 4, "fr": ["le la les des une dans pour que qui sur"] * 4})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ²", "Ⅷ ①", "́ ̈", "12 34", "the½of²and", "Ⅷ le la des"])], "i int, text string")
    got = {r["i"]: (r["language"]["lang"], r["language"]["score"]) for r in langid.with_language(docs, model).collect()}
    assert [got[i] for i in range(4)] == [("und", 0.0)] * 4 and got[4][0] == "en" and got[5][0] == "fr"
    assert langid.words_of("a½b c²") == ["a", "b", "c"]
