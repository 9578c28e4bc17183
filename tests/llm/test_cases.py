"""Odd rows and empty tables through every operator."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import brown, decontaminate, host_rules, langid, mixing, pii, reshard, simhash, tokens, toxicity
from tradewind.llm.store import scratch_path


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontaminate_odd(spark, odd_docs, no_docs):
    b = bench(spark, [(1, "Seven small birds watch from the old wall nearby"), (2, None), (3, ""), (None, "un deux"), (4, "X"), (4, "x")])
    found = {(r["doc_id"], r["text"]): r["contamination"] for r in decontaminate.with_matches(odd_docs, b).collect()}
    assert all(h["hit"] == [[10, 19]] for (i, _), h in found.items() if i in (1, 2, 7))
    assert found[3, None]["n_words"] == 0 and found[3, None]["hit"] == []
    assert [m["item_id"] for m in found[8, "x"]["matches"]] == [4, 4]
    named = spark.createDataFrame([("k1", "un deux"), (None, "x")], "item_id string, text string")
    by_name = {r["doc_id"]: [m["item_id"] for m in r["contamination"]["matches"]] for r in decontaminate.with_matches(odd_docs, named).collect()}
    assert by_name[9] == ["k1"] and by_name[8] == [None] and by_name[6] == []
    hit9 = found[9, "un deux trois quatre cinq"]
    assert hit9["hit"] == [[0, 2]] and hit9["matches"][0]["item_id"] is None
    kept = decontaminate.decontaminated(odd_docs, b)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, None}
    assert decontaminate.decontaminated(no_docs, b).count() == 0
    assert decontaminate.decontaminated(odd_docs, b.limit(0)).count() == odd_docs.count()


def test_decontaminate_blocks_agree(spark, odd_docs, monkeypatch):
    b = bench(spark, [(1, "seven small birds watch from the old wall nearby"), (2, "a lazy dog while seven small birds watch from the old wall"), (3, "un deux trois")])
    want = sorted(map(str, decontaminate.with_matches(odd_docs, b).select("doc_id", "contamination.hit").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    assert sorted(map(str, decontaminate.with_matches(odd_docs, b).select("doc_id", "contamination.hit").collect())) == want


def test_longest_match():
    item = " ".join(f"w{i}" for i in range(30))
    test = decontaminate.TestSuffixes([(7, item)])
    found = decontaminate.scan([f"a b {' '.join(f'w{i}' for i in range(3, 25))} c"], test)[0]
    assert found["matches"] == [[7, 3, 2, 22]] and found["hit"] == [[2, 24]]


def test_longest_matches_against_brute_force(monkeypatch):
    """Every item against every place, over few words, so that windows recur and items share them; also in small chunks of pairs."""
    rng = np.random.default_rng(11)
    for _ in range(150):
        monkeypatch.setattr(decontaminate, "PAIRS", int(rng.choice([1, 9, 60, 4_000_000])))
        window = int(rng.choice([2, 3, 10]))
        items = [(i, " ".join(rng.choice(["a", "b"], rng.integers(0, 14)))) for i in range(5)]
        docs = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 25))) for _ in range(4)]
        for text, row in zip(docs, decontaminate.scan(docs, decontaminate.TestSuffixes(items, window)), strict=True):
            words, hit, best = text.split(), set(), {}
            for i, x in ((i, t.split()) for i, t in items):
                for p in range(len(words)):
                    for j in range(len(x)):
                        k = 0
                        while p + k < len(words) and j + k < len(x) and words[p + k] == x[j + k]:
                            k += 1
                        if k >= min(window, len(x)):
                            hit |= set(range(p, p + k))
                            best[i] = min(best.get(i, (0, 0, 0)), (-k, p, j))
            assert {q for a, b in row["hit"] for q in range(a, b)} == hit
            assert sorted((m[0], -m[3], m[2], m[1]) for m in row["matches"]) == sorted((i, *b) for i, b in best.items())


def test_repeated_windows_do_not_multiply():
    """One word over and over, in many items: a match an item, not one for each pair of places."""
    test = decontaminate.TestSuffixes([(i, " ".join(["again"] * 300)) for i in range(20)])
    (found,) = decontaminate.scan([" ".join(["again"] * 2000)], test)
    assert found["hit"] == [[0, 2000]] and [m[1:] for m in found["matches"]] == [[0, 0, 300]] * 20


def test_simhash_odd(odd_docs, no_docs):
    rows = [tuple(r) for r in simhash.near_duplicates(odd_docs).collect()]
    assert len(rows) == odd_docs.count()
    assert {(i, c) for i, _, c in rows if i in (1, 2, 7)} == {(1, 1), (2, 1), (7, 1)}
    assert {(i, f, c) for i, f, c in rows if i in (3, 4, 5)} == {(3, 0, 3), (4, 0, 3), (5, 0, 3)}
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 6, 8, 9]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0


def test_simhash_dense_bucket(spark):
    """A hot bucket takes the way through one-bit changes; the links connect the same nodes as all pairs do."""
    rng = np.random.default_rng(3)
    values = {0}
    for _ in range(300):
        values.add(int(rng.choice(list(values))) ^ (1 << int(rng.integers(0, 12))))
    values |= {int(x) for x in rng.integers(0, 2**62, 50)}
    values = sorted(values)
    links = simhash.close_pairs(spark.createDataFrame([(v,) for v in values], "fp long")).collect()

    def classes(pairs):
        of = {v: v for v in values}

        def top(x):
            while of[x] != x:
                x = of[x]
            return x

        for a, b in pairs:
            x, y = top(a), top(b)
            of[max(x, y)] = min(x, y)
        return {v: top(v) for v in values}

    every = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    assert classes(links) == classes(every)


def test_components(spark):
    from tradewind.llm.graph import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_host_rules(spark, odd_docs, no_docs):
    judged = host_rules.judge(odd_docs)
    rows = judged.collect()
    assert len(rows) == odd_docs.count() and "verdict" in judged.columns
    kept = host_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 7, None}
    assert host_rules.keep_good(no_docs).count() == 0
    assert host_rules.measure("a b\n\na b\nc") == (5, 5, 0, 1, 0, 3)
    assert host_rules.measure("a b c d e a b c d e") == (10, 10, 0, 0, 10, 1)


def test_bad_host_drops_only_failing_rows(spark):
    """One of 30 hosts fails the symbol rule far more often than the rest: its failing rows go, and only they."""
    good, junk = " ".join(f"plain{i}" for i in range(20)), " ".join(f"j{i}$$" for i in range(20))
    rows = [(100 * h + i, junk if i < (36 if h == 7 else h % 3) else good, f"h{h}") for h in range(30) for i in range(40)]
    rows += [(9000 + i, "too short", "h1") for i in range(3)]
    got = {r["doc_id"]: (r["source"], r["text"], r["verdict"]) for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {source for source, _, v in got.values() if v["host_bad"]} == {"h7"}
    for source, text, v in got.values():
        assert v["kept"] == (text == good or (text == junk and source != "h7"))
        assert v["failed"] == (["symbols"] if text == junk else ["words"] if text == "too short" else [])
    assert sum(not v["kept"] and not v["base_failed"] for _, _, v in got.values()) == 36


def test_alike_hosts_are_not_bad(spark):
    rng = np.random.default_rng(6)
    counts = spark.createDataFrame([(f"h{h}", 500, [int(x) for x in rng.binomial(500, 0.2, len(host_rules.RULES))]) for h in range(40)], "h string, n long, failed array<long>")
    rows = host_rules.host_verdicts(counts).collect()
    assert sum(any(r["bad"]) for r in rows) <= 2 and all(0.15 < x < 0.25 for r in rows for x in r["rates"])


def test_toxicity(spark, odd_docs, no_docs):
    rng = np.random.default_rng(0)
    texts = [". ".join(" ".join(f"w{rng.integers(300)}" for _ in range(6)) for _ in range(5)) for _ in range(300)]
    labels = [i % 4 == 0 for i in range(300)]
    texts = [t + (". you vile worm" if y else "") for t, y in zip(texts, labels, strict=True)]
    model = toxicity.NoisyOr.fit(texts[:200], list(map(int, labels[:200])))
    scores = [model.score(t) for t in texts[200:]]
    assert np.mean([(s >= 0.5) == y for s, y in zip(scores, labels[200:], strict=True)]) > 0.97
    each = model.sentence_scores("w1 w2 w3. you vile worm. w4 w5")
    assert int(np.argmax(each)) == 1
    found = toxicity.with_toxicity(odd_docs, model).select("doc_id", "toxicity.score", "text").collect()
    assert len(found) == odd_docs.count() and all(r["score"] == 0 for r in found if not (r["text"] or "").strip())
    assert toxicity.with_toxicity(no_docs, model).count() == 0
    odd = "É w1 w2!  ... you vile worm.\n\n w4 ü\n."
    assert [odd[a:b] for a, b in toxicity.sentence_spans(odd)] == ["É w1 w2!", "you vile worm.", "w4 ü"]
    assert len(toxicity.sentence_spans(odd)) == len(toxicity.sentences(odd)) and toxicity.sentence_spans(None) == []
    where = toxicity.with_toxicity(spark.createDataFrame([(odd,)], "text string"), model).select("toxicity.worst").first()["worst"]
    assert [odd[x["start"] : x["end"]] for x in where] == ["you vile worm."]
    none = toxicity.train(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.score("anything at all") < 1e-6


def test_toxicity_keeps_the_ratio_of_labels(spark):
    """3 in 10 clean documents have a word that all toxic ones have: too few toxic ones to flag it, however small the sample."""
    rng = np.random.default_rng(4)
    toxic = [i % 20 == 0 for i in range(4000)]
    texts = [" ".join(f"w{rng.integers(8)}" for _ in range(6)) + (" vile" if y or rng.random() < 0.3 else "") for y in toxic]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    small = toxicity.train(docs, labels, most=400)
    fresh = [" ".join(f"w{rng.integers(8)}" for _ in range(6)) + " vile" for _ in range(200)]
    assert np.mean([small.score(t) >= 0.5 for t in fresh]) < 0.3


def test_langid(spark, odd_docs, no_docs):
    en = ["the house and the garden with a tree", "this is what they want for the evening", "where are the children going"]
    fr = ["la maison et le jardin avec un arbre", "voici ce que nous voulons pour la soirée", "où vont les enfants ce soir"]
    ru = ["это дом и сад", "куда идут дети"]
    model = langid.Languages({"en": en, "fr": fr, "ru": ru})
    assert model.predict("the evening garden")[0] == "en" and model.predict("la soirée avec les enfants")[0] == "fr"
    assert model.predict("дети")[0] == "ru" and model.predict("1234 !?")[0] == "und" and model.predict(None)[0] == "und"
    mixed = " ".join(en * 3 + fr * 3)
    assert [s[2] for s in model.spans(mixed)] == ["en", "fr"]
    rows = langid.with_language(odd_docs, model).select("doc_id", "language.lang", "text").collect()
    assert len(rows) == odd_docs.count() and {r["lang"] for r in rows if not (r["text"] or "").strip()} == {"und"}
    assert langid.with_language(no_docs, langid.train(no_docs)).count() == 0


def test_langid_path_is_the_best_of_all():
    """Viterbi against every path, for texts of few words; and a batch labels each text as it does alone."""
    en, fr, de = "the house and garden", "la maison et le jardin avec", "das haus und der garten"
    model = langid.Languages({"en": [en], "fr": [fr], "de": [de]})
    rng, pool = np.random.default_rng(1), (en + " " + fr + " " + de).split()
    texts = [" ".join(rng.choice(pool, rng.integers(1, 8))) for _ in range(40)] + [None, "", "12 !", f"{fr} {fr} {de} {de}"]
    for text in texts[:40]:
        words, path = model.label(text)
        ids = [model.known[w] for w in words]
        cost = lambda p, ids=ids: model.scores[ids, list(p)].sum() - langid.SWITCH * np.count_nonzero(np.diff(p))
        assert cost(path) >= max(map(cost, itertools.product(range(3), repeat=len(words)))) - 1e-9
    together = list(model.predict_all(texts))
    alone = langid.Languages({"en": [en], "fr": [fr], "de": [de]})
    assert together == [alone.predict(t) for t in texts] and together[40:43] == [("und", 0.0, [])] * 3


def test_langid_gram_sums():
    """The vectorized sums of n-gram rows against a sum over grams()."""
    model = langid.Languages({"en": ["the house"], "fr": ["la maison à l'été"]})
    words = ["the", "maison", "été", "x", "日本語", "zzzz"]
    keys = model.keys.tolist()
    for word, got in zip(words, model._gram_sums(words), strict=True):
        rows = []
        for g in langid.grams(word):
            (key,) = langid._gram_keys([g]).tolist()
            rows.append(model.table[keys.index(key) if key in keys else len(keys) + langid.ORDERS.index(len(g))])
        assert np.allclose(got, np.sum(rows, axis=0))


def test_langid_training_is_bounded(spark):
    rows = [(i, f"word{i % 50} le jardin", "fr") for i in range(300)] + [(i, f"house{i} the", "en") for i in range(20)] + [(1, None, "en"), (2, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, most=10, every=16)
    assert model.names == ["en", "fr"] and len(model.common) <= 8 * 2 + 8 * 3
    assert langid.train(docs).predict("le jardin")[0] == "fr"


def test_tokens(spark, odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, vocabulary = scratch_path(spark, "t"), public_tokenizers.path(tokens.VOCABULARY)
    tokens.write_tokens(odd_docs, path, vocabulary, files=3)
    plain = Tokenizer.from_file(vocabulary)
    rows = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == odd_docs.count()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
        assert list(r["ids"]) in [plain.encode(t or "", add_special_tokens=False).ids + [0] for t in texts[r["doc_id"]]]
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids == sorted(ids)
    crc = {r["start"]: r["ids_crc32"] for r in tokens.with_start(tokens.with_checksum(spark.read.orc(path)), spark.read.orc(path)).collect()}
    assert crc == {r["start"]: zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in rows}
    assert tokens.find_documents(spark, path, [8]).count() == 1
    assert "PushedFilters: [In(doc_id" in tokens.find_documents(spark, path, [8, 9])._jdf.queryExecution().toString()
    empty = scratch_path(spark, "t")
    tokens.write_tokens(no_docs, empty, vocabulary)
    assert tokens.read_tokens(spark, empty).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "\n", "a\nb c's", "x<|endoftext|>y", "tab\tand more", "\0 z", "", "it's 1 2,3"])
def test_encoder_pieces(text):
    import public_tokenizers

    e = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    assert e.encode([text, text])[1] == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids + [0], dtype="<u4").tobytes()


def test_encoder_forgets(monkeypatch):
    """However few pieces are remembered, ids are those of the plain tokenizer."""
    import public_tokenizers

    monkeypatch.setattr(tokens, "KNOWN_PIECES", 40)
    e, rng = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY)), np.random.default_rng(2)
    for _ in range(30):
        texts = [" ".join(f"w{rng.integers(60)}{rng.choice(['', ',', '\u00a0x', '  '])}" for _ in range(20)) for _ in range(5)]
        assert e.encode(texts) == [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids + [0], dtype="<u4").tobytes() for t in texts]
        assert len(e.known) <= 40 + 2


def test_reshard(spark, odd_docs, no_docs):
    found = reshard.reshard(odd_docs)
    assert found.columns == [*odd_docs.columns, "shard_", "slot", "moved"]
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard_"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert reshard.reshard(no_docs).count() == 0


def test_reshard_matches_rows_by_number(spark):
    """A group of equal rows is not gathered, and a hot id spreads over blocks."""
    rows = spark.range(6000).selectExpr("if(id < 4000, null, id) as doc_id", "if(id < 4000, null, 'abc') as text", "'a' as source")
    found = reshard.reshard(rows)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = found.collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 6000 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sum(r["doc_id"] is None and r["text"] is None for r in got) == 4000 and len({r["doc_id"] for r in got}) == 2001


def test_reshard_sizes_and_moves(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(10 + id % 90 as int)) as text", "if(id % 3 = 0, 'hot', cast(id % 7 as string)) as source")
    got = reshard.reshard(rows).collect()
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + len(r["text"]) + 1
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 4 * 101


def test_min_cost_flow_is_least():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(0, 50, 4).tolist()
        caps = reshard.even_capacities(sum(sizes), 6)
        flow = reshard.min_cost_flow(sizes, caps)
        assert [sum(f for (o, _), f in flow.items() if o == i) for i in range(4)] == sizes
        moved = sum(f for (o, n), f in flow.items() if o != n)
        assert moved == sum(sizes) - sum(min(s, c) for s, c in zip(sizes, caps))


def test_reshard_cuts_within_blocks(spark, monkeypatch):
    """Small blocks and large ones: every row has a shard, sizes are near even, and the bytes moved are the least."""
    rows = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 70 as int)) as text", "cast(pmod(hash(id), 5) as int) as old")
    for size in (400, 10_000, 1 << 25):
        monkeypatch.setattr(reshard, "BLOCK_BYTES", size)
        got = reshard.reshard(rows, F.col("old")).collect()
        sizes, olds = {}, {}
        for r in got:
            sizes[r["shard"]] = sizes.get(r["shard"], 0) + len(r["text"]) + 1
            olds[r["old"]] = olds.get(r["old"], 0) + len(r["text"]) + 1
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert len(got) == 3000 and all(sorted(s) == list(range(len(s))) for s in by.values())
        assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 6 * 71
        least = sum(olds.values()) - sum(min(n, sum(olds.values()) // 16) for n in olds.values())
        assert abs(sum(len(r["text"]) + 1 for r in got if r["moved"]) - least) <= 5 * 71


def test_rewrite_leaves_other_files_alone(spark, tmp_path):
    """Of five shards one is much too large: it gives rows to one that lacks some, the rest keep their files."""
    shard = "if(id < 700, 0, if(id < 800, 4, 1 + id % 3))"
    docs = spark.range(2000).selectExpr("id as doc_id", "'abc' as text", f"cast({shard} as int) as shard")
    docs = docs.selectExpr("*", "row_number() over (partition by shard order by doc_id) - 1 as slot")
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    reshard.write_shards(docs, old)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "old").glob("shard=*/*.parquet")}
    changed, moves = reshard.rewrite(spark, old, new, 5, slack=0.05)
    assert changed == [0, 4] and set(moves) == {(0, 4)}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "old").glob("shard=*/*.parquet")} == before
    assert {p.name for p in (tmp_path / "new").glob("shard=*")} == {"shard=0", "shard=4"}
    kept = spark.read.parquet(old).where("shard in (1, 2, 3)").unionByName(spark.read.parquet(new))
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(2000))
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) <= 400 * 1.05 + 2


def test_pii(odd_docs, no_docs):
    text = "mail a.b@c.org, iban DE89 3704 0044 0532 0130 00 card 4111 1111 1111 1111 call +1 (415) 555-2671 ip 10.0.0.300 10.0.0.3"
    kinds = [(k, text[s:e]) for k, s, e, _ in pii.find_spans(text)]
    assert kinds == [("email", "a.b@c.org"), ("ip", "10.0.0.3"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (415) 555-2671"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert not pii.find_spans("DE89 3704 0044 0532 0130 01") and pii.mod97("GB82WEST12345698765432") and not pii.luhn("4111111111111112")
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert [s[0] for s in pii.find_spans(f'token = "{key}"')] == ["secret"] and not pii.find_spans(f"the digest {key}")
    assert not pii.find_spans("secret aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 abcdefghijklmnopqrstuvwxyz")
    assert not pii.find_spans("order GB82WEST12345698765432") and [s[0] for s in pii.find_spans("order, bank account GB82WEST12345698765432")] == ["iban"]
    assert [s[0] for s in pii.find_spans("my social security number 123-45-6789")] == ["ssn"] and not pii.find_spans("part 123-45-6789")
    near, far = pii.find_spans("visa card 4111111111111111"), pii.find_spans("serial 4111111111111111")
    assert near[0][3] > far[0][3]
    found = pii.with_spans(odd_docs)
    assert found.count() == odd_docs.count() and pii.with_spans(no_docs).count() == 0
    masked = pii.masked(found.sparkSession.createDataFrame([(text,), (None,)], "text string").transform(pii.with_spans))
    assert [r["text"] for r in masked.collect()] == ["mail [email], iban [iban] card [card] call [phone] ip 10.0.0.300 [ip]", None]


def test_brown(spark, odd_docs, no_docs):
    model, counts, total, types = brown.train(odd_docs)
    found = brown.score(odd_docs, model, counts, total, types)
    rows = found.collect()
    assert len(rows) == odd_docs.count() and all(r["n_tokens"] == r["n_known"] for r in rows)
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5))
    m0, c0, n0, v0 = brown.train(no_docs)
    assert (n0, v0) == (0, 0) and brown.score(no_docs, m0, c0, n0, v0).count() == 0
    assert brown.score(odd_docs, m0, c0, n0, v0).agg(F.sum("n_known")).first()[0] == 0


def test_brown_rare_words_are_joined(spark, odd_docs, monkeypatch):
    model, counts, total, types = brown.train(odd_docs)
    want = sorted((str(r["doc_id"]), r["n_known"], round(r["score"], 6), round(r["base_score"], 6)) for r in brown.score(odd_docs, model, counts, total, types).collect())
    monkeypatch.setattr(brown, "FREQUENT", 30)
    model, counts, total, types = brown.train(odd_docs)
    assert len(model.count) <= 31
    got = sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6)) for r in brown.score(odd_docs, model, counts, total, types).collect())
    assert got == [(a, b, d) for a, b, _, d in want]


def test_brown_classes_are_probabilities(spark):
    docs = spark.createDataFrame([(i, "a b c a b d") for i in range(5)] + [(9, "d c b x1 y2")], "doc_id long, text string")
    model, counts, total, types = brown.train(docs)
    assert np.allclose((10**model.jump).sum(axis=1), 1)
    by = {}
    for r in counts.collect():
        k = model.class_of(r["word"].encode())
        by[k] = by.get(k, 0) + (r["c"] + 1) / 10 ** model.room[k]
    assert all(v < 1 + 1e-9 for v in by.values())


def test_brown_assigns_by_exchange(spark, monkeypatch):
    """Words and pools beyond the clustered ones take the class whose contexts they have: tested against a plain count."""
    monkeypatch.setattr(brown, "CLUSTERED", 8)
    monkeypatch.setattr(brown, "ASSIGNED", 5)
    rng = np.random.default_rng(3)
    nouns, verbs = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(12)]
    pick = lambda pool: pool[int(12 * rng.random() ** 2)]
    texts = [" ".join(f"{pick(nouns)} {pick(verbs)}" for _ in range(20)) for _ in range(80)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model, counts, _, _ = brown.train(docs)
    ranked = [w for w in model.count if w != b"\n"]
    seeds = {w: model.cluster[w] for w in [*ranked[:8], b"\n"]}
    k = max(seeds.values()) + 1
    seen, pairs = np.zeros((k + 1, k + 1)), {}
    for t in texts:
        stream = [b"\n", *t.encode().split(), b"\n"]
        for a, b in zip(stream, stream[1:]):
            x, y = seeds.get(a, k), seeds.get(b, k)
            seen[x, y] += 1
            pairs.setdefault(a, []).append(("after", y))
            pairs.setdefault(b, []).append(("before", x))
    log = np.log(seen + 0.5)
    for w in ranked[8:13]:
        gain = [sum(log[c, y] if side == "after" else log[y, c] for side, y in pairs[w]) - len(pairs[w]) / 2 * (np.log(seen[c].sum() + 0.5) + np.log(seen[:, c].sum() + 0.5)) for c in range(k)]
        assert model.cluster[w] == int(np.argmax(gain))
    assert model.class_of(b"never") == model.pools[brown.pool_of(b"never")]


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    n, groups = 24, 3
    of = np.arange(n) % groups
    rng.shuffle(of)
    counts = np.where(of[None, :] == (of[:, None] + 1) % groups, 20, 0) + rng.integers(0, 3, (n, n))
    got = brown.exchange(counts.astype(float), groups)
    assert len({(a, b) for a, b in zip(of.tolist(), got.tolist(), strict=True)}) == groups


def test_mixing(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (77, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labelled = mixing.domain_labels(labels)
    targets = {"good": 0.5, "poor": 0.5}
    rates, mix = mixing.rated(odd_docs, labelled, targets)
    rows = rates.collect()
    assert len(rows) == odd_docs.count() and all(r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-9 for r in rows)
    assert {r["n_tokens"] for r in rows if r["id"] in (3, 4, 5)} == {1}
    budget = sum(r["n_tokens"] for r in rows)
    for i, d in enumerate(sorted(targets)):
        assert abs(sum(r["n_tokens"] * r["p"][i] * r["rate"] for r in rows) / budget - mix.reached[d]) < 1e-6
    assert mixing.mixed(odd_docs, labelled, targets).columns == odd_docs.columns
    assert mixing.mixed(no_docs, labelled, targets).count() == 0 and mixing.rated(no_docs, labelled, targets)[0].count() == 0
    assert mixing.rated(odd_docs, labelled.limit(0), targets)[0].count() == odd_docs.count()


def test_mixing_copies_are_those_of_the_rates(spark):
    docs = spark.createDataFrame([(i, ("good plain words here " if i % 3 else "junk junk junk ") * (1 + i % 5) + f"u{i}") for i in range(240)], "doc_id long, text string")
    labels = mixing.domain_labels(docs.selectExpr("doc_id", "cast(doc_id % 3 != 0 as int) as quality", "0 as toxic").where("doc_id < 150"))
    rates, mix = mixing.rated(docs, labels, {"good": 0.9, "poor": 0.1})
    want = {r["id"]: r["copies"] for r in rates.collect() if r["copies"]}
    got = {r["doc_id"]: r["n"] for r in mixing.mixed(docs, labels, {"good": 0.9, "poor": 0.1}).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == want and mix.residual < 1e-3 and mix.model.loss < mix.model.prior_loss / 2


def least_squares(a: np.ndarray, targets: np.ndarray, steps: int = 60_000) -> np.ndarray:
    """Nonnegative rates nearest to the targets: coordinate steps of projected gradient with restarts, from 1."""
    r = v = np.ones(a.shape[1])
    scale = 1 / np.sqrt(a.sum(axis=0))
    b = a * scale  # rates weighed by tokens
    size, pace, x = 1 / np.linalg.norm(b @ b.T, 2), 1.0, r / scale
    v = x
    for _ in range(steps):
        new = np.maximum(0, v - size * b.T @ (b @ v - targets))
        pace = 1.0 if (v - new) @ (new - x) > 0 else pace
        more = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        v, x, pace = new + (pace - 1) / more * (new - x), new, more
    return x * scale


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mixing_query_is_the_least_squares_point(spark, sf):
    """The query's totals against the minimum of the distance over its own posteriors; where the targets are in reach it reaches them."""
    found = mixing.op3_mixing(spark, f"/root/testdata/{sf}").toPandas()
    p = found[[f"p_{d}" for d in sorted(mixing.TARGETS)]].to_numpy()
    n, rate = found["n_tokens"].to_numpy(dtype=float), found["rate"].to_numpy()
    budget, wanted = n.sum(), np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)])
    kinds, of = np.unique(p, axis=0, return_inverse=True)
    tokens_of = np.bincount(of, weights=n) / budget
    best = np.linalg.norm((tokens_of[:, None] * kinds).T @ least_squares((tokens_of[:, None] * kinds).T, wanted, 20_000) - wanted)
    got = np.linalg.norm((n[:, None] * p).T @ rate / budget - wanted)
    assert (rate >= 0).all() and got <= best + 1e-4 and np.allclose(found["residual"], got, atol=1e-6)
    assert np.allclose(p.sum(axis=1), 1) and (np.abs(found["copies"] - rate) < 1).all()
    if sf != "sf0.001":  # its 80 labels single out no word
        assert got < 1e-3
        assert abs((n * found["copies"]).sum() - (n * rate).sum()) < 0.05 * budget


@pytest.mark.parametrize("shares", [(0.92, 0.05, 0.03), (0.7, 0.1, 0.2)])
def test_fit_rates_is_the_minimum(spark, shares):
    """Also where no nonnegative rates reach the targets: no row is surely of the first domain."""
    rng = np.random.default_rng(7)
    kinds = np.array([[0.87, 0.02, 0.11], [0.85, 0.03, 0.12], [0.03, 0.94, 0.03], [0.03, 0.02, 0.95], [0.4, 0.3, 0.3]])
    p, n = kinds[rng.choice(5, 60, p=[0.5, 0.2, 0.1, 0.15, 0.05])], rng.integers(1, 200, 60)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    a, budget = (n[:, None] * p).T, float(n.sum())
    targets = budget * np.array(shares)
    r = least_squares(a / budget, targets / budget)
    rate, reached = mixing.fit_rates(rows, targets.tolist())
    got = np.array([x[0] for x in rows.select(rate).collect()])
    assert (got >= 0).all() and np.allclose(a @ got, reached, rtol=1e-6)
    assert np.linalg.norm(a @ got - targets) <= np.linalg.norm(a @ r - targets) + 1e-4 * budget
    assert np.allclose(a @ got / budget, a @ r / budget, atol=1e-3)
    with pytest.raises(RuntimeError):
        mixing.fit_rates(rows, targets.tolist(), steps=0)
