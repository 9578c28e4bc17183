"""Every registered query of the subpackage, run over a written table of odd and real rows, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tradewind.llm import registry

QUERIES = registry.queries()
WS = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with odd rows added to documents."""
    path = str(tmp_path_factory.mktemp("sf"))
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("text is not null").first()["text"]
    odd = [
        (90001, None, "en", "src0", None), (90002, "", None, None, 0), (90003, "  \n\t ", "fr", "src1", 4), (90004, "One", "en", "src0", 3),
        (90005, f"Before it. {item} after", "en", "src2", 9), (90006, "a b c " * 40, "en", "src2", 9), (90007, "Mail A.b@c.org or 10.0.0.1, 4111 1111 1111 1111", "en", "src2", 9),
        (90008, "é ü ß 日本語 +1 (415) 555-2671", "de", "src3", 9), (90009, "One", "en", "src0", 3),
    ]
    docs = real.unionByName(spark.createDataFrame(odd, real.schema)).repartition(3)
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def run(spark, folder, name) -> pd.DataFrame:
    return QUERIES[name](spark, folder).toPandas().set_index("doc_id").sort_index()


def test_op1(spark, folder, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    places = {}
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r["text"])
        for j in range(max(0, len(w) - 9) if len(w) >= 10 else bool(w)):
            places.setdefault(tuple(w[j : j + 10]), set()).add(str(r["item_id"]))
    sizes = {len(p) for p in places}
    got = run(spark, folder, "op1_decontaminate")
    assert set(got.index) == set(docs)
    for i, d in docs.items():
        w, hit, items = words(d["text"]), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (found := places.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    items |= found
        want = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
        assert tuple(got.loc[i, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]]) == want
    assert got.loc[90005, "contaminated"]


@pytest.mark.parametrize(("name", "folds", "fold"), [("op2_toxicity", 5, 0), ("op4_langid", 4, 2)])
def test_folds_and_ranges(spark, folder, docs, name, folds, fold):
    got = run(spark, folder, name)
    assert set(got.index) == set(docs) and got["score"].between(0, 1).all()
    assert all(got.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % folds == fold) for i in docs)
    if name == "op2_toxicity":
        assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    else:
        langs = {d["lang"] for d in docs.values()} - {None}
        assert set(got["lang_pred"]) <= langs | {"und"} and set(got.loc[[90001, 90002, 90003], "lang_pred"]) == {"und"}
        known = [i for i, d in docs.items() if d["lang"] and got.loc[i, "held_out"] and len(d["text"] or "") > 200]
        assert sum(got.loc[i, "lang_pred"] == docs[i]["lang"] for i in known) > 0.9 * len(known)


def test_op5(spark, folder, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = run(spark, folder, "op5_tokens")
    for i in sorted(docs):
        ids = plain.encode(docs[i]["text"] or "", add_special_tokens=False).ids + [0]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert tuple(got.loc[i, ["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), crc)
        start += len(ids)


def fingerprint(text):
    w = WS.findall(lower(text))
    parts = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[j : j + 3]) for j in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op6(spark, folder, docs):
    got, prints = run(spark, folder, "op6_simhash"), {i: fingerprint(d["text"]) for i, d in docs.items()}
    of = {i: i for i in docs}
    for _ in docs:  # smallest id reachable, by repeated passes
        new = {i: min(of[j] for j in docs if (prints[i] ^ prints[j]).bit_count() <= 2) for i in docs}
        if new == of:
            break
        of = new
    assert {i: r["fingerprint"] for i, r in got.iterrows()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert got["component_id"].to_dict() == of


def test_op7(spark, folder, docs):
    got = run(spark, folder, "op7_host_rules")
    for i, d in docs.items():
        text = d["text"] or ""
        w = WS.findall(text)
        lines = [x for x in text.split("\n") if WS.search(x)]
        windows = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        inside = {j + k for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for k in range(5)}
        base = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), base)
        assert tuple(got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]]) == want
        assert not (base and got.loc[i, "kept"])


def test_op8(spark, folder, docs):
    got = run(spark, folder, "op8_reshard")
    assert set(got.index) == set(docs)
    for i, d in docs.items():
        data = (d["text"] or "").encode()
        assert tuple(got.loc[i, ["size", "text_crc32", "law"]]) == (len(data) + 1, zlib.crc32(data), "bytes")
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard")) and got["shard"].between(0, 15).all()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()


def test_op9(spark, folder, docs):
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    digits = lambda s: [int(c) for c in s if "0" <= c <= "9"]
    luhn = lambda d: sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0
    tests = {
        "email": (email, lambda s: True), "ip": (ip, lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    got = run(spark, folder, "op9_pii")
    for i, d in docs.items():
        spans = {k: [(m.start(), m.end()) for m in re.finditer(p, d["text"] or "") if ok(m[0])] for k, (p, ok) in tests.items()}
        named = [f"{k}:{a}:{b}" for k in tests for a, b in spans[k]]
        assert tuple(got.loc[i, ["n_email", "n_ip", "n_card", "n_phone"]]) == tuple(len(spans[k]) for k in tests)
        assert got.loc[i, "base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [x for x in got.loc[i, "spans"].split(",") if x.split(":")[0] in tests] == named
        assert len(got.loc[i, "spans"].split(",")) == len(got.loc[i, "scores"].split(","))


def test_op10(spark, folder, docs):
    tokens = {i: [*WS.findall(lower(d["text"])), "\n"] for i, d in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    # (c + 1) / (N + V + 1): one place beyond the known words
    size = math.log10(counts.total() + len(counts) + 1)
    got = run(spark, folder, "op10_brown")
    for i, t in tokens.items():
        r = got.loc[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(counts[w] > 0 for w in t), counts.total())
        assert math.isclose(r["base_score"], sum(math.log10(counts[w] + 1) - size for w in t), rel_tol=1e-9)
        assert r["score"] < 0


def test_pipeline(spark, folder, docs):
    """Each stage against what its query says of its own input, and run() against the stages in turn."""
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    columns = rows.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{folder}/stage-{name}/documents.parquet"
        stage(spark, rows, folder).write.parquet(out)
        before, after = {r["doc_id"]: r for r in rows.collect()}, spark.read.parquet(out).collect()
        kept = {r["doc_id"] for r in after}
        here = f"{folder}/in-{name}"
        rows.write.parquet(f"{here}/documents.parquet")
        for other in ("benchmark", "labels"):
            spark.read.parquet(f"{folder}/{other}.parquet").write.parquet(f"{here}/{other}.parquet")
        if name == "quality_rules":
            assert kept == set(run(spark, here, "op7_host_rules").query("kept").index)
        elif name == "near_duplicates":
            assert kept == set(run(spark, here, "op6_simhash")["component_id"])
        elif name == "decontamination":
            assert kept == set(run(spark, here, "op1_decontaminate").query("not contaminated").index)
        elif name == "mixing":
            copies = run(spark, here, "op3_mixing")["copies"]
            assert Counter(r["doc_id"] for r in after) == Counter(copies[copies > 0].to_dict())
        else:
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in rows.collect())
            by = Counter(r["shard"] for r in after)
            assert all({r["slot"] for r in after if r["shard"] == s} == set(range(k)) for s, k in by.items())
        assert kept <= set(before)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert spark.read.parquet(out).columns == columns
            assert all(r["text"] == before[r["doc_id"]]["text"] for r in after)
        rows = spark.read.parquet(out)
    whole = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, folder).select(F.col("doc_id")).collect())
    assert whole == Counter(r["doc_id"] for r in rows.collect())
