"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import read_table
from tradewind.llm.text import ALNUM_TABLE

#: Labelled documents that the model is fitted on at most: those of smallest hash, of each label half at most, weighed to the real ratio.
TRAIN_DOCS = 8_000
#: Features that get a weight: the ones in the most training documents, in MIN_DOCS at least.
VOCABULARY = 100_000
MIN_DOCS = 5
#: A positive document counts this many times: there are few, and their labels hold for one sentence.
POSITIVE = 2.5
STEPS, RATE, DECAY = 160, 0.1, 5e-5
FOLDS, HELD_FOLD = 5, 0
#: Sentences end at a line feed or after . ! ? ; the split is on bytes.
ENDS = re.compile(rb"(?<=[.!?])\s+|\n")


def sentences(text: str | None) -> list[list[bytes]]:
    """The lower-cased words of each sentence that has any."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return [w for s in ENDS.split(data) if (w := s.translate(ALNUM_TABLE).split())]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Code points where each sentence of sentences() begins and ends."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out, start, at, before = [], 0, 0, 0
    for end, after in [*(m.span() for m in ENDS.finditer(data)), (len(data), len(data))]:
        if data[start:end].translate(ALNUM_TABLE).split():
            first = before + len(data[at:start].decode("utf-8", "surrogatepass"))
            at, before = start, first
            out.append((first, first + len(data[start:end].decode("utf-8", "surrogatepass"))))
        start = after
    return out


#: Lengths in bytes of the word beginnings that are features beside whole words: inflected forms share them.
PREFIXES = (5, 6, 7, 8)
#: Words whose sum of weights a worker remembers.
KNOWN_WORDS = 300_000


def features(word: bytes) -> list[bytes]:
    return [word + b"$", *(word[:n] for n in PREFIXES if len(word) >= n)]


class NoisyOr:
    """P(document) = 1 - prod over sentences of (1 - sigmoid(bias + sum of the weights of its distinct words)).

    A word's weight is the sum over its features.
    """

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    @classmethod
    def fit(cls, texts: list[str | None], labels: list[int], stands: tuple[float, float] = (1.0, 1.0)) -> NoisyOr:
        """Full-batch gradient steps (Adam) on the document likelihood. Equal input gives equal weights.

        A document stands for stands[label] documents, for samples that take labels at different rates.
        """
        parts: dict[bytes, list[bytes]] = {}
        seen: dict[bytes, int] = {}
        for t in texts:
            mine = {w for s in sentences(t) for w in s}
            for f in {f for w in mine for f in parts.setdefault(w, features(w))}:
                seen[f] = seen.get(f, 0) + 1
        names = sorted((f for f, n in seen.items() if n >= MIN_DOCS), key=lambda f: (-seen[f], f))[:VOCABULARY]
        number = {f: i for i, f in enumerate(names)}
        del seen
        numbers = {w: [number[f] for f in fs if f in number] for w, fs in parts.items()}
        del parts
        ids, lengths, doc = array("i"), array("i"), array("i")
        for d, t in enumerate(texts):
            for s in sentences(t):
                before = len(ids)
                for w in sorted(set(s)):
                    ids.extend(numbers[w])
                lengths.append(len(ids) - before)
                doc.append(d)
        del numbers
        ids, doc = np.array(ids, dtype=np.int32), np.array(doc, dtype=np.int32)
        sent = np.repeat(np.arange(len(doc), dtype=np.int32), np.array(lengths, dtype=np.int32))
        y = np.array(labels, dtype=np.float64)
        used = np.where(y == 1, stands[1], stands[0]) * (np.bincount(doc, minlength=len(y)) > 0)
        theta, bias = np.zeros(len(names)), -6.0
        m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
        for step in range(1, STEPS + 1):
            z = bias + np.bincount(sent, weights=theta[ids], minlength=len(doc))
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            log_q = np.bincount(doc, weights=np.log1p(-p), minlength=len(y))
            q = np.exp(log_q)
            pull = np.where(y == 1, POSITIVE * q / np.maximum(1 - q, 1e-9), -1.0) * used
            g = pull[doc] * p / max(1, used.sum())
            gw = np.bincount(ids, weights=g[sent], minlength=len(names)) - DECAY * theta
            gb = g.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            fix_m, fix_v = 1 - 0.9**step, 1 - 0.99**step
            theta += RATE * (m / fix_m) / (np.sqrt(v / fix_v) + 1e-6)
            bias += RATE * (mb / fix_m) / (np.sqrt(vb / fix_v) + 1e-6)
        return cls({f: float(t) for f, t in zip(names, theta.tolist(), strict=True) if t}, float(bias))

    def word(self, word: bytes) -> float:
        if (known := self.known.get(word)) is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            get = self.weights.get
            known = self.known[word] = sum(get(f, 0.0) for f in features(word))
        return known

    def sentence_scores(self, text: str | None) -> list[float]:
        word, out = self.word, []
        for s in sentences(text):
            z = self.bias + sum(map(word, set(s)))
            out.append(1 / (1 + np.exp(-z)) if -35 < z < 35 else float(z > 0))
        return out

    def score(self, text: str | None) -> float:
        """0 for a text without words."""
        clean = 1.0
        for p in self.sentence_scores(text):
            clean *= 1 - p
        return 1 - clean


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_DOCS) -> NoisyOr:
    """Fit on the labelled documents, `most` of them at most: a bound on what the driver holds, whatever the corpus size.

    Up to half are positives and up to half negatives; within a label those of smallest hash of the id are taken. A label
    that is cut has its documents count for as many as there are, so the ratio of labels is that of all rows. Rows of null label, and labels without a document, are not used. Labels that repeat an id count each. If a label is missing
    altogether the model scores 0 throughout.
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    order = F.xxhash64("id", F.lit(11))
    ones = known.where("y = 1").orderBy(order, "id").limit(most // 2)
    rest = known.where("y = 0").orderBy(order, "id").limit(most - most // 2)
    counts = {r["y"]: r["n"] for r in known.where("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect()}
    stands = tuple(max(1.0, counts.get(y, 0) / max(1, room)) for y, room in enumerate((most - most // 2, most // 2)))
    # at most `most` rows of two numbers
    picked = F.broadcast(ones.union(rest))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(picked, "id").select("id", "t", "y")
    got = sorted(((r["id"], r["t"] or "", r["y"]) for r in rows.toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    if {0, 1} - {r[2] for r in got}:
        return NoisyOr({}, -40.0)
    return NoisyOr.fit([r[1] for r in got], [r[2] for r in got], stands)


SCORES = "score double, worst array<struct<sentence:int,start:int,end:int,score:double>>"


def with_toxicity(docs: DataFrame, model: NoisyOr, text: str = "text", out: str = "toxicity", offending: float = 0.5) -> DataFrame:
    """docs plus a struct: the document's score and the sentences that score `offending` or more: number from 0, code points
    where it starts and ends, and score.

    The model is broadcast; its size is bounded by VOCABULARY words. Null, empty and wordless texts score 0. Rows are
    scored whole and alone, so repeated rows repeat their score; other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            rows = []
            for t in part:
                each = shared.value.sentence_scores(t)
                clean = float(np.prod(1 - np.array(each))) if each else 1.0
                bad = [i for i, p in enumerate(each) if p >= offending]
                spans = sentence_spans(t) if bad else []
                rows.append((1 - clean, [{"sentence": i, "start": spans[i][0], "end": spans[i][1], "score": float(each[i])} for i in bad]))
            yield pd.DataFrame(rows, columns=["score", "worst"])

    return docs.withColumn(out, F.pandas_udf(scores, SCORES)(F.col(text)))


def fold_of(id_col: str, folds: int):
    """crc32 of the id as text, modulo; null counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(fold_of("doc_id", FOLDS) != HELD_FOLD)
    model = train(docs, labels)
    found = with_toxicity(docs, model)
    score = F.col("toxicity.score")
    offending = F.array_join(F.transform("toxicity.worst", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_FOLD).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"), F.size("toxicity.worst").alias("n_offending"), offending.alias("offending"))
