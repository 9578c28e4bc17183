"""Quality by nearest-neighbour voting: labelled documents as latent-semantic vectors, exact cosines, votes weighted by similarity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import drop, materialize, read_table
from tradewind.llm.text import ALNUM_TABLE, encoded
from tradewind.llm.toxicity import fold_of

#: Labelled documents that vote, at most: of each label up to half, those of smallest hash, weighed to the real ratio. Their texts stay on the executors.
TRAIN_DOCS = 4_000
#: Features of the latent space: those in the most voters, of words and of shapes.
WORDS, SHAPES = 5_000, 500
MIN_DOCS = 3
DIMENSIONS = 48
NEIGHBOURS = 25
#: A cosine counts to this power: cosines of texts in one language are all high.
SHARPNESS = 6
#: Weight of the words of a text against its shapes.
WORD_WEIGHT = 0.35
KNOWN_TOKENS = 200_000
BLOCK = 256
FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.3

_CLASSES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_SHAPE_BYTES = 8


def token_features(token: bytes) -> list[bytes]:
    """The words of a token (`w` and the word in lower case) and its shape (`s`; runs of capitals, small letters, digits and signs count once)."""
    shape = _RUNS.sub(rb"\1", token.translate(_CLASSES))[:_SHAPE_BYTES]
    return [b"s" + shape, *(b"w" + w for w in token.translate(ALNUM_TABLE).split())]


def repeats(tokens: list[bytes], data: bytes) -> list[tuple[bytes, int]]:
    """Shapes of the text as a whole: tokens equal to the one before, tokens met earlier, lines met earlier."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [(b"s=next", sum(map(eq, tokens, tokens[1:]))), (b"s=again", len(tokens) - len(set(tokens))), (b"s=line", len(lines) - len(set(lines)))]


def tally(text: str | None) -> Counter:
    """How often each feature of a text occurs in it."""
    data = encoded(text)
    tokens = data.split()
    out: Counter = Counter()
    for token, n in Counter(tokens).items():
        for f in token_features(token):
            out[f] += n
    for f, n in repeats(tokens, data):
        if n:
            out[f] += n
    return out


class Space:
    """Latent-semantic space of labelled documents, and the documents as unit vectors in it."""

    def __init__(self, names: list[bytes], weights: np.ndarray, axes: np.ndarray, voters: np.ndarray, votes: np.ndarray, stands: np.ndarray):
        self.number = {f: i for i, f in enumerate(names)}
        self.weights, self.axes = weights, axes
        self.shapes = sum(f[:1] == b"s" for f in names)
        self.voters, self.votes, self.stands = voters, votes, stands
        total = stands.sum()
        self.share = float((stands * votes).sum() / total) if total else 0.0
        self.known: dict[bytes, list[int]] = {}

    @classmethod
    def fit(cls, names: list[bytes], frequency: list[int], rows: list[tuple[list[int], list[float]]], votes: list[int], stands: list[float]) -> Space:
        """names: features in order, so shapes before words; rows: of each voter the numbers of its features and how often they
        occur. Equal input gives equal axes."""
        n = len(rows)
        weights = np.log((1 + n) / (1 + np.array(frequency, dtype=np.float64))) + 0.3 if names else np.zeros(0)
        space = cls(names, weights.astype(np.float32), np.zeros((len(names), 0), np.float32), np.zeros((0, 0), np.float32), np.array(votes, np.float32), np.array(stands, np.float32))
        x = np.zeros((n, len(names)), dtype=np.float32)
        for i, (at, times) in enumerate(rows):
            x[i, at] = times
        x = space.scaled(x)
        k = min(DIMENSIONS, *x.shape)
        basis = np.random.default_rng(13).standard_normal((x.shape[1], k + 12)).astype(np.float32)
        for _ in range(5):
            basis = np.linalg.qr(x.T @ (x @ basis))[0] if k else basis
        if k:
            _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
            space.axes = np.ascontiguousarray((basis @ v.T)[:, :k], dtype=np.float32)
        space.voters = space.unit(x @ space.axes)
        return space

    def scaled(self, counts: np.ndarray) -> np.ndarray:
        """Roots of counts by rarity; the words and the shapes of a text are each brought to a length of their own."""
        x = np.sqrt(counts) * self.weights
        for part, length in ((x[:, : self.shapes], 1.0), (x[:, self.shapes :], WORD_WEIGHT)):
            part *= length / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        return x

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def counts(self, text: str | None, row: np.ndarray) -> None:
        data = encoded(text)
        tokens = data.split()
        number, known = self.number, self.known
        at, times = [], []
        for token, n in Counter(tokens).items():
            if (ids := known.get(token)) is None:
                if len(known) >= KNOWN_TOKENS:
                    known.clear()
                ids = known[token] = [number[f] for f in token_features(token) if f in number]
            at += ids
            times += [n] * len(ids)
        for f, n in repeats(tokens, data):
            if f in number:
                at.append(number[f])
                times.append(n)
        np.add.at(row, at, times)

    def score_all(self, texts: list[str | None]) -> np.ndarray:
        """P(label 1) of each text: the votes of its NEIGHBOURS nearest voters, each weighted by its similarity. Without a
        similar voter, or a known feature, it is the share of label 1."""
        out = np.full(len(texts), self.share)
        near = min(NEIGHBOURS, len(self.voters))
        if not near:
            return out
        for start in range(0, len(texts), BLOCK):
            part = texts[start : start + BLOCK]
            x = np.zeros((len(part), len(self.weights)), dtype=np.float32)
            for row, text in zip(x, part):
                self.counts(text, row)
            cosines = self.unit(self.scaled(x) @ self.axes) @ self.voters.T
            nearest = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
            weight = np.maximum(np.take_along_axis(cosines, nearest, 1), 0.0).astype(np.float64) ** SHARPNESS * self.stands[nearest]
            total = weight.sum(axis=1)
            voted = (weight * self.votes[nearest]).sum(axis=1) / np.maximum(total, 1e-12)
            out[start : start + len(part)] = np.where(total > 1e-9, np.clip(voted, 0, 1), self.share)
        return out


def _tallies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        found = [(i, f, n) for i, text in zip(part["id"], part["t"]) for f, n in tally(text).items()]
        yield pd.DataFrame(found, columns=["id", "feature", "n"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_DOCS) -> Space:
    """The voters: `most` labelled documents at most, whatever the corpus size.

    Up to half have label 1 and up to half 0, those of smallest hash of the id; a label that is cut has its documents stand for
    all of it. Features are counted where the texts are: the driver gets WORDS + SHAPES names and, for each voter, the counts of
    those, which bounds its memory in bytes. Null labels and labels without a document are not used; an id that repeats counts
    each time. With one label only, or none, all scores are its share.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    order = F.xxhash64("id", F.lit(13))
    room = (most - most // 2, most // 2)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    stands = [max(1.0, counts.get(y, 0) / max(1, room[y])) for y in (0, 1)]
    picked = known.where("y = 0").orderBy(order, "id").limit(room[0]).union(known.where("y = 1").orderBy(order, "id").limit(room[1]))
    # `most` rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("t")).join(F.broadcast(picked), F.col("doc") == F.col("id")).select("t", "y")
    voters = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "voters")
    counted = materialize(voters.select("id", "t").mapInPandas(_tallies, "id long, feature binary, n long"), "features")
    spread = counted.groupBy("feature").agg(F.count("*").alias("docs")).where(F.col("docs") >= MIN_DOCS)
    is_word = F.substring("feature", 1, 1) == F.lit(b"w")
    top = [spread.where(c).orderBy(F.desc("docs"), "feature").limit(n) for c, n in ((is_word, WORDS), (~is_word, SHAPES))]
    names = sorted((bytes(r["feature"]), r["docs"]) for part in top for r in part.collect())
    numbered = spark.createDataFrame([(bytearray(f), i) for i, (f, _) in enumerate(names)], "feature binary, number int")
    # WORDS + SHAPES rows
    entries = counted.join(F.broadcast(numbered), "feature").groupBy("id").agg(F.collect_list(F.struct("number", "n")).alias("e"))
    got = voters.select("id", "y").join(entries, "id", "left").orderBy("id").toLocalIterator()
    sparse, votes = [], []
    for r in got:
        e = sorted((x["number"], x["n"]) for x in r["e"] or ())
        sparse.append(([a for a, _ in e], [b for _, b in e]))
        votes.append(r["y"])
    drop(counted)
    drop(voters)
    return Space.fit([f for f, _ in names], [d for _, d in names], sparse, votes, [stands[y] for y in votes])


def with_quality(docs: DataFrame, model: Space, text: str = "text", out: str = "quality") -> DataFrame:
    """docs plus the score of each whole text, 0 to 1. The voters' vectors and the axes, bounded by the named limits, are
    broadcast; cosines with all voters are exact, a block of documents at a time. Null and empty texts score the share of
    label 1. A column of the name `out` is replaced; all others pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(shared.value.score_all(part.tolist()), dtype="float64")

    return docs.withColumn(out, F.pandas_udf(scores, "double")(F.col(text)))


def op13_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(fold_of("doc_id", FOLDS) != HELD_FOLD)
    found = with_quality(docs, train(docs, labels), out="score")
    return found.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_FOLD).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
