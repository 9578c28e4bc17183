"""Language of whole texts and of their spans: script ranges, per-word scores, Viterbi with a switching penalty."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.store import materialize, read_table
from tradewind.llm.toxicity import fold_of

UNKNOWN = "und"
FOLDS, HELD_FOLD = 4, 2
#: Documents of one language, and of all languages, that the model is fitted on at most: those of smallest hash of the text.
TRAIN_DOCS, TRAIN_EVERY = 1_500, 20_000
#: Languages that are learned at most: those of the most labelled texts.
LANGUAGES = 1_000
#: Character n-grams of a word with its ends marked, and how much is added to each count.
ORDERS, ADD = (2, 3, 4), 0.2
#: The most frequent words of a language that count as a feature of their own.
COMMON_WORDS = 5_000
#: Price of a change of language between two words, in natural log units.
SWITCH = 8.0
#: One word's advantage of one language over another is held to this.
CLIP = 6.0
#: Share of a language's words in a script from which the script admits the language.
MIN_SHARE = 0.01
#: Words that a worker remembers, that are scored in one go, and documents that are labelled in one go.
KNOWN_WORDS, LEARNED_AT_ONCE, CALL_ROWS = 300_000, 10_000, 250
#: Odd multiplier of the rolling key of an n-gram.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Letters, and signs such as ½ or ② that words_of() takes out again.
LETTERLIKE = re.compile(r"[^\W\d_]+")

#: First code points of the ranges by which a word's first letter gives its script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB07, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"),
)


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode's categories L only: no digits, number-like signs or lone marks)."""
    found = LETTERLIKE.findall(text)
    if "".join(found).isalpha():
        return found
    return ["".join(run) for w in found for letters, run in groupby(w, str.isalpha) if letters]


def script(word: str) -> str:
    code, low, high = ord(word[0]), 0, len(SCRIPTS)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if SCRIPTS[mid][0] <= code else (low, mid)
    return SCRIPTS[low][1]


def grams(word: str) -> list[str]:
    """Of a lower-cased word."""
    marked = f"<{word}>"
    return [marked[i : i + n] for n in ORDERS for i in range(len(marked) - n + 1)]


def _gram_keys(names: list[str]) -> np.ndarray:
    """A 64-bit number for each n-gram, from its length and code points."""
    keys = np.zeros(len(names), dtype=np.uint64)
    for i, g in enumerate(names):
        key = len(g)
        for c in g:
            key = (key * int(MIX) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        keys[i] = key
    return keys


class Languages:
    """Scores of words for each learned language, and the candidates of each script."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        counts, words, scripts = [], [], []
        for lang in self.names:
            found = Counter(w.lower() for t in texts[lang] for w in words_of(t))
            mine, shapes = Counter(), Counter()
            for w, n in found.items():
                shapes[script(w)] += n
                for g in grams(w):
                    mine[g] += n
            counts.append(mine)
            words.append(dict(found.most_common(COMMON_WORDS)))
            scripts.append({s for s, n in shapes.items() if n >= MIN_SHARE * max(1, found.total())})
        gram_names = sorted(set().union(*counts))
        totals = [[sum(n for g, n in c.items() if len(g) == k) + ADD * len(gram_names) for k in ORDERS] for c in counts]
        #: Keys of the n-grams in ascending order; `table` has their rows, then one row of each order for unseen ones and one of zeros.
        keys = _gram_keys(gram_names)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        unseen = [[math.log(ADD / t[k]) for t in totals] for k in range(len(ORDERS))]
        seen = [[math.log((c.get(g, 0) + ADD) / t[len(g) - ORDERS[0]]) for c, t in zip(counts, totals, strict=True)] for g in gram_names]
        seen = np.array(seen, dtype=np.float64).reshape(len(seen), len(self.names))[order]
        self.table = np.vstack([seen, np.array(unseen, dtype=np.float64).reshape(len(ORDERS), len(self.names)), np.zeros((1, len(self.names)))])
        sums = [sum(w.values()) + 1 for w in words]
        common = sorted(set().union(*words))
        self.common = {w: i for i, w in enumerate(common, 1)}
        logs = [[math.log((m.get(w, 0) + 0.5) / s) for m, s in zip(words, sums, strict=True)] for w in common]
        self.common_table = np.array([[0.0] * len(self.names), *logs], dtype=np.float64).reshape(1 + len(logs), len(self.names))
        every = set().union(*scripts) if scripts else set()
        self.allowed = {s: np.array([s in m for m in scripts]) for s in every}
        self.forget()

    def forget(self) -> None:
        #: Number of each word that was scored, and by number its scores and letters.
        self.known: dict[str, int] = {}
        self.scores, self.letters = np.zeros((0, len(self.names))), np.zeros(0, dtype=np.int64)

    def _gram_sums(self, words: list[str]) -> np.ndarray:
        """Sum of the rows of all n-grams of each word."""
        marked = [f"<{w}>" for w in words]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        lengths = np.array([len(w) for w in marked], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
        padded, total = np.concatenate([codes, np.zeros(ORDERS[-1], dtype=np.uint64)]), np.zeros((len(words), len(self.names)))
        for k, n in enumerate(ORDERS):
            key = np.full(len(codes), n, dtype=np.uint64)
            for i in range(n):
                key = key * MIX + padded[i : i + len(codes)]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            seen = self.keys[at] == key if len(self.keys) else np.zeros(len(codes), dtype=bool)
            row = np.where(left < n, len(self.table) - 1, np.where(seen, at, len(self.keys) + k))
            total += np.add.reduceat(self.table[row], starts, axis=0)
        return total

    def learn(self, words: list[str]) -> None:
        """Number new words, which are in lower case, and remember their scores by language.

        The best language has 0 and the rest stand below, CLIP at most; so do languages that do not use the script of the
        word. A script that no language uses says nothing: all are 0. n-gram sums are averaged over the orders.
        """
        parts = [self.scores]
        none, every = np.zeros(len(self.names), dtype=bool), self.allowed
        for i in range(0, len(words), LEARNED_AT_ONCE):
            part = words[i : i + LEARNED_AT_ONCE]
            total = self._gram_sums(part) / len(ORDERS)
            total += self.common_table[[self.common.get(w, 0) for w in part]]
            allowed = np.array([every.get(script(w), none) for w in part])
            top = np.where(allowed, total, -np.inf).max(axis=1, keepdims=True)
            score = np.where(allowed, np.clip(total - np.where(np.isfinite(top), top, 0.0), -CLIP, 0.0), -CLIP)
            score[~allowed.any(axis=1)] = 0.0
            parts.append(score)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.scores = np.vstack(parts)
        self.letters = np.concatenate([self.letters, np.array([len(w) for w in words], dtype=np.int64)])

    def _best_path(self, table: np.ndarray) -> np.ndarray:
        """Viterbi over one text's rows of scores."""
        best = int(np.argmax(table.sum(axis=0)))
        # One language throughout is optimal if no stretch in another repays the switch into or out of it, and doing
        # without the best one altogether does not repay a switch either.
        gain = np.delete(table - table[:, [best]], best, axis=1)
        run = np.cumsum(gain, axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), run[:-1]]), axis=0)
        if not gain.size or ((run - low).max() <= SWITCH and gain.max(axis=1).sum() <= SWITCH):
            return np.full(len(table), best)
        n, k = table.shape
        rows, stay, back = table.tolist(), list(range(k)), []
        score = rows[0]
        for row in rows[1:]:
            top = max(score)
            change = top - SWITCH
            if min(score) >= change:
                back.append(stay)
            else:
                at = score.index(top)
                back.append([i if s >= change else at for i, s in zip(stay, score)])
                score = [s if s >= change else change for s in score]
            score = [s + x for s, x in zip(score, row)]
        path = np.zeros(n, dtype=np.int64)
        path[-1] = score.index(max(score))
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t - 1][path[t]]
        return path

    def numbered(self, texts: list[str | None]) -> tuple[list[int], np.ndarray]:
        """(words in each text, numbers of all words in turn). New words of all texts are scored in one go."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        found = [words_of(t.lower()) if t else [] for t in texts]
        flat = list(chain.from_iterable(found))
        # in order of appearance, so that equal input gives equal numbers
        self.learn([w for w in dict.fromkeys(flat) if w not in self.known])
        return [len(x) for x in found], np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))

    def paths(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int | np.ndarray]]:
        """For each text, the numbers of its words and the language of each: one number if it is the same throughout.

        The gains of all texts over their best language are summed at once; where even all gains together do not repay a switch,
        one language is the optimum and no path is sought.
        """
        lengths, flat = self.numbered(texts)
        ends = np.cumsum(lengths)
        some = [i for i, n in enumerate(lengths) if n]
        sure = {}
        if some and self.names:
            table, starts = self.scores[flat], np.array([ends[i] - lengths[i] for i in some])
            best = np.add.reduceat(table, starts, axis=0).argmax(axis=1)
            counts = np.array([lengths[i] for i in some])
            gain = table - np.take_along_axis(table, np.repeat(best, counts)[:, None], axis=1)
            sure_of = np.add.reduceat(np.maximum(gain, 0).max(axis=1), starts) <= SWITCH
            sure = {i: int(b) for i, b, s in zip(some, best, sure_of) if s}
        for i, (end, n) in enumerate(zip(ends.tolist(), lengths)):
            ids = flat[end - n : end]
            if not n or not self.names:
                yield ids, 0
            else:
                yield ids, sure[i] if i in sure else self._best_path(self.scores[ids])

    def label(self, text: str | None) -> tuple[list[str], np.ndarray]:
        """The words of a text and the number of the language of each, by Viterbi."""
        words = words_of((text or "").lower())
        if not words or not self.names:
            return words, np.zeros(0, dtype=np.int64)
        ((_, path),) = self.paths([text])
        return words, np.full(len(words), path) if isinstance(path, int) else path

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, word after the last, language) of each stretch of one language."""
        words, path = self.label(text)
        cuts = np.flatnonzero(np.diff(path)) + 1 if len(path) else []
        edges = [0, *map(int, cuts), len(words)] if len(words) else [0]
        return [(a, b, self.names[path[a]]) for a, b in zip(edges, edges[1:])]

    def predict_all(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """For each text: language with the most letters, its share of the letters, and the spans."""
        for ids, path in self.paths(texts):
            if not len(ids) or not self.names:
                yield UNKNOWN, 0.0, []
            elif isinstance(path, int):
                yield self.names[path], 1.0, [(0, len(ids), self.names[path])]
            else:
                letters = np.bincount(path, weights=self.letters[ids], minlength=len(self.names))
                top = int(letters.argmax())
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(ids)]
                yield self.names[top], float(letters[top] / letters.sum()), [(a, b, self.names[path[a]]) for a, b in zip(cuts, cuts[1:])]

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        return next(self.predict_all([text]))


def train(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = TRAIN_DOCS, every: int = TRAIN_EVERY) -> Languages:
    """Fit on whole texts: `most` of each language and `every` of all languages at most, a documented bound, whatever the corpus size.

    Per language the texts of smallest hash are taken, copies once. What is ranked and joined are hashes of texts; only the texts
    that are taken reach the driver. Null languages and null texts are not used. Without any labelled text nothing is learned and
    all texts are `und`.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(text), F.lit(5)).alias("h"), F.col(text).alias("t"))
    distinct = materialize(known.select("l", "h").distinct(), "labelled")
    counts = distinct.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()
    room = max(1, min(most, every // max(1, len(counts))))
    # hashes are spread evenly, so a bar a language leaves some times `room` of them, however many there are
    bars = [(r["l"], min((1 << 63) - 1, -(1 << 63) + (1 << 64) * (4 * room + 40) // r["n"])) for r in counts]
    bars = docs.sparkSession.createDataFrame(bars, "l string, bar long")
    few = distinct.join(F.broadcast(bars), "l").where("h <= bar")
    first = few.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("n") <= room)
    # `every` rows of two values at most, or one a language
    picked = known.join(F.broadcast(first.select("l", "h")), ["l", "h"]).groupBy("l", "h").agg(F.first("t").alias("t"))
    texts: dict[str, list[str]] = {}
    for row in picked.orderBy("l", "h").toLocalIterator():
        texts.setdefault(row["l"], []).append(row["t"])
    return Languages(texts)


LABEL = "lang string, score double, spans array<struct<first:int,end:int,lang:string>>"


def with_language(docs: DataFrame, model: Languages, text: str = "text", out: str = "language") -> DataFrame:
    """docs plus a struct: language of the whole text, its share of the letters, and spans of words of one language.

    A null text, or one without a letter, is `und` with score 0. Words in a script that no learned language uses follow
    their neighbours. Ties go to the name that sorts first. Rows are labelled whole and alone; the model, whose size is
    bounded by its training documents, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labels(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            rows = []
            for at in range(0, len(part), CALL_ROWS):
                for name, score, spans in shared.value.predict_all(part.iloc[at : at + CALL_ROWS].tolist()):
                    rows.append((name, score, [dict(zip(("first", "end", "lang"), s, strict=True)) for s in spans]))
            yield pd.DataFrame(rows, columns=["lang", "score", "spans"])

    return docs.withColumn(out, F.pandas_udf(labels, LABEL)(F.col(text)))


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold_of("doc_id", FOLDS) == HELD_FOLD
    model = train(docs.where(~held))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.size("language.spans").alias("n_spans"))
