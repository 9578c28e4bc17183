"""Class-based n-gram scoring: exchange clustering of frequent words, class transitions, word emissions."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import drop, materialize, read_table
from tradewind.llm.text import lower_words
from tradewind.llm.toxicity import fold_of

FOLDS, HELD_FOLD = 7, 2
#: Words clustered by exchange in turn, the number of classes, and sweeps after which exchange stops even if words still move.
CLUSTERED, CLASSES, SWEEPS = 1_500, 48, 20
#: Words that get a class each by one exchange step against the classes of the clustered ones: the next most frequent.
ASSIGNED = 50_000
#: All further words, seen or not, are pooled by their last three bytes, and each pool gets a class by the same step.
POOLS = 1_024
#: Words whose counts every task holds: the most frequent. Counts of all others are joined, so nothing that grows is broadcast.
FREQUENT = 200_000
#: Weight of the class bigram against the class unigram.
MIX = 0.9
#: Documents that a task works on in one go, and other words that it remembers.
CALL_ROWS, KNOWN_WORDS = 400, 300_000
END = "\n"  # the end token; no word contains a line feed


def pool_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % POOLS


class Numbers(dict):
    """word -> number; a word that is not in the table has the number of its pool, by `pools`, and is remembered for a while."""

    def __init__(self, known: dict[bytes, int], pools: list[int]):
        super().__init__(known)
        self.pools, self.room = pools, len(known) + KNOWN_WORDS

    def __missing__(self, word: bytes) -> int:
        n = self.pools[zlib.crc32(word[-3:]) % POOLS]
        if len(self) < self.room:
            self[word] = n
        return n


def streams(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[list[list[bytes]], list[bytes]]]:
    """The words of some whole texts, and all of them in turn with an end before the first and after each."""
    end = END.encode()
    for batch in batches:
        texts = batch.column(column)
        for at in range(0, batch.num_rows, CALL_ROWS):
            words = [lower_words(t) for t in texts.slice(at, CALL_ROWS).to_pylist()]
            flat = [end]
            for w in words:
                flat += w
                flat.append(end)
            yield words, flat


def tokens_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): counts of all tokens of all rows, the end token included. A grouped count, combined before the shuffle."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.explode(F.split(lowered, "[\\x20\\x09-\\x0D]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("c"))
    ends = docs.agg(F.count("*").alias("c")).where("c > 0").select(F.lit(END).alias("word"), "c")
    return words.union(ends)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word from a square matrix of bigram counts, by exchange clustering.

    Words start in classes by rank; in turn, each moves to the class where the likelihood of the class bigram
    model, sum n log n over class pairs minus the sums over left and right classes, is highest. Ties keep the lowest class number.
    """
    n = len(bigrams)
    classes = max(1, min(classes, n))
    of = np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # word -> class, word <- class
    pair = member.T @ right

    def h(x):
        return x * np.log(np.maximum(x, 1.0))

    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, self_count = of[w], bigrams[w, w]
            r, lf = right[w].copy(), left[w].copy()
            r[a] -= self_count
            lf[a] -= self_count
            base = pair.copy()
            base[a] -= right[w]
            base[:, a] -= left[w]
            base[a, a] += self_count
            row, col = base.sum(axis=1), base.sum(axis=0)
            rs, ls = right[w].sum(), left[w].sum()
            # putting w into class k changes row k by r, column k by lf, and the diagonal by all three
            gain = (h(base + r[None, :]) - h(base)).sum(axis=1) + (h(base + lf[:, None]) - h(base)).sum(axis=0)
            d = np.diag(base)
            gain += h(d + r + lf + self_count) - h(d + r) - h(d + lf) + h(d)
            gain -= h(row + rs) - h(row) + h(col + ls) - h(col)
            k = int(gain.argmax())
            if gain[k] <= gain[a] + 1e-9:
                k = int(a)
            base[k] += r
            base[:, k] += lf
            base[k, k] += self_count
            pair = base
            if k != a:
                moved += 1
                of[w] = k
                right[:, a] -= bigrams[:, w]
                right[:, k] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, k] += bigrams[w]
        if not moved:
            break
    return of


class ClassModel:
    """What every task holds: counts of frequent words, classes of words and pools, transitions, and totals of each class."""

    def __init__(self):
        self.count: dict[bytes, int] = {}
        self.cluster: dict[bytes, int] = {}
        self.pools: list[int] = [0] * POOLS

    def class_of(self, word: bytes) -> int:
        c = self.cluster.get(word)
        return self.pools[pool_of(word)] if c is None else c


def _numbered(docs: DataFrame, text: str, listed: list[bytes]) -> DataFrame:
    """(ids: array<int>) for each row: its tokens by place in `listed`, all other words as len(listed) and more by pool.

    Written once, so that the passes which count contexts read numbers, not texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        place = Numbers({w: i for i, w in enumerate(words)}, list(range(len(words), len(words) + POOLS)))
        for texts, flat in streams(batches):
            ids = np.fromiter(map(place.__getitem__, flat), dtype=np.int32, count=len(flat))[1:]
            ends = np.cumsum([0, *(len(w) + 1 for w in texts)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["ids"])

    return materialize(docs.select(text).mapInArrow(number, "ids array<int>"), "numbered")


def _lookup(listed: list[bytes], known: dict[bytes, int], pools: list[int]) -> np.ndarray:
    """Number of each id of _numbered(): that of its word, else that of its pool."""
    return np.array([pools[pool_of(w)] if (n := known.get(w)) is None else n for w in listed] + pools, dtype=np.int64)


def _cells(tokens: DataFrame, numbers: np.ndarray, end: int, size: int, cells_of) -> DataFrame:
    """(cell, n): cells_of(numbers of a stream of tokens, from an end on) counted over all rows of _numbered().

    Every task adds up its own `size` cells, bounded by the parameters, and sends those it has; they are summed by key.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CALL_ROWS):
                ids = batch.column(0).slice(at, CALL_ROWS).flatten().to_numpy(zero_copy_only=False)
                found = cells_of(shared.value[np.concatenate([[end], ids])])
                if 8 * len(found) > size:
                    total += np.bincount(found, minlength=size)
                else:
                    np.add.at(total, found, 1)
        cells = np.flatnonzero(total)
        for at in range(0, len(cells), 100_000):
            part = cells[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["cell", "n"])

    return tokens.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _matrix(cells: DataFrame, size: int) -> np.ndarray:
    matrix = np.zeros(size * size)
    for row in cells.toLocalIterator():
        matrix[row["cell"]] = row["n"]
    return matrix.reshape(size, size)


def _assigned(tokens: DataFrame, listed: list[bytes], seeds: dict[bytes, int], words: list[bytes], seen: np.ndarray) -> tuple[list[int], list[int]]:
    """(class of each word, class of each pool): where exchange would put it, the classes of the seeds staying as they are.

    seen has the pairs of classes of seeds and, last, of all other words. What a unit adds to sum n log n over pairs of classes,
    less the same over left and right classes, if it joins class k, is to first order its counts times the logarithms of what
    is there; contexts of each unit are counted over all rows.
    """
    k = len(seen) - 1
    wide = 2 * (k + 1)
    known = {w: i for i, w in enumerate(words)} | {w: -1 - c for w, c in seeds.items()}
    units = len(words) + POOLS

    def contexts(ids: np.ndarray) -> np.ndarray:
        at, context = np.flatnonzero(ids >= 0), np.where(ids < 0, -1 - ids, k)
        return np.concatenate([ids[at] * wide + context[at + 1], ids[at] * wide + (k + 1) + context[at - 1]])

    cells = _cells(tokens, _lookup(listed, known, list(range(len(words), units))), listed.index(END.encode()), units * wide, contexts)
    log = np.log(seen + 0.5)
    after, before = log[:k, :].T, log[:, :k]
    size = np.log(seen[:k].sum(axis=1) + 0.5) + np.log(seen[:, :k].sum(axis=0) + 0.5)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        unit = part["cell"].to_numpy() // wide
        names, row = np.unique(unit, return_inverse=True)
        counts = np.zeros((len(names), wide))
        counts[row, part["cell"].to_numpy() % wide] = part["n"].to_numpy()
        right, left = counts[:, : k + 1], counts[:, k + 1 :]
        gain = right @ after + left @ before - right.sum(axis=1, keepdims=True) * size
        return pd.DataFrame({"unit": names, "k": gain.argmax(axis=1).astype("int32")})

    # a group has 500 units of `wide` cells at most
    found = cells.withColumn("part", F.expr(f"cell div {500 * wide}")).groupBy("part").applyInPandas(choose, "unit long, k int")
    of = [0] * units
    for row in found.toLocalIterator():
        of[row["unit"]] = row["k"]
    return of[: len(words)], of[len(words) :]


def train(docs: DataFrame, text: str = "text") -> tuple[ClassModel, DataFrame, int, int]:
    """(model, counts, N, V). counts is the stored table (word, c) of all training tokens.

    Counts cover all rows. Only what the parameters bound reaches the driver: the FREQUENT most frequent words, the bigram
    matrix over clustered words, a class for each assigned word and pool. Words of the first count that no longer fits whole
    are left to the join.
    """
    counts = materialize(tokens_table(docs, text), "counts")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least, room = 1, FREQUENT
    # one row for each distinct count
    for row in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        room -= row["n"]
        if room < 0:
            least = row["c"] + 1
            break
    m = ClassModel()
    top = [(-row["c"], row["word"].encode("utf-8", "surrogatepass")) for row in counts.where(F.col("c") >= least).toLocalIterator()]
    m.count = {w: -c for c, w in sorted(top)}
    end = END.encode()
    ranked = [w for w in m.count if w != end]
    clustered = [*ranked[:CLUSTERED], end]
    units = len(clustered) + 1
    number = {w: i for i, w in enumerate(clustered)}
    listed = list(m.count) if end in m.count else [*m.count, end]
    at, tokens = listed.index(end), _numbered(docs, text, listed)
    others = [units - 1] * POOLS
    pairs = _matrix(_cells(tokens, _lookup(listed, number, others), at, units * units, lambda ids: ids[:-1] * units + ids[1:]), units)
    of = exchange(pairs[:-1, :-1], CLASSES)
    k = int(of.max()) + 1
    member = np.zeros((units, k + 1))
    member[np.arange(units), [*of, k]] = 1
    m.cluster = {w: int(c) for w, c in zip(clustered, of, strict=True)}
    words = ranked[CLUSTERED : CLUSTERED + ASSIGNED]
    classes, m.pools = _assigned(tokens, listed, m.cluster, words, member.T @ pairs @ member)
    m.cluster |= dict(zip(words, classes, strict=True))
    jumps = _matrix(_cells(tokens, _lookup(listed, m.cluster, m.pools), at, k * k, lambda ids: ids[:-1] * k + ids[1:]), k)
    drop(tokens)
    m.classes = k
    seen = jumps.sum(axis=0)
    unigram = (seen + 1) / (seen.sum() + k)
    followed = jumps.sum(axis=1, keepdims=True)
    m.jump = np.log10(MIX * (jumps + 0.1) / (followed + 0.1 * k) + (1 - MIX) * unigram[None, :])

    # tokens and types of each class; all words, by a grouped sum
    shared = docs.sparkSession.sparkContext.broadcast((m.cluster, m.pools))

    def of_words(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cluster, pools = shared.value
        for part in words:
            data = [w.encode("utf-8", "surrogatepass") for w in part]
            yield pd.Series([pools[pool_of(w)] if (c := cluster.get(w)) is None else c for w in data], dtype="int32")

    held, kinds = np.zeros(k), np.zeros(k)
    by = counts.select(F.pandas_udf(of_words, "int")("word").alias("k"), "c").groupBy("k").agg(F.sum("c").alias("t"), F.count("*").alias("n"))
    for row in by.collect():
        held[row["k"]], kinds[row["k"]] = row["t"], row["n"]
    #: log10 of what (c + 1) of a word is divided by within its class; every class keeps room for one unseen word
    m.room = np.log10(held + kinds + 1)
    return m, counts, int(total), int(types)


PARTS = "n_tokens long, n_local long, base_local double, model_local double"


def score(docs: DataFrame, model: ClassModel, counts: DataFrame, total: int, types: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: n_tokens, n_known, base_score, score, perplexity; other columns than text stay.

    One pass scores every token whose word is frequent, and all transitions, in the task. The words left over, distinct
    ones of a row with their number, are joined with the table of counts and summed by row: no count is approximated and
    the table is never broadcast. Null and empty texts have one token, the end. Repeated rows are scored each.
    Words are numbered by row, not by id, so null and repeated ids do no harm.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    kept = [c for c in docs.columns if c != text]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        # words with a count here are numbered; others have -1 less their class
        listed = list(m.count)
        number = Numbers({w: i for i, w in enumerate(listed)}, [-1 - c for c in m.pools])
        number |= {w: -1 - c for w, c in m.cluster.items() if w not in m.count}
        class_of = np.array([m.class_of(w) for w in listed], dtype=np.int64)
        log = np.log10(np.array(list(m.count.values()), dtype=np.float64) + 1)
        for batch in batches:
            at = 0
            for words, flat in streams(iter([batch.select([text])])):
                ids = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
                here = ids >= 0
                k = np.where(here, class_of[ids] if len(listed) else 0, -1 - ids)
                logs = np.where(here, log[ids] if len(listed) else 0.0, 0.0)
                lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
                starts = np.cumsum(lengths) - lengths  # the tokens of a text stand one further on, behind the first end
                per = logs[1:] + m.jump[k[:-1], k[1:]] - m.room[k[1:]]
                left = np.flatnonzero(~here[1:])
                offsets = np.searchsorted(left, np.append(starts, len(flat) - 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(offsets), pa.array([flat[i + 1] for i in left.tolist()], type=pa.binary()).cast(pa.string()))
                part = batch.slice(at, len(words))
                at += len(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in kept), pa.array(lengths), pa.array(np.add.reduceat(here[1:].astype(np.int64), starts)),
                        pa.array(np.add.reduceat(logs[1:], starts)), pa.array(np.add.reduceat(per, starts)), rare,
                    ],
                    names=[*kept, "n_tokens", "n_local", "base_local", "model_local", "rare"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)
    parts = docs.mapInArrow(local, f"{fields + ', ' if fields else ''}{PARTS}, rare array<string>")
    parts = materialize(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    rare = parts.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
    summed = rare.join(counts, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"))
    joined = parts.drop("rare").join(summed, "row", "left")
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    size = math.log10(total + types + 1)
    value = F.col("model_local") + logs
    return joined.select(
        *[f"`{c}`" for c in kept], "n_tokens", (F.col("n_local") + more).alias("n_known"),
        (F.col("base_local") + logs - F.col("n_tokens") * F.lit(size)).alias("base_score"), value.alias("score"),
        F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
    )


def op10_brown(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold_of("doc_id", FOLDS) == HELD_FOLD
    model, counts, total, types = train(docs.where(~held))
    found = score(docs, model, counts, total, types)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
