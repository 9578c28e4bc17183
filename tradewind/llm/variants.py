"""Spelling variants: words one edit apart by a positional q-gram index with a count filter, and each word's usual form.

Two words one edit apart keep all grams that the edit does not touch: in place before it, and shifted by one behind an insertion.
Of the longer word's grams at most GRAM are touched, so both words share at least max length - 2 * GRAM + 1 of them. Hence, with
each word's grams ordered by rarity, the first shared one is among the GRAM + 1 rarest of both: only these are posted. A posting
list is named by gram, length and position, which are the length and position limits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tradewind.llm.store import drop, materialize, read_table
from tradewind.llm.text import crc32_sql

LEAST_LENGTH, LEAST_COUNT = 7, 2
TYPO_EVERY = 31
#: A word's form has at least this many times its occurrences.
TIMES = 10
GRAM = 3
POSTED = GRAM + 1
#: Gram frequencies are counted in this many buckets, a bound on what is broadcast. Any order of grams is right; a good one is fast.
BUCKETS = 1 << 18
#: Posting lists longer than this are keyed further, by all grams that survive an edit.
DENSE = 64
#: Words of up to this many code points are compared as rows of a matrix, longer ones one by one.
SHORT = 64
PAIRS_AT_ONCE = 100_000
RUN = re.compile("[a-zÀ-ÿ]+")


def run_counts(doc_id, text: str | None, least: int = LEAST_LENGTH) -> Counter:
    """Words of one text: runs of letters, A-Z lowered; where TYPO_EVERY divides the crc32 of `<doc_id>:<run>`, without one letter."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    start = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
    out: Counter = Counter()
    for word, n in Counter(w for w in RUN.findall(data) if len(w) >= least).items():
        h = zlib.crc32(word.encode(), start)
        if h % TYPO_EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            out[word] += n
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            total.update(run_counts(doc_id, text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LENGTH code points with LEAST_COUNT occurrences or more in whole texts; counted a batch at a time first."""
    found = docs.select(F.col(id_col), F.col(text)).mapInArrow(_counts, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(len(words), length)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of x matters for every bit of the result."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(codes: np.ndarray) -> np.ndarray:
    """Whole grams as numbers: 21 bits for each code point."""
    c = codes.astype(np.uint64)
    return c[:, :-2] << np.uint64(42) | c[:, 1:-1] << np.uint64(21) | c[:, 2:]


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, total = batch.column(0).to_pylist(), np.zeros(BUCKETS, dtype=np.int64)
        for n, rows in _by_length(words):
            grams = _grams(_codes([words[i] for i in rows], n))
            total += np.bincount((_mix(grams) % np.uint64(BUCKETS)).astype(np.int64).ravel(), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])


POSTING = "key long, id long, word string, shorter boolean, dense boolean"


def _post(frequency, most: int):
    """Rows of words -> postings of their rarest grams, as the longer (or equal) word of a pair and as the shorter one.

    A list that has over `most` postings in the batch alone is known to be dense: its first most + 1 rows go on, so that it is dense for all, and
    the rest are marked at once. So no list sends more rows than that from a batch, however hot it is.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            keys, rows, short = [], [], []
            for n, at in _by_length(words):
                grams = _grams(_codes([words[i] for i in at], n))
                rare = frequency.value[(_mix(grams) % np.uint64(BUCKETS)).astype(np.int64)]
                order = np.argsort(grams, axis=1, kind="stable")
                order = np.take_along_axis(order, np.argsort(np.take_along_axis(rare, order, 1), axis=1, kind="stable"), 1)[:, :POSTED]
                gram, place = np.take_along_axis(grams, order, 1), order.astype(np.uint64)
                for longest, shift in ((n, 0), (n + 1, 0), (n + 1, 1)):
                    limits = (np.uint64(longest) << np.uint64(32)) | (place + np.uint64(shift))
                    keys.append(_mix(gram ^ _mix(limits)).ravel().view(np.int64))
                    rows.append(np.repeat(at, order.shape[1]))
                    short.append(np.full(order.size, longest > n))
            if not keys:
                continue
            key, row, shorter = np.concatenate(keys), np.concatenate(rows), np.concatenate(short)
            by = np.argsort(key, kind="stable")
            key, row, shorter = key[by], row[by], shorter[by]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            turn = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
            goes = turn <= most
            over = np.unique(row[~goes])
            spelled = pa.array(words, pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[goes]), pa.array(ids[row[goes]]), spelled.take(pa.array(row[goes])), pa.array(shorter[goes]), pa.array(np.zeros(goes.sum(), dtype=bool))],
                ["key", "id", "word", "shorter", "dense"],
            )
            if len(over):
                none = pa.nulls(len(over), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(ids[over]), pa.nulls(len(over), pa.string()), pa.nulls(len(over), pa.bool_()), pa.array(np.ones(len(over), dtype=bool))], ["key", "id", "word", "shorter", "dense"])

    return post


def _pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows within consecutive runs of these sizes, in bounded chunks."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(ends))
    partners = ends - at - 1
    total, first = np.cumsum(partners), 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS_AT_ONCE)))
        n = partners[first:last]
        left = np.repeat(at[first:last], n)
        step = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        yield left, left + 1 + step
        first = last


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of codes of equal length, or b one longer: whether enough positional grams agree (the count filter), and then whether exactly one edit parts them."""
    n, wide = a.shape[1], b.shape[1]
    here = a == b[:, :n]
    if n == wide:
        agree = here[:, :-2] & here[:, 1:-1] & here[:, 2:]
        found = here.sum(axis=1) == n - 1
    else:
        shifted = a == b[:, 1:]
        agree = here[:, :-2] & here[:, 1:-1] & here[:, 2:] | shifted[:, :-2] & shifted[:, 1:-1] & shifted[:, 2:]
        head = np.where(here.all(axis=1), n, here.argmin(axis=1))
        tail = np.where(shifted.all(axis=1), n, shifted[:, ::-1].argmin(axis=1))
        found = head + tail >= n
    return (agree.sum(axis=1) >= wide - 2 * GRAM + 1) & found


def _near_rows(words: list[str], shorter: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids one edit apart within runs of one posting list each."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    place, codes = np.zeros(len(words), dtype=np.int64), {}
    for n, rows in _by_length(words):
        if n <= SHORT:
            codes[n] = _codes([words[i] for i in rows], n)
            place[rows] = np.arange(len(rows))
    for left, right in _pairs(sizes):
        turned = lengths[left] > lengths[right]
        a, b = np.where(turned, right, left), np.where(turned, left, right)
        gap = lengths[b] - lengths[a]
        fits = np.where(gap == 0, ~shorter[a] & ~shorter[b], (gap == 1) & shorter[a] & ~shorter[b]) & (ids[a] != ids[b])
        a, b, gap = a[fits], b[fits], gap[fits]
        for kind in np.unique(lengths[a] * 2 + gap):
            n, g = int(kind) // 2, int(kind) % 2
            mine = np.flatnonzero((lengths[a] == n) & (gap == g))
            x, y = a[mine], b[mine]
            if n + g <= SHORT:
                ok = _verified(codes[n][place[x]], codes[n + g][place[y]])
            else:
                ok = np.array([near(words[i], words[j]) for i, j in zip(x, y)], dtype=bool)
            yield ids[x[ok]], ids[y[ok]]


LINKS = "a long, b long"


def _links(a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), other], ["a", "b"])


def _whole_runs(batches: Iterator[pa.RecordBatch], key: str, most: int | None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys and the sizes of the runs, from batches sorted by key. A run cut by a batch is kept for the
    next one; of a run longer than `most` no more than `most` + 1 rows are kept, and all its other rows come as runs of at least that size."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        keys = table[key].to_numpy()
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        cut = int(starts[-1])
        if most is not None and len(keys) - cut > 2 * most + 2:
            cut = len(keys) - most - 1
        kept = table.slice(cut)
        if cut:
            inside = starts[starts < cut]
            yield table.slice(0, cut), np.diff(np.r_[inside, cut])
    if kept is not None and kept.num_rows:
        keys = kept[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield kept, np.diff(np.r_[starts, len(keys)])


def _merge_postings(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Merged postings, sorted by list -> verified pairs, and (id, null) for the words of dense lists."""
    for table, sizes in _whole_runs(batches, "key", most):
        ids, heavy = table["id"].to_numpy(), np.repeat(sizes > most, sizes)
        if heavy.any():
            yield _links(np.unique(ids[heavy]))
        few = np.flatnonzero(~heavy)
        if len(few):
            words = table["word"].take(pa.array(few)).to_pylist()
            for a, b in _near_rows(words, table["shorter"].to_numpy()[few], sizes[sizes <= most], ids[few]):
                yield _links(a, b)


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of dense lists, keyed by all grams that survive one edit: what stands before it and what stands behind it.

    A replaced letter leaves both parts with their length; a word with a letter inserted leaves those of the shorter word.
    """
    for batch in batches:
        keys, rows, shorter = [], [], []
        for i, w in enumerate(batch.column(1).to_pylist()):
            mine = {(xxh64_intdigest(w, 1), True)}
            for at in range(len(w)):
                mine.add((xxh64_intdigest(f"{w[:at]}\0{w[at + 1:]}", 2), False))
                mine.add((xxh64_intdigest(w[:at] + w[at + 1 :], 1), False))
            keys += [k for k, _ in mine]
            shorter += [s for _, s in mine]
            rows += [i] * len(mine)
        at = pa.array(rows, pa.int64())
        signed = pa.array(np.array(keys, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([signed, batch.column(0).take(at), batch.column(1).take(at), pa.array(shorter, pa.bool_())], ["key", "id", "word", "shorter"])


def _merge_survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, sizes in _whole_runs(batches, "key", None):
        ids, shorter = table["id"].to_numpy(), table["shorter"].to_numpy()
        for a, b in _near_rows(table["word"].to_pylist(), shorter, sizes, ids):
            yield _links(a, b)


def near_words(words: DataFrame, dense: int = DENSE) -> DataFrame:
    """words (id, word), distinct words of LEAST_LENGTH code points or more -> (a, b): ids of all words one edit apart, once each way.

    Postings of the rarest grams are shuffled by list, merged in order by the sort of the shuffle, and paired under the length and
    position limits that name the list; a pair is kept if it reaches the count of shared grams that one edit leaves, and is then
    verified. Words of lists of more than `dense` postings meet where all grams that survive an edit are the same; that
    loses no pair, and a list then holds what is one edit apart or has a common neighbour. Work grows with the words and the pairs found.
    """
    spark = words.sparkSession
    counts = words.select("word").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = np.zeros(BUCKETS, dtype=np.int64)
    for row in counts.toLocalIterator():  # BUCKETS rows at most
        frequency[row["bucket"]] = row["n"]
    posted = words.select("id", "word").mapInArrow(_post(spark.sparkContext.broadcast(frequency), dense), POSTING)
    # a dense mark has no list; it is dealt out by its word
    spread = F.coalesce("key", F.xxhash64("id"))
    listed = posted.repartition(spread).sortWithinPartitions("key")
    found = materialize(listed.mapInArrow(_listed_or_marked(dense), LINKS), "listed")
    marked = found.where("b is null").select(F.col("a").alias("id")).distinct()
    rest = words.join(marked, "id", "left_semi").select("id", "word").mapInArrow(_survivors, "key long, id long, word string, shorter boolean")
    more = rest.repartition("key").sortWithinPartitions("key").mapInArrow(_merge_survivors, LINKS)
    both = found.where("b is not null").unionByName(more)
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _listed_or_marked(most: int):
    """Null keys sort first: marks of dense words pass, postings go on to be merged."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []

        def listed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if marks := batch.column(0).null_count:
                    ready.append(_links(batch.column(1).slice(0, marks).to_numpy()))
                yield batch.slice(marks)

        for out in _merge_postings(listed(), most):
            yield from ready
            ready.clear()
            yield out
        yield from ready

    return merged


def roots(forms: DataFrame) -> DataFrame:
    """forms (id, form: ids) -> (id, root): the last of the chain of forms. Each round doubles what a link spans, so rounds are few."""
    now = materialize(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("id").alias("mid"), F.col("root").alias("further"))
        after = materialize(now.join(ahead, now["root"] == ahead["mid"], "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop(now)
        now = after.select("id", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", times: int = TIMES, dense: int = DENSE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of word_counts().

    form: the near word with most occurrences (ties: smallest in code-point order) if it has `times` those of the word, else null;
    root: the end of the chain of forms, the word itself without one. Occurrences grow along a chain, so it has no cycle. Null and
    empty texts have no words; a null id counts as the empty text; repeated rows count each; other columns are not read. No words, no rows.
    """
    words = materialize(word_counts(docs, id_col, text).withColumn("id", F.monotonically_increasing_id()), "words")
    links = materialize(near_words(words, dense), "near")
    other = words.select(F.col("id").alias("b"), F.col("n").alias("other_n"), F.col("word").alias("other"))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"), F.col("b").alias("id"))).alias("best")
    found = links.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), best)
    usual = -F.col("best.n") >= F.lit(times) * F.col("n")
    known = words.join(found, words["id"] == found["a"], "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.word")).alias("form"), F.when(usual, -F.col("best.n")).alias("form_n"), F.when(usual, F.col("best.id")).alias("form_id")
    )
    known = materialize(known, "forms")
    ends = roots(known.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    ends = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return known.join(ends, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))


def op11_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: The rows of op11_variants, with near words found through their deletions.
SQL = f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY 1, 2),
hashed AS (SELECT run, n, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM low),
spelled AS (SELECT CASE WHEN h % {TYPO_EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
cut AS (SELECT word, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, unnest(range(1, CAST(length(word) + 1 AS BIGINT))) AS i FROM w)),
one AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND length(a.word) = length(b.word) WHERE a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON w.word = head || tail UNION SELECT w.word, cut.word FROM cut JOIN w ON w.word = head || tail),
best AS (SELECT one.word, other, w.n AS other_n, count(*) OVER (PARTITION BY one.word) AS n_near, row_number() OVER (PARTITION BY one.word ORDER BY w.n DESC, other) AS rn FROM one JOIN w ON w.word = other),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * w.n THEN other END AS form, CASE WHEN other_n >= {TIMES} * w.n THEN other_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word AND rn = 1),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = chain.at WHERE form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms last_form ON last_form.word = c.at WHERE last_form.form IS NULL"""
