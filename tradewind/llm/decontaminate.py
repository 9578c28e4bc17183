"""Benchmark decontamination through suffix arrays of the training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tradewind.llm.store import fresh, materialize, read_table
from tradewind.llm.text import alnum_words

WINDOW = 10
#: Bytes of benchmark text that are broadcast at a time, some 300,000 windows or 50 MB in memory; a larger benchmark takes several passes.
BLOCK_BYTES = 2 << 20
#: Words of one shard, i.e. of one suffix array.
SHARD_WORDS = 2_000_000
#: Pairs of an occurrence and a place in an item that are looked at together.
PAIRS = 4_000_000


class TestSuffixes:
    """A block of the benchmark: the distinct windows that start a test suffix, in word order, and where they occur."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        number = self.vocab
        self.items, texts = [], []
        for item, text in items:
            ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in alnum_words(text)), dtype=np.uint32)
            if len(ids):
                self.items.append(item)
                texts.append(ids)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        end = np.zeros(window, dtype=np.uint32)
        words = np.concatenate([x for t in texts for x in (t, end)]) if texts else end
        begins = np.cumsum(sizes + window) - sizes - window
        n_windows = np.maximum(sizes - window, 0) + 1
        item = np.repeat(np.arange(len(texts), dtype=np.int32), n_windows)
        word = (np.arange(len(item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)).astype(np.int32)
        at = begins[item] + word if len(item) else np.zeros(0, dtype=np.int64)
        keys = self._keys(words[at[:, None] + np.arange(window)])
        order = np.argsort(keys, kind="stable")
        keys, self.place_item, self.place_word = keys[order], item[order], word[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        self.low = keys[first]
        #: Number of the places of each window; they stand one window after another, items and words within them in order.
        self.n_places = np.diff(np.r_[first, len(keys)])
        self.first_place = first
        self.lengths = np.minimum(sizes[self.place_item[first]], window) if len(first) else first
        #: Windows of items shorter than `window`, and the keys that end what begins with them.
        self.short = np.flatnonzero(self.lengths < window)
        rows = words[at[order[first[self.short]]][:, None] + np.arange(window)] if len(self.short) else np.zeros((0, window), dtype=np.uint32)
        self.high = self._keys(np.where(np.arange(window) < self.lengths[self.short][:, None], rows, np.uint32(0xFFFFFFFF)))
        self.size = len(number) + 1
        #: Shortest window by its first word, and the word pairs that occur within windows.
        self.shortest = np.full(self.size + 1, 1 << 40, dtype=np.int64)
        if len(first):
            np.minimum.at(self.shortest, words[at[order[first]]], self.lengths)
        both = (words[:-1] > 0) & (words[1:] > 0)
        self.pairs = np.unique(words[:-1][both].astype(np.int64) * self.size + words[1:][both])

    def _keys(self, rows) -> np.ndarray:
        """Big-endian bytes, so that byte order is word order."""
        flat = np.array(rows, dtype=">u4").reshape(-1, self.window)
        if not len(flat):
            return np.zeros(0, dtype=f"S{4 * self.window}")
        return np.ascontiguousarray(flat).view(f"S{4 * self.window}").ravel()


class Shard:
    """The suffix array of some training documents, over the suffixes that a test suffix can reach.

    A suffix is left out only if its words, up to the length of the shortest window with its first
    word, contain a pair of neighbours that no window has; no test suffix matches there.
    """

    def __init__(self, docs: list[np.ndarray], test: TestSuffixes):
        self.lengths = np.array([len(d) for d in docs], dtype=np.int64)
        end = np.zeros(1, dtype=np.int64)
        self.words = np.concatenate([x for d in docs for x in (d, end)]) if docs else end
        self.begins = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]) if docs else end
        n = len(self.words)
        good = np.zeros(n, dtype=bool)
        if len(test.pairs):
            codes = self.words[:-1] * test.size + self.words[1:]
            at = np.searchsorted(test.pairs, codes)
            good[:-1] = test.pairs[np.minimum(at, len(test.pairs) - 1)] == codes
        stops = np.where(good, n, np.arange(n))
        reach = np.minimum.accumulate(stops[::-1])[::-1] - np.arange(n) + 1
        positions = np.flatnonzero((self.words > 0) & (reach >= test.shortest[self.words]))
        padded = np.concatenate([self.words, np.zeros(test.window, dtype=np.int64)])
        rows = padded[positions[:, None] + np.arange(test.window)]
        rows[np.logical_or.accumulate(rows == 0, axis=1)] = 0  # nothing is compared beyond a document's end
        keys = test._keys(rows) if len(positions) else np.zeros(0, dtype=f"S{4 * test.window}")
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = positions[order], keys[order]

    def search(self, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of every test suffix: (position, window number) of all occurrences."""
        if not len(test.low) or not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        low, high = np.searchsorted(self.keys, test.low, "left"), np.searchsorted(self.keys, test.low, "right")
        high[test.short] = np.searchsorted(self.keys, test.high, "right")
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.suffixes[low[which] + offset], which


def longest(doc: np.ndarray, at: np.ndarray, which: np.ndarray, test: TestSuffixes) -> list[tuple[int, int, int, int, int]]:
    """(document, item number, item_start, doc_start, length in words) of the longest match of each document and item that share a window.

    A match is a run of windows on one diagonal. doc ascends; at is a window's place in the document. Pairs of an occurrence and
    a place in an item are made for some documents at a time, and for a document with very many for one item at a time, so memory
    is bounded whatever is repeated. Of equal lengths the first in the document, then in the item, is taken.
    """
    out: list[tuple[int, int, int, int, int]] = []
    pairs = np.cumsum(test.n_places[which])
    begin = 0
    while begin < len(doc):
        done = pairs[begin - 1] if begin else 0
        end = max(int(np.searchsorted(pairs, done + PAIRS, "right")), begin + 1)
        if end < len(doc):  # whole documents
            cut = int(np.searchsorted(doc, doc[end], "left"))
            end = cut if cut > begin else int(np.searchsorted(doc, doc[begin], "right"))
        d, p, w = doc[begin:end], at[begin:end], which[begin:end]
        n = test.n_places[w]
        if n.sum() <= PAIRS:
            out += _runs(d, p, w, n, test, None)
        else:
            items = np.unique(np.concatenate([test.place_item[test.first_place[x] : test.first_place[x] + test.n_places[x]] for x in np.unique(w)]))
            for item in items.tolist():
                has = np.array([(test.place_item[test.first_place[x] : test.first_place[x] + test.n_places[x]] == item).any() for x in np.unique(w)])
                some = np.isin(w, np.unique(w)[has])
                out += _runs(d[some], p[some], w[some], n[some], test, item)
        begin = end
    return out


def _runs(d, p, w, n, test: TestSuffixes, item: int | None) -> list[tuple[int, int, int, int, int]]:
    if item is None:
        hit = np.repeat(np.arange(len(d)), n)
        place = test.first_place[w][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
    else:
        mine = {x: (f := test.first_place[x]) + np.flatnonzero(test.place_item[f : f + test.n_places[x]] == item) for x in np.unique(w).tolist()}
        sizes = np.array([len(mine[x]) for x in w.tolist()], dtype=np.int64)
        hit, place = np.repeat(np.arange(len(d)), sizes), np.concatenate([mine[x] for x in w.tolist()])
    of, j, at = test.place_item[place], test.place_word[place], p[hit]
    order = np.lexsort((at, at - j, of, d[hit]))
    of, j, at, doc, n_words = of[order], j[order], at[order], d[hit][order], test.lengths[w][hit][order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (of[1:] != of[:-1]) | (at[1:] - j[1:] != at[:-1] - j[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at))) - 1 + n_words[first]
    doc, of, j, at = doc[first], of[first], j[first], at[first]
    best = np.lexsort((j, at, -length, of, doc))
    keep = np.ones(len(best), dtype=bool)
    keep[1:] = (doc[best][1:] != doc[best][:-1]) | (of[best][1:] != of[best][:-1])
    best = best[keep]
    return list(zip(doc[best].tolist(), of[best].tolist(), j[best].tolist(), at[best].tolist(), length[best].tolist(), strict=True))


def scan(texts: list[str | None], test: TestSuffixes) -> list[dict]:
    """For each text: n_words, hit (sorted, disjoint [start, end) word ranges) and matches.

    matches has the longest verbatim match (item, item_start, doc_start, length in words) of each item that shares a window with
    the text; see longest(). A short item's match is the item.
    """
    get, out = test.vocab.get, []
    docs, words = [], 0

    def flush() -> None:
        shard = Shard(docs, test)
        at, which = shard.search(test)
        rows = [{"n_words": int(n), "hit": [], "matches": []} for n in shard.lengths]
        if len(at):
            doc = np.searchsorted(shard.begins, at, "right") - 1
            local = at - shard.begins[doc]
            order = np.lexsort((local, doc))
            doc, local, which = doc[order], local[order], which[order]
            ends = local + test.lengths[which]
            for d, p, e in zip(doc.tolist(), local.tolist(), ends.tolist(), strict=True):
                hit = rows[d]["hit"]
                if hit and hit[-1][1] >= p:
                    hit[-1][1] = max(hit[-1][1], e)
                else:
                    hit.append([p, e])
            for d, item, j, p, n in longest(doc, local, which, test):
                rows[d]["matches"].append([test.items[item], j, p, n])
        out.extend(rows)

    for text in texts:
        ids = np.fromiter((get(w, -1) for w in alnum_words(text)), dtype=np.int64)
        ids[ids < 0] = test.size  # a word that the benchmark lacks
        docs.append(ids)
        words += len(ids) + 1
        if words >= SHARD_WORDS:
            flush()
            docs, words = [], 0
    flush()
    return out


def found_type(item: T.DataType) -> T.StructType:
    """Type of the struct that with_matches() adds, for items whose id is of this type."""
    match = T.StructType([T.StructField("item_id", item), *(T.StructField(n, T.LongType()) for n in ("item_start", "doc_start", "length"))])
    return T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("matches", T.ArrayType(match)),
    ])


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The items, in blocks of BLOCK_BYTES of text or a single longer item."""
    block, size = [], 0
    for row in benchmark.select(item, text).toLocalIterator(prefetchPartitions=True):
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block or not size:
        yield block


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "contamination") -> DataFrame:
    """docs plus a struct: n_words, hit word ranges, and the longest verbatim matches with their places.

    Every document is searched against every item. The benchmark is the stated query set: blocks of
    BLOCK_BYTES of it are broadcast, one pass over docs for each; between passes the table is written
    to the shared folder. Training text is never broadcast or shuffled. Null and empty texts have no
    words; items without words are passed over; ids of items may be of any type; an item with a null id counts as a hit but
    is in `matches` with a null id. Repeated rows repeat their result. Other columns pass through; only
    `out` is replaced. Empty tables of either kind are fine.
    """
    spark = docs.sparkSession
    docs = docs.drop(out)
    found = found_type(benchmark.schema[item].dataType)
    arrow = to_arrow_schema(T.StructType([T.StructField(out, found)])).field(0).type
    schema = T.StructType([*docs.schema.fields, T.StructField(out, found)])
    docs = docs.select("*", F.lit(None).cast(found).alias(out))
    blocks = _blocks(benchmark, item, item_text)
    for n, block in enumerate(blocks):
        docs = materialize(docs, "searched") if n else docs
        test = spark.sparkContext.broadcast(TestSuffixes(block))

        def search(batches: Iterator[pa.RecordBatch], test=test) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = scan(batch.column(text).to_pylist(), test.value)
                for row, old in zip(rows, batch.column(out).to_pylist(), strict=True):
                    row["matches"] = [dict(zip(("item_id", "item_start", "doc_start", "length"), m, strict=True)) for m in row["matches"]]
                    if old:
                        row["hit"] = _union(old["hit"] + row["hit"])
                        row["matches"] = old["matches"] + row["matches"]
                cols = [pa.array(rows, type=arrow) if name == out else batch.column(name) for name in batch.schema.names]
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

        docs = docs.mapInArrow(search, schema)
    return docs


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that share no window with the benchmark, with the columns of docs."""
    out = fresh(docs, "contamination")
    return with_matches(docs, benchmark, text, out=out).where(F.size(f"{out}.hit") == 0).select([f"`{c}`" for c in docs.columns])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_matches(docs, read_table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    items = F.array_sort(F.array_distinct(F.transform(F.filter(c["matches"], lambda m: m["item_id"].isNotNull()), lambda m: m["item_id"].cast("string"))))
    hits = F.aggregate(c["hit"], F.lit(0).cast("long"), lambda n, h: n + h[1] - h[0])
    longest = F.coalesce(F.array_max(F.transform(c["matches"], lambda m: m["length"])), F.lit(0).cast("long"))
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), hits.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"), longest.alias("longest_match"),
    )
