"""Token ids in ORC: encoded in the tasks, range-partitioned and sorted by document id, with row indexes and Bloom filters."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm.store import read_table, scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Pieces that a worker keeps encoded; see Encoder._forget().
KNOWN_PIECES = 500_000
#: Documents that are encoded in one call.
CALL_ROWS = 500
#: UTF-8 bytes of text that one file holds, about.
FILE_BYTES = 64 << 20
#: Signs that end a piece as a token of their own, whatever stands before: behind a letter the split of byte-level BPE starts anew at them.
TAILS = ".,;:!?"
#: A white-space character that is neither a space nor a line feed, or nothing but a space.
ODD_SPACE = re.compile(r"[^\S \n]|^ $")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """The tokenizer with a memory of pieces.

    Byte-level BPE first splits a text and never merges across the split. A single space before a
    word goes with the word, and a single line feed between words stands alone, so a text whose white
    space is of these two kinds only is the concatenation of its pieces at them. Each distinct piece
    is encoded once by the tokenizer, many in one call with line feeds between; a sign behind a letter is split off first. Any
    other text, and one with a special token's sign, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.line_feed = self._whole("\n")
        self.known = {"": b"", "\n": self.line_feed}
        self.tail = {c: self._whole(c) for c in TAILS}
        self.met = np.zeros(1 << 24, dtype=bool)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        together = [p for p in pieces if not p.isspace()]
        found = {p: self._whole(p) for p in pieces if p.isspace()}
        feed = int.from_bytes(self.line_feed, "little")
        for at in range(0, len(together), 500):
            part = together[at : at + 500]
            ids = self._ids("\n".join(part))
            cuts, data = (4 * np.flatnonzero(ids == feed)).tolist(), ids.tobytes()
            cuts.append(len(data))
            found[part[0]] = data[: cuts[0]]
            found.update(zip(part[1:], map(data.__getitem__, map(slice, [c + 4 for c in cuts], cuts[1:])), strict=True))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, followed by END_ID."""
        end, known = np.array([END_ID], dtype="<u4").tobytes(), self.known
        split: list[list[str] | None] = []
        for text in texts:
            if not text:
                split.append([])
            elif "\0" in text or "<|" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
                split.append(None)
            else:
                split.append(text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"))
        new = list(set().union(*filter(None, split)).difference(known))
        odd = {p for p in new if ODD_SPACE.search(p)} if " " in new or ODD_SPACE.search("".join(new)) else ()
        if odd:
            split = [p if p is None or odd.isdisjoint(p) else None for p in split]
            new = [p for p in new if p not in odd]
        # a word with a sign behind it is the word's ids and the sign's
        tails = [p for p in new if p[-1] in TAILS and "A" <= p[-2:-1] <= "z" and p[-2].isalpha()]
        bases = {p[:-1] for p in tails}
        new = list(bases.union(new).difference(known, tails))
        known.update(self._learn(new))
        known.update([(p, known[p[:-1]] + self.tail[p[-1]]) for p in tails])
        new += tails
        out = [self._whole(t) + end if p is None else b"".join(map(known.__getitem__, p)) + end for t, p in zip(texts, split, strict=True)]
        self._forget(new)
        return out

    def _forget(self, new: list[str]) -> None:
        """Keep new pieces while half the memory is free, then those that are met again, by a table of bits, until it is full."""
        if not new or len(self.known) <= KNOWN_PIECES // 2:
            return
        at = np.fromiter(map(hash, new), dtype=np.int64, count=len(new)) & (len(self.met) - 1)
        again = self.met[at]
        self.met[at] = True
        room = KNOWN_PIECES - (len(self.known) - len(new))
        keep = again & (np.cumsum(again) <= room)
        for p, kept in zip(new, keep.tolist(), strict=True):
            if not kept:
                del self.known[p]


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text: str = "text", files: int | None = None) -> None:
    """Encode every whole text and write (doc_id, shard, shard_start, n_tokens, ids) as ORC in ascending id order.

    Shards are ranges of ids, one file each; within a shard rows ascend, so min/max statistics of stripes
    and row groups prune a search for an id, as the Bloom filters do for ids that fall between. The
    ORC writer stores ids with its integer run-length encoding. A null text is empty: one END_ID. A null id
    sorts first. Rows that share an id are adjacent, in the order of a hash of their text: the ranges are found from
    a sample of ids and hashes, so no text reaches the driver. Column clashes cannot happen: only the two
    named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    if files is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        files = max(1, -(-size // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, CALL_ROWS):
                part = batch.slice(at, CALL_ROWS)
                ids = encoder.encode(part.column("text").to_pylist())
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(counts)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.full(len(ids), shard, dtype=np.int32)), pa.array(start + ends - counts), pa.array(counts), pa.ListArray.from_arrays(offsets, flat)],
                    names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                start += int(ends[-1]) if len(ends) else 0

    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered.mapInArrow(encode, f"doc_id {kind}, shard int, shard_start long, n_tokens long, ids array<int>").write.options(**{
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
        "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd",
    }).orc(path)


def with_start(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows of the files, or some of them, plus `start`: the number of ids in all documents before.

    It is the shard's offset, from one sum a shard over `stored` (all rows), plus the stored position within
    the shard; ids are not read for it.
    """
    sums = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row a file
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(before, "shard").withColumn("start", F.col("before") + F.col("shard_start")).drop("before")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the files plus `start`. Stripes are read in parallel."""
    stored = spark.read.orc(path)
    return with_start(stored, stored)


def find_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of a few documents: the filter reaches ORC, which skips stripes by statistics and Bloom filter."""
    return spark.read.orc(path).where(F.col("doc_id").isin(ids))


def with_checksum(rows: DataFrame) -> DataFrame:
    """(doc_id, shard, shard_start, n_tokens, ids) -> ids_crc32 in place of ids, which are long gone before any shuffle."""

    kept = ["doc_id", "shard", "shard_start", "n_tokens"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(crc, type=pa.int64())], names=[*kept, "ids_crc32"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(*kept, "ids").mapInArrow(check, f"doc_id {kind}, shard int, shard_start long, n_tokens long, ids_crc32 long")


def op5_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    stored = spark.read.orc(path)
    return with_start(with_checksum(stored), stored).select("doc_id", "start", "n_tokens", "ids_crc32")
