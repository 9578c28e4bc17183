"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tradewind.llm.graph import connected_components
from tradewind.llm.store import materialize, read_table
from tradewind.llm.text import lower_words

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Four blocks of 16 bits: two fingerprints that differ in two bits agree in at least two whole blocks.
BLOCKS = [((1 << 16) - 1) << (16 * i) for i in range(4)]
#: Buckets of more fingerprints than this are resolved through one-bit neighbours, not pairs.
DENSE = 32


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint; 0 for a text without words. Fewer words than a shingle count as one shingle."""
    words = lower_words(text)
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.array([xxh64_intdigest(p, SEED) for p in parts], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([_signed(simhash(t)) for t in part], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs plus a signed 64-bit fingerprint of each whole text (null: no words)."""
    return docs.withColumn(out, F.pandas_udf(_fingerprint, "long")(F.col(text)))


def close_pairs(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp: long) -> links (a, b) that connect all pairs at MAX_BITS bits or fewer.

    Pigeonhole: the six pairs of 16-bit blocks are the keys, so every close pair shares a key. In an
    ordinary bucket the pairs are joined and verified. A dense bucket (a hot group of near copies) is
    split once more, without forming its pairs: two fingerprints are at most two bits apart exactly if
    a one-bit change of each (or none) meets in the same value, so each sends its 33 variants within
    the bucket's free bits, and the at most 65 that meet in a value are linked to the smallest.
    """
    masks = [BLOCKS[i] | BLOCKS[j] for i, j in combinations(range(4), 2)]
    keys = F.array(*[
        F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)
    ])
    keyed = prints.select("fp", F.inline(keys))
    sized = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    member = materialize(keyed.join(sized, ["c", "k"]), "buckets")

    few = member.where(F.col("n") <= DENSE)
    left, right = few.select("c", "k", F.col("fp").alias("a")), few.select("c", "k", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    plain = left.join(right, ["c", "k"]).where((F.col("a") < F.col("b")) & near).select("a", "b")

    free = [
        F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in masks
    ]
    flips = F.element_at(F.array(*free), F.col("c") + 1)
    meets = (
        member.where(F.col("n") > DENSE)
        .select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
        .groupBy("v")
        .agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    dense = meets.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where((F.col("a") < F.col("b")) & near)
    return plain.union(dense).distinct()


def _grouped(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, th, fp, root) for each row of docs: th is a hash of the text, root names the component."""
    marked = materialize(
        with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), "t", "fp").select(
            "id", F.xxhash64("t").alias("th"), "fp"
        ),
        "fingerprints",
    )
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = connected_components(close_pairs(nodes.select("fp")))
    linked = materialize(
        nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "linked",
    )
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(linked.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: its id, `fingerprint` (long) and `component_id`.

    component_id is the smallest id among all rows reachable through links of MAX_BITS bits or fewer,
    the row itself included. Equal fingerprints are one node, so copies are never expanded to pairs.
    Null and wordless texts have fingerprint 0 and link like others. A null id is passed over in the
    minimum (null only if all reachable ids are). Rows that share an id stay separate rows. An empty
    table gives no rows; other columns are not read.
    """
    return _grouped(docs, id_col, text).select(
        F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the smallest id, then the smallest text hash.

    Of rows equal in id and text one stays, whichever. A null id sorts last, so it stays only where no
    row of its component has an id. Columns and their order are those of docs.
    """
    found = _grouped(docs, id_col, text)
    won = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("w")).select(
        F.col("w.id").alias("won_id"), F.col("w.th").alias("won_th")
    )
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text).alias("th"))
    same = F.col(f"row.{id_col}").eqNullSafe(F.col("won_id")) & (F.col("th") == F.col("won_th"))
    kept = hashed.join(won, same, "left_semi")
    twice = found.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").select("id", F.col("th").alias("th2"))
    is_twice = F.col(f"row.{id_col}").eqNullSafe(F.col("id")) & (F.col("th") == F.col("th2"))
    one = (
        kept.join(twice, is_twice, "left_semi")
        .withColumn("id", F.col(f"row.{id_col}"))
        .dropDuplicates(["id", "th"])
        .select("row")
    )
    return kept.join(twice, is_twice, "left_anti").select("row").union(one).select("row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
