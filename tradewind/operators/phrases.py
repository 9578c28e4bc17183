"""Finding given phrases in texts by an equi-join of word sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases of more words than this are refused: each length that occurs costs one row for every word of a text.
MOST_WORDS = 12
#: An index of at most so many phrases and UTF-8 bytes is broadcast; larger ones are joined by a shuffle of both sides.
BROADCAST_PHRASES, BROADCAST_BYTES = 100_000, 8 << 20


def phrase_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and #."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9#]+"), lambda w: w != "")


def _sequences(n: int) -> Column:
    """The n words from each word of w on, with its number."""
    return F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i + 1, n), " ").alias("gram")))


def phrase_hits(texts: DataFrame, phrases: DataFrame, text: str, key: str | list[str]) -> DataFrame:
    """(key, phrase_id, at, n_words): every place, as a word number from 0, where a phrase stands as whole words.

    key is a column of texts, or several that go with each place.

    phrases has (phrase_id, phrase). They are indexed by their words as one string, and a text sends its word sequences of the
    lengths that phrases have, so both meet in one equi-join; no text is compared with a phrase that it does not hold.
    """
    index = phrases.select("phrase_id", phrase_words(F.col("phrase")).alias("w")).where(F.size("w") > 0)
    index = index.select("phrase_id", F.array_join("w", " ").alias("gram"), F.size("w").alias("n_words"))
    sizes = index.groupBy("n_words").agg(F.count("*").alias("n"), F.sum(F.octet_length("gram")).alias("bytes")).orderBy(F.desc("n_words")).limit(MOST_WORDS + 1).collect()
    lengths = sorted(r["n_words"] for r in sizes)
    if lengths and lengths[-1] > MOST_WORDS:
        raise ValueError(f"a phrase has {lengths[-1]} words, at most {MOST_WORDS} are taken")
    keys = [key] if isinstance(key, str) else key
    rows = texts.select(*keys, phrase_words(F.col(text)).alias("w"))
    grams = [_sequences(n) for n in lengths]
    every = F.flatten(F.array(*[F.when(F.size("w") >= n, g).otherwise(F.array().cast("array<struct<at:int,gram:string>>")) for n, g in zip(lengths, grams)]))
    if not lengths:
        return rows.limit(0).select(*keys, F.lit(None).cast(phrases.schema["phrase_id"].dataType).alias("phrase_id"), F.lit(0).alias("at"), F.lit(0).alias("n_words"))
    # a plan's guess at the size of sequences is far too low, so without a hint they may be what is broadcast
    small = sum(r["n"] for r in sizes) <= BROADCAST_PHRASES and sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    return rows.select(*keys, F.inline(every)).join(index.hint("broadcast" if small else "merge"), "gram").select(*keys, "phrase_id", "at", "n_words")


def longest_phrase(texts: DataFrame, phrases: DataFrame, text: str, key: str) -> DataFrame:
    """(key, phrase_id, n_longest): of the phrases of a text the longest one; those marked `generic` only where no other stands.

    phrases has (phrase_id, phrase, generic). Phrases alike in both leave a tie: the smallest id, and their number.
    """
    rank = phrases.select("phrase_id", F.struct((~F.col("generic")).alias("named"), F.length("phrase").alias("wide")).alias("rank"))
    hits = phrase_hits(texts, phrases, text, key).select(key, "phrase_id").distinct().join(rank, "phrase_id")
    best = hits.withColumn("most", F.max("rank").over(Window.partitionBy(key))).where("rank = most")
    return best.groupBy(key).agg(F.min("phrase_id").alias("phrase_id"), F.count("*").alias("n_longest"))
