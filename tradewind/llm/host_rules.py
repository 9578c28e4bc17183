"""Quality rules whose failures are aggregated by host, shrunk by a beta prior, and judged by host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import materialize, read_table
from tradewind.llm.text import encoded

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PCT = 20
#: Softer rules: they only count towards the host, no document goes for them alone.
MAX_SYMBOL_PCT = 10
MAX_DUP_LINES_PCT = 30
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 12
#: A host is bad by a rule if its shrunk failure rate is this many standard deviations of the prior above the prior's mean, and MIN_RATE at least.
TAIL, MIN_RATE = 2.0, 0.05
#: Documents that the prior counts for at least and at most.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one whole text; a null or empty text has zeros."""
    data = encoded(text)
    words = data.split()
    n = len(words)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    spaces = len(data) - len(data.translate(None, SPACES))
    seen, lines, again = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    k, repeated = REPEAT_WINDOW, 0
    windows = list(zip(*(words[i:] for i in range(k))))
    if len(set(windows)) < len(windows):
        first, double = {}, set()
        for w in windows:
            if w in first:
                double.add(w)
            first[w] = True
        until = 0
        for at, w in enumerate(windows):
            if w in double:
                repeated += at + k - max(at, until)
                until = at + k
    return n, len(text or "") - spaces, symbols, again, repeated, lines


def _measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in MEASURES.split(", ")]
    for part in texts:
        yield pd.DataFrame([measure(t) for t in part], columns=names, dtype="int64")


def measured(docs: DataFrame, text: str = "text", out: str = "m") -> DataFrame:
    """docs plus a struct of the measures of MEASURES."""
    return docs.withColumn(out, F.pandas_udf(_measures, MEASURES)(F.col(text)))


def base_failed(m: str = "m"):
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PCT * F.col(f"{m}.n_words"))


#: The rules by which hosts are judged, in order.
RULES = ("words", "repeats", "symbols", "lines", "lengths")


def failures(m: str = "m"):
    """Array of one boolean for each of RULES; integer arithmetic, so it is the same on any engine."""
    x = lambda c: F.col(f"{m}.{c}")
    return F.array(
        x("n_words") < MIN_WORDS,
        100 * x("n_repeat_words") > MAX_REPEAT_PCT * x("n_words"),
        100 * x("n_symbols") > MAX_SYMBOL_PCT * x("n_words"),
        100 * x("n_dup_lines") > MAX_DUP_LINES_PCT * x("n_lines"),
        (x("word_chars") < MIN_WORD_CHARS * x("n_words")) | (x("word_chars") > MAX_WORD_CHARS * x("n_words")),
    )


def host_counts(marked: DataFrame) -> DataFrame:
    """(h, m) -> (h, n, failed: array of a count for each of RULES); combined before the shuffle, so a hot host is one key of sums."""
    rows = marked.select("h", failures().alias("f"))
    return rows.groupBy("h").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("f")[i]) for i in range(len(RULES))]).alias("failed"))


def host_verdicts(counts: DataFrame) -> DataFrame:
    """(h, n, failed) -> the same plus `rates`, the shrunk failure rates, and `bad`, by rule.

    For each rule a beta prior is fitted by moments over hosts of two or more documents: with mean m of their failure rates and
    variance v beyond what sampling gives, a + b = m(1-m)/v - 1, held between LEAST_PRIOR and MOST_PRIOR (few hosts, or no
    spread: MOST_PRIOR). rate = (failed + a) / (n + a + b). A host is bad by a rule in the upper tail of that prior: TAIL standard
    deviations above the mean, and MIN_RATE at least.
    """
    k = len(RULES)
    some = counts.where("n >= 2").select("n", *[(F.col("failed")[i] / F.col("n")).alias(f"r{i}") for i in range(k)])
    sums = [x for i in range(k) for x in (F.avg(f"r{i}").alias(f"m{i}"), F.var_samp(f"r{i}").alias(f"v{i}"))]
    prior = some.agg(*sums, F.avg(1 / F.col("n")).alias("noise"), F.count("*").alias("hosts"))

    def fitted(i: int):
        m = F.coalesce(F.col(f"m{i}"), F.lit(0.0))
        beyond = F.col(f"v{i}") - m * (1 - m) * F.col("noise")
        strength = F.when((F.col("hosts") >= 2) & (beyond > 0), m * (1 - m) / beyond - 1).otherwise(F.lit(MOST_PRIOR))
        strength = F.least(F.lit(MOST_PRIOR), F.greatest(F.lit(LEAST_PRIOR), strength))
        return F.struct(m.alias("m"), strength.alias("strength"), (m + TAIL * F.sqrt(m * (1 - m) / (strength + 1))).alias("bar"))

    prior = prior.select(F.array(*[fitted(i) for i in range(k)]).alias("prior"))
    rates = F.transform("prior", lambda p, i: (F.col("failed")[i] + p["m"] * p["strength"]) / (F.col("n") + p["strength"]))
    # the prior is one row
    found = counts.join(F.broadcast(prior)).withColumn("rates", rates)
    return found.withColumn("bad", F.transform("rates", lambda r, i: (r > F.col("prior")[i]["bar"]) & (r >= MIN_RATE))).drop("prior")


def judge(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """docs plus a struct `verdict`: the measures, base_failed, failed (names of RULES that the row fails), host_rates, host_bad and kept.

    A row is kept unless it fails a base rule (words, repeats), or fails a rule by which its host is bad: clean rows of a bad
    host stay, and so do rows of a good host that fail one of the other rules. Rows with a null host form one host of their own.
    Null and empty texts have no words and fail. Every row is judged, repeated rows too; an empty table gives none. Columns of
    docs keep their names, whatever they are (only `verdict` is replaced).
    """
    others = [F.col(f"row.`{c}`") for c in docs.columns if c != "verdict"]
    return _judged(docs, host, text).select(*others, "verdict")


def _judged(docs: DataFrame, host: str, text: str) -> DataFrame:
    """(row: struct of docs, verdict). Texts are measured once for the hosts and again with their rows, and are never shuffled."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(host).alias("h"), F.col(text).alias("t"))
    counts = materialize(host_counts(measured(docs.select(F.col(host).alias("h"), F.col(text).alias("t")), "t")), "hosts")
    return _joined(measured(rows, "t").drop("t"), counts).select("row", "verdict")


def _joined(marked: DataFrame, counts: DataFrame) -> DataFrame:
    hosts = host_verdicts(counts).select(F.col("h").alias("host"), "rates", "bad")
    found = marked.join(hosts, marked["h"].eqNullSafe(hosts["host"])).withColumn("f", failures())
    judged = F.exists(F.arrays_zip("f", "bad"), lambda x: x["f"] & x["bad"])
    named = F.filter(F.transform("f", lambda x, i: F.when(x, F.element_at(F.array(*map(F.lit, RULES)), i + 1))), lambda x: x.isNotNull())
    bad = F.exists("bad", lambda x: x)
    verdict = F.struct("m.*", base_failed().alias("base_failed"), named.alias("failed"), F.col("rates").alias("host_rates"), bad.alias("host_bad"), (~base_failed() & ~judged).alias("kept"))
    return found.withColumn("verdict", verdict)


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs."""
    return _judged(docs, host, text).where("verdict.kept").select("row.*")


def op7_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    marked = materialize(measured(docs.select("doc_id", F.col("source").alias("h"), "text")).drop("text"), "measures")
    return _joined(marked, host_counts(marked)).select(
        "doc_id", *[f"verdict.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        F.array_join("verdict.failed", ",").alias("failed"), F.col("verdict.host_bad").alias("host_bad"), F.array_max("verdict.host_rates").alias("host_rate"),
    )
