"""Mixing to target weights by soft membership: posteriors of a labelled-table classifier, rates by projected gradient.

Everything here is DataFrame and SQL; the driver handles vectors and matrices with a few rows for each domain.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import drop, materialize, read_table

log = logging.getLogger(__name__)

#: Labelled documents that the classifier is fitted on at most: those of smallest hash of the id.
LABELLED = 20_000
#: Words and shapes that have a weight at most: those whose counts by domain stand out most.
VOCABULARY = 256
#: A word stands out if its count in a domain is this many standard deviations from what the domain's share gives.
SIGNIFICANT = 3.0
#: Documents that each domain's counts are filled up with, at the pooled rate of the word.
FILL = 10.0
#: Parts of the labelled documents; each is scored by the words of the others before weights are calibrated.
FOLDS = 5
#: Newton steps of the calibration, and the penalty on its squared weights.
NEWTON, RIDGE = 12, 1.0
#: Largest rate, so that no document is shipped more often however rare its domain is.
MOST = 4.0
#: Steps of the projected gradient after which it is an error that it has not settled; WRITTEN of them lie between two written tables.
STEPS, WRITTEN = 300, 8
#: Steps that are tried in one pass: how far, and the share of its trace that is added to the diagonal of their matrix.
LENGTHS, DAMPS = (1.0, 3.0), tuple(4.0**-i for i in range(1, 12))
#: The gradient counts as zero when a step of full length moves rates by less, as a root mean square by tokens.
STILL = 1e-6
#: The domains of the query and the pipeline, by labels: and the share of tokens that each is to have.
TARGETS = {"good": 0.92, "poor": 0.05, "toxic": 0.03}
SYMBOLS = "#*$%&|<>"


def words_of(text: str) -> Column:
    """Lower-cased runs of ASCII letters, digits and anything beyond ASCII; some elements may be empty. Null has none."""
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def evidence(text: str, words: str) -> Column:
    """The words of a text and two shapes of it: how often words recur at its length, and how many symbols it has a word.

    A shape starts with a line feed, as no word does.
    """
    n = F.size(words)
    size = F.least(F.floor(F.log2(n.cast("double"))), F.lit(14))
    fresh_share = F.floor(10 * F.size(F.array_distinct(words)) / n)
    symbols = F.octet_length(F.coalesce(F.col(text), F.lit(""))) - F.octet_length(F.translate(F.coalesce(F.col(text), F.lit("")), SYMBOLS, ""))
    shapes = F.array(F.concat(F.lit("\nr"), size, F.lit("/"), fresh_share), F.concat(F.lit("\ns"), F.least(F.lit(9), F.floor(4 * symbols / n))))
    return F.concat(F.col(words), shapes)


def n_tokens_of(words: str) -> Column:
    """The words of a row and an end. Only the first and the last element of words_of() can be empty."""
    n, w = F.size(words), F.col(words)
    return (n - (w[0] == "").cast("int") - ((n > 1) & (F.element_at(w, -1) == "")).cast("int") + 1).cast("long")


@dataclass
class Words:
    """Words or shapes that stand out, and their log odds by domain against the pooled rate."""

    names: list[str]
    odds: list[list[float]]

    def found(self, seen: str) -> Column:
        """Array of those distinct elements of `seen` that are known."""
        return F.array_intersect(F.col(seen), F.lit(self.names)) if self.names else F.array().cast("array<string>")

    def scores(self, found: str, domains: int) -> Column:
        """Array of one sum of log odds a domain, over the elements of `found`, each on an inverse-sine scale."""
        if not self.names:
            return F.array_repeat(F.lit(0.0), domains)
        names = F.lit(self.names)
        tables = [F.lit([row[d] for row in self.odds]) for d in range(domains)]
        total = lambda table: F.aggregate(F.col(found), F.lit(0.0), lambda s, w: s + F.element_at(table, F.array_position(names, w).cast("int")))
        return F.array(*[F.asinh(total(t)) for t in tables])


@dataclass
class Classifier:
    domains: list[str]
    words: Words
    #: weights of the scores and a constant, for each domain but the first
    weights: list[list[float]]
    #: mean log loss on the labelled documents that neither chose words nor weights, and that of the domains' shares alone
    loss: float
    prior_loss: float

    def posterior(self, scores: str) -> Column:
        return softmax(self.weights, scores, len(self.domains))


def softmax(weights: list[list[float]], scores: str, k: int) -> Column:
    """Array of one probability a domain. The weights are constants that all calls share compiled code for."""
    x = F.array_append(F.col(scores), F.lit(1.0))
    dot = lambda w: F.aggregate(F.zip_with(F.lit(w), x, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    logits = F.array(F.lit(0.0), *[dot([float(y) for y in w]) for w in weights])
    odds = F.transform(F.array(F.struct(logits.alias("z"))), lambda r: F.transform(r["z"], lambda z: F.exp(z - F.array_max(r["z"]))))
    return F.transform(odds, lambda r: F.transform(r, lambda o: o / F.aggregate(r, F.lit(0.0), lambda s, y: s + y)))[0]


def _chosen(counts: DataFrame, have: list[list[int]], skip: int | None) -> Words:
    """The words that stand out, from the counts of all folds but one. have has the documents of each domain and fold."""
    k, folds = len(have), [f for f in range(FOLDS) if f != skip]
    docs = [float(sum(have[d][f] for f in folds)) for d in range(k)]
    every = sum(docs)
    if not every:
        return Words([], [])
    by = counts.select("w", *[sum((F.col(f"n{d}_{f}") for f in folds), F.lit(0)).alias(f"n{d}") for d in range(k)])
    all_of = sum((F.col(f"n{d}") for d in range(1, k)), F.col("n0"))
    apart = [F.abs(F.col(f"n{d}") - all_of * (h / every)) / F.sqrt(all_of * (h / every) * (1 - h / every) + 1) for d, h in enumerate(docs)]
    most = F.greatest(*apart) if k > 1 else apart[0]
    rows = by.withColumn("z", most).where(F.col("z") >= SIGNIFICANT).orderBy(F.desc("z"), "w").limit(VOCABULARY).collect()
    odds = []
    for r in rows:
        c = [r[f"n{d}"] for d in range(k)]
        q = (sum(c) + 0.5) / (every + 1)
        odds.append([math.log((x + FILL * q) / (h + FILL) / q) for x, h in zip(c, docs, strict=True)])
    return Words([r["w"] for r in rows], odds)


def _calibrated(scored: DataFrame, k: int) -> list[list[float]]:
    """Multinomial logistic weights on scored (s, y: int), by Newton steps; each is one grouped sum of a few numbers."""
    m = (k - 1) * (k + 1)
    at, step, best = [0.0] * m, [0.0] * m, math.inf
    kept = list(at)
    shape = lambda v: [v[d * (k + 1) : (d + 1) * (k + 1)] for d in range(k - 1)]
    ridge = [RIDGE if j % (k + 1) < k else 1e-3 for j in range(m)]
    x = [*[f"s[{j}]" for j in range(k)], "1D"]
    over = [f"(p[{d + 1}] - cast(y = {d + 1} as double))" for d in range(k - 1)]
    curve = lambda a, b: f"p[{a + 1}] * ({int(a == b)} - p[{b + 1}])"
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    sums = ["sum(-ln(greatest(p[y], 1e-300D)))", *[f"sum({over[i // (k + 1)]} * {x[i % (k + 1)]})" for i in range(m)]]
    sums += [f"sum({curve(i // (k + 1), j // (k + 1))} * {x[i % (k + 1)]} * {x[j % (k + 1)]})" for i, j in pairs]
    for _ in range(NEWTON if k > 1 else 0):
        loss, *got = scored.select("s", "y", softmax(shape(at), "s", k).alias("p")).selectExpr(*sums).first()
        if loss is None:
            break
        loss += sum(r * a * a / 2 for r, a in zip(ridge, at, strict=True))
        if loss > best + 1e-9:
            step = [s / 2 for s in step]
            at = [a + s for a, s in zip(kept, step, strict=True)]
            continue
        settled = best - loss < 1e-6 * abs(loss)
        best, kept = loss, list(at)
        if settled:
            break
        slope = [g + r * a for g, r, a in zip(got[:m], ridge, at, strict=True)]
        bend = [[0.0] * m for _ in range(m)]
        for (i, j), v in zip(pairs, got[m:], strict=True):
            bend[i][j] = bend[j][i] = v
        for i, r in enumerate(ridge):
            bend[i][i] += r
        step = [-s for s in _solve(bend, slope)]
        at = [a + s for a, s in zip(kept, step, strict=True)]
    return shape(kept)


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text: str = "text", most: int = LABELLED) -> Classifier:
    """Words that stand out by domain, their log odds, and calibrated weights of the domains' sums.

    Fitted on `most` labelled documents at most, those of smallest hash of the id, so the ids that are broadcast are bounded.
    Copies of a text count once a domain, and a word once a text. labelled has (id, domain). Texts become lists of words where
    they are read. Weights are calibrated on sums that the words of other folds give, on all folds but the last, which the log loss is of. Without labels the posterior is even.
    """
    k, none = len(domains), [[0.0] * (len(domains) + 1)] * (len(domains) - 1)
    known = labelled.where(F.col("domain").isin(domains)).distinct().orderBy(F.xxhash64("id", F.lit(29)), "id", "domain").limit(most)
    number = sum((F.when(F.col("domain") == d, i).otherwise(0) for i, d in enumerate(domains)), F.lit(0))
    known = known.select(F.col("id").alias("kid"), number.cast("int").alias("y"))
    # `most` rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(F.broadcast(known), F.col("id") == F.col("kid"))
    rows = rows.select(F.xxhash64("t", F.lit(31)).alias("h"), "y", "t", words_of("t").alias("words"))
    rows = rows.select("h", "y", F.array_distinct(evidence("t", "words")).alias("seen")).groupBy("h", "y").agg(F.first("seen").alias("seen"))
    rows = materialize(rows.withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int")), "labelled")
    have = [[0] * FOLDS for _ in range(k)]
    for r in rows.groupBy("y", "fold").count().collect():
        have[r["y"]][r["fold"]] = r["count"]
    tokens = rows.select("y", "fold", F.explode("seen").alias("w")).where("w <> ''")
    cells = [F.count_if((F.col("y") == d) & (F.col("fold") == f)).alias(f"n{d}_{f}") for d in range(k) for f in range(FOLDS)]
    # a word of fewer documents than SIGNIFICANT cannot stand out
    counts = materialize(tokens.groupBy("w").agg(*cells).where(F.expr(" + ".join(f"n{d}_{f}" for d in range(k) for f in range(FOLDS))) >= SIGNIFICANT), "words")
    parts = [_chosen(counts, have, f) for f in range(FOLDS)]
    of_fold = lambda column: F.coalesce(*[F.when(F.col("fold") == f, column(part)) for f, part in enumerate(parts)])
    scored = rows.select("y", "fold", of_fold(lambda part: part.found("seen")).alias("found"))
    scored = materialize(scored.select("y", "fold", of_fold(lambda part: part.scores("found", k)).alias("s")), "scores")
    tried = _calibrated(scored.where(F.col("fold") != FOLDS - 1), k) if sum(map(sum, have)) else none
    last = scored.where(F.col("fold") == FOLDS - 1)
    share = [sum(have[d][:-1]) for d in range(k)]
    prior = [math.log((n + 1) / (sum(share) + k)) for n in share]
    surprise = lambda p: -F.log(F.greatest(F.element_at(p, F.col("y") + 1), F.lit(1e-300)))
    loss, plain = last.agg(F.avg(surprise(softmax(tried, "s", k))), F.avg(-F.element_at(F.lit(prior), F.col("y") + 1))).first()
    return Classifier(domains, _chosen(counts, have, None), tried, loss or 0.0, plain or 0.0)


def with_membership(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """(row: struct of docs, n_tokens, p: posterior by domain). A projection: nothing is shuffled. Equal texts have equal p."""
    k = len(model.domains)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("t"), words_of(text).alias("words"))
    rows = rows.select("row", n_tokens_of("words").alias("n_tokens"), evidence("t", "words").alias("seen"))
    rows = rows.select("row", "n_tokens", model.words.found("seen").alias("found"))
    rows = rows.select("row", "n_tokens", model.words.scores("found", k).alias("s"))
    return rows.select("row", "n_tokens", model.posterior("s").alias("p"))


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination with pivoting, for a matrix with a few rows a domain."""
    n = len(b)
    m = [[*row, y] for row, y in zip(a, b, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(n):
            if r != i and m[r][i]:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def _largest(g: list[list[float]]) -> float:
    """No less than the largest eigenvalue of a matrix of nonnegative numbers, by row sums scaled with an almost eigenvector."""
    v = [1.0] * len(g)
    for _ in range(200):
        w = [sum(x * y for x, y in zip(row, v, strict=True)) for row in g]
        v = [max(x / max(*w, 1e-300), 1e-9) for x in w] if len(w) > 1 else [1.0]
    return max(sum(x * y for x, y in zip(row, v, strict=True)) / u for row, u in zip(g, v, strict=True))


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = 5e-5, still: float = STILL, most: float | None = None, strict: bool = True) -> tuple[Column, list[float]]:
    """(rate, reached): rate is a Column over rows (n_tokens, p) whose expected domain totals are nearest to targets.

    Minimizes |A r - T|^2 over 0 <= r <= most (no bound for None), from r = 1, by projected gradient: A[k, i] = n_tokens * p[k] of row i. A step is
    r <- r - p' x, brought back between the bounds, and rows at a bound that the gradient p' e (e = A r - T) holds there stay. x is e in the
    metric of the other rows, e times the inverse of their sum of n_tokens * p p', which nearly meets the targets at once where no
    row is cut off at a bound; of its DAMPS and LENGTHS, the pair that leaves the least |e|; or e / L, a step in the plain metric, if that
    leaves less. L is the largest eigenvalue of that sum over all rows, so a plain step never overshoots, and |e| falls in every
    step. Rates depend on p alone, so rows of equal p are one row of the iteration.

    A step needs two distributed sums of a few numbers. The latest steps are a fold over a table of r that is written again
    after every WRITTEN of them, and the rate is a fold over all. Ends when every total is within `tolerance` of the whole
    budget; or when a plain step would move rates by `still` at most, the root mean square by tokens, or no step makes |e|
    less, which is the minimum where no rates between the bounds reach the targets. After `steps` it is a RuntimeError that none holds, or,
    if not strict, the nearest totals so far are taken; they only come nearer. No rows: rate 1.
    """
    k = len(targets)
    p = lambda i: F.col("p")[i]
    weight = F.col("n_tokens")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    alike = materialize(rows.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("n_tokens")), "memberships")
    products = lambda w: [total(w * p(i) * p(j)) for i in range(k) for j in range(k)]
    found = list(alike.agg(*[total(weight * p(i)) for i in range(k)], *products(weight), total(weight)).first())
    reached, gram, every = found[:k], found[k:-1], found[-1]
    square = lambda g: [list(g[i * k : i * k + k]) for i in range(k)]
    whole = max(1e-300, _largest(square(gram)))
    near = lambda: all(abs(x - t) <= tolerance * max(1.0, sum(targets)) for x, t in zip(reached, targets, strict=True))
    off = lambda at: sum((x - t) ** 2 for x, t in zip(at, targets, strict=True))
    numbers = lambda by: "array(" + ", ".join(f"array({', '.join(f'{y!r}D' for y in x)})" for x in by) + ")"
    dot = lambda x, first: " + ".join(f"{x}[{first + i}] * p[{i}]" for i in range(k))
    # of x = [x, e]; the numbers of steps are one constant, so that all steps share compiled code
    box = lambda r: f"greatest(0D, {r})" if most is None else f"least({most!r}D, greatest(0D, {r}))"
    top = lambda r, x: "" if most is None else f"when {r} >= {most!r}D and {dot(x, k)} < 0D then {most!r}D "
    moved = lambda r, x: f"case when {r} <= 0D and {dot(x, k)} > 0D then 0D {top(r, x)}else {box(f'{r} - ({dot(x, 0)})')} end"

    def fold(by: list[list[float]], r: str) -> Column:
        return F.expr(f"aggregate({numbers(by)}, {r}, (at, x) -> {moved('at', 'x')})") if by else F.expr(r)

    taken: list[list[float]] = []
    lately: list[list[float]] = []
    state, stored = alike.withColumn("r", F.lit(1.0 if most is None else min(1.0, most))), alike
    while every and not near():
        if len(taken) == steps:
            if not strict:
                log.warning("mixing rates did not settle in %d steps: totals %s for targets %s", steps, reached, targets)
                break
            raise RuntimeError(f"mixing rates did not settle in {steps} steps: totals {reached} for targets {targets}")
        e = [x - t for x, t in zip(reached, targets, strict=True)]
        plain = [x / whole for x in e]
        tried = state.select("n_tokens", "p", fold(lately, "r").alias("r"))
        tried = tried.withColumn("move", F.col("r") - F.expr(f"transform({numbers([plain + e])}, x -> {box(f"r - ({dot('x', 0)})")})")[0])
        inside = F.lit(True) if most is None else (F.col("r") < most) | (F.col("move") > 0)
        free = F.when(((F.col("r") > 0) | (F.col("move") < 0)) & inside, weight).otherwise(0.0)
        squares, *gram = tried.agg(total(weight * F.col("move") * F.col("move")), *products(free)).first()
        if squares <= still * still * every:
            break
        g = square(gram)
        trace = sum(g[i][i] for i in range(k))
        scaled = [_solve([[y + d * trace * (i == j) for j, y in enumerate(row)] for i, row in enumerate(g)], e) for d in DAMPS if trace]
        choices = [[length * y for y in x] + e for x in scaled for length in LENGTHS] + [plain + e]
        ends = tried.select("n_tokens", "p", F.expr(f"transform({numbers(choices)}, x -> {moved('r', 'x')})").alias("c"))
        sums = ends.agg(*[total(weight * p(i) * F.col("c")[j]) for j in range(len(choices)) for i in range(k)]).first()
        totals = [list(sums[j * k : j * k + k]) for j in range(len(choices))]
        best = min(range(len(choices)), key=lambda j: off(totals[j]))
        if not off(totals[best]) < off(reached):
            break
        reached = totals[best]
        taken.append(choices[best])
        lately.append(choices[best])
        if len(lately) == WRITTEN:
            state = materialize(state.select("n_tokens", "p", fold(lately, "r").alias("r")), "steps")
            drop(stored)
            stored, lately = state, []
    drop(stored)
    return fold(taken, "1D" if most is None else f"{min(1.0, most)!r}D"), reached


def domain_labels(labels: DataFrame) -> DataFrame:
    """(id, domain) from the labels table: toxic, else good or poor by quality; rows without a quality are unlabelled."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain")).where("id is not null and domain is not null")


@dataclass
class Mix:
    """What rates need: the classifier, the rate as a Column over (n_tokens, p), and the shares of the budget reached and wanted."""

    model: Classifier
    rate: Column
    reached: dict[str, float]
    wanted: dict[str, float]

    @property
    def residual(self) -> float:
        """Distance of the totals reached from those wanted, as a share of the budget."""
        return math.sqrt(sum((self.reached[d] - self.wanted[d]) ** 2 for d in self.wanted))


def _settled(members: DataFrame, model: Classifier, targets: dict[str, float], most: float | None) -> Mix:
    domains, weight = sorted(targets), sum(targets.values())
    budget = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    rate, reached = fit_rates(members, [budget * targets[d] / weight for d in domains], most=most, strict=False)
    shares = {d: x / max(1, budget) for d, x in zip(domains, reached, strict=True)}
    mix = Mix(model, rate, shares, {d: targets[d] / weight for d in domains})
    log.info("log loss %.4f (shares alone %.4f); shares reached %s, wanted %s", model.loss, model.prior_loss, mix.reached, mix.wanted)
    return mix


def copies_of(rate: str, *row: str) -> Column:
    """rate rounded down or up by a hash of the row, so that its expectation is rate."""
    chance = F.pmod(F.xxhash64(*row, F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(F.col(rate) + chance).cast("int")


def rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text: str = "text", most: float | None = MOST) -> tuple[DataFrame, Mix]:
    """((id, n_tokens, p, rate, copies) for each row of docs, the Mix). p follows the names of targets, sorted.

    The budget is all tokens of docs; a row has its words and an end. Weights need not sum to 1. Where no rates reach the
    targets the totals are those nearest by least squares, and the Mix has the residual. Null ids and texts are fine: a text
    without words has the posterior of its shape. Repeated rows have the same rate and copies. An empty table gives no rows.
    """
    model = fit_classifier(docs, labelled, sorted(targets), id_col, text)
    rows = with_membership(docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("h"), F.col(text).alias("t")), model, "t")
    rows = materialize(rows.select("row.id", "row.h", "n_tokens", "p"), "posteriors")
    mix = _settled(rows.select("n_tokens", "p"), model, targets, most)
    return rows.withColumn("rate", mix.rate).withColumn("copies", copies_of("rate", "h")).drop("h"), mix


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text: str = "text", most: float | None = MOST) -> DataFrame:
    """The rows of docs, each `copies` times (none at 0, and no more than `most`), with the columns of docs.

    Where the targets ask for more of a domain than `most` times what there is, its rows are at the bound and the totals are those
    nearest by least squares; the log has them.

    Posteriors are computed once for the rates and again where rows are copied: texts are read twice and never shuffled.
    """
    model = fit_classifier(docs, labelled, sorted(targets), id_col, text)
    only = docs.select(F.col(text).alias("t"))
    members = materialize(with_membership(only, model, "t").groupBy("p").agg(F.sum("n_tokens").alias("n_tokens")), "posteriors")
    mix = _settled(members, model, targets, most)
    rows = with_membership(docs, model, text).withColumn("rate", mix.rate)
    rows = rows.withColumn("h", F.xxhash64(F.col(f"row.`{id_col}`"), F.col(f"row.`{text}`")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), copies_of("rate", "h")))).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rates, mix = rated(docs, domain_labels(read_table(spark, sf_dir, "labels")), TARGETS)
    return rates.select(
        F.col("id").alias("doc_id"), "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))], "rate", "copies",
        F.lit(mix.residual).alias("residual"),
    )
