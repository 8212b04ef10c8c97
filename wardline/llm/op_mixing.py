"""Mixing to target weights with soft memberships.

*Posteriors.* A labelled table names the domain of some documents. Word log-odds (hashed words, one half of the bounded sample) and
surface counts feed a softmax regression (the other half); every document gets a posterior over the domains.
*Rates.* With t tokens, posterior p and rate r, a document adds r t p to the domains' expected token totals. Nonnegative rates are
sought so that the totals are the targets: least squares, solved by projected gradient descent. A rate's change counts by its
document's tokens (so a long text moves no further than a short one), and the residual is measured in the metric of the inverse
Gram matrix, in which one is a safe step length. One step is one aggregate over the stored vectors; a rate follows from the
posterior and the step vectors alone, so neither rates nor documents are ever gathered. Targets out of reach are approached in
that metric, ``MAX_STEPS`` steps far. A domain can be kept whole: rates of documents that most likely are of it are then
projected onto [1, inf) instead of [0, inf) at every step, and what is left of the gap to the targets is logged.
*Copies.* A document of rate r is kept floor(r + u) times, u drawn from the hash of its id: r copies in expectation.

Sample: at most ``PER_DOMAIN`` labelled texts of each domain by the smallest hash. The driver gets word counts of the hash space,
one short row per sampled text, and per step one number per domain.

Nulls and edge cases: a null or empty text has no tokens and keeps the rate it starts with; a null id draws u = 0.5; without labels
there is one domain, ``all``; a target of an unknown domain is dropped and the others are scaled up; domains without a target
get zero; repeated rows each count; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.hot import free_names
from wardline.llm import words as W
from wardline.llm.op_quality import text_counts
from wardline.llm.registry import query, table
from wardline.llm.sampling import smallest_hashes
from wardline.sources.tables import stored

PER_DOMAIN = 2000
SLOTS = 1 << 15
#: Log-odds from which a single word counts as telling.
STRONG = 1.5
MAX_STEPS, TOLERANCE = 40, 1e-4
_log = logging.getLogger(__name__)
#: Shares of the corpus' tokens that the query asks for.
TARGETS = {"plain": 0.90, "low": 0.08, "toxic": 0.02}


@dataclass
class Classifier:
    domains: list[str]
    log_odds: np.ndarray | None  # domain x slot
    centre: np.ndarray | None
    scale: np.ndarray | None
    weights: np.ndarray | None  # feature x domain, the constant last

    def posterior(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones((len(features), len(self.domains))) / len(self.domains)
        x = np.hstack([(features - self.centre) / self.scale, np.ones((len(features), 1))]) @ self.weights
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _slots(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word slots of a chunk of texts and the first word of each text."""
    for _, _, data, offsets in W.chunks(texts):
        data = W.LOWER[data]
        starts, ends, first = W.spans(data, offsets, W.NOT_WHITE)
        yield (W.span_hashes(data, starts, ends) >> W.U64(49)).astype(np.int64), first


def features(texts: pa.Array, log_odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row of features per text, its number of words)."""
    counts = text_counts(texts)
    n = np.maximum(counts["n_words"], 1)
    surface = np.stack([
        np.log1p(counts["n_words"]), counts["word_chars"] / n, counts["n_symbols"] / n, counts["n_repeat_words"] / n, np.log1p(counts["n_dup_lines"])
    ], 1)
    odds = []
    for slots, first in _slots(texts):
        size = np.maximum(np.diff(first), 1)[:, None]
        per_word = log_odds[:, slots]
        odds.append(np.hstack([_sums(per_word, first) / np.sqrt(size), np.log1p(np.maximum(_sums(np.maximum(per_word - STRONG, 0), first), 0))]))
    return np.hstack([surface, np.concatenate(odds) if odds else np.zeros((0, 2 * len(log_odds)))]), counts["n_words"]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values), values.shape[1] + 1))
    np.cumsum(values, axis=1, out=total[:, 1:])
    return np.diff(total[:, first], axis=1).T


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, steps: int = 400) -> np.ndarray:
    """Ridge-penalised softmax regression by accelerated gradient descent; the constant comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    target = np.eye(k)[y]
    step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 + ridge)
    w = look = np.zeros((x.shape[1], k))
    for i in range(steps):
        z = x @ look
        e = np.exp(z - z.max(1, keepdims=True))
        new = look - step * (x.T @ (e / e.sum(1, keepdims=True) - target) + ridge * look)
        look = new + i / (i + 3) * (new - w)
        w = new
    return w


def fit(docs: DataFrame, domains: DataFrame, per_domain: int = PER_DOMAIN) -> Classifier:
    """Learn posteriors from (doc_id, domain). Runs jobs over the sample."""
    known = domains.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    known = stored(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "domains")
    names = sorted(r["domain"] for r in known.select("domain").distinct().collect())  # one row per domain
    if len(names) < 2:
        return Classifier(names or ["all"], None, None, None, None)
    sample = None
    for name in names:
        part = smallest_hashes(known.where(F.col("domain") == name), per_domain)
        sample = part if sample is None else sample.unionByName(part)
    sample = stored(sample.withColumnRenamed("doc_id", "sample_id"), "domain-sample")
    half = F.pmod(F.xxhash64("sample_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), F.col("doc_id") == F.col("sample_id"))
    texts = stored(texts.select("text", "domain", half), "domain-texts")
    number = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((len(names), SLOTS), np.int64)
        for batch in batches:
            label = np.array([number[d] for d in batch.column(1).to_pylist()])
            at = 0
            for slots, first in _slots(batch.column(0)):
                rows = label[at + W.rows_of(first)]
                tally += np.bincount(rows * SLOTS + slots, minlength=tally.size).reshape(tally.shape)
                at += len(first) - 1
        for i, row in enumerate(tally):
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)), pa.array(used), pa.array(row[used])], names=["d", "slot", "n"])

    counts = np.zeros((len(names), SLOTS))
    totals = texts.where("half = 0").select("text", "domain").mapInArrow(count, "d int, slot long, n long").groupBy("d", "slot").agg(F.sum("n").alias("n"))
    got = totals.toPandas()
    counts[got["d"].to_numpy(int), got["slot"].to_numpy(int)] = got["n"].to_numpy(float)
    smooth = counts + 0.5 * (counts.sum(0) + 1) / (counts.sum() + SLOTS) * len(names)
    share = np.log(smooth / (smooth.sum(1, keepdims=True)))
    log_odds = np.clip(share - share.mean(0), -4, 4)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = features(batch.column(0), log_odds)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "domain"])

    rows = texts.where("half = 1").select("text", "domain").mapInArrow(read, "x array<double>, domain string").collect()
    if not rows:
        return Classifier(names, None, None, None, None)
    x, y = np.array([r["x"] for r in rows]), np.array([number[r["domain"]] for r in rows])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    size = known.groupBy("domain").agg(F.count("*").alias("n")).collect()
    weights = fit_softmax((x - centre) / scale, y, len(names))
    # the sample has as many texts of each domain as it can: take its shares back out, put the labelled table's in
    share = np.bincount(y, minlength=len(names)) / len(y)
    real = np.array([{r["domain"]: r["n"] for r in size}[n] for n in names], float)
    weights[-1] += np.log(real / real.sum()) - np.log(np.maximum(share, 1e-9))
    return Classifier(names, log_odds, centre, scale, weights)


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, p) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = soft(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(float)), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "p"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, n_tokens double, p array<double>")


def soft(texts: pa.Array, model: Classifier) -> tuple[np.ndarray, np.ndarray]:
    if model.log_odds is None:
        n = text_counts(texts)["n_words"]
        return model.posterior(np.zeros((len(n), 1))), n
    x, n = features(texts, model.log_odds)
    return model.posterior(x), n


def wanted(model: Classifier, targets: Mapping[str, float]) -> np.ndarray:
    """Target shares of the model's domains."""
    share = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains])
    return share / share.sum() if share.sum() else np.ones(len(share)) / len(share)


def least_rate(model: Classifier, whole: str | None) -> Column:
    """The smallest rate a document may have: one for those that most likely are of the domain ``whole``, else zero."""
    if whole not in model.domains:
        return F.lit(0.0)
    own = F.element_at("p", model.domains.index(whole) + 1) == F.array_max("p")
    return F.when(own, 1.0).otherwise(0.0)


def rate_column(start: float, steps: list[np.ndarray], least: Column | None = None) -> Column:
    """A document's rate after the given steps, from its posterior ``p``."""
    least = F.lit(0.0) if least is None else least
    rate = F.greatest(least, F.lit(start))
    for g in steps:
        move = sum((F.element_at("p", d + 1) * float(v) for d, v in enumerate(g)), F.lit(0.0))
        rate = F.greatest(least, rate - move)
    return rate


def rates_of(p: np.ndarray, start: float, steps: list[np.ndarray], whole: int | None = None) -> np.ndarray:
    """The same in NumPy; ``whole`` is the number of the domain that is kept whole."""
    least = np.zeros(len(p)) if whole is None else (p[:, whole] == p.max(1)).astype(float)
    rate = np.maximum(least, start)
    for g in steps:
        rate = np.maximum(least, rate - p @ g)
    return rate


def fit_rates(
    vectors: DataFrame, shares: np.ndarray, budget: float | None = None, max_steps: int = MAX_STEPS, least: Column | None = None
) -> tuple[float, list[np.ndarray]]:
    """Starting rate and projected-gradient steps towards expected totals of ``shares`` x ``budget`` tokens (default: all there are)."""
    k = len(shares)
    v = [F.col("n_tokens") * F.element_at("p", d + 1) for d in range(k)]
    row = vectors.agg(F.sum("n_tokens").alias("t"), *[F.sum(v[i] * F.element_at("p", j + 1)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    if not row["t"]:
        return 1.0, []
    gram = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    goal = shares * (row["t"] if budget is None else budget)
    start, steps = float(goal.sum() / row["t"]), []
    for _ in range(max_steps):
        gap = expected(vectors, k, rate_column(start, steps, least)) - goal
        if np.abs(gap).max() <= TOLERANCE * goal.sum():
            break
        steps.append(inverse @ gap)
    return start, steps


def expected(vectors: DataFrame, k: int, rate: Column) -> np.ndarray:
    """The ``k`` domains' expected token totals at a rate."""
    got = vectors.agg(*[F.sum(F.col("n_tokens") * F.element_at("p", d + 1) * rate).alias(f"s{d}") for d in range(k)]).first()
    return np.array([got[f"s{d}"] or 0.0 for d in range(k)])


def whole_budget(vectors: DataFrame, shares: np.ndarray, whole: int, budget: float | None) -> float | None:
    """``budget``, raised to what the protected documents, once each, need for their domain's share."""
    least = F.when(F.col("least") > 0, F.col("n_tokens")).otherwise(0.0)
    row = vectors.agg(F.sum("n_tokens").alias("t"), F.sum(least * F.element_at("p", whole + 1)).alias("own")).first()
    if not row["t"] or shares[whole] <= 0:
        return budget
    return max(row["t"] if budget is None else budget, row["own"] / float(shares[whole]))


def mixed(docs: DataFrame, domains: DataFrame, targets: Mapping[str, float], budget: float | None = None, whole: str | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says. Runs the fit when called; the texts are not shuffled.

    With ``whole``, a domain, no document that most likely is of it has a rate below one, so none of them is lost. The budget is
    raised where that domain's share of it is less than those documents; a gap to the targets that remains is logged.
    """
    model = fit(docs, domains)
    protected = model.domains.index(whole) if whole in model.domains else None
    vectors = stored(memberships(docs, model).withColumn("least", least_rate(model, whole)), "memberships")
    shares, least = wanted(model, targets), F.col("least")
    if protected is not None:
        budget = whole_budget(vectors, shares, protected, budget)
    start, steps = fit_rates(vectors, shares, budget, least=least)
    if protected is not None:
        got = expected(vectors, len(shares), rate_column(start, steps, least))
        gap = got / max(got.sum(), 1e-300) - shares
        if np.abs(gap).max() > TOLERANCE:
            said = ", ".join(f"{d} {g:+.4f}" for d, g in zip(model.domains, gap))
            _log.warning("%s text is kept whole; expected token shares less their targets: %s", whole, said)
    at, names = docs.columns.index("text"), docs.columns
    draw = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 40)) / float(1 << 40), F.lit(0.5))

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, _ = soft(batch.column(at), model)
            copies = np.floor(rates_of(p, start, steps, protected) + batch.column(len(names)).to_numpy()).astype(np.int64)
            for lo in range(0, len(copies), 1000):
                yield batch.select(names).take(pa.array(np.repeat(np.arange(lo, min(lo + 1000, len(copies))), copies[lo : lo + 1000])))

    return docs.withColumn(free_names(docs, "draw")[0], F.when(F.col("doc_id").isNull(), 0.5).otherwise(draw)).mapInArrow(repeat, docs.schema)


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labelled table: toxic, low (quality 0), plain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "plain")
    return labels.select("doc_id", domain.alias("domain"))


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, label_domains(table(spark, sf_dir, "labels")))
    vectors = stored(memberships(docs, model), "memberships")
    start, steps = fit_rates(vectors, wanted(model, TARGETS))
    rate = rate_column(start, steps)
    return vectors.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), *[F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(model.domains)], rate.alias("rate"))
