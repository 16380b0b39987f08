"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

A classifier fitted on labelled rows gives each document posteriors over domains. Nonnegative rates, one for each document,
are found by projected-gradient least squares on the domain totals: steps are summed before they are projected, and scaled by
the Gram matrix of the rows whose rate is not 0. A rate is then the projection of 1 plus the posteriors times the sum of the
steps, one number a domain, so an iteration is one aggregation of a narrow table, and at the end each rate is computed where
its text is: rates are never joined to texts. Tokens are those of a compiled tokenizer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, frugal, slices, strings, texts_of, word_hashes
from .token_counts import compiled

TABLE_BITS = 16
#: Bounds of the labelled sample: rows of each domain, bytes of a row, passes over these.
ROWS_A_DOMAIN, ROW_BYTES, PASSES, RATE = 1500, 1 << 16, 12, 0.05
#: Passes over the rows at most, how near a target counts as met, and how much more a missed target weighs than rates far from 1.
PASSES_MOST, TOLERANCE, STIFFNESS = 100, 1e-6, 1e7


@dataclass
class Classifier:
    """Multinomial logistic regression on the hashed words of a text, scaled by the square root of their number."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        each = self.weights[(h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)]
        sums = np.zeros((len(h) + 1, len(self.domains)))
        np.cumsum(each, axis=0, out=sums[1:])
        ends = np.cumsum(n)
        return (sums[ends] - sums[ends - n]) / np.sqrt(np.maximum(n, 1))[:, None] + self.bias

    def posteriors(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = self.scores(h, n)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 3) -> Classifier:
    """From (domain, text) rows."""
    rng = np.random.default_rng(seed)
    domains = sorted({d for d, _ in rows})
    k = len(domains)
    model = Classifier(domains, np.zeros((1 << TABLE_BITS, k), np.float64), np.zeros(k))
    if not rows:
        return model
    gold = np.array([domains.index(d) for d, _ in rows])
    features = []
    for _, t in rows:
        raw = t.encode()
        features.append(word_hashes(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))[0])
    m1, m2, step, order = np.zeros_like(model.weights), np.zeros_like(model.weights), 0, np.arange(len(rows))
    for _ in range(PASSES):
        rng.shuffle(order)
        for a in range(0, len(order), 200):
            part = order[a : a + 200]
            n = np.array([len(features[i]) for i in part])
            h = np.concatenate([features[i] for i in part])
            error = model.posteriors(h, n)
            error[np.arange(len(part)), gold[part]] -= 1
            error /= len(part)
            at = (h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
            each = np.repeat(error / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
            grad = np.stack([np.bincount(at, each[:, j], 1 << TABLE_BITS) for j in range(k)], axis=1) + 1e-6 * model.weights
            step += 1
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            model.weights -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
            model.bias -= 0.5 * error.sum(axis=0)
    return model


def fit(docs: DataFrame, labels: DataFrame, domain: Column, rows_a_domain: int = ROWS_A_DOMAIN, row_bytes: int = ROW_BYTES) -> Classifier:
    """A classifier from a sample of the labelled rows of at most `row_bytes` of text.

    About `rows_a_domain` of each domain are chosen by a hash of their id, at most twice that. `labels` has doc_id and the
    columns of `domain`, whose null rows are no labels. The sample is bounded by the parameters, so its ids may go to all
    executors, and the driver gets a bounded number of bytes.
    """
    known = labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")
    counts = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("domain") == name, rows_a_domain / n).otherwise(share)
    sample = known.where(uniform < share).limit(2 * rows_a_domain * max(1, len(counts)))
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= row_bytes).join(F.broadcast(sample), "doc_id").limit(4 * rows_a_domain * max(1, len(counts)))
    return train(sorted((r.domain, r.text) for r in texts.select("domain", "text").collect()))


def _lists(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))


def memberships(docs: DataFrame, model: Classifier, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, p (posteriors) of every row; the whole text counts. A text without words has the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast((model, compiled(tokenizer_path)))

    @frugal
    def run(batches):
        m, tokenizer = sent.value
        for batch in batches:
            at, data = strings(batch.column("text"))
            for a, b in slices(at):
                p = m.posteriors(*word_hashes(at[a : b + 1], data))
                n = tokenizer.count(texts_of(batch, a, b))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), _lists(p)], ["doc_id", "n_tokens", "p"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def _linear(offset: np.ndarray) -> Column:
    return sum((F.col("p")[i] * float(x) for i, x in enumerate(offset)), F.lit(1.0))


def with_rates(members: DataFrame, offset: np.ndarray) -> DataFrame:
    """`members` with the rate of each row."""
    return members.withColumn("rate", F.greatest(F.lit(0.0), _linear(offset)))


@dataclass
class Point:
    """What one pass tells of an offset: the shares of tokens by domain, the loss, its gradient, and its second derivative."""

    reached: np.ndarray
    loss: float
    gradient: np.ndarray
    curve: np.ndarray


def evaluate(members: DataFrame, offset: np.ndarray, targets: np.ndarray) -> Point | None:
    """One aggregation over all rows; None without tokens. Rows of rate 0 have no part in the curve."""
    k = len(targets)
    own = members.select(F.col("n_tokens").cast("double").alias("n"), *(F.col("p")[i].alias(f"p{i}") for i in range(k)), F.greatest(F.lit(0.0), _linear(offset)).alias("r"))
    free = F.when(F.col("r") > 0, F.col("n")).otherwise(0.0)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = own.agg(
        F.sum("n"), F.sum(F.col("n") * F.col("r") * F.col("r")),
        *(F.sum(F.col("n") * F.col("r") * F.col(f"p{i}")) for i in range(k)), *(F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs),
    ).first()
    if not row[0]:
        return None
    total, square, sums, products = row[0], row[1] / row[0], np.array(row[2 : 2 + k]) / row[0], np.array(row[2 + k :]) / row[0]
    curve = np.eye(k) / STIFFNESS
    for (i, j), x in zip(pairs, products, strict=True):
        curve[i, j] += x
        curve[j, i] += x * (i != j)
    return Point(sums, square / 2 + float(offset @ offset) / (2 * STIFFNESS) - float(targets @ offset), sums + offset / STIFFNESS - targets, curve)


@dataclass
class Solution:
    """offset: the sum of the steps; a row's rate is max(0, 1 + p * offset). reached: the shares of tokens by domain that the
    rates give. residual: by how much the farthest misses its target; above the tolerance only where no nonnegative rates
    reach the targets. passes: how often the rows were read."""

    offset: np.ndarray
    reached: np.ndarray
    residual: float
    passes: int


def solve(members: DataFrame, targets: np.ndarray, passes: int = PASSES_MOST) -> Solution:
    """Least squares of the expected domain shares against `targets`, over nonnegative rates of `members` (n_tokens, p).

    Rows weigh by their tokens, so that a row's length does not steer its rate; of the rates that reach the targets, those
    nearest to 1 are found. It ends when the targets are met or the gradient is gone; RuntimeError if neither comes about.
    """
    at = np.zeros(len(targets))
    now, read = evaluate(members, at, targets), 1
    if now is None:
        return Solution(at, np.zeros(len(targets)), 0.0, read)
    while True:
        residual = float(np.abs(targets - now.reached).max())
        if residual < TOLERANCE or np.abs(now.gradient).max() < TOLERANCE / 1000:
            return Solution(at, now.reached, residual, read)
        step = -np.linalg.solve(now.curve, now.gradient)
        size = 1.0
        while True:
            if read >= passes or size < 1e-6:
                raise RuntimeError(f"rates did not settle in {read} passes; {residual:.2g} off the targets")
            new, read = evaluate(members, at + size * step, targets), read + 1
            if new.loss <= now.loss + 1e-4 * size * float(now.gradient @ step) + 1e-12 * abs(now.loss):
                break
            size /= 4
        at, now = at + size * step, new


def _aimed(model: Classifier, targets: dict[str, float], budget: float) -> tuple[Classifier, np.ndarray]:
    if not model.domains:
        model, targets = Classifier(["all"], np.zeros((1 << TABLE_BITS, 1)), np.zeros(1)), {"all": 1.0}
    goal = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains])
    if not goal.sum():
        raise ValueError("no target is a domain of the labels")
    return model, budget * goal / goal.sum()


def mix(docs: DataFrame, model: Classifier, targets: dict[str, float], budget: float, tokenizer_path: str) -> tuple[DataFrame, Solution]:
    """(doc_id, n_tokens, p, rate of every row of `docs` (doc_id, text); what the rates reach). p is in the order of model.domains.

    `targets` are weights of the domains, scaled to sum 1; a domain not named has weight 0. `budget` is the wanted number of
    tokens as a share of those there are. Null and empty texts have no tokens and do not count, but get a rate too. Repeated
    rows count each; an empty table or one without tokens gives rate 1. Without labels there is one domain and rate `budget`.
    """
    model, goal = _aimed(model, targets, budget)
    members = Stored(memberships(docs, model, tokenizer_path), "members")
    found = solve(members.df, goal)
    return with_rates(members.df, found.offset), found


def copies(rate: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """The rates rounded to whole numbers of copies, up or down by a number from 0 to 1, so that the expectation is kept."""
    return np.floor(rate + uniform).astype(np.int32)


def resample(docs: DataFrame, model: Classifier, targets: dict[str, float], budget: float, tokenizer_path: str) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...), each as often as the rate that mix() gives it says.

    Rates are rounded by a hash of id and text, so rows equal in both are kept alike. All columns pass through; none is
    added. Each rate is computed where the text is, from the solver's offset, without a join or a shuffle.
    """
    model, goal = _aimed(model, targets, budget)
    members = Stored(memberships(docs, model, tokenizer_path), "members")
    found = solve(members.df, goal)
    members.drop()
    sent = docs.sparkSession.sparkContext.broadcast((model, found.offset))
    uniform = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    own = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"), uniform.alias("u"))  # no name can clash

    @frugal
    def run(batches):
        m, offset = sent.value
        for batch in batches:
            at, data = strings(batch.column("text"))
            times = [np.zeros(0, np.int32)]
            for a, b in slices(at):
                p = m.posteriors(*word_hashes(at[a : b + 1], data))
                times.append(copies(np.maximum(0.0, 1 + p @ offset), batch.column("u").slice(a, b - a).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(times))], ["row", "times"])

    counted = own.mapInArrow(run, T.StructType([own.schema["row"], T.StructField("times", T.IntegerType())])).where("times > 0")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
