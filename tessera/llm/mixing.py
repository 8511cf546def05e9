"""Soft-membership mixing of documents to target domain weights.

A softmax classifier, fitted on a labelled table, gives every document its
posterior over domains.  Document rates r >= 0 are then fitted so that the
expected token totals per domain, sum of r * tokens * posterior, match the
targets, staying near 1 otherwise:

    min over r >= 0 of  sum_k (total_k(r) - target_k)^2 / T^2
                        + RIDGE * sum_i tokens_i / T * (r_i - 1)^2

by projected gradient steps with momentum.  A pass over the documents is one
distributed sum of K numbers; a document's rate follows from its posterior and
the errors of the passes so far, so nothing per document is kept at the driver
and no table is rewritten between passes.

Fitting the classifier takes at most ``TRAIN_ROWS`` labelled rows (a
documented bound); posteriors, totals and rates cover all documents.

Defined cases: null and empty texts have no tokens and the classifier's prior
as posterior; without labelled rows there are no domains and every rate is 1;
targets of domains without a labelled row go to the others in proportion;
rows that share a doc_id are separate, and the least of their texts trains;
extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, lists_of, sampled, tune
from tessera.llm.toxicity import BUCKETS, word_ids

TRAIN_ROWS = 8_000
EPOCHS, BATCH, RATE = 8, 64, 0.05
#: Weight of staying near 1; the fit ends when every total is within MISS of
#: its target, or when the errors of three passes differ by less than STILL
#: (targets that no rates meet), after PASSES at the latest.
RIDGE, PASSES, MISS, STILL = 1e-4, 400, 0.01, 2e-5
#: Passes after which the rates are written down, and documents of one task.
REPLAYED, TASK_ROWS = 25, 200_000


@dataclass
class DomainModel:
    """Softmax over hashed word features of a text."""

    domains: list[str]
    weights: np.ndarray  # (BUCKETS, domains)
    prior: np.ndarray

    def posterior(self, ids: np.ndarray) -> np.ndarray:
        rows = np.unique(ids)
        z = self.prior + (self.weights[rows].sum(0) / np.sqrt(len(rows)) if len(rows) else 0)
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_domains(ids: list[np.ndarray], y: np.ndarray, domains: list[str], seed: int = 3) -> DomainModel:
    """Adam on minibatches; starts from smoothed log-odds of the features."""
    k = len(domains)
    share = (np.bincount(y, minlength=k) + 1) / (len(y) + k)
    counts = np.full((BUCKETS, k), 0.5)
    rows = [np.unique(x) for x in ids]
    for r, label in zip(rows, y, strict=True):
        counts[r, label] += 1
    odds = np.log(counts / (np.bincount(y, minlength=k) + 1))
    known = np.minimum(1, (counts.sum(1, keepdims=True) - 0.5 * k) / 8)
    w = (odds - odds.mean(1, keepdims=True)) * known
    bias = np.log(share)
    rng = np.random.default_rng(seed)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            step += 1
            flat = np.concatenate([rows[i] for i in part]).astype(np.int64) if len(part) else np.zeros(0, np.int64)
            size = np.array([len(rows[i]) for i in part])
            doc = np.repeat(np.arange(len(part)), size)
            scale = 1 / np.sqrt(np.maximum(size, 1))
            z = bias + np.stack([np.bincount(doc, w[flat, c], len(part)) for c in range(k)], 1) * scale[:, None]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.eye(k)[y[part]]) / max(1, len(part))
            bias = bias - RATE * g.sum(0)
            touched, at = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(at, (g[:, c] * scale)[doc], len(touched)) for c in range(k)], 1)
            m[touched] = 0.9 * m[touched] + 0.1 * grad
            v[touched] = 0.99 * v[touched] + 0.01 * grad**2
            w[touched] -= RATE * m[touched] / (np.sqrt(v[touched]) + 1e-8) * 0.2
    return DomainModel(domains, w.astype("f4"), bias)


def posteriors(docs: DataFrame, labelled: DataFrame, *, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[str]]:
    """``docs`` with n_tokens (words) and the array posterior, and its
    domains.  ``labelled`` has doc_id and domain (string)."""
    tune(docs.sparkSession)
    known = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(train_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.unique(word_ids(t or "")).astype("i4") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("domain"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "domain", "ids"])

    # At most ``train_rows`` short rows travel, and the texts of these ids.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = sampled(texts, chosen, "text").mapInArrow(hashed, "doc_id long, domain string, ids array<int>").toArrow().sort_by("doc_id")
    domains = sorted(set(sample.column("domain").to_pylist()))
    y = np.array([domains.index(x) for x in sample.column("domain").to_pylist()], np.int64)
    ids = lists_of(sample.column("ids"))
    model = docs.sparkSession.sparkContext.broadcast(fit_domains(ids, y, domains) if domains else None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_ids(t or "") for t in b.column("text").to_pylist()]
            p = [model.value.posterior(x) if model.value else np.zeros(0) for x in words]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in words], pa.int64()), pa.array(p, pa.list_(pa.float64()))], [*b.schema.names, "n_tokens", "posterior"])

    rows = docs.drop("n_tokens", "posterior")
    schema = T.StructType([*rows.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(score, schema), domains


def _replayed(p: np.ndarray, errors: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps with these errors: where the next pass evaluates
    (with momentum), and the rates themselves."""
    rate = 1 / (1 + RIDGE)
    y, r = start or (np.ones(len(p)), np.ones(len(p)))
    root = np.sqrt(RIDGE / (1 + RIDGE))
    momentum = (1 - root) / (1 + root)
    for e in errors:
        nxt = np.maximum(0, y - rate * (p @ e + RIDGE * (y - 1)))
        y, r = np.maximum(0, nxt + momentum * (nxt - r)), nxt
    return y, r


def _state(b: pa.RecordBatch, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors and both rates of a batch of written states."""
    p = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
    return p, *_replayed(p, errors, (b.column(2).to_numpy(), b.column(3).to_numpy()))


def fit_rates(scratch: Scratch, placed: DataFrame, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Errors of each pass, which fix every document's rate, and the expected
    share of tokens per domain in the end.  ``placed`` is a written table of
    n_tokens and posterior; ``target`` are shares of all its tokens."""
    errors, written = np.zeros((0, len(target))), 0
    slim = placed.where("n_tokens > 0").select("n_tokens", "posterior", F.lit(1.0).alias("ahead"), F.lit(1.0).alias("now"))
    # A few numbers per document are read in every pass: few tasks do.
    slim = scratch.save(slim.coalesce(max(1, -(-slim.count() // TASK_ROWS))), "rates0")

    def totals(history: np.ndarray) -> np.ndarray:
        """Shares of tokens at the next point of evaluation and at the rates."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(2 * len(target) + 1)
            for b in batches:
                if b.num_rows:
                    n = b.column(0).to_numpy().astype("f8")
                    p, ahead, now = _state(b, history)
                    out[:-1] += np.concatenate([(n * r) @ p for r in (ahead, now)])
                    out[-1] += n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["k", "v"])

        got = slim.mapInArrow(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(2 * len(target) + 1)
        for r in got:  # 2 K + 1 numbers
            v[r["k"]] = r["v"]
        return (v[:-1] / v[-1] if v[-1] else np.tile(target, 2)).reshape(2, -1)

    def step(history: np.ndarray) -> DataFrame:
        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, _state(b, history)[1:])], b.schema.names)

        return slim.mapInArrow(move, slim.schema)

    still = 0
    while True:
        ahead, now = totals(errors[written:])
        met = bool((np.abs(now - target) <= MISS * np.maximum(target, 1e-3)).all())
        if met or still >= 3 or len(errors) >= PASSES:
            return errors, now
        still = still + 1 if len(errors) and np.abs(ahead - target - errors[-1]).max() < STILL else 0
        errors = np.vstack([errors, ahead - target])
        if len(errors) - written >= REPLAYED:
            slim, old, written = scratch.save(step(errors[written:]), f"rates{len(errors)}"), f"rates{written}", len(errors)
            scratch.drop(old)


def mix(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, budget: float = 1.0, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with n_tokens, posterior (map by domain) and rate.  Targets
    are weights; ``budget`` scales the present number of tokens."""
    scratch = Scratch(spark, "mixing")
    scored, domains = posteriors(docs, labelled, train_rows=train_rows)
    placed = scratch.save(scored, "posteriors")
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    if not domains or weight.sum() == 0:
        return placed.withColumns({"posterior": F.create_map().cast("map<string,double>"), "rate": F.lit(1.0)})
    errors, _ = fit_rates(scratch, placed, weight / weight.sum() * budget)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = b.column(b.num_columns - 1).values.to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_replayed(p, errors)[1])], [*b.schema.names, "rate"])

    rated = placed.mapInArrow(rate, T.StructType([*placed.schema.fields, T.StructField("rate", T.DoubleType())]))
    names = F.array(*(F.lit(d) for d in domains))
    return rated.withColumn("posterior", F.map_from_arrays(names, F.col("posterior")))


def copies(rate: Column, row: Column) -> Column:
    """Whole copies of a document: its rate rounded by a fixed hash of the row
    so that the expected number is the rate."""
    return F.floor(rate + F.pmod(F.xxhash64(row, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)).cast("int")


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic, poor and clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))
