"""Convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of the hashed rows of the word and of its first
five and four bytes, which inflected forms share; filters of widths 1 to 3 run
over the whole text, their largest response anywhere in it (max pooling) feeds
a logistic layer.  The first embedding dimension starts as the smoothed
log-odds of the row among the training rows, the others at random; all
weights are then trained with Adam.  Scores are calibrated on a part of the
sample that the weights never saw, and a threshold is picked there for each
language with enough labelled rows (the common one otherwise); the language
takes part in that decision only, never in the score.

Training takes at most ``TRAIN_ROWS`` labelled rows (the smallest hashes of
their ids), a documented bound of rows, whose texts the driver holds as word
hashes whatever their length; scoring reads every whole text.

Defined cases: a null or empty text is scored as one without words; null or
unknown languages use the common threshold; rows without a label are never
trained on; rows that share a doc_id are scored separately, and the least of
their texts trains; without labelled rows or with one class every score is the
share of toxic labels (0 without); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, lists_of, sampled, tune

TRAIN_ROWS = 10_000
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 3, 64, 0.01
_PAD = BUCKETS  # an embedding of zeros
_GAP = max(WIDTHS) - 1
_WORDS_AT_ONCE = 100_000
#: ASCII marks become spaces, capital letters small ones.
_TABLE = bytes(32 if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def word_ids(text: str) -> np.ndarray:
    """Rows of each word of a text: (words, 3)."""
    words = text.encode().translate(_TABLE).split()
    parts = (words, [b"5" + w[:5] for w in words], [b"4" + w[:4] for w in words])
    return np.stack([np.fromiter(map(crc32, x), np.uint32, len(words)).astype(np.int64) % BUCKETS for x in parts], 1)


def _joined(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of several texts with padding between, and where each starts."""
    pad = np.full((_GAP, 3), _PAD)
    lengths = np.array([max(1, len(x)) for x in ids]) + _GAP
    parts = [y for x in ids for y in (x if len(x) else pad[:1], pad)]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)[:-1]])


@dataclass
class TextCnn:
    table: np.ndarray  # (BUCKETS + 1, SIZE)
    filters: list[np.ndarray]  # per width (width, SIZE, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    shift: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)  # calibration of the margin
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = 0.7
    constant: float | None = None

    def embedded(self, flat: np.ndarray) -> np.ndarray:
        return self.table[flat[..., 0]] + self.table[flat[..., 1]] + self.table[flat[..., 2]]

    def _responses(self, flat: np.ndarray) -> np.ndarray:
        e = self.embedded(flat)
        out = []
        for w, (f, b) in zip(WIDTHS, zip(self.filters, self.biases, strict=True), strict=True):
            r = e @ f[0] + b
            for k in range(1, w):
                r[:-k] += e[k:] @ f[k]
            # Windows start at words only, never in the gap to the next text.
            r[flat[:, 0] == _PAD] = b
            out.append(r)
        return np.concatenate(out, 1)

    def pooled(self, ids: list[np.ndarray]) -> np.ndarray:
        flat, starts = _joined(ids)
        return np.maximum(np.maximum.reduceat(self._responses(flat), starts, axis=0), 0)

    def margins(self, ids: list[np.ndarray]) -> np.ndarray:
        out, a = [np.zeros(0)], 0
        while a < len(ids):
            b, n = a + 1, len(ids[a])
            while b < len(ids) and n + len(ids[b]) < _WORDS_AT_ONCE:
                n += len(ids[b])
                b += 1
            out.append(self.pooled(ids[a:b]) @ self.out + self.shift[0])
            a = b
        return np.concatenate(out)

    def scores(self, ids: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(ids), self.constant)
        z = self.scale[0] * self.margins(ids) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _start(ids: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> TextCnn:
    counts = np.zeros((2, BUCKETS))
    for x, label in zip(ids, y, strict=True):
        counts[int(label), np.unique(x)] += 1
    totals = np.array([(y == 0).sum(), (y == 1).sum()]) + 1.0
    odds = np.log((counts[1] + 0.5) / totals[1]) - np.log((counts[0] + 0.5) / totals[0])
    odds *= np.minimum(1, counts.sum(0) / 8)  # rare words say little
    table = rng.normal(0, 0.1, (BUCKETS + 1, SIZE))
    table[:BUCKETS, 0] = odds / 2
    table[_PAD] = 0
    filters = [rng.normal(0, 0.1, (w, SIZE, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(rng.normal(0.5, 0.2, f[:, 0, :].shape)) * rng.choice([1, 1, 1, -1], FILTERS)
    k = FILTERS * len(WIDTHS)
    return TextCnn(table, filters, [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0.1, 0.05, k), np.zeros(1))


def train(ids: list[np.ndarray], y: np.ndarray, langs: list[str | None], seed: int = 7) -> TextCnn:
    """Fit, calibrate and pick thresholds; every fifth row calibrates."""
    rng = np.random.default_rng(seed)
    if len(y) == 0 or y.min() == y.max():
        net = _start([], np.zeros(0), rng)
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    held = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~held)
    net = _start([ids[i] for i in fit], y[fit], rng)
    params = [net.table, *net.filters, *net.biases, net.out, net.shift]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(y == 1, 0.5 / max(y[fit].mean(), 1e-6), 0.5 / max(1 - y[fit].mean(), 1e-6))
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            step += 1
            grads = _gradients(net, [ids[i] for i in part], y[part], weight[part])
            for p, (m, v), (rows, g) in zip(params, moments, grads, strict=True):
                # The table's rows that a batch did not touch stay as they are.
                m[rows] = 0.9 * m[rows] + 0.1 * g
                v[rows] = 0.999 * v[rows] + 0.001 * g * g
                p[rows] -= RATE * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.999**step)) + 1e-6)
    net.table, net.filters = net.table.astype("f4"), [f.astype("f4") for f in net.filters]
    net.biases = [b.astype("f4") for b in net.biases]
    test = np.flatnonzero(held) if held.sum() >= 50 else fit
    z = net.margins([ids[i] for i in test])
    net.scale = _calibrate(z, y[test])
    s = 1 / (1 + np.exp(-np.clip(net.scale[0] * z + net.scale[1], -40, 40)))
    net.common = _threshold(s, y[test])
    groups = np.array([langs[i] or "" for i in test])
    net.thresholds = {g: _threshold(s[groups == g], y[test][groups == g]) for g in set(groups) if g and (groups == g).sum() >= 50 and 0 < y[test][groups == g].sum()}
    return net


def _gradients(net: TextCnn, ids: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[tuple]:
    """(rows, gradient) of each parameter; only maxima pass a gradient on."""
    flat, starts = _joined(ids)
    r = net._responses(flat)
    ends = np.append(starts[1:], len(flat))
    where = np.stack([a + r[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)])
    top = np.take_along_axis(r, where, 0)
    h = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.shift[0], -40, 40)))
    dz = (p - y) * weight / len(y)
    dh = dz[:, None] * net.out * (top > 0)
    table: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    filters, biases = [], []
    for i, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        d, at = dh[:, own], where[:, own]
        biases.append((slice(None), d.sum(0)))
        d = d * (flat[at, 0] != _PAD)
        g = np.zeros_like(f)
        for k in range(w):
            words = flat[np.minimum(at + k, len(flat) - 1)]
            g[k] = np.einsum("nf,nfs->sf", d, net.embedded(words))
            change = (d[:, :, None] * f[k].T[None]).reshape(-1, SIZE)
            rows += [words[..., c].ravel() for c in range(3)]
            table += [change] * 3
        filters.append((slice(None), g))
    order = np.argsort(every := np.concatenate(rows), kind="stable")
    unique, first = np.unique(every[order], return_index=True)
    sums = np.add.reduceat(np.concatenate(table)[order], first)
    sums[unique == _PAD] = 0
    return [(unique, sums), *filters, *biases, (slice(None), h.T @ dz), (slice(None), np.array([dz.sum()]))]


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps, with smoothed targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(move, -1, 1)
    return float(w[0]), float(w[1])


def _threshold(s: np.ndarray, y: np.ndarray) -> float:
    """The middle of the best range of thresholds by F1."""
    order = np.argsort(-s)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    k = int(f1.argmax())
    below = s[order[k + 1]] if k + 1 < len(s) else 0.0
    return float((s[order[k]] + below) / 2)


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, label: str = "toxic", held_out: tuple[int, int] = (3, 1), threshold: float = 0.7, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, and the decision
    by its language's threshold (lang_threshold, toxic_for_lang)."""
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", held_out[0]) == held_out[1]).alias("held_out"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    chosen = known.where(crc_mod("doc_id", held_out[0]) != held_out[1]).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(train_rows)
    hashed = sampled(rows, chosen, "text", "lang").mapInArrow(_hashed, "doc_id long, lang string, y long, ids array<int>")
    sample = hashed.toArrow().sort_by("doc_id")
    ids = [x.reshape(-1, 3) for x in lists_of(sample.column("ids"))]
    net = spark.sparkContext.broadcast(train(ids, sample.column("y").to_numpy().astype("f8"), sample.column("lang").to_pylist()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for b in batches:
            s = model.scores([word_ids(t) for t in b.column("text").to_pylist()])
            limit = np.array([model.thresholds.get(x, model.common) for x in b.column("lang").to_pylist()], "f8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("i4")), pa.array(limit), pa.array(s >= limit)], ["doc_id", "held_out", "score", "predicted", "lang_threshold", "toxic_for_lang"])

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, lang_threshold double, toxic_for_lang boolean")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [word_ids(t).astype("i4").ravel() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("_y").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "lang", "y", "ids"])
