"""Histogram gradient-boosted trees over document statistics.

Whole-text statistics of every document are computed in Arrow batches.
The trees are fitted at the driver on a sample of at most ``TRAIN_ROWS``
labelled rows (the rows with the smallest hash of their id; a documented bound
of labelled data only), with quantile bins, histograms by node and logistic
loss.  All trees are flattened into four arrays, which are walked for whole
batches at a time.

Statistics take no label, language, source or id.

Defined cases: a null or empty text has zero statistics and gets a score; rows
without a label are never trained on; rows that share a doc_id are scored
separately, and the least of their texts trains with that id's label; without
labelled rows, or with one class only, every score is the share of good labels
(0.5 without); other columns pass through (earlier ``score`` and ``predicted``
columns are replaced).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import crc_mod, sampled, tune

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.2
L2, LEAST = 1.0, 20
STATS = ("log_bytes", "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "repeat_windows", "log_lines", "dup_lines", "words_per_line", "lower", "upper", "digit", "space", "line_end", "stop_marks", "hard_marks", "table_marks", "other_ascii", "high", "entropy", "end_marks")


def _classes() -> np.ndarray:
    """Byte classes as columns of a 256-row matrix."""
    b = np.arange(256)
    one = lambda chars: np.isin(b, list(chars.encode()))
    lower, upper, digit = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    groups = [lower, upper, digit, b == 32, b == 10, one(".,;:"), one("!?"), one("#*$%&|<>"), (b < 128), b >= 128]
    return np.stack(groups, 1).astype("f8")


_CLASSES = _classes()
_ENDS = frozenset(b".!?\"')")


def statistics(text: str) -> list[float]:
    """The numbers of ``STATS`` for one whole text."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(data, "u1"), minlength=256)
    share = (counts @ _CLASSES) / len(data)
    p = counts[counts > 0] / len(data)
    n = len(words)
    seen = Counter(words)
    windows = max(0, n - 2)
    repeats = 1 - len(set(zip(words, words[1:], words[2:]))) / windows if windows else 0.0  # noqa: B905
    lines = [x for x in data.split(b"\n") if x.strip()]
    size = np.fromiter(map(len, words), np.int64, n)
    lower, upper, digit, space, line_end, stop, hard, table, ascii_, high = share
    return [
        np.log1p(len(data)), np.log1p(n), size.mean(), (size > 12).mean(), (size < 3).mean(),
        len(seen) / n, max(seen.values()) / n, repeats, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        lower, upper, digit, space, line_end, stop, hard, table, ascii_ - lower - upper - digit - space - line_end - stop - hard - table, high,
        float(-(p * np.log2(p)).sum()), sum(x.rstrip()[-1] in _ENDS for x in lines) / len(lines),
    ]


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays: node i splits feature[i] at threshold[i] into
    left[i] and left[i] + 1; a leaf points to itself (left[i] = i, feature -1)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[node]
                right = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = self.left[node] + (right & (f >= 0))
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting with logistic loss on histograms of quantile bins."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        flat = np.zeros(1)
        return Trees(flat.astype(int) - 1, flat, flat.astype(int), flat, np.array([0]), float(np.log(share / (1 - share))))
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], 1)
    feature, threshold, left, value, roots = [], [], [], [], []

    def add() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, len(left)), (value, 0.0)):
            a.append(v)
        return len(left) - 1

    prior = float(np.log(share / (1 - share)))
    margin = np.full(n, prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(add())
        where = np.full(n, roots[-1])
        level = [roots[-1]]
        for depth in range(DEPTH + 1):
            index = {v: i for i, v in enumerate(level)}
            at = np.full(len(left), -1)
            at[level] = np.arange(len(level))
            slot = at[where]
            live = slot >= 0
            cell = (slot[live, None] * k + np.arange(k)) * BINS + binned[live]
            shape = (len(level), k, BINS)
            sums = [np.bincount(cell.ravel(), np.repeat(w[live], k), len(level) * k * BINS).reshape(shape) for w in (grad, hess, np.ones(n))]
            total = [s[:, 0].sum(1) for s in sums]
            for v, i in index.items():
                value[v] = -RATE * total[0][i] / (total[1][i] + L2)
            if depth == DEPTH:
                break
            g, h, c = (s.cumsum(2)[:, :, :-1] for s in sums)
            rest = [t[:, None, None] - s for t, s in zip(total, (g, h, c), strict=True)]
            gain = g**2 / (h + L2) + rest[0] ** 2 / (rest[1] + L2) - (total[0] ** 2 / (total[1] + L2))[:, None, None]
            gain[(c < LEAST) | (rest[2] < LEAST)] = -np.inf
            nxt = []
            for v, i in index.items():
                j, b = np.unravel_index(int(gain[i].argmax()), gain[i].shape)
                if gain[i, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[v], threshold[v] = int(j), float(cuts[j][b])
                    left[v] = add()
                    add()
                    mine = where == v
                    where[mine] = left[v] + (binned[mine, j] > b)
                    nxt += [left[v], left[v] + 1]
            level = nxt
            if not level:
                break
        margin += np.array(value)[where]
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), prior)


def fit_classifier(docs: DataFrame, labels: DataFrame, *, label: str = "quality", held_out: tuple[int, int] = (4, 2), rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on at most ``rows`` labelled documents outside the fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", held_out[0]) != held_out[1])).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    # At most ``rows`` pairs of numbers travel, and the texts of these ids.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = sampled(texts, chosen, "text").mapInArrow(_measured, "doc_id long, y double, stats array<float>").toArrow().sort_by("doc_id")
    x = np.array(sample.column("stats").to_pylist(), "f4").reshape(sample.num_rows, len(STATS))
    return fit_trees(x, sample.column("y").to_numpy())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        stats = [statistics(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array(stats, pa.list_(pa.float32()))], ["doc_id", "y", "stats"])


def classified(docs: DataFrame, trees: Trees, *, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted; all other columns pass through."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t or "") for t in b.column("text").to_pylist()], "f4").reshape(b.num_rows, len(STATS))
            s = model.value.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype("i4"))], [*b.schema.names, "score", "predicted"])

    rows = docs.drop("score", "predicted")
    fields = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(score, fields)


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, held_out: tuple[int, int] = (4, 2), **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    tune(spark)
    scored = classified(docs.select("doc_id", "text"), fit_classifier(docs, labels, held_out=held_out, **options))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", held_out[0]) == held_out[1]).alias("held_out"), "score", "predicted")
