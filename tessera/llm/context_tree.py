"""Context-tree weighting language model over bytes.

Every byte is eight binary decisions.  A decision's context is the bits of the
byte already known and the last 0 to 5 bytes.  Each node holds a Krichevsky-Trofimov estimate;
a node's weighted probability is half its own estimate plus half the product
of its children's, and a decision's probability mixes the estimates of all
depths with the resulting posteriors.  A child never met in training leaves
its parent's estimate as it is.

Fitting gathers, over all documents, one count per context and byte; documents
held out add the pairs they need with count zero, so that one table gives the
code length of every byte to be scored, and the depth is the same at any size.
The table stays distributed: the values of its ``HOT_KEYS`` most frequent keys
(a fixed bound) travel to the workers, which sum them up per document and
leave the other keys of a document with their numbers; those are joined to
the table and summed per document, without the texts.  The unigram base over
words is exact and works alike: ``HOT_WORDS`` words travel, all others are
joined.

Defined cases: a null or empty text has only its end symbol; rows with a null
id are held out; rows that share a doc_id each give a row; with no training
rows every bit has probability one half; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, crc_mod, tune

DEPTH = 5
#: Depths computed at the driver: at most 256^2 contexts of 255 nodes.
TOP = 2
START, END = 0xFE, 0xFF  # never bytes of UTF-8
HOT_WORDS, HOT_KEYS = 1 << 17, 1 << 21
#: Keys of one task of the model.
TASK_KEYS = 1 << 20
_CHUNK = 1 << 22
_LOG2 = 0.6931471805599453
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context << 8 | byte) of all symbols, and where each text starts."""
    pad = bytes([START]) * DEPTH
    data = np.frombuffer(b"".join([pad + t + bytes([END]) for t in texts]), "u1")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    keys = data.astype("u8")
    for d in range(1, DEPTH + 1):  # the latest byte is the most significant
        keys[d:] |= data[:-d].astype("u8") << np.uint64(8 * (DEPTH + 1 - d))
    keep = np.ones(len(data), bool)
    first = np.concatenate([[0], np.cumsum(lengths + DEPTH)[:-1]]).astype(np.int64)
    for k in range(DEPTH):
        keep[first + k] = False
    return keys[keep], np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2: Stirling's series after a shift by eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov estimate of these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - 1.1447298858494002


def _level(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> tuple[Level, np.ndarray]:
    """(nodes, chance of a one, posterior of stopping here), log weighted."""
    kt = _kt(zeros, ones)
    weighted = kt if children is None else np.logaddexp(kt, children) - _LOG2
    stop = np.ones_like(kt) if children is None else np.exp(np.minimum(0, kt - _LOG2 - weighted))
    return (nodes, ((ones + 0.5) / (zeros + ones + 1)).astype("f4"), stop.astype("f4")), weighted


def _fold(nodes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Node keys without their earliest context byte, and sums over them."""
    parents, at = np.unique(((nodes >> np.uint64(16)) << np.uint64(8)) | (nodes & np.uint64(255)), return_inverse=True)
    return parents, *(np.bincount(at, v, len(parents)) for v in values)


def _nodes(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted node keys (context << 8 | 1, known bits) with bit counts."""
    out = []
    for j in range(8):
        node = (pair & ~np.uint64(255)) | np.uint64(1 << j) | ((pair & np.uint64(255)) >> np.uint64(8 - j))
        ones = n * ((pair >> np.uint64(7 - j)) & np.uint64(1))
        node, at = np.unique(node, return_inverse=True)
        out.append((node, np.bincount(at, n - ones, len(node)), np.bincount(at, ones, len(node))))
    node, zeros, ones = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(node, kind="stable")
    return node[order], zeros[order], ones[order]


def lower_levels(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = TOP) -> tuple[dict[int, Level], tuple[np.ndarray, ...]]:
    """Levels depth .. top + 1 of the contexts in ``keys``, and what the level
    ``top`` gets from them: nodes, counts of zeros and ones, log weighted."""
    seen = counts > 0
    pair, n = keys[seen], counts[seen].astype("f8")
    levels: dict[int, Level] = {}
    below: tuple[np.ndarray, np.ndarray] | None = None
    for d in range(depth, top, -1):
        nodes, zeros, ones = _nodes(pair, n)
        children = None if below is None else _fold(*below)[1]
        levels[d], weighted = _level(nodes, zeros, ones, children)
        below = (nodes, weighted)
        pair, n = _fold(pair, n)  # a pair folds as a node does
    return levels, _fold(nodes, zeros, ones, weighted)


def upper_levels(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray, top: int = TOP) -> dict[int, Level]:
    """Levels top .. 0."""
    levels: dict[int, Level] = {}
    for d in range(top, -1, -1):
        levels[d], weighted = _level(nodes, zeros, ones, children)
        if d:
            nodes, zeros, ones, children = _fold(nodes, zeros, ones, weighted)
    return levels


def log10_of(levels: dict[int, Level], keys: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log10 probability of the byte of each key in its context."""
    out = np.zeros(len(keys))
    for a in range(0, len(keys), 1 << 19):
        part = keys[a : a + (1 << 19)]
        slot, byte = part >> np.uint64(8), part & np.uint64(255)
        for j in range(8):
            known = np.uint64(1 << j) | (byte >> np.uint64(8 - j))
            bit = (byte >> np.uint64(7 - j)) & np.uint64(1)
            p = np.full(len(part), np.nan)
            for d in range(depth, -1, -1):
                nodes, one, stop = levels[d]
                if not len(nodes):
                    continue
                node = ((slot >> np.uint64(8 * (depth - d))) << np.uint64(8)) | known
                at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                kt = np.where(bit == 1, one[at], 1 - one[at])
                mixed = np.where(np.isnan(p), kt, stop[at] * kt + (1 - stop[at]) * p)
                p = np.where(nodes[at] == node, mixed, p)
            out[a : a + (1 << 19)] += np.log10(np.where(np.isnan(p), 0.5, p))
    return out


class KeyTable:
    """Open-addressing hash table of keys to values; NaN where a key is not."""

    _FREE = np.uint64((1 << 64) - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys, self._values = np.full(1 << bits, self._FREE), np.full(1 << bits, np.nan, "f4")
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = np.flatnonzero(self._keys[at] == self._FREE)
            slots, first = np.unique(at[free], return_index=True)
            put = left[free[first]]
            self._keys[slots], self._values[slots] = keys[put], values[put]
            stay = np.ones(len(left), bool)
            stay[free[first]] = False
            left, at = left[stay], (at[stay] + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype("i8")

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out, held = self._values[at], self._keys[at]
        left = np.flatnonzero((held != keys) & (held != self._FREE))
        out[held == self._FREE] = np.nan
        at = at[left]
        while len(left):
            at = (at + 1) & self._mask
            held = self._keys[at]
            done = (held == keys[left]) | (held == self._FREE)
            out[left[done]] = self._values[at[done]]
            left, at = left[~done], at[~done]
        return out


_TABLES: dict[int, KeyTable] = {}


def _table_of(known) -> KeyTable:
    """The table of a broadcast (keys, values); one per Python worker."""
    if known.value[2] not in _TABLES:
        _TABLES.clear()
        _TABLES[known.value[2]] = KeyTable(*known.value[:2])
    return _TABLES[known.value[2]]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task: (kind, key, word, n); kind 0 byte keys, 1 words, 2
    the number of trained documents."""
    words: Counter[bytes] = Counter()
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    fresh: dict[bool, list[bytes]] = {True: [], False: []}
    waiting = {True: 0, False: 0}
    trained = 0

    def flush(train: bool) -> None:
        if fresh[train]:
            keys = keys_of(fresh[train])[0]
            keys, n = np.unique(keys, return_counts=True)
            parts.append((keys, n if train else np.zeros(len(keys), np.int64)))
            fresh[train], waiting[train] = [], 0
        if len(parts) > 8:
            parts[:] = [_merge(parts)]

    for b in batches:
        for text, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = text.encode()
            if not held:
                trained += 1
                words.update(data.lower().split())
            fresh[not held].append(data)
            waiting[not held] += len(data)
            if waiting[not held] >= _CHUNK:
                flush(not held)
    flush(True)
    flush(False)
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
    if parts:
        keys, n = _merge(parts)
        for a in range(0, len(keys), 100_000):
            k = keys[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k), "i4")), pa.array(k.astype("i8")), pa.nulls(len(k), pa.binary()), pa.array(n[a : a + 100_000])], schema=schema)
    items = list(words.items())
    for a in range(0, len(items), 50_000):
        w, n = zip(*items[a : a + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(w), "i4")), pa.nulls(len(w), pa.int64()), pa.array(w, pa.binary()), pa.array(n, pa.int64())], schema=schema)
    if trained:
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([trained], pa.int64())], schema=schema)


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    got = [b for b in batches if b.num_rows]
    return [c.to_numpy() for c in pa.Table.from_batches(got).columns] if got else None


def _model(scratch: Scratch, counts: DataFrame) -> DataFrame:
    """Every key with its log10 probability.

    The trees below the last three bytes are independent and have at most 2^24
    keys each; tasks take them by a hash.  What the depths above need is summed
    per node first.
    """
    spark = scratch.spark
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // TASK_KEYS))
    dealt = counts.repartition(tasks, F.shiftright("key", 8 * (DEPTH - TOP)))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _columns(batches)
        if got is not None:
            node, zeros, ones, weighted = lower_levels(got[0].astype("u8"), got[1])[1]
            yield pa.RecordBatch.from_arrays([pa.array(node.astype("i8")), pa.array(zeros), pa.array(ones), pa.array(weighted)], ["node", "zeros", "ones", "weighted"])

    sums = dealt.mapInArrow(up, "node long, zeros double, ones double, weighted double").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted"))
    node, zeros, ones, weighted = (c.to_numpy() for c in sums.orderBy("node").toArrow().columns)
    above = spark.sparkContext.broadcast(upper_levels(node.astype("u8"), zeros, ones, weighted))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _columns(batches)
        if got is not None:
            keys = got[0].astype("u8")
            order = np.argsort(keys)
            keys, n = keys[order], got[1][order]
            levels = above.value | lower_levels(keys, n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype("i8")), pa.array(n), pa.array(log10_of(levels, keys).astype("f4"))], ["key", "n", "value"])

    return scratch.save(dealt.mapInArrow(down, "key long, n long, value float"), "model")


def _hot_limit(model: DataFrame, most: int) -> int:
    """Least count that at most ``most`` keys reach, from a histogram of about
    eight bins per doubling."""
    bins = model.where("n > 0").groupBy(F.floor(8 * F.log2("n")).alias("b")).agg(F.count("*").alias("keys"), F.min("n").alias("n"))
    limit, total = 1 << 62, 0
    for r in bins.orderBy(F.desc("b")).collect():  # a few hundred rows
        total += r["keys"]
        if total > most:
            break
        limit = r["n"]
    return limit


def _cold(row: np.ndarray, keys: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """Per row the distinct ones of these keys and how often each occurs."""
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(keys))).astype("i4")
    at = pa.array(np.searchsorted(row[first], np.arange(rows + 1)).astype("i4"))
    return pa.ListArray.from_arrays(at, pa.array(keys[first].astype("i8"))), pa.ListArray.from_arrays(at, pa.array(times))


def score_documents(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out_modulus: int = 10, hot_words: int = HOT_WORDS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Fit on the rows not held out, score all rows: counts, base_score, score
    and bits_per_byte, the code length over the bytes of the text and its end."""
    tune(spark)
    scratch = Scratch(spark, "context-tree")
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), (crc_mod(id_col, held_out_modulus) == 0).alias("held_out"), F.col(id_col).cast("long").alias("doc_id"))

    gathered = rows.select("text", "held_out").mapInArrow(_gather, "kind int, key long, word binary, n long")
    counts = scratch.save(gathered.groupBy("kind", "key", "word").agg(F.sum("n").alias("n")), "counts")
    model = _model(scratch, counts.where("kind = 0").select("key", "n"))
    limit = _hot_limit(model, hot_keys)
    frequent = model.where(F.col("n") >= limit).select("key", "value").toArrow()
    known = spark.sparkContext.broadcast((frequent.column("key").to_numpy().astype("u8"), frequent.column("value").to_numpy(), uuid.uuid4().int))

    vocabulary = counts.where("kind = 1").select("word", "n")
    ends = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    trained = vocabulary.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    # The end is one more token: distinct where any document was trained on.
    train_tokens, distinct = trained["n"] + ends, trained["v"] + (ends > 0)
    hot = {bytes(r["word"]): float(np.log10(r["n"] + 0.1)) for r in vocabulary.orderBy(F.desc("n"), "word").limit(hot_words).toLocalIterator()}
    hot_table = spark.sparkContext.broadcast(hot)
    floor = np.log10(train_tokens + 0.1 * (distinct + 1))
    end_score = float(np.log10(ends + 0.1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, logs = _table_of(known), hot_table.value
        for b in batches:
            texts = [t.encode() for t in b.column(0).to_pylist()]
            code = np.zeros(len(texts))
            rare_row, rare_key = [np.zeros(0, "i8")], [np.zeros(0, "u8")]
            a = 0
            while a < len(texts):  # a few MB at a time
                e, size = a + 1, len(texts[a])
                while e < len(texts) and size + len(texts[e]) < _CHUNK:
                    size += len(texts[e])
                    e += 1
                k, starts = keys_of(texts[a:e])
                got = values.get(k).astype("f8")
                cold = np.flatnonzero(np.isnan(got))
                got[cold] = 0
                rare_row.append(a + np.searchsorted(starts, cold, side="right") - 1)
                rare_key.append(k[cold])
                code[a:e] = np.add.reduceat(got, starts)
                a = e
            rare = _cold(np.concatenate(rare_row), np.concatenate(rare_key), len(texts))
            tokens, sums, hits, cold = [], [], [], []
            for t in texts:
                split = t.lower().split()
                got = list(map(logs.get, split))
                missing = got.count(None)
                rest = Counter(w for w, g in zip(split, got, strict=True) if g is None) if missing else {}
                tokens.append(len(split) + 1)
                hits.append(len(split) - missing)
                sums.append(sum(g for g in got if g is not None) if missing else sum(got))
                cold.append(list(rest.items()))
            pairs = pa.array([[{"word": w, "n": c} for w, c in x] for x in cold], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(code), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(sums, pa.float64()), pa.array([len(t) for t in texts], pa.int64()), pairs, *rare], ["doc_id", "held_out", "code", "n_tokens", "n_hot", "hot_sum", "n_bytes", "cold", "keys", "times"])

    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, code double, n_tokens long, n_hot long, hot_sum double, n_bytes long, cold array<struct<word: binary, n: bigint>>, keys array<long>, times array<int>")
    scored = scratch.save(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("keys", "times")).alias("r")).select("row", "r.keys", "r.times")
    rest = model.where(F.col("n") < limit).select(F.col("key").alias("keys"), "value")
    codes = rare.join(rest, "keys").groupBy("row").agg(F.sum(F.col("times") * F.col("value").cast("double")).alias("rare_code"))
    cold = scored.select("row", F.explode("cold").alias("c")).select("row", "c.word", F.col("c.n").alias("times"))
    joined = cold.join(vocabulary, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("cold_sum"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_cold"))
    zero = F.lit(0)
    base = F.col("hot_sum") + F.coalesce("cold_sum", F.lit(0.0)) + F.lit(end_score) - F.col("n_tokens") * F.lit(float(floor))
    out = scored.drop("cold", "keys", "times").join(joined, "row", "left").join(codes, "row", "left")
    code = F.col("code") + F.coalesce("rare_code", F.lit(0.0))
    n_known = F.col("n_hot") + F.coalesce("n_cold", zero) + F.lit(int(ends > 0))
    return out.select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), code.alias("score"), (-code * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
