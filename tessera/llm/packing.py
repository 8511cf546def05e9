"""Sum-of-squares packing of token sequences.

A document longer than a sequence is cut into pieces of full length, the
remainder first; full pieces fill a sequence alone.  Every other piece goes,
in descending order of length within its shard, where the sum over gaps g of
N(g)^2 becomes smallest, N(g) being the number of open bins with residual gap
g; a gap of 0 closes a bin.  Shards are dealt by a hash of the piece and hold
about ``SHARD_PIECES`` pieces each whatever the input size, so the work of a
task is bounded and the open sequences at its end are a small share.

Defined cases: a null text is empty and has only its end id; rows that share a
doc_id are separate documents; null doc_ids are kept; an empty table gives no
row; extra columns of the pieces pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, tune
from tessera.llm.tokens import default_tokenizer, encoder

CAPACITY = 1024
SHARD_PIECES = 8_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def token_pieces(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text: doc_id, piece, start, length, ids (binary,
    little-endian unsigned 32-bit)."""
    path = tokenizer or default_tokenizer()
    tune(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                wide = np.frombuffer(ids + end, enc.dtype).astype("<u4")
                rows += [(doc, k, s, n, wide[s : s + n].tobytes()) for k, (s, n) in enumerate(cut(len(wide), capacity))]
            if rows:
                doc, piece, start, length, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.

    Items come in descending order.  Moving a bin from gap g to g - s changes
    the sum of squares by 2 (N(g-s) - N(g)) + 2, or by 1 - 2 N(g) where the
    bin is then full; the least change wins, ties by the smallest gap.  A new
    bin is opened only where no open one has room, as every bin costs a
    sequence.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        fits = counts[s:]
        change = 2 * (counts[: capacity + 1 - s] - fits) + 2
        change[0] = 1 - 2 * fits[0]
        change[fits == 0] = np.iinfo(np.int64).max
        left = int(change.argmin())
        if fits[left]:
            counts[left + s] -= 1
            b = open_bins[left + s].pop()
            offset[i] = capacity - left - s
        else:
            left, b, offset[i] = capacity - s, bins, 0
            bins += 1
        where[i] = b
        if left:
            counts[left] += 1
            open_bins[left].append(b)
    return where, offset


def pack_pieces(spark: SparkSession, pieces: DataFrame, *, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset (long) to pieces with a ``length``."""
    scratch = Scratch(spark, "packing")
    kept = scratch.save(pieces, "pieces")
    shards = max(1, -(-kept.count() // shard_pieces))
    row = F.monotonically_increasing_id()  # stable: the table is written
    dealt = kept.withColumn("_shard", F.pmod(F.xxhash64(row), F.lit(shards)))
    schema = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_shard")
        where, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    return dealt.groupBy("_shard").applyInPandas(pack, schema)
