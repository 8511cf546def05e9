"""Token ids as Arrow stream files of equal-length sequences and masks.

``write_token_shards`` deals documents out by ranges of their id, encodes each
whole text, appends the end id and writes per range one shard:

* ``*.tokens.arrows``: Arrow stream; every record batch holds
  ``ROWS_PER_BATCH`` rows of ``input_ids`` (fixed-size list of ``seq_len``
  unsigned integers, the narrowest that holds the vocabulary) and ``mask``
  (fixed-size list of booleans; false on the padding of a shard's last row).
  All batches but the last have one byte size, so row i lies at a computable
  place: ``SequenceReader`` maps the file and returns it without a copy.
* ``*.docs.arrows``: Arrow stream with doc_id, start (in the shard), n_tokens.

A task writes under a name of its own and returns it; only names in the
committed manifest are ever read, so a lost or repeated task does no harm.

Defined cases: a null text counts as empty (one end id); null doc_ids sort
first; rows that share a doc_id are all kept, in order of their text, and may
lie in several shards; an empty table gives no shard; extra columns are
ignored; a text that holds a special token's content gets that token's id, as
the library gives it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, store, tune
from tessera.llm.tokens import default_tokenizer, encoder

SEQ_LEN = 2048
ROWS_PER_BATCH = 64
_HEAD = 24
_MANIFEST = "shard int, tokens_path string, docs_path string, n_docs long, n_tokens long"


def _schema(width: int, seq_len: int) -> pa.Schema:
    kind = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class ShardWriter:
    """Cuts a stream of ids into rows of ``seq_len`` and writes full batches."""

    def __init__(self, base: str, name: str, dtype: np.dtype, seq_len: int) -> None:
        fs, root = store(base)
        fs.create_dir(root, recursive=True)
        self.tokens_path, self.docs_path = f"{base}/{name}.tokens.arrows", f"{base}/{name}.docs.arrows"
        self._dtype, self._seq_len = dtype, seq_len
        self._schema = _schema(dtype.itemsize, seq_len)
        self._docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self._files = [fs.open_output_stream(f"{root}/{name}.tokens.arrows"), fs.open_output_stream(f"{root}/{name}.docs.arrows")]
        self._tokens = pa.ipc.new_stream(self._files[0], self._schema)
        self._docs = pa.ipc.new_stream(self._files[1], self._docs_schema)
        self._waiting: list[bytes] = []
        self._bytes = 0
        self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: list, texts_ids: list[bytes]) -> None:
        lengths = [len(x) // self._dtype.itemsize for x in texts_ids]
        starts = self.n_tokens + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("i8")
        self._docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths, pa.int64())], schema=self._docs_schema))
        self.n_docs += len(doc_ids)
        self.n_tokens += sum(lengths)
        for x in texts_ids:
            self._waiting.append(x)
            self._bytes += len(x)
            if self._bytes >= self._full():
                self._flush(last=False)

    def _full(self) -> int:
        return ROWS_PER_BATCH * self._seq_len * self._dtype.itemsize

    def _flush(self, last: bool) -> None:
        data = b"".join(self._waiting)
        full = self._full()
        at = 0
        while len(data) - at >= full or (last and at < len(data)):
            ids = np.frombuffer(data, self._dtype, count=min(full, len(data) - at) // self._dtype.itemsize, offset=at)
            rows = -(-len(ids) // self._seq_len)
            mask = np.zeros(rows * self._seq_len, bool)
            mask[: len(ids)] = True
            ids = np.pad(ids, (0, len(mask) - len(ids)))
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self._schema, strict=True)]
            self._tokens.write_batch(pa.record_batch(columns, schema=self._schema))
            at += full
        self._waiting, self._bytes = ([data[at:]], len(data) - at) if at < len(data) else ([], 0)

    def close(self) -> None:
        self._flush(last=True)
        for x in (self._tokens, self._docs, *self._files):
            x.close()


class SequenceReader:
    """Random access to the sequences of one shard, without a copy where the
    file can be mapped."""

    def __init__(self, uri: str) -> None:
        fs, path = store(uri)
        self._source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        stream = pa.ipc.open_stream(self._source)
        self._head = self._source.tell()
        self.schema = stream.schema
        self.seq_len = self.schema.field("input_ids").type.list_size
        size = self._source.size()
        # The first message gives the byte size of every full batch.
        if size - self._head > 8:
            pa.ipc.read_message(self._source)
            self._stride = self._source.tell() - self._head
        else:
            self._stride = 1
        self._n_batches = max(0, -(-(size - 8 - self._head) // self._stride))
        self._last = self.batch(self._n_batches - 1).num_rows if self._n_batches else 0

    def __len__(self) -> int:
        return max(0, self._n_batches - 1) * ROWS_PER_BATCH + self._last

    def batch(self, k: int) -> pa.RecordBatch:
        self._source.seek(self._head + k * self._stride)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self._source), self.schema)

    def __getitem__(self, row: int) -> tuple[np.ndarray, pa.Array]:
        if not 0 <= row < len(self):
            raise IndexError(row)
        batch, at = self.batch(row // ROWS_PER_BATCH), row % ROWS_PER_BATCH
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)[at * self.seq_len : (at + 1) * self.seq_len]
        return ids, batch.column(1).values.slice(at * self.seq_len, self.seq_len)

    def ids(self) -> Iterator[np.ndarray]:
        """Real ids (mask applied) batch by batch."""
        for k in range(self._n_batches):
            batch = self.batch(k)
            ids = batch.column(0).values.to_numpy(zero_copy_only=True)
            yield ids if k < self._n_batches - 1 else ids[batch.column(1).values.to_numpy(zero_copy_only=False)]


def write_token_shards(docs: DataFrame, out_dir: str, *, tokenizer: str | None = None, end_id: int = 0, seq_len: int = SEQ_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below ``out_dir``; returns the plan of the manifest,
    one row per shard in ascending order of doc_id.  Materialise it before use."""
    path = tokenizer or default_tokenizer()
    tune(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        shard, writer = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                writer = ShardWriter(out_dir, f"shard-{shard:06d}-{uuid.uuid4().hex}", enc.dtype, seq_len)
            writer.add(b.column(0).to_pylist(), [x + end for x in enc.encode(b.column(1).to_pylist())])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "tokens_path": [writer.tokens_path], "docs_path": [writer.docs_path], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Many rows of one id (or of none) part at the beginnings of their texts.
    head = F.left("text", F.lit(_HEAD))
    return rows.repartitionByRange("doc_id", head).sortWithinPartitions("doc_id", "text").mapInArrow(write, _MANIFEST)


def read_token_documents(manifest: DataFrame, *, digest: bool = False) -> DataFrame:
    """Documents read back from the files of a materialised manifest: doc_id,
    start (ids of all documents before it), n_tokens and ``ids`` (array), or
    with ``digest`` ids_crc32 instead of the ids."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    shards = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from _documents(row, digest)

    extra = "ids_crc32 long" if digest else "ids array<long>"
    return placed.repartition(shards, "shard").mapInArrow(read, f"doc_id long, start long, n_tokens long, {extra}")


def _documents(row: dict, digest: bool) -> Iterator[pa.RecordBatch]:
    stream, buffer = SequenceReader(row["tokens_path"]).ids(), np.empty(0, "<u4")
    fs, path = store(row["docs_path"])
    with fs.open_input_stream(path) as f, pa.ipc.open_stream(f) as index:
        for docs in index:
            out = []
            for n in docs.column("n_tokens").to_pylist():
                parts, have = [buffer], len(buffer)
                while have < n:
                    parts.append(next(stream).astype("<u4"))
                    have += len(parts[-1])
                joined = parts[0] if len(parts) == 1 else np.concatenate(parts)
                ids, buffer = joined[:n], joined[n:]
                out.append(zlib.crc32(ids.tobytes()) if digest else ids.astype("i8"))
            start = pa.array(docs.column("start").to_numpy() + row["base"])
            yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(out, pa.int64() if digest else pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def token_output(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write the files to the shared folder and return the manifest, a row per
    shard in one file."""
    scratch = Scratch(spark, "tokens")
    return scratch.save(write_token_shards(docs, f"{scratch.path}/files", **options).repartition(1), "manifest")
