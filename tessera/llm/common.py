"""Shared helpers of the training-data operators.

Intermediate tables live below the folder named by ``spark.checkpoint.dir``,
which all executors share.  The folder is read from the session; a temporary
one is made only where the setting is absent and everything runs in one
process (tests); elsewhere its absence is an error.  ``release`` deletes what
operators left there once their results are written.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch sent to Python workers: whole texts may be long.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as a full URI of Hadoop's file system."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera_')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", full)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path of a Hadoop URI."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


class Scratch:
    """A private folder below the shared one, for tables between stages."""

    #: Folders not yet deleted.
    folders: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
        Scratch.folders.append(self)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and read it back, which cuts its lineage."""
        path = f"{self.path}/{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads; without names the folder."""
        if not names:
            Scratch.folders = [s for s in Scratch.folders if s is not self]
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names or ("",):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            p.getFileSystem(conf).delete(p, True)


def release(*keep: Scratch) -> None:
    """Delete the tables of all operators called so far but for ``keep``:
    results that were not yet written cannot be read any more."""
    for s in list(Scratch.folders):
        if not any(s is k for k in keep):
            s.drop()


def numbered(scratch: Scratch, docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` with a key per row that is the same in every job: file and row
    number of a Parquet table as it stands, otherwise a number written down."""
    node = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    if node == "LogicalRelation":
        at = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        try:
            return docs.withColumn(name, at)
        except AnalysisException:
            pass  # not Parquet: no row numbers
    at = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    return scratch.save(docs.withColumn(name, at), "numbered")


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def sampled(docs: DataFrame, chosen: DataFrame, *columns: str) -> DataFrame:
    """``chosen`` (doc_id and a label, of bounded size) with ``columns`` of the
    documents of these ids.  Of rows that share an id the least stands for all,
    so that what is gathered is bounded however often an id repeats."""
    found = docs.select("doc_id", F.struct(*columns).alias("_row")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy(*chosen.columns).agg(F.min("_row").alias("_row")).select(*chosen.columns, "_row.*")


def lists_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Rows of a list column of numbers as arrays, without Python objects."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        values, at = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out
