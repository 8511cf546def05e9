"""Incremental encoding of a stream of text shapes (an extension).

Every micro-batch becomes a data set of its own, ``path``/batch-N, which a
repeated run of the batch replaces.  ``batches`` opens what is there, to be
drawn together; ``compact`` merges it into one data set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.dataset import Dataset, folders, merged, write_dataset
from tessera.operators.shapes import projected
from tessera.sources.text import parse_shapes, valid_shapes


def start(lines: DataFrame, path: str, checkpoint: str, *, mapbits: int = 48, metabits: int = 0) -> StreamingQuery:
    """Encode each micro-batch of lines; every line is stored once."""

    def encode(batch: DataFrame, number: int) -> None:
        shapes = projected(parse_shapes(batch, metabits).where(valid_shapes()))
        write_dataset(shapes, f"{path}/batch-{number}", mapbits=mapbits, metabits=metabits, overwrite=True)

    return lines.writeStream.foreachBatch(encode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(spark: SparkSession, path: str) -> list[Dataset]:
    """The data sets of the batches, in order."""
    names = [n for n in folders(spark, path) if n.startswith("batch-")]
    return [Dataset(spark, f"{path}/{n}") for n in sorted(names, key=lambda n: int(n[6:]))]


def compact(spark: SparkSession, path: str, out: str, *, unique: bool = False) -> Dataset:
    """All batches as one data set at ``out``, which must not exist."""
    found = batches(spark, path)
    write_dataset(merged(found, unique=unique).select("verts", "meta"), out, mapbits=found[0].mapbits, metabits=found[0].metabits)
    return Dataset(spark, out)
