"""Training-corpus pipeline: quality classifier, near-duplicates, pseudonyms,
mixing to target weights, packing into sequences.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, numbered, release, table
from tessera.llm.jaccard_join import Rule, jaccard_components
from tessera.llm.mixing import copies, label_domains, mix
from tessera.llm.packing import pack_pieces, token_pieces
from tessera.llm.pii import pseudonymise
from tessera.llm.quality_classifier import classified, fit_classifier

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PII_KEY = "example-key"
#: Weights of expected tokens by domain.
TARGETS = {"clean": 0.97, "toxic": 0.02, "poor": 0.01}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    trees = fit_classifier(docs, table(spark, sf_dir, "labels"))
    return classified(docs.select(*COLUMNS), trees).where("predicted = 1").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, a
    similarity of 0.8), the one of smallest doc_id; all wordless texts stay."""
    scratch = Scratch(spark, "dedup")
    rows = numbered(scratch, docs).select(*COLUMNS, "_row")
    found = scratch.save(jaccard_components(spark, rows, Rule(words=5, num=80), row_col="_row"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    kept = found.where("group_id IS NOT NULL").groupBy("group_id").agg(first).select(F.col("first.row").alias("_row"))
    kept = kept.unionByName(found.where("group_id IS NULL").select(F.col("row").alias("_row")))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses get pseudonyms."""
    out = pseudonymise(docs.select(*COLUMNS), PII_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go by their rate, rounded by a hash of their row so
    that the expected tokens of every domain stay as fitted."""
    rows = docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id())
    mixed = mix(spark, rows, label_domains(table(spark, sf_dir, "labels")), TARGETS)
    times = copies(F.col("rate"), F.col("_row"))
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(0), times))).where(F.col("_copy") < times).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024."""
    pieces = token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(spark, pieces)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Classifiers and packing have no SQL equivalent.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.  What a stage left behind goes as
    soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    others = [s for s in Scratch.folders if s is not scratch]
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        release(scratch, *others)
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
