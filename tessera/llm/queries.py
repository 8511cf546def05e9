"""The registered queries ``opN_<name>`` of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import context_tree, embedding_dedup, mixing, pii, quality_classifier, quality_rules, toxicity
from tessera.llm.common import table
from tessera.llm.jaccard_join import Rule, jaccard_components
from tessera.llm.oracles import ORACLE_SQL
from tessera.llm.packing import pack_pieces, token_pieces
from tessera.llm.token_output import read_token_documents, token_output


#: A deployment passes its own secret; this one makes results repeatable.
PII_KEY = "example-key"
#: Weights of expected tokens by domain.
MIX_TARGETS = {"clean": 0.9, "poor": 0.04, "toxic": 0.06}


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_documents(token_output(spark, table(spark, sf_dir, "documents")), digest=True)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(spark, table(spark, sf_dir, "documents"), Rule(words=3, num=90))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"), labelled, MIX_TARGETS)
    share = [F.coalesce(F.col("posterior")[d], F.lit(0.0)).alias(f"p_{d}") for d in MIX_TARGETS]
    return mixed.select("doc_id", "n_tokens", *share, "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(spark, table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(spark, table(spark, sf_dir, "documents"))
    return found.withColumn("reasons", F.array_join("reasons", ","))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(spark, digest)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY, count_col="n_pseudonyms")
    return docs.select("doc_id", "text", "n_pseudonyms")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_mixing": op3_mixing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_context_tree": op5_context_tree,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_pii_pseudonyms": op10_pii_pseudonyms,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
