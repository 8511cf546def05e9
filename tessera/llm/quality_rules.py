"""Adaptive quality rules, in DataFrame and SQL functions only.

Every document gets whole-text statistics.  Per language and source, KLL
quantile sketches of the ratios derived from them give the quartiles, which
are drawn towards those of the merged sketches of the language: a group counts
with its number of documents, the language with ``PRIOR`` ones, so that the
fences change without a jump as a group grows.  A document that passes the
base rule fails the adaptive one where a ratio lies beyond its group's fence:
the upper quartile plus ``SPREAD`` interquartile ranges plus a slack (mean
word length has a lower fence as well).  Where both quartiles are 0, as those
of symbols, repeated lines, repeated windows and marks are in clean text, the
slack alone is the fence.

Words are runs of characters other than space and U+0009 to U+000D.  Repeated
3-word windows are told by 64-bit hashes within one document.

Defined cases: a null or empty text has no words, zero counts and fails the
base rule; null languages and sources form groups of their own; a group
without any passing document has no fence and is judged by the base rule; rows
that share a doc_id are judged separately; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

MIN_WORDS = 50
#: Documents that the language counts for beside those of a group.
PRIOR = 200
SKETCH_K = 800
SPREAD = 4.0
#: Ratio -> slack above the upper fence.
SLACK = {"symbol_ratio": 0.04, "dup_line_ratio": 0.4, "repeat_ratio": 0.35, "mark_ratio": 0.05, "upper_ratio": 0.2, "mean_word": 1.5}
_WS = r"[\\x20\\x09-\\x0D]+"
_TRIM = r"' \t\n\u000b\u000c\r'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Hashes of the 3-word windows in order.
_WINDOWS = "CASE WHEN size(words) < 3 THEN CAST(array() AS array<bigint>) ELSE transform(slice(words, 1, size(words) - 2), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))) END"
#: Positions of repeated windows from the (hash, position) pairs in order.
_REPEATED = "sort_array(transform(filter(s, (x, i) -> coalesce(get(s, i - 1).h = x.h, false) OR coalesce(get(s, i + 1).h = x.h, false)), x -> x.i))"
#: Words that windows at sorted positions cover: each adds up to 3, less where the next one starts.
_COVERED = "aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0L, (a, b) -> a + b)"


def document_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row of counts per document: whole texts, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trimmed = f"trim(BOTH {_TRIM} FROM text)"
    rows = rows.select("doc_id", "lang", "source", "text", F.expr(f"CASE WHEN {trimmed} = '' THEN CAST(array() AS array<string>) ELSE split({trimmed}, '{_WS}') END").alias("words"), F.expr(rf"filter(split(text, '\\n'), x -> trim(BOTH {_TRIM} FROM x) <> '')").alias("lines"))
    rows = rows.select("doc_id", "lang", "source", "text", "words", "lines", F.expr(_WINDOWS).alias("windows"))
    pairs = "sort_array(transform(windows, (x, i) -> struct(x AS h, i AS i)))"
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.expr("CAST(size(words) AS bigint)").alias("n_words"),
        F.expr("CAST(char_length(array_join(words, '')) AS bigint)").alias("word_chars"),
        F.expr(r"CAST(regexp_count(text, '[#*$%&|<>]') AS bigint)").alias("n_symbols"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS bigint)").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE {_let(pairs, 's', _let(_REPEATED, 'p', _COVERED))} END").alias("n_repeat_words"),
        F.expr("CAST(size(lines) AS bigint)").alias("n_lines"),
        F.expr(r"CAST(regexp_count(text, '[!?]{2,}') AS bigint)").alias("n_marks"),
        F.expr(r"CAST(char_length(text) - char_length(regexp_replace(text, '[A-Z]+', '')) AS bigint)").alias("n_upper"),
    )


def _ratios(stats: DataFrame) -> DataFrame:
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return stats.withColumns({"symbol_ratio": F.col("n_symbols") / chars, "dup_line_ratio": F.col("n_dup_lines") / lines, "repeat_ratio": F.col("n_repeat_words") / words, "mark_ratio": F.col("n_marks") / words, "upper_ratio": F.col("n_upper") / chars, "mean_word": F.col("word_chars") / words})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fences(ratios: DataFrame) -> DataFrame:
    """Fences per (lang, source): one small row per group."""
    passing = ratios.where(~base_failed())
    sketches = passing.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in SLACK))
    by_lang = sketches.groupBy("lang").agg(*(F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(f"{c}_lang") for c in SLACK)).withColumnRenamed("lang", "_lang")
    both = sketches.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")))
    out = []
    for c, slack in SLACK.items():
        own, lang = ([F.kll_sketch_get_quantile_double(F.col(s), F.lit(q)) for q in (0.25, 0.75)] for s in (c, f"{c}_lang"))
        low, high = ((F.col("n") * a + PRIOR * b) / (F.col("n") + PRIOR) for a, b in zip(own, lang, strict=True))
        out.append((high + SPREAD * (high - low) + slack).alias(f"{c}_max"))
        if c == "mean_word":
            out.append((low - SPREAD * (high - low) - slack).alias(f"{c}_min"))
    return both.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *out)


def quality_rules(spark: SparkSession, docs: DataFrame, **columns: str) -> DataFrame:
    """Counts, base_failed, kept and the reason of every document."""
    scratch = Scratch(spark, "quality-rules")
    ratios = _ratios(scratch.save(document_stats(docs, **columns), "stats"))
    limits = scratch.save(fences(ratios), "fences")
    # The fences are one row per language and source; Spark broadcasts them
    # if their measured size allows it.
    joined = ratios.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    beyond = [F.when(F.col(c) > F.col(f"{c}_max"), F.lit(c)) for c in SLACK] + [F.when(F.col("mean_word") < F.col("mean_word_min"), F.lit("mean_word_low"))]
    reasons = F.array_compact(F.array(F.when(base_failed(), F.lit("base")), *beyond))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (F.size(reasons) == 0).alias("kept"), reasons.alias("reasons"))
