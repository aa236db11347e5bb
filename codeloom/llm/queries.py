"""Registered queries of the training-data operators; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.decontaminate import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.langid import detect_languages, held_out, train_languages

    docs = _table(spark, sf_dir, "documents")
    out = held_out()
    model = train_languages(docs.filter(~out))
    return detect_languages(docs, model, spans=False).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.chat_pairs import format_preferences, stale_answer_pairs

    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return format_preferences(stale_answer_pairs(_table(spark, sf_dir, "conversations"))).select(
        F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans")
    )


def op5_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.html_tree import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.masked_lm import score_documents, train_masked_lm

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, train_masked_lm(docs))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.mixing import mix_sources

    labels = _table(spark, sf_dir, "labels")
    return mix_sources(_table(spark, sf_dir, "documents"), labels.select("doc_id", quality_weight().alias("weight")))


def quality_weight():
    """Good labelled documents draw earlier keys, bad ones later; others weigh 1."""
    return F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2.0).when(F.col("quality").isNull(), 1.0).otherwise(0.5)


def op8_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.quality_votes import judge_quality

    return judge_quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of every page: pages carry the number of their document as a path segment."""
    number = F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:[/.?#]|$)', 1) AS BIGINT)")
    bad = labels.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad")
    )
    own = pages.select("url", number.alias("_number"))
    return own.join(bad, own["_number"] == bad["_doc"], "left").select("url", "bad")


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.url_reputation import filter_urls

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, page_outcomes(pages, _table(spark, sf_dir, "labels")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_simhash, op3_language_id, op4_chat_pairs, op5_html_tree, op6_masked_lm, op7_source_mixing, op8_quality_votes, op9_url_reputation, op10_suffix_dedup)}
