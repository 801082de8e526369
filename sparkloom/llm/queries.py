"""Registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bin_packing, chat_template, decontaminate, exact_dedup, filter_audit, language_id, lexical_search, mixing, quality_classifier, quality_rules, simhash, token_counts, url_filter
from sparkloom.storage import table, texts


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(texts(spark, sf_dir))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_template.with_control_case(table(spark, sf_dir, "conversations"))
    return chat_template.digests(chat_template.format_conversations(turns), in_place=True)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(texts(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint(found["fp"]).alias("fingerprint"), "component_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.QUERY)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.corpus_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return token_counts.token_counts(texts(spark, sf_dir), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.shard_slots(table(spark, sf_dir, "documents"), shards=24)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(texts(spark, sf_dir), largest=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_format": op2_chat_format,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_filter_audit": op11_filter_audit,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_chat_format": chat_template.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_exact_dedup": exact_dedup.ORACLE,
}
