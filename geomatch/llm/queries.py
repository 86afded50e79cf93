"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geomatch.llm import chat, decontaminate, html, langid, lm, packing, quality, repair, search, simhash, substrings, toxicity, warc
from geomatch.llm.common import read


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def judge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def score_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexity_scores(read(spark, sf_dir, "documents"))


def find_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only for contaminated documents: one for each item found in them."""
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_control_conversation(spark, read(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_conversations(rows))


def extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, read(spark, sf_dir, "pages"))


def rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read(spark, sf_dir, "documents"))


def repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_reports(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": extract_main_text,
    "op2_language_id": identify_language,
    "op3_chat_formatting": format_chats,
    "op4_simhash_near_dedup": simhash_near_dedup,
    "op5_toxicity": score_toxicity,
    "op6_best_fit_packing": pack_sequences,
    "op7_warc": archive_pages,
    "op8_quality_rules": judge_quality,
    "op9_benchmark_decontamination": find_contamination,
    "op10_lm_scoring": score_language_model,
    "op11_ranked_search": rank_documents,
    "op12_substring_dedup": remove_repeats,
    "op13_structure_repair": repair_conversations,
}
