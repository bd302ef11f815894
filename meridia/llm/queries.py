"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language, line_dedup, media, near_dedup, packing, pii, toxicity, url_filter
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where hosts, suffixes and <html lang> are real: the words of all pages outside tags and scripts."""
    raw = F.col("html")
    words = F.regexp_replace(F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract(raw, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", words.alias("text"), declared.alias("lang"), url_filter.parse(F.col("url"))[0].alias("source"))
    return language.identify(pages, id_col="page_id")


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.media_column(table(spark, sf_dir, "documents")))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, keep_ids=False)


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id,
    "language_of_pages": page_languages,
    "op2_toxicity": toxic,
    "op3_telephony_audio": telephony,
    "op4_packing": packed,
    "op5_html_extraction": main_text,
    "op6_decontamination": leaks,
    "op7_line_dedup": lines,
    "op8_pii_bootstrap": personal,
    "op9_minhash_near_dedup": near,
    "op10_url_filter": urls,
}
SQL: dict[str, str] = {"op10_url_filter": url_filter.SQL}
