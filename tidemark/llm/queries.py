"""Registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import binslack, dac, exact, fertility, langid, media, mixing, neardup, ppm, qda, search, suffix, variants
from tidemark.llm.common import documents


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), percent=85)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_ids(dac.write_ids(documents(spark, sf_dir)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all pages with their long text runs as media, read back; positions and captions beside op8's one figure a text."""
    return media.page_media(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), output="digest")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binslack.pack(documents(spark, sf_dir))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir), damage=199).select("word", "form", "root", "n", "n_near", "form_n")


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return exact.exact_duplicates(docs.select("doc_id", "text", exact.text_sha256(F.col("text")).alias("text_sha256")))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fertility": op1_fertility,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_ppm": op4_ppm,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_ids": op6_token_ids,
    "op7_mixing": op7_mixing,
    "op8_media": op8_media,
    "page_media": page_media,
    "op9_repeats": op9_repeats,
    "op10_packing": op10_packing,
    "op11_variants": op11_variants,
    "op12_exact": op12_exact,
    "op13_search": op13_search,
}

SQL: dict[str, str] = {
    "op5_near_duplicates": neardup.NEARDUP_SQL, "op7_mixing": mixing.MIX_SQL, "op9_repeats": suffix.REPEATS_SQL,
    "op11_variants": variants.VARIANTS_SQL, "op12_exact": exact.EXACT_SQL, "op13_search": search.SEARCH_SQL,
}
