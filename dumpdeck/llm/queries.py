"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpdeck.llm import (
    bpe, chat, exact_dedup, filter_audit, html, katz, minhash, mixing, packing, quality, repeats, urls, vector_codes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query("op1_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.taken_words(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@_query("op3_exact_dedup", exact_dedup.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), digest_all=True)


@_query("op6_url_filters")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = urls.labelled_pages(pages, _table(spark, sf_dir, "labels"))
    return urls.filter_urls(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


@_query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counts, "base_failed", "kept")


@_query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def vocabulary(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> bpe.Vocabulary:
    return bpe.Vocabulary(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


@_query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary(spark))


@_query("op7_chat_formatting", chat.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_probe(_table(spark, sf_dir, "conversations")), vocabulary(spark))


@_query("op10_minhash", minhash.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"), words=4, percent=80)


@_query("op5_katz")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


@_query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(_table(spark, sf_dir, "documents"))


@_query("op11_filter_audit", filter_audit.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.Tokens(
        spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return packing.digests(_table(spark, sf_dir, "documents"), tokens)


@_query("op13_vector_codes", vector_codes.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(_table(spark, sf_dir, "embeddings"))
