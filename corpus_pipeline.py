"""From raw documents to token ids: quality rules, exact and near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the
next stage's documents. A mixed document is there as often as the mix takes it (see ``llm.mixing``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpdeck.llm import bpe, exact_dedup, minhash, mixing, quality
from dumpdeck.llm.common import checkpoint_folder
from dumpdeck.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs.select(*COLUMNS))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_copies(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and hashes of them and of the text decoded from them."""
    codes = vocabulary(spark)
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text", "lang", "source"), codes), codes)
    return back.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]

#: Robust estimates, shuffled streams and BPE have no SQL; tests run the stages beside a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
    return docs
