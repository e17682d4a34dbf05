"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written and read again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import common, decontaminate, minhash, packing, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if it scores this much.
QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    score = quality.score_column(docs, common.table(spark, sf_dir, "labels"))
    return docs.withColumn("_score", score).where(F.col("_score") >= QUALITY).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingle sets are at least 0.8 alike."""
    return minhash.deduplicated(docs, 80).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each piece of personal data replaced by its kind."""
    found = pii.find_pii(docs, carry=True).withColumn("text", pii.redacted(F.col("text"), F.col("_spans")))
    return found.withColumn("n_chars", F.when(F.size("_spans") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier or the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each read back from Parquet by the next."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
