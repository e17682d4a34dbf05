"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import cap_filters, common, credentials, decontaminate, lexical, minhash, packing, pii, quality, repeats, resampling, sharding, token_counts, wavelet


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document."""
    return token_counts.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of each document, of 16 of near equal bytes."""
    return sharding.balanced_shards(common.table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates that each document is in, at 85 in 100."""
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2,048 tokens."""
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in each document."""
    return credentials.digests(credentials.find_secrets(common.table(spark, sf_dir, "documents")), credentials.BASE)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of each document, learned from the labels that are not held out."""
    return quality.quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the wavelet files of all documents read back as."""
    out = common.Scratch(spark, "wavelet").path("files")
    wavelet.write(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return wavelet.read(spark, out)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in each document."""
    return credentials.digests(pii.find_pii(common.table(spark, sf_dir, "documents")), pii.KINDS)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold, verbatim or with other slots."""
    return decontaminate.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("_key")


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return cap_filters.near_vectors(common.table(spark, sf_dir, "embeddings"))


def op11_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document left when all strings of 400 bytes that start elsewhere too are removed, as a digest."""
    return repeats.digests(repeats.without_repeats(common.table(spark, sf_dir, "documents")))


def op12_word_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents against the benchmark, and the tenth of them that is drawn."""
    return resampling.resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op13_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of the highest scores for each benchmark item."""
    return lexical.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_sharding, op3_minhash, op4_packing, op5_secrets, op6_quality, op7_wavelet, op8_pii, op9_decontamination, op10_cap_filters, op11_column_bwt, op12_word_suffix_arrays,
        op13_block_max_wand,
    )
}
ORACLE_SQL: dict[str, str] = {"op12_word_suffix_arrays": resampling.ORACLE_SQL, "op13_block_max_wand": lexical.ORACLE_SQL}
