"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary is encoded alone; those that come back as their own single id are proved whole.
A pre-token among them counts one without a merge; only the rest goes through the merges, once for each distinct pre-token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .encoding import ByteLevelPieces, byte_alphabet, merger


def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the library encodes alone as one pre-token and one id."""
    tokenizer = Tokenizer.from_file(path)
    back = {c: b for b, c in byte_alphabet().items()}
    known = {}
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            known[token] = (bytes(back[c] for c in token).decode("utf-8"), i)
        except (KeyError, UnicodeDecodeError):  # not a whole number of characters: never a pre-token by itself
            continue
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    encoded = tokenizer.encode_batch([text for text, _ in known.values()], add_special_tokens=False)
    return frozenset(
        text for (token, (text, i)), e in zip(known.items(), encoded, strict=True) if e.ids == [i] and [p for p, _ in split(text)] == [token]
    )


@lru_cache(maxsize=4)
def _counter(path: str, whole) -> ByteLevelPieces:
    tokenizer = Tokenizer.from_file(path)
    merge, proved = merger(tokenizer), whole.value
    return ByteLevelPieces(tokenizer, lambda p: 1 if p in proved else len(merge(p.encode())), lambda i: 1, sum)


def count_tokens(docs: DataFrame, path: str, *, text: str = "text") -> Column:
    """A column with the number of tokens of ``text`` (whole; null counts as empty, so 0) under the byte-level BPE file ``path``.

    The proof's result is broadcast: it holds no more strings than the vocabulary.
    """
    spark = docs.sparkSession
    common.ship(spark)
    whole = spark.sparkContext.broadcast(prove_whole_tokens(path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = _counter(path, whole)
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="int64")

    return count(F.col(text))


def token_counts(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    Null text: 0 bytes and tokens. Whole texts of any length are counted, a word at a time. Null ids and repeated rows are kept as they are; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return rows.select(
        "doc_id", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(count_tokens(rows, path, text="_text"), F.lit(0)).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
