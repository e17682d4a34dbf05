"""Drawing documents whose n-grams are distributed like a target's, by importance weights and Gumbel noise.

The words of a block of texts get ids, and the block a suffix array over them: its suffixes ordered by as many words as the longest
n-gram has, with the words that each has in common with the one before (LCP). A run of suffixes with n words in common holds all
occurrences of one n-gram, so that it is hashed once, and its bucket is scattered back to the occurrences. Buckets are counted over all
documents and all of the target; a document's weight is the sum of its occurrences' gains.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .words import Ids, words

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Bytes of text in a block, unless one document has more.
BLOCK = 4 << 20


def suffix_array(ids: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes by their first ``longest`` words, none beyond its document; ``ends``: where each word's document ends.

    lcp[k]: the words, ``longest`` at most, that suffix order[k] has in common with order[k - 1].
    """
    n = len(ids)
    left = np.minimum(ends - np.arange(n), longest)
    rank, depth = ids.astype(np.int64) + 1, 1
    while depth < longest:  # by twice as many words each time; what is over sorts first
        after = np.zeros(n, np.int64)
        after[: max(n - depth, 0)] = rank[depth:]
        after[left <= depth] = 0
        rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        depth *= 2
    order = np.argsort(rank, kind="stable")
    lcp, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for k in range(longest):
        a, b = order[1:] + k, order[:-1] + k
        same &= (left[order[1:]] > k) & (left[order[:-1]] > k)
        same[same] = ids[a[same]] == ids[b[same]]
        lcp[1:] += same
    return order, lcp


def occurrences(texts: list[str | None], longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, words of each text, text of each n-gram occurrence, its bucket) for each block of the texts."""
    at = 0
    while at < len(texts):
        vocabulary, parts, size, first = Ids(), [], 0, at
        while at < len(texts) and (not parts or size + len(texts[at] or "") <= BLOCK):
            parts.append(vocabulary.of(words(texts[at])))
            size += len(texts[at] or "")
            at += 1
        counts = np.array([len(p) for p in parts])
        ids = np.concatenate(parts)
        of_text, ends = np.repeat(np.arange(len(parts)), counts), np.repeat(np.cumsum(counts), counts)
        order, lcp = suffix_array(ids, ends, longest)
        spelt, where, found = list(vocabulary), [], []
        for n in range(1, longest + 1):
            fits = ends[order] - order >= n
            # A run begins where fewer than n words are shared with the suffix before; suffixes that are too short share fewer.
            heads = np.flatnonzero(fits & (lcp < n))
            hashed = np.fromiter((zlib.crc32(b" ".join(spelt[i] for i in ids[p : p + n].tolist())) % buckets for p in order[heads].tolist()), np.int64, len(heads))
            run = np.cumsum(fits & (lcp < n)) - 1
            where.append(of_text[order[fits]])
            found.append(hashed[run[fits]])
        yield first, counts, np.concatenate(where), np.concatenate(found)


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many n-gram occurrences of all texts are in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in occurrences(batch.column(0).to_pylist(), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of each bucket's share of the target to its share of the source."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """floor of 1,000 times a Gumbel variate drawn by the id; of a null id, that of the empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, by: list[Column], scratch: common.Scratch) -> DataFrame:
    """``rows`` with ``rank``, from 1 without gaps, in the order of ``by``: ranges of rows are sorted by themselves and shifted by those before."""
    held = scratch.write(rows.withColumn("_one", F.monotonically_increasing_id()), "rows")  # so that ties have an order that stays
    sorted_rows = held.repartitionByRange(*by, F.col("_one")).sortWithinPartitions(*by, F.col("_one"))
    placed = scratch.write(sorted_rows.drop("_one").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return numbered.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_before")


def resampled(
    docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all but the id long) for each row of ``docs``.

    Features are the runs of 1 to ``longest`` words, counted with repeats. Of the rows with ``least_words`` words or more, ``percent`` in 100
    (rounded down) are drawn: those of the highest scores, ties to the smaller id (null ids last, then in any order); the others have no rank. Null and empty texts
    have no features. Rows that share an id are scored each by its own text, with the same noise. An empty target makes all buckets
    alike rare in it. Other columns are ignored. No rows in, none out.
    """
    common.ship(docs.sparkSession)
    scratch = common.Scratch(docs.sparkSession, "resampling")
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            features, weight, n_words = (np.zeros(len(texts), np.int64) for _ in range(3))
            for first, counts, of_text, found in occurrences(texts, longest, buckets):
                block = slice(first, first + len(counts))
                n_words[block] = counts
                features[block] = np.bincount(of_text, minlength=len(counts))
                np.add.at(weight[block], of_text, gain[found])
            noises = np.array([noise(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (n_words, features, weight, weight + noises))], ["doc_id", "n_words", "n_features", "weight", "score"])

    scored = scratch.write(rows.mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long, score long"), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = ranked(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], scratch)
    columns = ["doc_id", "n_features", "weight", "score"]
    return order.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def _sql() -> str:
    ids = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""
WITH RECURSIVE steps(i, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc(t) AS (SELECT list(c ORDER BY i) FROM steps WHERE k = 8),
docs AS (SELECT doc_id, {ids} AS ws FROM documents),
d AS (SELECT doc_id, unnest(ws) AS w FROM docs),
b AS (SELECT unnest({ids}) AS w FROM benchmark),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM d UNION SELECT w FROM b)),
hashed AS (
    SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(len(x) // 2), lambda i: ((strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
        lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]))) % {BUCKETS} AS bucket
    FROM vocabulary, crc),
s AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY bucket),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + {BUCKETS}) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + {BUCKETS}))))::BIGINT AS g
    FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM d JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
    SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM docs LEFT JOIN weights USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM able) // 100 THEN place END AS rank
FROM scored LEFT JOIN able USING (doc_id)
"""


#: For single words, ids that are not repeated.
ORACLE_SQL = _sql()
