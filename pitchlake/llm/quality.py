"""Quality scores by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled documents is turned into weighted term vectors (hashed byte trigrams, and a few terms for the
shape of the text), which a truncated singular value decomposition maps to a small latent space. The sample's latent vectors
and labels are broadcast, their number being a parameter; every document is mapped the same way, compared with all of them by
blocked cosine products, and scored by its nearest neighbours' labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TRIGRAMS = 4096
#: Labelled documents of each class that are learned from, at most.
PER_CLASS = 1500
LATENT = 48
NEIGHBOURS = 25
#: Similarity counts by this power.
SHARPNESS = 4
#: Weight of the shape terms beside the trigrams, whose vector has length 1.
SHAPE = 1.0
_BINS, _SHAPES = 12, 7


def _shape(text: str, raw: np.ndarray) -> np.ndarray:
    """Shares that tell prose from lists, shouting and noise, each from 0 to 1."""
    words = text.split()
    n, w = max(len(raw), 1), max(len(words), 1)
    letters = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    upper = (raw >= 65) & (raw <= 90)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    digits = (raw >= 48) & (raw <= 57)
    marks = ~(letters | blank | digits)
    lines = text.split("\n")
    return np.array(
        [
            upper.sum() / max(letters.sum(), 1),
            min(1.0, 4 * marks.sum() / n),
            min(1.0, 4 * digits.sum() / n),
            (len(set(words)) / w) ** 0.5 if w > 20 else 0.9,
            len(set(lines)) / len(lines),
            1 - sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
            min(1.0, n / w / 16),
        ]
    )


def terms(text: str | None) -> np.ndarray:
    """Root counts of hashed byte trigrams, then soft one-hot bins of the shape shares."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(TRIGRAMS + _SHAPES * _BINS, np.float32)
    if len(raw) > 2:
        a = raw.astype(np.uint32)
        code = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2_654_435_761)
        out[:TRIGRAMS] = np.sqrt(np.bincount(code >> np.uint32(20), minlength=TRIGRAMS))
    if len(raw):
        places = _shape(text, raw) * (_BINS - 1)
        for k, p in enumerate(places):
            low = min(int(p), _BINS - 2)
            out[TRIGRAMS + k * _BINS + low] += 1 - (p - low)
            out[TRIGRAMS + k * _BINS + low + 1] += p - low
    return out


@dataclass
class Model:
    weights: np.ndarray  # of terms
    basis: np.ndarray  # terms x latent
    vectors: np.ndarray  # of the sample, length 1
    votes: np.ndarray  # of the sample: its class's weight where the label is 1, else 0
    mass: np.ndarray  # of the sample: its class's weight
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = _scaled(x, self.weights) @ self.basis
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest neighbours of each row of terms."""
        near = self.latent(x) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        # Of neighbours as near as each other to six digits, those first in the sample.
        order = np.arange(near.shape[1]) * 1e-11 - np.round(near.astype(np.float64), 6)
        at = np.argpartition(order, k - 1, axis=1)[:, :k]
        w = np.clip(np.take_along_axis(near, at, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
        total = (w * self.mass[at]).sum(axis=1)
        return np.where(total > 0, (w * self.votes[at]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)


def _scaled(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = x * weights
    length = np.linalg.norm(x[:, :TRIGRAMS], axis=1, keepdims=True)
    x[:, :TRIGRAMS] /= np.maximum(length, 1e-12)
    x[:, TRIGRAMS:] *= SHAPE / np.sqrt(_SHAPES)
    return x


def fit(texts: list[str | None], labels: list[int], shares: dict[int, float], latent: int = LATENT, seed: int = 20_261) -> Model:
    """From a sample; ``shares``: how common each label is among all labelled documents."""
    y = np.array(labels)
    scaled = x = np.empty((len(texts), TRIGRAMS + _SHAPES * _BINS), np.float32)  # scaled in place: one such table is all that the driver holds
    for k, t in enumerate(texts):
        x[k] = terms(t)
    seen = (x[:, :TRIGRAMS] > 0).sum(axis=0)
    weights = np.ones(x.shape[1], np.float32)
    weights[:TRIGRAMS] = np.log((1 + len(x)) / (1 + seen)) + 0.1
    for k in range(0, len(x), 256):
        x[k : k + 256] = _scaled(x[k : k + 256], weights)
    rng = np.random.default_rng(seed)
    wide = min(latent + 16, *scaled.shape)
    q = np.linalg.qr(scaled @ rng.standard_normal((scaled.shape[1], wide)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(scaled @ (scaled.T @ q))[0]
    _, _, vt = np.linalg.svd(q.T @ scaled, full_matrices=False)
    basis = np.ascontiguousarray(vt[:latent].T)
    vectors = scaled @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    counts = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    mass = np.array([shares.get(int(c), 0.0) / counts[int(c)] for c in y])
    return Model(weights, basis, vectors, mass * (y == 1), mass, shares.get(1, 0.5))


def sample(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, per_class: int) -> tuple[list, list, dict[int, float]]:
    """At most ``per_class`` training documents of each label (those of least hash), and the shares of the labels.

    An id with two labels counts as 0; of an id's several texts that of least hash is learned from.
    """
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    usable = usable.where(~held_out("_id")).groupBy("_id").agg(F.min("_y").alias("_y"))
    counts = {r["_y"]: r["count"] for r in usable.groupBy("_y").count().collect()}
    chosen = None
    for y in sorted(counts):
        part = usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return [], [], {}
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    least = F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"))).alias("least")
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(least).select("_id", F.col("least.t").alias("_text"), "_y").collect()  # at most 2 * per_class
    rows.sort(key=lambda r: r["_id"])
    total = sum(counts.values())
    return [r["_text"] for r in rows], [r["_y"] for r in rows], {y: n / total for y, n in counts.items()}


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score_column(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Column:
    """A column with the score of ``text``, learned from the labelled rows of ``docs`` that aren't held out."""
    spark = docs.sparkSession
    common.ship(spark)
    texts, y, shares = sample(docs, labels, doc_id=doc_id, text=text, label=label, per_class=per_class)
    model = spark.sparkContext.broadcast(fit(texts, y, shares) if texts else None)
    common.give_back()  # what learning took on the driver

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        for found in batches:
            out = np.full(len(found), 0.5 if m is None else m.prior)
            full = [k for k, t in enumerate(found) if t] if m else []
            for s in range(0, len(full), 512):
                at = full[s : s + 512]
                out[at] = m.score(np.stack([terms(found.iat[k]) for k in at]))
            yield pd.Series(np.clip(out, 0.0, 1.0))
        common.give_back()

    return score(F.col(text))


def quality_scores(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= ``cut``) for each row of ``docs``.

    Learned from labelled documents that aren't held out. Null and empty texts have no terms and get the share of label 1 among all
    labelled documents. Labels that are null or neither 0 nor 1, and of ids without a document, teach nothing; with none left, each
    score is 0.5. Rows with a null id aren't held out. An id with two labels teaches the label 0, one with several texts that of least
    hash; each of its rows is scored by its own text. Whole texts of any length are scored. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    labelled = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"))
    score = score_column(rows, labelled, label="label", per_class=per_class)
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
