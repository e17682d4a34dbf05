"""Correlations of all pairs of metrics over the rows that measure both, from one pass of block products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_moments(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(a, b, n, sx, sy, sxx, syy, sxy) for each pair of metrics, a before b: sums over the rows that measure both.

    Values are taken from the metric's mean, so that large values far from 0 lose no digits. A task multiplies masked blocks of its rows and sends
    a row a pair; those are added up by pair. Nulls and NaN are not measured.
    """
    values = [F.nanvl(F.col(f"`{m}`").cast("double"), F.lit(None).cast("double")).alias(f"m{i}") for i, m in enumerate(metrics)]
    rows = df.select(*values)
    middle = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in rows.columns]).first() or []  # a number a metric
    centre = np.array(list(middle), np.float64)
    first, second = np.triu_indices(len(metrics), 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(first)))
        for batch in batches:
            raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            known = (~np.isnan(raw)).astype(np.float64)
            x = np.where(known > 0, raw - centre, 0.0)
            n, s, q, p = known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x
            total += [m[first, second] for m in (n, s, s.T, q, q.T, p)]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), *(pa.array(t) for t in total)], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    sums = rows.mapInArrow(add, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    whole = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    names = F.array(*[F.lit(m) for m in metrics])
    return whole.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), F.col("n").cast("long").alias("n"), "sx", "sy", "sxx", "syy", "sxy")


def correlations(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(a, b, n, r): Pearson's correlation of each pair; null where either doesn't vary over the rows that measure both."""
    found = pair_moments(df, metrics)
    spread = lambda s, q: F.col("n") * F.col(q) - F.col(s) * F.col(s)
    scale = F.sqrt(F.greatest(spread("sx", "sxx"), F.lit(0.0))) * F.sqrt(F.greatest(spread("sy", "syy"), F.lit(0.0)))
    # What is left of a constant metric's sums is rounding.
    flat = (spread("sx", "sxx") <= 1e-12 * F.col("n") * F.col("sxx")) | (spread("sy", "syy") <= 1e-12 * F.col("n") * F.col("syy"))
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(scale, F.lit(0.0))
    return found.select("a", "b", "n", F.when(~flat, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("r"))
