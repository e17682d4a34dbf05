"""The number of clusters of every group, all groups and numbers in the same jobs.

Each group is clustered for every number that it may have and from several starts at once: a Lloyd step is one pass over the rows, in which a
task adds up, for each model, what belongs to each centre, and one aggregate. The best start of each number is held against exact
silhouettes, for which blocks of rows meet once for all numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import euclid
from ..scratch import held
from . import blocks

# Rows that a cluster must have on average; the least size of a cluster: at all, usually, as a share; clusters of a group.
AVERAGE, LEAST, USUAL, SHARE = 12, 6, 20, 0.04
FEWEST, MOST, RESTARTS, TOLERANCE = 3, 9, 10, 0.9
#: Lloyd steps at most; rows of a group among which starts are drawn; bytes of centres that go to the tasks at a time.
STEPS, DRAWN, CENTRE_BYTES = 100, 1024, 32 << 20
SEED = 20_262


@dataclass
class Clusters:
    """A fitted clustering of one group; clusters are numbered in the order of their centres, so equal fits give equal numbers."""

    k: int
    centers: list[list[float]]
    silhouette: float
    inertia: float = 0.0
    sizes: list[int] = field(default_factory=list)

    def assign(self, df: DataFrame, vector: str, out: str = "cluster") -> DataFrame:
        return df.withColumn(out, self.nearest(vector))

    def nearest(self, vector: str) -> Column:
        """The number of the nearest centre; of equally near ones the first."""
        far = F.array(*[F.struct(euclid(F.col(vector), F.array(*[F.lit(float(v)) for v in c])).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(self.centers)])
        return F.array_min(far)["k"]


@dataclass
class Choice:
    """The clusterings of one group by number of clusters, and the number chosen."""

    fits: dict[int, Clusters]
    k: int
    elbow: int

    @property
    def chosen(self) -> Clusters:
        return self.fits[self.k]


def candidate_ks(n: int, fewest: int = FEWEST, most: int = MOST) -> range:
    """The numbers of clusters that n rows can bear."""
    top = max(2, min(most, n // AVERAGE))
    return range(min(fewest, top), top + 1)


def least_size(n: int) -> int:
    return max(LEAST, min(USUAL, n // 4), int(SHARE * n))


def choose_k(found: dict[int, float], smallest: dict[int, int] | None = None, floor: int = 0, tolerance: float = TOLERANCE) -> int:
    """The largest number whose silhouette is within ``tolerance`` of the best, of those whose clusters are all large enough.

    Where none has large enough clusters, the least number; where no silhouette is above 0, the one of the best.
    """
    usable = found
    if smallest and floor:
        usable = {k: s for k, s in found.items() if smallest[k] >= floor}
        if not usable:
            return min(found)
    best = max(usable.values())
    if best <= 0:
        return min(k for k, s in usable.items() if s == best)
    return max(k for k, s in usable.items() if s >= tolerance * best)


def chosen(found: dict[int, float], smallest: dict[int, int], n: int, fewest: int = FEWEST) -> int:
    """``choose_k`` over the numbers that n rows can bear, and over 2 as well where none of those has large enough clusters."""
    floor = least_size(n)
    offered = {k for k in found if k >= min(fewest, max(found))}
    if fewest > 2 and all(smallest[k] < floor for k in offered):
        offered |= {2} & found.keys()
    return choose_k({k: found[k] for k in offered}, smallest, floor)


def elbow(inertia: dict[int, float]) -> int:
    """The number furthest from the chord between the ends of the curve."""
    ks = sorted(inertia)
    if len(ks) < 3:
        return ks[0]
    low, high = min(inertia.values()), max(inertia.values())
    x, y = (lambda k: (k - ks[0]) / (ks[-1] - ks[0])), (lambda k: (inertia[k] - low) / max(high - low, 1e-9))
    fall = y(ks[-1]) - y(ks[0])
    return max(ks, key=lambda k: abs(y(k) - y(ks[0]) - fall * x(k)))


def drawn_start(rows: np.ndarray, k: int, start: int) -> np.ndarray:
    """k of the rows, each drawn with a chance by its squared distance from those before."""
    rng = np.random.default_rng([SEED, k, start])
    out = [rows[rng.integers(len(rows))]]
    far = ((rows - out[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        out.append(rows[rng.choice(len(rows), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(rows))])
        far = np.minimum(far, ((rows - out[-1]) ** 2).sum(axis=1))
    return np.array(out)


def _starts(rows: DataFrame, ks: dict, restarts: int) -> dict:
    """{group: {(k, start): centres}}, drawn among the ``DRAWN`` rows of least hash of each group."""
    kind = rows.schema["g"].dataType.simpleString()
    few = rows.withColumn("_h", F.xxhash64(F.lit(3), "key"))
    sizes = few.groupBy("g").agg(F.count("*").alias("_n"))
    # Hashes are even: about twice as many as are wanted are below this share of their range, and the task keeps the least.
    share = F.lit(-(2.0**63)) + F.lit(2.0**64 * 2 * DRAWN) / F.col("_n")
    few = few.join(sizes, "g").where((F.col("_n") <= 2 * DRAWN) | (F.col("_h").cast("double") <= share)).select("g", "key", "x", "_h")

    def draw(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_h", "ascending"), ("key", "ascending")]).slice(0, DRAWN)
        x, g = blocks.matrix(group.column("x")), group.column("g")[0]
        out = [(k, s, drawn_start(x, k, s).ravel().tolist()) for k in ks[g.as_py()] for s in range(restarts)]
        return pa.table([pa.array([g.as_py()] * len(out), group.schema.field("g").type), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64()))))], names=["g", "k", "s", "c"])

    found: dict = {}
    for r in few.groupBy("g").applyInArrow(lambda group: draw(group), f"g {kind}, k int, s int, c array<double>").collect():  # the centres of a batch of groups
        found.setdefault(r["g"], {})[r["k"], r["s"]] = np.array(r["c"]).reshape(r["k"], -1)
    return found


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
    label = d.argmin(axis=1)
    return label, d[np.arange(len(x)), label] + (x * x).sum(axis=1)


def _each_group(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    names = np.array(batch.column("g").to_pylist(), dtype=object)
    x = blocks.matrix(pa.chunked_array([batch.column("x")]))
    for g in dict.fromkeys(names.tolist()):
        at = np.flatnonzero(names == g)
        yield g, at, x[at]


def _step(rows: DataFrame, models: dict, dims: int) -> dict:
    """{(group, model, cluster): (rows, squared distance, sum of rows)} with each row at its nearest centre."""
    names = list(models)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for g, _, x in _each_group(batch):
                for m, centres in models.get(g, {}).items():
                    label, far = _nearest(x, centres)
                    hot = np.zeros((len(x), len(centres)))
                    hot[np.arange(len(x)), label] = 1.0
                    made = np.column_stack([hot.sum(axis=0), hot.T @ far, hot.T @ x])
                    total[g, m] = total[g, m] + made if (g, m) in total else made
        out = [(names.index(g), *m, c, row) for (g, m), made in total.items() for c, row in enumerate(made.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())))], ["g", "k", "s", "c", "v"])

    parts = rows.select("g", "x").mapInArrow(add, "g int, k int, s int, c int, v array<double>")
    sums = parts.groupBy("g", "k", "s", "c").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(dims + 2)])
    return {(names[r[0]], (r[1], r[2]), r[3]): np.array(r[4:]) for r in sums.collect()}  # a row a centre


def lloyd(rows: DataFrame, starts: dict, steps: int = STEPS) -> dict:
    """{group: {(k, start): (centres, sizes, squared distance)}} of the rows (g, key, x), each model stepped until its centres stay."""
    dims = next(iter(next(iter(starts.values())).values())).shape[1]
    done: dict = {g: {} for g in starts}
    live = {g: dict(models) for g, models in starts.items()}
    for step in range(steps + 1):
        sums = _step(rows, live, dims)
        moving: dict = {}
        for g, models in live.items():
            for m, centres in models.items():
                found = [sums.get((g, m, c)) for c in range(len(centres))]
                new = np.array([c if v is None or not v[0] else np.round(v[2:] / v[0], 9) for c, v in zip(centres, found, strict=True)])
                if step == steps or np.abs(new - centres).max() <= 1e-8:
                    done[g][m] = (centres, [0 if v is None else int(v[0]) for v in found], sum(0.0 if v is None else float(v[1]) for v in found))
                else:
                    moving.setdefault(g, {})[m] = new
        live = moving
        if not live:
            break
    return done


def _silhouettes(rows: DataFrame, fits: dict, size: int) -> dict:
    """{(group, k): mean silhouette}, exact, by Euclidean distances; 0 for a row alone in its cluster."""
    names, kind, group_kind = list(fits), rows.schema["key"].dataType.simpleString(), rows.schema["g"].dataType.simpleString()
    ks = {g: sorted(fits[g]) for g in names}
    width = max(sum(ks[g]) for g in names)
    g_type, key_type = (pa.int64() if t == "bigint" else pa.int32() if t == "int" else pa.string() for t in (group_kind, kind))

    def labelled(g: object, x: np.ndarray) -> np.ndarray:
        return np.column_stack([_nearest(x, np.array(fits[g][k].centers))[0] for k in ks[g]])

    def add(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        g = mine.column("g")[0].as_py()
        x, y = blocks.matrix(mine.column("x")), blocks.matrix(theirs.column("x"))
        d, labels = blocks.distances(x, y, "euclid"), labelled(g, y)
        hot = np.column_stack([labels[:, [i]] == np.arange(k) for i, k in enumerate(ks[g])]).astype(np.float64)
        return pa.table([mine.column("g"), mine.column("key"), pa.array((d @ hot).tolist(), pa.list_(pa.float64())), mine.column("x")], names=["g", "key", "s", "x"])

    every = rows.select("g", "key", "x")
    empty = pa.schema([("g", g_type), ("key", key_type), ("s", pa.list_(pa.float64())), ("x", pa.list_(pa.float64()))])
    sums = blocks.each_block(blocks.met(every, every, "g", size), "g", add, f"g {group_kind}, key {kind}, s array<double>, x array<double>", empty)
    whole = sums.groupBy("g", "key").agg(F.first("x").alias("x"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            sums = batch.column("s").to_pylist()
            for g, at, x in _each_group(batch):
                s, labels, first = np.array([[np.nan if v is None else v for v in sums[i]] for i in at]), labelled(g, x), 0
                for i, k in enumerate(ks[g]):
                    n = np.array(fits[g][k].sizes, np.float64)
                    own, part = labels[:, i], s[:, first : first + k]
                    a = part[np.arange(len(at)), own] / np.maximum(n[own] - 1, 1)
                    rest = np.where((np.arange(k)[None, :] == own[:, None]) | (n == 0), np.inf, part / np.maximum(n, 1))
                    b = rest.min(axis=1)
                    top = np.maximum(a, b)
                    value = np.where((n[own] > 1) & np.isfinite(b) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
                    total[names.index(g), k] = total.get((names.index(g), k), 0.0) + value.sum()
                    first += k
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in total], pa.int32()) for i in (0, 1)] + [pa.array(list(total.values()), pa.float64())], ["g", "k", "s"])

    means = whole.mapInArrow(score, "g int, k int, s double").groupBy("g", "k").agg(F.sum("s").alias("s")).collect()  # a row a number of clusters
    return {(names[r["g"]], r["k"]): r["s"] / sum(fits[names[r["g"]]][r["k"]].sizes) for r in means}


def select_clusters(
    df: DataFrame, key: str, vector: str, by: str | None = None, fewest: int = FEWEST, most: int = MOST, restarts: int = RESTARTS, ks: range | None = None, starts: dict | None = None, size: int = blocks.SIZE
) -> dict[object, Choice]:
    """{group: Choice}: for each group (None without ``by``) its clusterings by number of clusters, and the number chosen.

    ``ks``: the numbers to try in every group, in place of those that its size allows. ``starts``: {group: {(k, start): centres}}. Groups of fewer than three
    rows have no clusters. ``key`` is unique; rows without a vector or key are left out. Centres go to the tasks in batches of groups of a bounded size.
    """
    group = F.col(by) if by else F.lit(0)
    rows = held(df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(group.alias("g"), F.col(key).alias("key"), F.transform(vector, lambda v: v.cast("double")).alias("x")).where("g IS NOT NULL"))
    sizes = {r["g"]: (r["n"], r["dims"]) for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).collect() if r["n"] >= 3}  # a row a group
    wanted = {g: list(ks) if ks else sorted({*candidate_ks(n, fewest, most), 2}) for g, (n, _) in sizes.items()}
    wanted = {g: [k for k in found if k < sizes[g][0]] for g, found in wanted.items()}
    out: dict[object, Choice] = {}
    for batch in _batches(wanted, {g: dims for g, (_, dims) in sizes.items()}, restarts):
        mine = rows.where(F.col("g").isin(batch))
        models = lloyd(mine, {g: starts[g] for g in batch} if starts else _starts(mine, {g: wanted[g] for g in batch}, restarts))
        fits = {g: {k: _best(models[g], k) for k in sorted({k for k, _ in models[g]})} for g in batch}
        for (g, k), s in _silhouettes(mine, fits, size).items():
            fits[g][k].silhouette = s
        for g in batch:
            found = {k: fit.silhouette for k, fit in fits[g].items()}
            smallest = {k: min(n for n in fit.sizes) for k, fit in fits[g].items()}
            n = sizes[g][0]
            k = choose_k(found, smallest, least_size(n)) if ks else chosen(found, smallest, n, fewest)
            out[g if by else None] = Choice(fits[g], k, elbow({k: fit.inertia for k, fit in fits[g].items() if ks or k >= min(candidate_ks(n, fewest, most))}))
    return out


def _best(models: dict, k: int) -> Clusters:
    """The model of the least squared distance, of equals that of the first start, its clusters in the order of their centres."""
    centres, sizes, inertia = min((models[m] for m in sorted(models) if m[0] == k), key=lambda m: round(m[2], 6))
    order = np.lexsort(centres.T[::-1])
    return Clusters(k, [[float(v) for v in centres[i]] for i in order], 0.0, inertia, [sizes[i] for i in order])


def _batches(wanted: dict, dims: dict, restarts: int) -> list[list]:
    out, size = [], 0
    for g, ks in wanted.items():
        own = sum(ks) * restarts * dims[g] * 8
        if not out or size + own > CENTRE_BYTES:
            out.append([])
            size = 0
        out[-1].append(g)
        size += own
    return out


def assigned(df: DataFrame, vector: str, by: str, choices: dict[object, Choice], out: str = "cluster") -> DataFrame:
    """``df`` with the number of the nearest centre of its group's chosen clustering; null in groups without one."""
    number = F.lit(None).cast("int")
    for g, choice in choices.items():
        number = F.when(F.col(by) == F.lit(g), choice.chosen.nearest(vector)).otherwise(number)
    return df.withColumn(out, number)
