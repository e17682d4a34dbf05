"""Near-duplicate vectors by spherical-cap filters.

The filters are random directions with structure: each table turns the space at random and cuts it into blocks with a code of
unit vectors each; a filter is one code word a block, and its score for a vector the sum of the blocks' scores. List decoding
finds all filters of a table whose score exceeds the cap from the sorted scores of the blocks, without visiting the others.
The code's size follows the number of vectors, so that filters stay equally full; the cap is the highest at which pairs at the
least cosine still share a filter but for a stated share of them.
Vectors meet in the filters they share, and each pair that meets is compared in double precision; a pair counts in the first
filter that it shares. Equal vectors are one class throughout; full filters are dealt out in blocks of members. Vectors travel with
their filters: fetched by pair afterwards, each pair of a group of near copies would have to be written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .resampling import ranked

#: Random turns of the space, and blocks of each.
TABLES, BLOCKS = 16, 2
#: Words of a block's code, by the number of vectors: its root over the tables', rounded up to a power of two within these bounds.
FEWEST, MOST = 32, 1024
#: Share of pairs at just the least cosine that may share no filter, and pairs that the cap is set from.
MISSED, PROBES = 0.0005, 4000
SEED = 20_261
#: Members of a filter that meet in one step; a fuller filter is dealt out in blocks of as many.
MEMBERS = 1024


class Code:
    """The product codes for vectors of one length."""

    def __init__(self, dims: int, tables: int, words: int, seed: int):
        rng = np.random.default_rng([seed, dims])
        wide = dims + -dims % BLOCKS
        self.dims, self.wide, self.words, self.tables = dims, wide, words, tables
        self.turns = [np.linalg.qr(rng.standard_normal((wide, wide)))[0] for _ in range(tables)]
        self.codes = []
        for _ in range(tables):
            c = rng.standard_normal((BLOCKS, words, wide // BLOCKS))
            self.codes.append(c / np.linalg.norm(c, axis=2, keepdims=True))

    def _scores(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        y, half = x @ self.turns[table], self.wide // BLOCKS
        return y[:, :half] @ self.codes[table][0].T, y[:, half:] @ self.codes[table][1].T

    def cap(self, least: float, missed: float = MISSED, probes: int = PROBES, seed: int = SEED) -> float:
        """The highest cap that a share of 1 - ``missed`` of random pairs with that cosine exceeds in some filter alike."""
        if self.dims < 2:
            return -1.0
        rng = np.random.default_rng([seed, 1])
        x, away = _unit(rng.standard_normal((probes, self.dims))), rng.standard_normal((probes, self.dims))
        away = _unit(away - (away * x).sum(axis=1, keepdims=True) * x)
        x, y = (np.pad(v, ((0, 0), (0, self.wide - self.dims))) for v in (x, least * x + np.sqrt(1 - least**2) * away))
        best = np.full(probes, -np.inf)
        for t in range(self.tables):
            (a, b), (c, d) = self._scores(x, t), self._scores(y, t)
            for k in range(probes):
                # Words whose best sum can't beat what is found are left out.
                rows = np.flatnonzero(np.minimum(a[k] + b[k].max(), c[k] + d[k].max()) > best[k])
                if len(rows):
                    best[k] = max(best[k], np.minimum(a[k][rows, None] + b[k][None, :], c[k][rows, None] + d[k][None, :]).max())
        return float(np.quantile(best, missed))

    def decode(self, x: np.ndarray, cap: float) -> list[np.ndarray]:
        """For each unit vector, all filters that it exceeds the cap of."""
        x = np.pad(x, ((0, 0), (0, self.wide - self.dims)))
        found: list[list[np.ndarray]] = [[] for _ in x]
        for t in range(self.tables):
            a, b = self._scores(x, t)
            order = np.argsort(-b, axis=1)
            sorted_b = np.take_along_axis(b, order, axis=1)
            for k in range(len(x)):
                rows = np.flatnonzero(a[k] + sorted_b[k, 0] >= cap)
                if len(rows):
                    ends = np.searchsorted(-sorted_b[k], a[k][rows] - cap, side="right")
                    found[k] += [(t * self.words + r) * self.words + order[k, :e] for r, e in zip(rows, ends, strict=True)]
        return [np.sort(np.concatenate(f)).astype(np.int32) if f else np.empty(0, np.int32) for f in found]


@lru_cache(maxsize=4)
def _code(dims: int, tables: int, words: int) -> Code:
    return Code(dims, tables, words, SEED)


def code_words(vectors: int, tables: int, dims: int = 64) -> int:
    """Words of a block's code for so many vectors; there are few directions to tell apart where dimensions are few."""
    words = FEWEST
    while words < MOST and words * words * tables < vectors:
        words *= 2
    return min(words, 2 ** min(dims + 1, 16))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _postings(classes: DataFrame, caps: dict[int, tuple[int, float]], tables: int) -> DataFrame:
    """(d, filter, a, copies, x, filters): a row for each filter of each class, by vector length d; ``caps``: {d: (words, cap)}."""
    kind, x = classes.schema["a"].dataType.simpleString(), classes.schema["x"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = whole.column(0).to_numpy()
            for d in np.unique(lengths).tolist():
                same = whole.take(pa.array(np.flatnonzero(lengths == d)))
                words, cap = caps[d]
                of = _code(d, tables, words)
                for s in range(0, len(same), 1024):
                    batch = same.slice(s, 1024)
                    filters = of.decode(_unit(_matrix(batch.column(3), d)), cap)
                    at = pa.array(np.repeat(np.arange(len(batch)), [len(f) for f in filters]))
                    flat = np.concatenate(filters)
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, filters)]), pa.int32()), pa.array(flat))
                    d_of, *rest = (c.take(at) for c in batch.columns)
                    yield pa.RecordBatch.from_arrays([d_of, pa.array(flat), *rest, lists.take(at)], ["d", "filter", "a", "copies", "x", "filters"])

    return classes.select("d", "a", "copies", "x").mapInArrow(decode, f"d int, filter int, a {kind}, copies long, x {x}, filters array<int>")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows with equal first columns (rows come sorted by them), and where each group starts."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in range(keys):
            c = table.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([*held, batch])
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at[:-1]
        held = table.slice(at[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def _meet(posts: DataFrame, least: float) -> DataFrame:
    """(a, links, to): for each member of a filter, its links that count here, and the smallest that it reaches over links here."""
    kind = posts.schema["a"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _whole_groups(batches, 4):
            nodes, copies = table.column(5).to_numpy(), table.column(6).to_numpy()
            dims, filters, left = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(4).to_numpy()
            vectors, own = table.column(7).combine_chunks(), table.column(8).combine_chunks()
            ends, flat = own.offsets.to_numpy(), own.values.to_numpy()
            out_a, out_n, out_to = [], [], []
            for s, e in zip(at, [*at[1:], table.num_rows], strict=True):
                if e - s < 2:
                    continue
                x = _unit(_matrix(vectors.slice(s, e - s), int(dims[s])))
                one = left[s:e]  # 1: of the left block, 2: of the right; 3: both, within one block
                rows, cols = np.flatnonzero(one & 1), np.flatnonzero(one & 2)
                i, j = np.nonzero(x[rows] @ x[cols].T >= least - 1e-9)
                i, j = rows[i] + s, cols[j] + s
                keep = (nodes[i] < nodes[j]) if one[0] == 3 else (nodes[i] != nodes[j])
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                exact = np.concatenate([(x[i[c : c + 65_536] - s] * x[j[c : c + 65_536] - s]).sum(axis=1) for c in range(0, len(i), 65_536)]) >= least
                i, j = i[exact], j[exact]
                if not len(i):
                    continue
                who = np.union1d(i, j)
                p, q = np.searchsorted(who, i), np.searchsorted(who, j)
                first = ~_shared_before(filters[s], who, ends, flat, p, q)
                out_a.append(nodes[who])
                out_n.append(np.bincount(p, first * copies[j], len(who)).astype(np.int64) + np.bincount(q, first * copies[i], len(who)).astype(np.int64))
                out_to.append(_smallest_reached(nodes[who], p, q))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in (out_a, out_n, out_to)], ["a", "links", "to"])

    return posts.mapInArrow(compare, f"a {kind}, links long, to {kind}")


def _smallest_reached(labels: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest label that each place reaches over the links (p, q)."""
    while True:
        new = labels.copy()
        np.minimum.at(new, p, labels[q])
        np.minimum.at(new, q, labels[p])
        if (new == labels).all():
            return new
        labels = new


def _shared_before(f: int, who: np.ndarray, ends: np.ndarray, flat: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the members who[p] and who[q] share a filter before f: then their pair has been counted there."""
    lists = [flat[ends[w] : ends[w + 1]] for w in who]
    lists = [a[a < f] for a in lists]
    ids, counts = np.unique(np.concatenate(lists), return_counts=True)
    ids = ids[counts > 1]
    if not len(ids):
        return np.zeros(len(p), bool)
    has = np.zeros((len(who), len(ids)), np.float32)
    for k, a in enumerate(lists):
        a = a[np.isin(a, ids, assume_unique=True)]
        has[k, np.searchsorted(ids, a)] = 1
    return (has @ has.T)[p, q] > 0


def near_vectors(vectors: DataFrame, least: float = 0.9, *, vec_id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, members: int = MEMBERS, missed: float = MISSED) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors``; a link is a pair of one length found with cosine >= ``least``.

    Vectors that are null, zero, or hold null or non-finite parts, link with nothing; those of different lengths not with each other.
    Ids are long. Rows that share one are vectors of their own: those with equal vectors count each other as links, and the component of
    each goes by its own vector. Rows with a null id link with nothing and get a null component. Other columns are ignored.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    scratch = common.Scratch(spark, "cap-filters")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x"))
    fine = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    fine = F.coalesce(fine, F.lit(False))
    good = rows.where(fine).withColumn("h", F.xxhash64("x")).withColumn("g", F.xxhash64(F.lit(1), "x"))
    classes = scratch.write(good.groupBy("h", "g").agg(F.min("vec_id").alias("a"), F.count("*").alias("copies"), F.first("x").alias("x")).withColumn("d", F.size("x")), "classes")
    # Unlike vectors of one id are nodes of their own: then nodes are numbered in the order of ids.
    shared = not classes.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if shared:
        classes = scratch.write(ranked(classes.withColumnRenamed("a", "id"), [F.col("id"), F.col("h"), F.col("g")], scratch).withColumnRenamed("rank", "a"), "numbered")
    names = classes.select(F.col("a").alias("component"), (F.col("id") if shared else F.col("a")).alias("component_id"))
    lengths = {r["d"]: r["count"] for r in classes.groupBy("d").count().where("count > 1").collect()}  # the lengths that occur
    caps = {d: (w := code_words(n, tables, d), _code(d, tables, w).cap(least, missed)) for d, n in sorted(lengths.items())}
    posts = scratch.write(_postings(classes.where(F.col("d").isin(*caps)) if caps else classes.limit(0), caps, tables), "postings")
    sizes = posts.groupBy("d", "filter").agg(F.ceil(F.count("*") / members).cast("int").alias("blocks")).where("blocks > 1")
    dealt = posts.join(sizes, ["d", "filter"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    # A member of block b meets those of every block: as left block with later ones, as right block with earlier ones.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("p"), F.greatest("b", o).alias("q"), F.when(F.col("b") == o, 3).when(F.col("b") < o, 1).otherwise(2).alias("side")))
    dealt = dealt.withColumn("m", F.explode(meets)).select("d", "filter", "m.p", "m.q", "m.side", "a", "copies", "x", "filters")
    sorted_posts = dealt.repartition(common.partitions(spark), "d", "filter", "p", "q").sortWithinPartitions("d", "filter", "p", "q")
    met = scratch.write(_meet(sorted_posts, least).groupBy("a").agg(F.sum("links").alias("links"), F.collect_set("to").alias("to")), "met")
    scratch.drop(posts)
    component = common.connected_components(spark, met.select("a", F.explode("to").alias("b")), scratch)
    of_class = (
        classes.select("h", "g", "a", "copies")
        .join(met.select("a", "links"), "a", "left")
        .join(component, F.col("a") == F.col("node"), "left")
        .select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "a").alias("component"))
    )
    of_class = of_class.join(names, "component") if shared else of_class.withColumnRenamed("component", "component_id")
    # A class may hold any share of all rows; they meet it in parts.
    keyed = good.select("vec_id", "h", "g").withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(common.SALTS)).cast("int"))
    linked = keyed.join(keyed.select("h", "g", "_s").distinct().join(of_class, ["h", "g"]), ["h", "g", "_s"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
