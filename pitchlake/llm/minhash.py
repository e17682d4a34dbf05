"""Near-duplicate documents by bottom-k sketches of one hash function.

Every document keeps the k smallest hashes of its word shingles; one of few shingles keeps them all. Documents with equal sets are one class.
Inverted lists of the retained values generate overlaps: as a pair that is similar enough shares most retained values, a document only enters
the lists of its rarest ones, as many as a similar partner cannot all lack, and brings along how many values it has from that one on. So the
first list that two share bounds how many values they can share at all, and pairs under the least overlap are dropped there, before anything
is fetched. Within a list a few leaders are compared with all other members, members that are joined already are not compared again, leaders
that have met the whole list leave it, and a pair is left to the first list that it shares. So a list of m copies costs about m comparisons, none is left out, and no list is gathered in
one place: members meet its leaders in parts. The sketch of a candidate pair's union then estimates its similarity, or gives it where the
sketches are whole sets; of the others only pairs that pass fetch their full sets, on which links are confirmed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 5
#: Hashes that a sketch retains, and shingles up to which it retains all.
SKETCH, WHOLE = 64, 256
#: A similar pair is lost with at most this probability (for each of: candidate search, estimate).
MISS = 1e-8
_PLACE = np.random.default_rng(20_261).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: A-Z lower-cased, words parted by ASCII blanks; fewer words are one shingle."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = max(len(h) - words + 1, 1)
    total = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(len(h), words)):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(_mixed(total))


def least_overlap(k: int, percent: int, miss: float = MISS) -> int:
    """The largest t so that of k values of a union, each shared with probability percent/100, fewer than t are shared with probability <= miss."""
    p, tail = percent / 100, 0.0
    for t in range(k + 1):
        tail += comb(k, t) * p**t * (1 - p) ** (k - t)
        if tail > miss:
            return max(t, 1)
    return k


def sketches(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc_id, key (a hash of the text), n (distinct shingles), h1, h2 (of the whole set), sketch (its k smallest hashes, or all of up to ``WHOLE``)."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("key"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_pieces(batches):
            sizes, h1, h2, kept = [], [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py())
                sizes.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(_mixed(s * _PLACE[0]).sum(dtype=np.uint64).view(np.int64)))
                kept.append(s if len(s) <= WHOLE else s[:k].copy())
            offsets = np.cumsum([0, *map(len, kept)], dtype=np.int32)
            flat = np.concatenate(kept).view(np.int64) if kept else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], ["doc_id", "key", "n", "h1", "h2", "sketch"]
            )

    return rows.mapInArrow(make, f"doc_id {kind}, key long, n long, h1 long, h2 long, sketch array<long>")


def packed_texts(rows: DataFrame) -> DataFrame:
    """(_id, _key, text): texts compressed, to be shuffled."""
    kind = rows.schema["_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_pieces(batches):
            small = [zlib.compress(t.as_py().encode("utf-8", "surrogatepass"), 1) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(small, pa.binary())], ["_id", "_key", "text"])

    return rows.mapInArrow(pack, f"_id {kind}, _key long, text binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """(a, set): the whole sorted set of each document of (a, packed text)."""
    kind = docs.schema["a"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_pieces(batches):
            sets = [shingles(zlib.decompress(t.as_py()).decode("utf-8", "surrogatepass")).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["a", "set"])

    return docs.select("a", "text").mapInArrow(make, f"a {kind}, set binary")


def _by_leader(pairs: DataFrame, held: DataFrame, value: str) -> DataFrame:
    """``pairs`` (a, b) with ``mine`` and ``other``, the ``value`` of each side from ``held`` (a, value). b may be in any share of the pairs: they meet its value in parts."""
    pairs = pairs.withColumn("_s", common.salt("a"))
    leaders = pairs.select("b", "_s").distinct().join(held.select(F.col("a").alias("b"), F.col(value).alias("other")), "b")
    return pairs.join(held.select("a", F.col(value).alias("mine")), "a").join(leaders, ["b", "_s"]).select("a", "b", "mine", "other")


def estimated(pairs: DataFrame, sketched: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b, sure): the pairs that the sketches of their unions don't rule out, sure where both are whole sets; ``sketched``: (a, n, sketch)."""
    kind, least = pairs.schema["a"].dataType.simpleString(), least_overlap(k, percent)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_pieces(batches):
            left, right, good, sure = batch.column(2), batch.column(3), [], []
            for x, y in zip(left, right, strict=True):
                (nx, x), (ny, y) = ((v["n"].as_py(), v["sketch"].values.to_numpy(zero_copy_only=False).view(np.uint64)) for v in (x, y))
                whole = len(x) == nx and len(y) == ny
                if whole:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                else:  # the k smallest of the union are known either way
                    x, y = x[:k], y[:k]
                    union = np.union1d(x, y)[:k]
                    shared = (np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)).sum()
                    good.append(bool(shared >= least))
                sure.append(whole)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns[:2]), pa.array(sure, pa.bool_()).filter(keep)], ["a", "b", "sure"])

    held = sketched.select("a", F.struct("n", "sketch").alias("_v"))
    return _by_leader(pairs, held, "_v").mapInArrow(estimate, f"a {kind}, b {kind}, sure boolean")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    kind = pairs.schema["a"].dataType.simpleString()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_pieces(batches):
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return _by_leader(pairs, sets, "set").mapInArrow(confirm, f"a {kind}, b {kind}")


def linked(pairs: DataFrame, sketched: DataFrame, sets: DataFrame, percent: int, k: int, scratch: common.Scratch) -> DataFrame:
    """The similar ones of ``pairs`` (a, b), written: by sketches that are whole sets, else by full sets once their sketches allow it."""
    maybe = scratch.write(estimated(pairs, sketched, percent, k), "maybe")
    return scratch.write(maybe.where("sure").select("a", "b").union(confirmed(maybe.where("NOT sure").select("a", "b"), sets, percent)), "found")


def _lists(reps: DataFrame, percent: int, k: int) -> DataFrame:
    """Postings (v, a, n, whole, left, central, _s) of the rarest retained values of each class that could have a partner; lists of one are left out.

    left: how many of a's values that others have too come from v on, in the order of their lists' lengths. A set of up to ``WHOLE`` shingles meets
    others such by its whole set (so it enters as few lists as its size needs), and longer ones by the sketches of both, under other names of the values.
    """
    named = lambda values, whole: F.transform(values, lambda v: F.struct((v if whole else F.bitwise_not(v)).alias("v"), F.lit(whole).alias("whole")))
    none = F.array().cast("array<struct<v: bigint, whole: boolean>>")
    # Whole sets of few shingles have no longer partner, long ones no whole set.
    short = F.when(F.col("n") <= WHOLE, named(F.col("sketch"), True)).otherwise(none)
    long = F.when(F.col("n") * 100 > WHOLE * percent, named(F.slice("sketch", 1, k), False)).otherwise(none)
    post = reps.select("a", "n", F.explode(F.concat(short, long)).alias("p")).select("a", "n", "p.v", "p.whole")
    shared = common.by_salted_key(post, "v", "a", {"f": F.count("*")}).where("f > 1")
    mine = post.withColumn("_s", common.salt("a")).join(shared, ["v", "_s"]).groupBy("a", "n", "whole").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("vs"))
    need = F.when(F.col("whole"), F.ceil(F.col("n") * percent / 100)).otherwise(least_overlap(k, percent)).cast("int")
    mine = mine.where(F.size("vs") >= need).withColumns({"most": F.size("vs"), "vs": F.slice("vs", 1, F.size("vs") - need + 1)["v"]})
    central = F.col("most") / F.when(F.col("whole"), F.col("n")).otherwise(k)
    each = mine.select("a", "n", "whole", "most", central.alias("central"), F.posexplode("vs").alias("at", "v"))
    return each.select("v", "a", "n", "whole", (F.col("most") - F.col("at")).alias("left"), "central", common.salt("a").alias("_s"))


def _components(docs: DataFrame, percent: int, doc_id: str, text: str, k: int) -> DataFrame:
    """(doc_id, key, n, first, component_id): for each row its text's hash, the size of its set, the first node of its component and that node's id.

    A class of equal sets is a node named by its smallest id; where unlike classes have the same, by (id, h1, h2), so that they stay apart.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "minhash")
    sketched = scratch.write(sketches(docs, doc_id, text, k), "sketches")
    of_class = sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.write(of_class.select("h1", "h2", F.col("least.doc_id").alias("id"), F.col("least.key").alias("key"), "n", "sketch"), "classes")
    made = scratch.write(sketched.drop("sketch"), "rows")
    scratch.drop(sketched)
    some = made.where("n > 0 AND doc_id IS NOT NULL")
    shared = not classes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    classes = classes.withColumn("a", F.struct("id", "h1", "h2") if shared else F.col("id"))
    reps = classes.select("a", "n", "sketch")
    live = scratch.write(_lists(reps, percent, k), "postings")
    wanted = classes.join(live.where("NOT whole").select("a").distinct(), "a", "left_semi").select("a", F.col("id").alias("_id"), F.col("key").alias("_key"))
    # Only texts that can have a set of more shingles than any that is compared by its sketch.
    texts = packed_texts(docs.where(F.octet_length(F.col(text)) > 2 * (WHOLE * percent // 100)).select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("text")))
    # One row of each representative's text: rows with the same id and text are alike. Whole sets are in the sketches.
    sets = scratch.write(full_sets(texts.join(wanted, ["_id", "_key"]).groupBy("_id", "_key").agg(F.first("a").alias("a"), F.first("text").alias("text"))), "sets")
    listed = scratch.write(reps.join(live.select("a").distinct(), "a", "left_semi"), "listed")
    component = _join_lists(live, listed, sets, percent, k, scratch)
    first = classes.join(component, F.col("a") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "a").alias("first"))
    # A class may hold any share of all rows; its rows meet it in parts.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(common.SALTS)).cast("int").alias("_s")
    parts = some.select("h1", "h2", part).distinct().join(first, ["h1", "h2"])
    rows = made.select("doc_id", "key", "n", "h1", "h2", part).join(parts, ["h1", "h2", "_s"], "left")
    rows = rows.select("doc_id", "key", "n", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))
    return rows.withColumn("component_id", F.coalesce("first.id" if shared else "first", "doc_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, *, doc_id: str = "doc_id", text: str = "text", k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: links are pairs with 100 * intersection >= percent * union.

    Null or blank text: an empty set, linked with nothing. Rows with a null id are kept, with a null component. Rows that share an
    id are compared each by its own text. Other columns are ignored. No rows in, none out.
    """
    found = _components(docs, percent, doc_id, text, k)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 80, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of which each group of near-duplicates keeps the one with the smallest id.

    Rows with a null id and different blank texts stay. Of rows that share both id and text, and of those that share an id and a
    group, one stays; rows that share an id only are told apart by their texts.
    """
    found = _components(docs, percent, doc_id, text, SKETCH).where("doc_id IS NOT NULL")
    # The one text of a group that its smallest id names; blank texts (no group) all stay.
    grouped = found.where("n > 0").groupBy("first").agg(F.min(F.struct("doc_id", "key")).alias("least")).select("least.doc_id", "least.key")
    blank = found.where("n = 0").select("doc_id", "key")
    names = {c: f"_{c}_{uuid.uuid4().hex}" for c in ("id", "key", "turn")}
    kept = grouped.union(blank).distinct().select(F.col("doc_id").alias(names["id"]), F.col("key").alias(names["key"]))
    same = (F.col(names["id"]) == docs[doc_id]) & (F.col(names["key"]) == F.xxhash64(docs[text]))
    some = docs.where(F.col(doc_id).isNotNull()).join(kept, same, "left_semi")
    of_text = Window.partitionBy(doc_id, F.xxhash64(F.col(text))).orderBy(F.xxhash64(*docs.columns))
    one = some.withColumn(names["turn"], F.row_number().over(of_text)).where(F.col(names["turn"]) == 1).drop(names["turn"])
    return one.unionByName(docs.where(F.col(doc_id).isNull()))


def _own_shingles(sets: DataFrame, nodes: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(a, alone): how many shingles of each of ``nodes`` (a, comp) that have a full set none of another component has."""
    kind = sets.schema["a"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_pieces(batches):
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            for s in range(0, len(flat), 100_000):
                rows = pa.array(at[s : s + 100_000])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(flat[s : s + 100_000])], ["a", "comp", "s"])

    each = scratch.write(sets.join(nodes, "a").select("a", "comp", "set").mapInArrow(spread, f"a {kind}, comp {kind}, s long"), "shingles")
    own = each.groupBy("s").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 = c1").select("s")
    out = scratch.write(each.join(own, "s").groupBy("a").agg(F.count("*").alias("alone")), "alone")
    scratch.drop(each)
    return out


def _join_lists(live: DataFrame, sketched: DataFrame, sets: DataFrame, percent: int, k: int, scratch: common.Scratch) -> DataFrame:
    """(node, component) from the links among members of the same list."""
    spark = live.sparkSession
    live = live.withColumns({"alone": F.lit(0).cast("long"), "comp": F.col("a")})
    # The least overlap of a pair: of whole sets by their sizes, else of sketches.
    need = F.when(F.col("whole"), F.ceil((F.col("n") + F.col("l.n")) * percent / (100 + percent))).otherwise(least_overlap(k, percent))
    close = (F.least("n", "l.n") * 100 >= F.greatest("n", "l.n") * percent) & (F.least("left", "l.left") >= need)
    met = lambda pairs: linked(scratch.write(pairs.select("a", F.col("l.a").alias("b")).distinct(), "pairs"), sketched, sets, percent, k, scratch)
    # To begin with, each member meets the leader of one list only, the most common of its own: copies of one text are mostly joined
    # by that, at a comparison each, and need not be compared in all the other lists that they share.
    last = live.groupBy("a", "whole").agg(F.min("left").alias("left"))
    own = scratch.write(live.join(last, ["a", "whole", "left"]), "own")
    first = own.groupBy("v").agg(F.max(F.struct("central", "a", "n")).alias("l")).join(own.select("v", "_s").distinct(), "v")
    links = met(own.join(first, ["v", "_s"]).where((F.col("a") != F.col("l.a")) & (F.least("n", "l.n") * 100 >= F.greatest("n", "l.n") * percent)))
    known = None
    if not links.isEmpty():
        known = scratch.write(common.connected_components(spark, links, scratch), "components")
        live = live.drop("comp").join(known.select(F.col("node").alias("a"), F.col("component").alias("comp")), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    for turn in range(1_000_000):
        every = {"c0": F.min("comp"), "c1": F.max("comp"), "least": F.min("n")}
        lists = common.by_salted_key(live, "v", "a", every).where("c0 < c1").select("v", "_s", "least")
        live = scratch.write(live.join(lists, ["v", "_s"]), "live")
        if turn:
            # From here on what a document has and no other component bounds its similarity to any of another.
            alone = _own_shingles(sets, live.where("NOT whole").select("a", "comp").distinct(), scratch)
            live = live.drop("alone").join(alone, "a", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
        # A partner has at least ``least`` shingles and none of those.
        reach = F.lit(100) * (F.col("n") - F.col("alone")) >= F.lit(percent) * (F.col("least") + F.col("alone"))
        live = scratch.write(live.where(reach).drop("least"), "live")
        if live.isEmpty():
            break
        if not turn:
            # A pair is left to the first list that it shares, in the order of all, where what is left bounds its overlap.
            in_order = F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("left"), "v")))["v"]
            live = scratch.write(live.join(live.groupBy("a", "whole").agg(in_order.alias("vs")), ["a", "whole"]), "live")
        leaders = 32**turn
        bucket = F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(leaders))
        lead = live.groupBy("v", bucket.alias("_b")).agg(F.max(F.struct("central", "a", "n", "left", "alone", "comp", "vs")).alias("l")).select("v", "l")
        # A copy of each leader for each part that its list is dealt into.
        lead = scratch.write(lead.join(live.select("v", "_s").distinct(), "v"), "leaders")
        most = F.least(F.col("n") - F.col("alone"), F.col("l.n") - F.col("l.alone"))
        fits = (F.col("comp") != F.col("l.comp")) & close & (most * 100 >= (F.col("n") + F.col("l.n") - most) * percent)
        fits = fits & (F.get(F.array_intersect("vs", "l.vs"), F.lit(0)) == F.col("v"))
        links = met(live.join(lead, ["v", "_s"]).where(fits))
        live = live.join(lead.select("v", F.col("l.a").alias("a")).distinct(), ["v", "a"], "left_anti")
        if links.isEmpty():
            continue
        edges = links if known is None else links.union(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
        known = scratch.write(common.connected_components(spark, edges, scratch), "components")
        live = live.drop("comp").join(known.select(F.col("node").alias("a"), F.col("component").alias("comp")), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    if known is None:
        return live.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return known
