"""Removal of long strings that also start elsewhere, by column-wise construction of a collection's Burrows-Wheeler transform.

Every window of ``length`` bytes names an anchor: of the ``gram``-byte strings in it the one of least hash, leftmost of equals. Equal
windows have equal anchors at equal distances, so windows with one anchor are cut out as one context, and only contexts round equal
anchors are compared. Equal contexts are one class; a class with more than one member recurs as a whole.

Unlike contexts round equal anchors make a collection, their anchors in one column. The collection's transform is built from the last
column to the first: each round inserts one symbol of every context, moves it to its place among the suffixes that begin at its
column (the stable sort by the new symbol is the last-to-first mapping), and updates the common prefixes of neighbours: one more than
the least between two places with the same symbol. As equal windows stand in the same column, suffixes of other columns need not be
interleaved; a round reads and writes one column's symbols, order and prefixes in sequence. Windows whose suffix has ``length``
symbols in common with a neighbour recur.

Groups of more than ``most`` contexts are split: a third of the windows at a time, dealt by all bytes that they have in common, until a
group is small or all its contexts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 400
GRAM = 256
#: Contexts of a group that one task may compare, and bytes of contexts that it takes at a time.
MOST, TAKE = 1_000, 4 << 20
#: Bytes of text hashed at a time.
CHUNK = 1 << 18
_LOW = np.uint64((1 << 20) - 1)  # of a key: the place, so that the leftmost of equal hashes is least

_BYTE = np.random.default_rng(20_263).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, CHUNK + 8192), _powers(pow(_BASE, -1, 2**64), CHUNK + 8192)


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each string of ``gram`` bytes."""
    n = len(text)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[text] * _UP[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    wide = np.concatenate([x, np.full(-len(x) % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    behind = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x) - w + 1], ahead[w - 1 : len(x)])


class Contexts:
    """Of a batch of texts: for each context its text, the hash of its anchor, its digest, start, the anchor's distance from there, number of windows."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length, found = length, []
        pieces = [(k, at) for k, t in enumerate(texts) for at in range(0, len(t) - length + 1, CHUNK)]
        while pieces:
            taken, size = [], 0
            while pieces and (not taken or size + len(texts[pieces[0][0]]) - pieces[0][1] <= CHUNK):
                k, at = pieces.pop(0)
                part = texts[k][at : at + CHUNK + length - 1]
                taken.append((k, at, part))
                size += len(part)
            found.append(self._of(taken, length, gram))
        self.text, self.h, self.start, self.before, self.windows = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 5
        views = [memoryview(t) for t in texts]
        digest = xxhash.xxh3_64_intdigest
        each = zip(self.text.tolist(), self.start.tolist(), self.before.tolist(), self.windows.tolist(), strict=True)
        self.digest = np.fromiter((digest(views[k][s : s + n + length - 1], (o << 16) + n) for k, s, o, n in each), np.uint64, len(self.text))

    @staticmethod
    def _of(taken: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
        joined = np.frombuffer(b"".join(part for _, _, part in taken), np.uint8)
        h = _gram_hashes(joined, gram)
        anchor = (_least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & _LOW).astype(np.int64)
        sizes = np.array([len(part) for _, _, part in taken])
        begin = np.cumsum(sizes) - sizes
        # Windows that lie in one text; those with one anchor are one context.
        first = np.repeat(begin, sizes - length + 1)
        which = np.repeat(np.arange(len(taken)), sizes - length + 1)
        within = np.arange(len(first)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
        at = first + within
        mine = anchor[at]
        new = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (which[1:] != which[:-1])]))
        windows = np.diff(np.append(new, len(at)))
        text = np.array([k for k, _, _ in taken])[which[new]]
        start = within[new] + np.array([at for _, at, _ in taken])[which[new]]
        return text, h[mine[new]], start, mine[new] - at[new], windows


def _sized(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _contexts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(t, h, c, l, o, b, n): each different context of each row of (t, text), with its first start and how often the text has it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Contexts(_sized(batch.column(1).to_pylist()), length, gram)
            order = np.lexsort((found.start, found.digest, found.text))
            text, digest = found.text[order], found.digest[order]
            new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])])) if len(order) else order
            at = order[new]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(found.text[at], pa.int64())), pa.array(found.h[at].view(np.int64)), pa.array(found.digest[at].view(np.int64)),
                    pa.array(found.start[at], pa.int64()), pa.array(found.before[at], pa.int32()), pa.array(found.windows[at], pa.int32()), pa.array(np.diff(np.append(new, len(order))), pa.int64()),
                ],
                ["t", "h", "c", "l", "o", "b", "n"],
            )

    return rows.select("t", "text").mapInArrow(cut, "t long, h long, c long, l long, o int, b int, n long")


def _packed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, t, z): texts compressed, to be shuffled."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            small = [len(t).to_bytes(8, "little") + (codec.compress(t, asbytes=True) if t else b"") for t in _sized(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary())], ["doc_id", "t", "z"])

    return rows.mapInArrow(pack, f"doc_id {kind}, t long, z binary")


def _unpacked(z: pa.Scalar) -> bytes:
    data = z.as_buffer()
    size = int.from_bytes(data[:8].to_pybytes(), "little")
    return pa.Codec("zstd").decompress(data[8:], size, asbytes=True) if size else b""


def _fetched(packed: DataFrame, wanted: DataFrame, length: int, scratch: common.Scratch) -> DataFrame:
    """(h, c, o, b, n, s): ``wanted`` (h, c, o, b, n, t, l) with its bytes, cut from the text that it is from."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for z, of_text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = memoryview(_unpacked(z))
                for w in of_text:
                    s = text[w["l"] : w["l"] + w["b"] + length - 1]
                    if xxhash.xxh3_64_intdigest(s, (w["o"] << 16) + w["b"]) == w["c"] % 2**64:  # else another text has the same hash
                        out.append((w["h"], w["c"], w["o"], w["b"], w["n"], bytes(s)))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [[]] * 6, _KINDS, strict=True)], _NAMES)

    lists = scratch.write(wanted.groupBy("t").agg(F.collect_list(F.struct("h", "c", "o", "b", "n", "l")).alias("of_text")), "wanted")  # those of one text
    return packed.join(lists, "t").select("z", "of_text").mapInArrow(cut, _SCHEMA).groupBy("h", "c").agg(*[F.first(x).alias(x) for x in _NAMES[2:]])


_NAMES, _KINDS = ["h", "c", "o", "b", "n", "s"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
_SCHEMA = "h long, c long, o int, b int, n long, s binary"


def columns(contexts: list[bytes], before: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(column, order, symbols, common) after each round, from the last column to the first; column 0 is the anchors'.

    ``group`` ascends. order: contexts by group and by what begins at the column; symbols: the transform's, which precede it (0: none);
    common: the symbols that each has in common with the one before it (0 for the first of a group).
    """
    m = len(contexts)
    sizes = np.array([len(s) for s in contexts])
    left, right = -int(before.max()), int((sizes - before).max())
    table = np.zeros((right - left + 1, m), np.uint16)  # a row a column; 0: no symbol; the first row precedes all
    for k, s in enumerate(contexts):
        at = 1 - int(before[k]) - left
        table[at : at + len(s), k] = np.frombuffer(s, np.uint8).astype(np.uint16) + 1
    base = group.astype(np.int64) * 257
    order, common_now = np.arange(m), np.zeros(m, np.int32)
    symbols = table[-1][order]
    for column in range(right - 1, left - 1, -1):
        key = base + symbols
        move = np.argsort(key, kind="stable")
        key = key[move]
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (symbols[move[1:]] > 0)])
        fresh = np.zeros(m, np.int32)
        at = np.flatnonzero(same)
        fresh[at] = 1 + _range_least(common_now, move[at - 1] + 1, move[at])
        order, common_now = order[move], fresh
        symbols = table[column - left][order]
        yield column, order, symbols, common_now


def _range_least(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of x[first..last], both inclusive, for each pair."""
    out = x[last].copy()
    wide = np.flatnonzero(last > first)
    if len(wide):
        f, e = first[wide], last[wide]
        level = np.frexp((e - f + 1).astype(np.float64))[1] - 1
        best, step = np.empty(len(wide), x.dtype), x
        for k in range(int(level.max()) + 1):  # step: the least of 2**k from each place on
            here = level == k
            best[here] = np.minimum(step[f[here]], step[e[here] - (1 << k) + 1])
            step = np.minimum(step[: -(1 << k)], step[1 << k :]) if len(step) > (1 << k) else step
        out[wide] = best
    return out


def recurring(contexts: list[bytes], before: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each context and window (by its start in the context): does another context of its group have it?"""
    sizes = np.array([len(s) for s in contexts])
    out = np.zeros((len(contexts), int(sizes.max()) - length + 1), bool)
    for column, order, _, shared in columns(contexts, before, group):
        near = shared >= length
        near[:-1] |= near[1:]
        which = order[near]
        at = column + before[which]
        inside = (at >= 0) & (at + length <= sizes[which])
        out[which[inside], at[inside]] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_RANGES = pa.list_(pa.struct([("f", pa.int32()), ("e", pa.int32())]))
_RANGES_SQL = "array<struct<f: int, e: int>>"


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """(h, c, r): the ranges of windows that each context shares with an unlike one of its group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            hs = np.array([r[0] for r in rows])
            group = np.concatenate([[0], np.cumsum(hs[1:] != hs[:-1])])
            found = recurring([r[3] for r in rows], np.array([r[2] for r in rows]), group, length)
            some = np.flatnonzero(found.any(axis=1)).tolist()
            ranges = [[{"f": f, "e": e} for f, e in _runs(found[k])] for k in some]
            return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in some], pa.int64()), pa.array([rows[k][1] for k in some], pa.int64()), pa.array(ranges, _RANGES)], ["h", "c", "r"])

        rows, size = [], 0
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= TAKE and r[0] != rows[-1][0]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        if rows:
            yield done(rows)

    dealt = contexts.select("h", "c", "o", "s").repartition("h").sortWithinPartitions("h", "c")
    return dealt.mapInArrow(compare, f"h long, c long, r {_RANGES_SQL}")


def _thirds(contexts: DataFrame, size: int, length: int) -> DataFrame:
    """(p, q, d, h, c, o, b, n, s): the parts of each context (p, q) whose windows have the anchor in the same ``size`` places, from window d on.

    h: of all bytes that windows of this part have in common, so that parts with a window in common have it in common too.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, c, o, b, n, s in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                for part in range((o - b + 1) // size, o // size + 1):
                    low, high = max(part * size, o - b + 1), min((part + 1) * size - 1, o)  # how far before the anchor its windows start
                    core = s[o - part * size : o - (part + 1) * size + 1 + length] if o >= part * size else b""
                    d, few = o - high, high - low + 1
                    own = s[d : d + few + length - 1]
                    out.append((h, c, d, _signed(core, part, h), _signed(own, high, few), high, few, n, own))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [[]] * 9, [pa.int64(), pa.int64(), pa.int32(), *_KINDS], strict=True)], ["p", "q", "d", *_NAMES])

    return contexts.select(*_NAMES).mapInArrow(split, f"p long, q long, d int, {_SCHEMA}")


def _signed(data: bytes, a: int, b: int) -> int:
    x = xxhash.xxh3_64_intdigest(data, ((a << 16) + b) % 2**64)
    return x - 2**64 if x >= 2**63 else x


def _covered(contexts: DataFrame, length: int, places: int, most: int, scratch: common.Scratch) -> DataFrame:
    """(h, c, r): the ranges of windows that recur, of ``contexts`` (h, c, o, b, n, s), one row a class."""
    groups = contexts.groupBy("h").agg(F.count("*").alias("g"))
    large = scratch.write(groups.where(F.col("g") > most).select("h"), "large")
    if large.isEmpty() or places == 1:
        return _compared(contexts, length)
    size = -(-places // 3)
    parts = scratch.write(_thirds(contexts.join(large, "h", "left_semi"), size, length), "parts")
    # Written, as Spark would else look for ``several`` before the grouping, and deal a hot anchor's parts to one task for both.
    classes = scratch.write(parts.groupBy("h", "c", "o", "b").agg(F.sum("n").alias("n"), F.first("s").alias("s")), "unlike")
    several = classes.groupBy("h").agg(F.count("*").alias("g")).where("g > 1").select("h")
    within = scratch.write(classes.join(several, "h", "left_semi").select(*_NAMES), "classes")
    whole = classes.where("n > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("f"), F.col("b").alias("e"))).cast(_RANGES_SQL).alias("r"))
    below = whole.unionByName(_covered(within, length, size, most, scratch))
    moved = F.transform("r", lambda x: F.struct((x["f"] + F.col("d")).cast("int").alias("f"), (x["e"] + F.col("d")).cast("int").alias("e")))
    up = parts.select("p", "q", "d", "h", "c").join(below, ["h", "c"]).select(F.col("p").alias("h"), F.col("q").alias("c"), moved.alias("r"))
    return _compared(contexts.join(large, "h", "left_anti"), length).unionByName(up)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in UTF-8 bytes, end exclusive), kept (the remaining bytes) for each row.

    Spans are the maximal runs of bytes covered by a string of ``length`` bytes that also starts anywhere else, in the same text or
    another; all are judged on the input. Repeated rows are copies of each other, whatever their ids; null texts are empty. Texts
    shorter than ``length`` are kept whole. Rows with null ids are kept. Other columns are ignored. No rows in, none out.
    """
    spark = docs.sparkSession
    common.ship(spark)
    scratch = common.Scratch(spark, "repeats")
    places = length - gram + 1
    long = docs.where(F.octet_length(F.col(text)) >= length)
    found = _contexts(long.select(F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text")), length, gram)
    shared = found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    live = scratch.write(found.join(shared, "h", "left_semi"), "live")
    classes = live.groupBy("h", "c", "o", "b").agg(F.sum("n").alias("n"), F.min(F.struct("t", "l")).alias("first"))
    classes = scratch.write(classes.select("h", "c", "o", "b", "n", "first.t", "first.l"), "classes")
    several = scratch.write(classes.groupBy("h").agg(F.count("*").alias("g")).where("g > 1").select("h"), "several")
    contexts = scratch.write(_fetched(_packed(long, doc_id, text), classes.join(several, "h", "left_semi"), length, scratch), "contexts")
    whole = classes.where("n > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("f"), F.col("b").alias("e"))).cast(_RANGES_SQL).alias("r"))
    covered = whole.unionByName(_covered(contexts, length, places, most, scratch)).groupBy("h", "c").agg(F.flatten(F.collect_list("r")).alias("r"))  # a few ranges of one context
    marks = live.select("t", "h", "c").join(covered, ["h", "c"]).groupBy("t", "h", "c").agg(F.first("r").alias("r"))
    marks = scratch.write(marks.groupBy("t").agg(F.collect_list(F.struct("c", "r")).alias("marks")), "marks")  # those of one text
    packed = _packed(docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))), doc_id, text)
    kind = packed.schema["doc_id"].dataType.simpleString()
    out_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for z, marked in zip(batch.column(1), batch.column(2), strict=True):
                data = _unpacked(z)
                mine = _spans(data, {m["c"] % 2**64: m["r"] for m in marked.as_py()}, length, gram) if marked.is_valid else []
                edges = [0, *(x for s in mine for x in s), len(data)]
                sizes.append(len(data))
                spans.append([{"start": s, "end": e} for s, e in mine])
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, out_kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return packed.join(marks, "t", "left").select("doc_id", "z", "marks").mapInArrow(remove, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def _spans(data: bytes, marks: dict[int, list[dict]], length: int, gram: int) -> list[tuple[int, int]]:
    """The bytes under the marked windows (by the digest of their context) of a text."""
    found = Contexts([data], length, gram)
    edge = np.zeros(len(data) + 1, np.int32)
    known = np.isin(found.digest, np.fromiter(marks, np.uint64, len(marks)))
    for start, digest in zip(found.start[known].tolist(), found.digest[known].tolist(), strict=True):
        for r in marks[digest]:
            edge[start + r["f"]] += 1
            edge[start + r["e"] - 1 + length] -= 1
    return _runs(np.cumsum(edge[:-1]) > 0)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from what ``without_repeats`` gives."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

