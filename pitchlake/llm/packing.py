"""Sequence packing, shortest pack first over the histogram of lengths.

A document longer than a sequence gives full pieces and a rest. The histogram of piece lengths has at most one entry a
length, so it is packed on the driver whatever the input: lengths are placed longest first, each into the shortest open
pack that has room, with counts of packs of a pattern kept instead of packs. Patterns go back to the pieces by the rank of
a piece among those of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoding import WordEncoder, packed

SEQUENCE = 2048
END_ID = 1


def shortest_pack_first(histogram: dict[int, int], room: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern: lengths from the start on, number of packs) for a histogram {length: count} of lengths up to ``room``."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by length so far
    lengths: list[int] = []  # of open packs, ascending
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for at in list(lengths):  # shortest first; those with this length in them come too late for it
            if not left or at + length > room:
                break
            stay = []
            for pattern, n in open_packs.pop(at):
                take = min(n, left)
                left -= take
                if take:
                    _put(open_packs, lengths, at + length, (*pattern, length), take)
                if n > take:
                    stay.append((pattern, n - take))
            if stay:
                open_packs[at] = stay
            else:
                lengths.remove(at)
        while left:  # new packs, of as many of this length as fit
            each = min(room // length, left)
            packs = left // each
            _put(open_packs, lengths, each * length, (length,) * each, packs)
            left -= packs * each
    return [x for at in sorted(open_packs) for x in open_packs[at]]


def _put(open_packs: dict, lengths: list[int], at: int, pattern: tuple[int, ...], n: int) -> None:
    if at not in open_packs:
        open_packs[at] = []
        k = bisect_right(lengths, at)
        if not k or lengths[k - 1] != at:
            insort(lengths, at)
    open_packs[at].append((pattern, n))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, next rank, first sequence, offset): where the pieces of a length go by their rank."""
    out, ranks, sequence = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            out.append((length, rank, rank + n, sequence, offset))
            ranks[length] = rank + n
            offset += length
        sequence += n
    return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", room: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and the end id, cut every ``room`` ids."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = packed([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for k, t in enumerate(batch.column(1)):
                ids = encode(t.as_py()) + end
                n = len(ids) // 4
                for s in range(0, n, room):
                    part = ids[4 * s : 4 * (s + room)]
                    at.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", room: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces with sequence_id and offset (both from 0 without gaps).

    Null and empty texts are the end id alone; texts of any length are cut into pieces of a sequence's length. Null ids and repeated rows are
    packed like others; pieces of one length are dealt by their rank, which any order of equal rows gives. No rows in, none out.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "packing")
    cut = scratch.write(pieces(docs, path, doc_id=doc_id, text=text, room=room, end_id=end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``room`` rows
    ranked = common.gapless(cut, ["length"], ["doc_id", "start", "ids_crc32"], "_rank", rows=sum(histogram.values()))
    where = spark.createDataFrame(slots(shortest_pack_first(histogram, room)), "length long, _from long, _to long, _first long, offset long")
    # As many rows as patterns have places, which the number of lengths bounds, not that of documents.
    where = where.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_first", "offset"))).alias("_slots"))
    hit = F.filter("_slots", lambda s: (F.col("_rank") >= s["_from"]) & (F.col("_rank") < s["_to"]))[0]
    return (
        ranked.join(F.broadcast(where), "length")
        .withColumn("_slot", hit)
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("_slot._first") + F.col("_rank") - F.col("_slot._from")).alias("sequence_id"), F.col("_slot.offset").alias("offset"),
        )
    )


def padding(packed_pieces: DataFrame, room: int = SEQUENCE) -> DataFrame:
    """One row: sequences, ids, padding (a sequence whose length is a power of two needs none)."""
    per = packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.pow(F.lit(2), F.floor(F.log2("n"))) == F.col("n")
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(whole, 0).otherwise(room - F.col("n"))).alias("padding"))


def padding_ratio(histogram: dict[int, int], room: int = SEQUENCE) -> float:
    """Share of padding in all places that the packing of a histogram takes."""
    p = np.array([(sum(x) & (sum(x) - 1) and room - sum(x), sum(x), n) for x, n in shortest_pack_first(histogram, room)])
    return float((p[:, 0] * p[:, 2]).sum() / ((p[:, 0] + p[:, 1]) * p[:, 2]).sum()) if len(p) else 0.0
