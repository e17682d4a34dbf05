"""Balanced shards by Karmarkar-Karp differencing.

Equal texts form one indivisible group. A group is a partial partition with one filled part; the two partial partitions with the
largest spread are combined, oppositely ordered, until one is left. Each task differences the groups that a hash deals it, so
that few partial partitions are left, one a task; these are combined in the same way, in tasks again while there are many,
and the last of them on the driver. Back from there, each group follows its part to a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Groups that a task differences, and partial partitions that one step combines.
GROUPS, FAN = 32_768, 1024


def combined(partials: list[list[int]], parts: int) -> tuple[list[int], list[list[int]]]:
    """(sums of the parts, where each part of each partial partition goes); ties go by position, so equal input gives equal output."""
    if not partials:
        return [0] * parts, []
    # A partial partition: its parts from large to small, each (sum, tree of (partial partition, part)).
    heap = []
    for k, sums in enumerate(partials):
        filled = sorted(((s, (k, j) if s else None) for j, s in enumerate(sums)), key=lambda p: -p[0]) + [(0, None)] * (parts - len(sums))
        heap.append((filled[-1][0] - filled[0][0], k, filled))
    heapq.heapify(heap)
    order = len(partials)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = [(x + y, t if s is None else s if t is None else [s, t]) for (x, s), (y, t) in zip(a, reversed(b), strict=True)]
        both.sort(key=lambda p: -p[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], order, both))
        order += 1
    to = [[0] * len(sums) for sums in partials]
    for part, (_, tree) in enumerate(heap[0][2]):
        todo = [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo += x
            elif x is not None:
                to[x[0]][x[1]] = part
    return [s for s, _ in heap[0][2]], to


def karmarkar_karp(sizes: list[int], parts: int) -> list[int]:
    """The part (0 to parts - 1) of each size."""
    return [to[0] for to in combined([[s] for s in sizes], parts)[1]]


def _differenced(groups: DataFrame, shards: int, tasks: int) -> DataFrame:
    """(_group, _ss, node, part, bytes): each task's groups in the parts of its own partial partition."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if len(b)]
        if not found:
            return
        table = pa.Table.from_batches(found).sort_by([("bytes", "descending"), ("_group", "ascending")])
        parts = karmarkar_karp(table["bytes"].to_pylist(), shards)
        node = pa.array([TaskContext.get().partitionId()] * len(parts), pa.int64())
        yield from pa.table([table["_group"], table["_ss"], node, pa.array(parts, pa.int32()), table["bytes"]], ["_group", "_ss", "node", "part", "bytes"]).to_batches()

    return groups.select("_group", "_ss", "bytes").repartition(tasks, "_group").mapInArrow(deal, "_group string, _ss array<int>, node long, part int, bytes long")


def _combined_nodes(sums: DataFrame, shards: int, fan: int) -> DataFrame:
    """(node, part, up, up_part, bytes): partial partitions (node, part, bytes) combined ``fan`` at a time."""

    def combine(_, batches):
        table = batches.sort_values(["node", "part"])
        nodes = [(n, rows) for n, rows in table.groupby("node")]
        partials = [[int(dict(zip(rows["part"], rows["bytes"], strict=True)).get(j, 0)) for j in range(shards)] for _, rows in nodes]
        to = combined(partials, shards)[1]
        place = {n: to[k] for k, (n, _) in enumerate(nodes)}
        return table.assign(up_part=[place[n][p] for n, p in zip(table["node"], table["part"], strict=True)])[["node", "part", "up", "up_part", "bytes"]]

    return sums.withColumn("up", F.floor(F.col("node") / fan).cast("long")).groupBy("up").applyInPandas(combine, "node long, part int, up long, up_part int, bytes long")


def balanced_shards(docs: DataFrame, shards: int = 16, *, doc_id: str = "doc_id", text: str = "text", per_task: int = GROUPS, fan: int = FAN) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law) for each row.

    Size: UTF-8 bytes and one more; null text has none, so size 1, crc32 0, and forms a group of its own. Null ids and
    repeated rows are kept, each with its own slot. One group larger than a shard's share fills its shard alone as far as
    differencing allows. No rows in, no rows out.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.coalesce(F.md5(F.encode(F.col(text), "UTF-8")), F.lit("of nulls")).alias("_group"),
    ).withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(common.SALTS)).cast("int"))
    scratch = common.Scratch(spark, "sharding")
    rows = scratch.write(rows, "rows")
    # A group may hold any share of all rows: it is added up, and later met again, in parts.
    parts = rows.groupBy("_group", "_s").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = scratch.write(parts.groupBy("_group").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.collect_set("_s").alias("_ss")), "groups")
    many, n = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed = scratch.write(_differenced(groups, shards, max(1, -(-many // per_task))), "differenced")
    up = scratch.write(placed.groupBy("node", "part").agg(F.sum("bytes").alias("bytes")), "sums")
    while up.select("node").distinct().count() > fan:
        step = scratch.write(_combined_nodes(up, shards, fan), "combined")
        placed = placed.join(step.select("node", "part", "up", "up_part"), ["node", "part"]).select("_group", "_ss", F.col("up").alias("node"), F.col("up_part").alias("part"), "bytes")
        up = scratch.write(step.groupBy(F.col("up").alias("node"), F.col("up_part").alias("part")).agg(F.sum("bytes").alias("bytes")), "sums")
    last = sorted(up.collect())  # of ``fan`` nodes at most
    nodes = sorted({r["node"] for r in last})
    held = {(r["node"], r["part"]): r["bytes"] for r in last}
    to = combined([[held.get((v, j), 0) for j in range(shards)] for v in nodes], shards)[1]
    shard_of = spark.createDataFrame([(v, j, to[k][j]) for k, v in enumerate(nodes) for j in range(shards)], "node long, part int, shard int")
    of_group = placed.join(F.broadcast(shard_of), ["node", "part"]).select("_group", F.explode("_ss").alias("_s"), "shard")  # ``fan`` nodes at most
    sharded = rows.join(of_group, ["_group", "_s"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")
    numbered = common.gapless(sharded, ["shard"], ["doc_id", "text_crc32", "size"], "slot", rows=n)
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
