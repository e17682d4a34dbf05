"""Token ids of a corpus in wavelet matrices, one file a shard.

A shard is a range of whole documents, in ascending order of their ids, closed when it holds so many bytes of text. Its one file is
a Parquet file (compressed, readable wherever Spark reads) of one row: the shard's wavelet matrix, with the documents' ids and
lengths. The matrix holds one bit-plane for each bit of a token id, highest first: the bits of all ids in the order of that plane,
packed, with the count of ones before each block of 2,048 bits and the number of zeros. Every plane's order is the one before,
parted stably into zeros and ones. From these, ``Matrix`` answers access, rank, count and select without undoing the file, and
``token_at``, ``token_totals`` and ``occurrences`` answer them over all files; ``Matrix.all`` undoes one plane by plane.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from . import common
from .encoding import ByteEncoder

BLOCK = 2048
#: UTF-8 bytes of text in a shard, unless one document alone has more: what a task holds at once.
SHARD_BYTES = 16 << 20
END_ID = 2
FORMAT = "shard long, bits int, docs array<{kind}>, lengths array<long>, planes array<binary>, ones array<binary>, zeros array<long>"


class Matrix:
    """A wavelet matrix over ids below 2 ** bits."""

    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ones, self.zeros = n, planes, ones, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> Matrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"an id of {int(ids.max())} needs more than {bits} bits")
        now = ids.astype(np.uint32 if bits > 16 else np.uint16)
        planes, ones, zeros = [], [], []
        for b in range(bits - 1, -1, -1):
            up = (now & now.dtype.type(1 << b)) != 0
            plane = np.packbits(up, bitorder="little")
            planes.append(plane)
            ones.append(_before(plane))
            low = np.compress(~up, now)
            zeros.append(len(low))
            now = np.concatenate([low, np.compress(up, now)])
        return cls(len(ids), planes, ones, zeros)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block = i // BLOCK
        at, plane = block * BLOCK // 8, self.planes[level]
        n = int(self.ones[level][block]) + int(np.bitwise_count(plane[at : i // 8]).sum())
        return n + (int(plane[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else n

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of value before place i lie after the last plane."""
        start, end = 0, i
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, start), self._ones(level, end)
            if value >> (len(self.zeros) - 1 - level) & 1:
                start, end = zeros + a, zeros + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, i: int) -> int:
        """How often value occurs before place i."""
        start, end = self._range(value, i)
        return end - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of value."""
        start, end = self._range(value, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i = start + k
        for level in range(len(self.zeros) - 1, -1, -1):
            zeros, bit = self.zeros[level], value >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - zeros if bit else i)
        return i

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th bit of that kind in a plane: by block counts, then within the block."""
        ones = self.ones[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def all(self) -> np.ndarray:
        """All ids in order."""
        now = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            up = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out = np.empty_like(now)
            out[np.flatnonzero(~up)] = now[: self.zeros[level]]
            out[np.flatnonzero(up)] = now[self.zeros[level] :] | now.dtype.type(1 << (len(self.zeros) - 1 - level))
            now = out
        return now.astype(np.uint32)


def _before(plane: np.ndarray) -> np.ndarray:
    """Ones before each block."""
    each = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(each)[:-1] if len(each) else []]).astype("<u4")


@lru_cache(maxsize=2)
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def write(docs: DataFrame, tokenizer: str, out: str, *, doc_id: str = "doc_id", text: str = "text", bits: int = 16, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text, append the end id, and write the ids to files under ``out``, one a shard, in ascending order of document ids.

    Null texts are empty. Rows without an id come first; rows that share one follow each other. Ids are of any type that Arrow and
    Parquet know. A token id of 2 ** ``bits`` or more is an error.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = _format(rows)
    arrow = to_arrow_schema(schema)
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    # Ranges of ids by rows, each cut into shards by bytes in its task; an id that very many rows share is dealt on by text.
    ordered = rows.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer), np.array([end_id], np.uint32)
        # Partitions come in the order of ids, and so do the shards of one.
        shard, held, ids, lengths, keys = TaskContext.get().partitionId() << 32, 0, [], [], []

        def closed() -> pa.RecordBatch:
            m = Matrix.build(np.concatenate(ids), bits)
            row = [[shard], [bits], [pa.concat_arrays(keys)], [lengths], [[p.tobytes() for p in m.planes]], [[o.tobytes() for o in m.ones]], [m.zeros]]
            columns = [pa.ListArray.from_arrays(pa.array([0, len(x[0])], pa.int32()), x[0]).cast(t.type) if t.name == "docs" else pa.array(x, t.type) for x, t in zip(row, arrow, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for k, t in enumerate(batch.column(1)):
                t = t.as_py() or ""
                now = len(t.encode("utf-8", "surrogatepass"))
                if ids and held + now > shard_bytes:
                    yield closed()
                    shard, held, ids, lengths, keys = shard + 1, 0, [], [], []
                ids += [encode(t), end]
                lengths.append(len(ids[-2]) + 1)
                keys.append(batch.column(0).slice(k, 1))
                held += now
        if ids:
            yield closed()

    ordered.mapInArrow(build, schema).write.option("compression", "zstd").option("parquet.block.size", str(8 << 20)).option("maxRecordsPerFile", 1).parquet(out)


def _format(rows: DataFrame) -> StructType:
    return StructType([StructField(f.name, ArrayType(rows.schema["doc_id"].dataType) if f.name == "docs" else f.dataType) for f in StructType.fromDDL(FORMAT.format(kind="int"))])


def opened(row: pa.RecordBatch, at: int = 0) -> Matrix:
    """The matrix in a row of (lengths, planes, ones, zeros)."""
    lengths, planes, ones, zeros = (row.column(row.schema.names.index(c))[at].as_py() for c in ("lengths", "planes", "ones", "zeros"))
    return Matrix(sum(lengths), [np.frombuffer(p, np.uint8) for p in planes], [np.frombuffer(o, "<u4") for o in ones], zeros)


def _files(spark: SparkSession, out: str) -> DataFrame:
    """The shards of the folder, each with ``base``: the ids of all shards before it.

    Counts are added up by a bounded number of ranges of shards first, so that no task sees them all.
    """
    common.ship(spark)
    files = spark.read.parquet(out)
    sizes = files.select("shard", F.shiftright("shard", 42).alias("_r"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))  # 1,024 partitions a range
    ranges = sizes.groupBy("_r").agg(F.sum("n").alias("n"))
    ranges = ranges.select("_r", F.coalesce(F.sum("n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    inside = Window.partitionBy("_r").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.join(ranges, "_r").select("shard", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base"))
    return files.join(F.broadcast(bases), "shard")  # a row of two numbers a shard, so planes stay where they are read


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    files = _files(spark, out)
    schema = StructType([StructField("doc_id", files.schema["docs"].dataType.elementType), *StructType.fromDDL("start long, n_tokens long, ids_crc32 long")])

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                lengths = batch.column(1)[row].values.to_numpy(zero_copy_only=False)
                ids = opened(batch, row).all().astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                base = batch.column(5)[row].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, pa.array(starts + base, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("docs", "lengths", "planes", "ones", "zeros", "base").mapInArrow(undo, schema)


def token_at(spark: SparkSession, out: str, places: DataFrame) -> DataFrame:
    """(place, token) for the places (long, over all documents in order) that exist; read off the planes of the shards they lie in."""
    files = _files(spark, out).withColumn("n", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    # Places meet shards in cells of a fixed width; a cell holds about a thousand shards.
    cell = 1 << 34
    spread = files.select(F.explode(F.sequence(F.floor(F.col("base") / cell), F.floor((F.col("base") + F.col("n") - 1) / cell))).alias("cell"), "shard", "base", (F.col("base") + F.col("n")).alias("end"))
    asked = places.select(F.col("place").cast("long").alias("p")).distinct().withColumn("cell", F.floor(F.col("p") / cell))
    met = asked.join(spread, "cell").where("p >= base AND p < end").groupBy("shard").agg(F.collect_list(F.col("p") - F.col("base")).alias("at"))
    here = files.join(met, "shard").select("at", "lengths", "planes", "ones", "zeros", "base")

    def access(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                m, at, base = opened(batch, row), batch.column(0)[row].as_py(), batch.column(5)[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([base + i for i in at], pa.int64()), pa.array([m.access(i) for i in at], pa.int64())], ["place", "token"])

    return here.mapInArrow(access, "place long, token long")


def token_totals(spark: SparkSession, out: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of a few tokens occurs, from ranks alone."""
    common.ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                m = opened(batch, row)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([m.count(t) for t in tokens], pa.int64())], ["token", "n"])

    each = spark.read.parquet(out).select("lengths", "planes", "ones", "zeros").mapInArrow(count, "token long, n long")
    return each.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, out: str, token: int) -> DataFrame:
    """(doc_id, place, offset) of each occurrence of a token: its place over all documents, and in its own; by select on the planes."""
    files = _files(spark, out)
    schema = StructType([StructField("doc_id", files.schema["docs"].dataType.elementType), *StructType.fromDDL("place long, offset long")])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                m = opened(batch, row)
                at = np.array([m.select(token, k) for k in range(m.count(token))], np.int64)
                ends = np.cumsum(batch.column(1)[row].values.to_numpy(zero_copy_only=False))
                doc = np.searchsorted(ends, at, side="right")
                starts = np.concatenate([[0], ends[:-1]])
                base = batch.column(5)[row].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values.take(pa.array(doc)), pa.array(at + base), pa.array(at - starts[doc], pa.int64())], ["doc_id", "place", "offset"])

    return files.select("docs", "lengths", "planes", "ones", "zeros", "base").mapInArrow(locate, schema)
