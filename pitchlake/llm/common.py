"""What the operators share: scratch tables, connected components, gapless numbering."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()
_libc = ctypes.CDLL(None)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets one; a cluster must name its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="pitchlake-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    """Best effort: a scratch folder that stays behind costs disk, not results."""
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables in the shared folder; they outlive lost executors, and go when dropped or at the program's end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(f"{name}-{uuid.uuid4().hex[:8]}")
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_scratch_path", None):
            _delete(self.spark, path)

    def close(self) -> None:
        try:
            _delete(self.spark, self.base)
        except Exception:  # noqa: BLE001  (the session may be gone already)
            pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that functions in it can be found where only the driver has it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="pitchlake-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that what is made of a piece is small beside the batch; in the end the task's memory is given back."""
    for batch in batches:
        for s in range(0, max(len(batch), 1), rows):
            yield batch.slice(s, rows)
    give_back()


def give_back() -> None:
    """Return what a worker has freed to the system: it stays for the next task, which may need its memory elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """As many partitions as the session shuffles into."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Parts that the rows of one key are dealt into where a join has to meet them all.
SALTS = 32


def salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def by_salted_key(rows: DataFrame, key: str, salted: str, aggregates: dict[str, Column]) -> DataFrame:
    """(key, _s, aggregates): what all rows of a key give, once for each salt that its rows have, so that a hot key's rows can be joined with it in parts.

    Spark adds up a key's rows, and the set of their salts as bits, where they are read: a task gets a row of each of those before it.
    """
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt(salted)))
    whole = rows.groupBy(key).agg(*[x.alias(name) for name, x in aggregates.items()], bits.alias("_ss"))
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("_ss", s) == 1)
    return whole.withColumn("_s", F.explode(salts)).drop("_ss")


def connected_components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for each node in them.

    Alternates large-star and small-star steps until nothing changes: each step keeps the number of rows and needs no more of
    a node than its smallest neighbour; a hub's edges meet it in parts. Steps are written to the shared folder.
    """
    edges = scratch.write(
        links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(),
        "links",
    )

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = by_salted_key(both, "u", "v", {"m": F.min("v")}).withColumn("m", F.least("m", "u"))
        return both.where("v > u").withColumn("_s", salt("v")).join(low, ["u", "_s"]).select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi")

    def small_star(e: DataFrame) -> DataFrame:
        low = by_salted_key(e, "hi", "lo", {"m": F.min("lo")})
        met = e.withColumn("_s", salt("lo")).join(low, ["hi", "_s"])
        moved = met.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        return moved.union(met.select(F.col("m").alias("lo"), "hi")).where("lo <> hi").distinct()

    while True:
        stepped = scratch.write(small_star(large_star(edges)), "links")
        # All edges are stars to the smallest node once no node hangs on two, or hangs on one and holds another.
        ends = stepped.select(F.col("hi").alias("x"), F.lit(1).alias("h"), F.lit(0).alias("l")).union(stepped.select(F.col("lo").alias("x"), F.lit(0).alias("h"), F.lit(1).alias("l")))
        per = ends.groupBy("x").agg(F.sum("h").alias("h"), F.max("l").alias("l"))
        if per.where("h > 1 OR h = 1 AND l = 1").isEmpty():
            scratch.drop(edges)
            break
        scratch.drop(edges)
        edges = stepped
    return stepped.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        stepped.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def gapless(df: DataFrame, group: list[str], order: list[str], out: str, rows: int, per_bucket: int = 65_536) -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps, in buckets of a hash of ``order``.

    A group may hold any share of all rows: it is dealt into buckets, each numbered by itself and shifted by the
    sizes of those before it. ``rows`` (all rows of ``df``) sets the number of buckets.
    """
    buckets = max(16, -(-rows // per_bucket))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(inside) - 1)
        .join(sizes, [*group, "_bucket"])
        .withColumn(out, (F.col("_base") + F.col("_row")).cast("long"))
        .drop("_bucket", "_base", "_row")
    )
