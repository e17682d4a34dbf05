"""Match events as they come in: possession by window and player-match rows, each event once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import count_if
from ..operators.ranking import best_of

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files under ``path``, with an event time that watermarks can use."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value) a window; an event counts once however often it is sent, up to the watermark."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    per = once.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return per.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, touches) of each user's unbroken activity."""
    per = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(count_if(F.col("event_type") != "error").alias("touches"))
    return per.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "touches")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Process all there is, then stop; a rerun with the same checkpoint takes only what is new."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, out: str, keys: list[str], order: list[str], checkpoint: str):
    """Each micro-batch replaces the rows of its keys: one row a key, the last by ``order``, is written beside the others under the batch's number.

    A batch that is run again overwrites its own folder only. ``latest`` reads the newest rows; ``compacted`` folds old batches into one.
    """

    def write(batch: DataFrame, number: int) -> None:
        best_of(batch, keys, [F.desc(c) for c in order]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest row of each key among the batches; a batch has one row a key at most, so there are no ties."""
    rows = spark.read.parquet(out)
    columns = [c for c in rows.columns if c not in ("batch", *keys)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_r")).select(*keys, "_r.*")


def compacted(spark: SparkSession, out: str, keys: list[str], target: str) -> None:
    """All batches so far as the one batch of a new folder, numbered as their last, so that reads need not go over all history."""
    last = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    latest(spark, out, keys).write.mode("overwrite").parquet(f"{target}/batch={last}")
