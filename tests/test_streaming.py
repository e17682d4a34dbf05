"""Streams over files give what a batch gives, and each event once."""

import shutil
from datetime import datetime

from pyspark.sql import functions as F

from pitchlake.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_activity_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    shutil.copy(f"{SF}/events.parquet", source / "a.parquet")
    shutil.copy(f"{SF}/events.parquet", source / "b.parquet")  # sent twice
    stream = ingest.activity(ingest.read_events(spark, str(source)), late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.table("activity").collect()}
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.start, r.event_type): r.n for r in batch.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_late_events_are_left_out(spark, tmp_path):
    """Windows are given out once the watermark has passed them; what comes for them after that doesn't count."""
    source = tmp_path / "in"
    row = lambda k, ts, v: (k, datetime.fromisoformat(ts), 1, "view", v, None)
    parts = [[row(1, "2024-01-01 10:10:00", 1.0), row(2, "2024-01-01 10:50:00", 1.0)], [row(3, "2024-01-01 20:00:00", 1.0)], [row(4, "2024-01-01 10:20:00", 5.0), row(3, "2024-01-01 20:00:00", 9.0)], [row(5, "2024-01-02 20:00:00", 1.0)]]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for part in parts:
        spark.createDataFrame(part, ingest.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        ingest.run_to_table(ingest.activity(ingest.read_events(spark, str(source))), out, checkpoint).awaitTermination()
    got = {(str(r.start), r.n, r.value) for r in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01 10:00:00", 2, 2.0), ("2024-01-01 20:00:00", 1, 1.0)}


def test_upserts_take_the_last_row_of_a_key(spark, tmp_path):
    source, out, cp = str(tmp_path / "in"), str(tmp_path / "rows"), str(tmp_path / "cp")
    row = lambda k, ts, v: (k, datetime.fromisoformat(ts), 1, "view", v, None)
    for part in ([row(1, "2024-01-01 10:00:00", 1.0), row(1, "2024-01-01 11:00:00", 2.0), row(2, "2024-01-01 10:00:00", 3.0)], [row(2, "2024-01-01 09:00:00", 4.0)]):
        spark.createDataFrame(part, ingest.EVENTS).coalesce(1).write.mode("append").parquet(source)
        ingest.upsert_batches(ingest.read_events(spark, source), out, ["event_id"], ["ts"], cp).awaitTermination()
    want = {1: 2.0, 2: 4.0}
    assert {r.event_id: r.value for r in ingest.latest(spark, out, ["event_id"]).collect()} == want
    ingest.compacted(spark, out, ["event_id"], str(tmp_path / "one"))
    assert {r.event_id: r.value for r in ingest.latest(spark, str(tmp_path / "one"), ["event_id"]).collect()} == want


def test_append_and_upsert(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    shutil.copy(f"{SF}/events.parquet", source / "a.parquet")
    per = ingest.sessions(ingest.read_events(spark, str(source)))
    ingest.run_to_table(per, str(tmp_path / "sessions"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sessions")).count() > 0
    rows = ingest.read_events(spark, str(source)).select("event_id", "value")
    ingest.upsert_batches(rows, str(tmp_path / "rows"), ["event_id"], ["value"], str(tmp_path / "cp2")).awaitTermination()
    assert ingest.latest(spark, str(tmp_path / "rows"), ["event_id"]).count() == spark.read.parquet(f"{SF}/events.parquet").count()
