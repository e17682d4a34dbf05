"""Tables written in the folder that driver and executors share, to be read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a folder of its own, and a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="pitchlake-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def held(df: DataFrame) -> DataFrame:
    """``df``, written once and read from there: what follows may refer to it any number of times, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/held-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  (the session may be gone already)
        pass
