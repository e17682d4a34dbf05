"""Files that are the same, byte for byte, whenever their rows are; only those that changed are written.

Rows are numbered in an order and cut into parts of a bounded size; a part is a file of a fixed name. A manifest of the parts' digests lies beside them: what it
has already is left alone, what it has no longer is deleted. Parts are written aside and moved into place one by one, the manifest last, so a run that breaks
off is put right by the next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..scratch import held

#: Bytes of a part before compression, at most, unless one row has more.
PART_BYTES = 8 << 20


def csv_line(columns: list[str]) -> Column:
    """A row as a line of CSV: nulls empty, quotes where needed."""
    special = lambda s: F.contains(s, F.lit(",")) | F.contains(s, F.lit('"')) | F.contains(s, F.lit("\n")) | F.contains(s, F.lit("\r"))
    cell = lambda s: F.when(special(s), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(s, F.lit("")))
    return F.concat_ws(",", *[cell(F.col(f"`{c}`").cast("string")) for c in columns])


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system of ``path``, its Path class)."""
    jvm = spark.sparkContext._jvm
    of = jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def exists(spark: SparkSession, path: str) -> bool:
    fs, of = _files(spark, path)
    return fs.exists(of(path))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(folder, part, rows, sha256) of the parts under ``path``; empty where nothing was written yet."""
    schema = "folder string, part int, rows long, sha256 string"
    return spark.read.schema(schema).json(f"{path}/_manifest") if exists(spark, f"{path}/_manifest") else spark.createDataFrame([], schema)


def parts_of(lines: DataFrame, folder: Column, order: list[str | Column], part_bytes: int = PART_BYTES) -> DataFrame:
    """(folder, part, rows, sha256, text): ``lines`` (line, ...) in their order, cut so that no part is over ``part_bytes`` unless its one row is."""
    placed = numbered(lines.withColumn("folder", folder), ["folder"], order, "_nth")
    longest = placed.groupBy("folder").agg(F.greatest(F.lit(1), F.floor(part_bytes / (F.max(F.octet_length("line")) + 1))).cast("long").alias("_each"))
    cut = placed.join(longest, "folder").withColumn("part", F.floor((F.col("_nth") - 1) / F.col("_each")).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "line"))), lambda r: r["line"]), "\n")  # a part's bounded rows
    whole = cut.groupBy("folder", "part").agg(F.count("*").alias("rows"), text.alias("text"))
    return whole.select("folder", "part", "rows", F.sha2("text", 256).alias("sha256"), "text")


def write_parts(parts: DataFrame, path: str, suffix: str, header: str | None = None, compressed: bool = True) -> dict[str, int]:
    """Make the files under ``path`` those of ``parts``; {written, kept, deleted}. Files are <folder>/part-<number><suffix>."""
    spark = parts.sparkSession
    fs, of = _files(spark, path)
    wanted = held(parts)
    old = held(manifest(spark, path))
    changed = wanted.join(old.select("folder", "part", "sha256"), ["folder", "part", "sha256"], "left_anti")
    gone = old.join(wanted.select("folder", "part"), ["folder", "part"], "left_anti")
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    body = F.concat_ws("\n", *([F.lit(header)] if header else []), "text")
    rows = changed.select("folder", "part", body.alias("value")).repartition("folder", "part")
    rows.write.option("compression", "gzip" if compressed else "none").partitionBy("folder", "part").text(staged)
    name = lambda r: f"{path}/{r['folder']}/part-{r['part']:05d}{suffix}"
    written = deleted = 0
    for r in _listed(changed.select("folder", "part")):
        source = next(s.getPath() for s in fs.listStatus(of(f"{staged}/folder={_escaped(spark, r['folder'])}/part={r['part']}")) if s.getPath().getName().startswith("part-"))
        fs.mkdirs(of(f"{path}/{r['folder']}"))
        fs.delete(of(name(r)), False)
        fs.rename(source, of(name(r)))
        written += 1
    for r in _listed(gone.select("folder", "part")):
        fs.delete(of(name(r)), False)
        deleted += 1
    fs.delete(of(staged), True)
    fresh = f"{path}/_manifest-{uuid.uuid4().hex}"
    wanted.select("folder", "part", "rows", "sha256").coalesce(1).sortWithinPartitions("folder", "part").write.json(fresh)  # a row a file
    fs.delete(of(f"{path}/_manifest"), True)
    fs.rename(of(fresh), of(f"{path}/_manifest"))
    return {"written": written, "kept": wanted.count() - written, "deleted": deleted}


def _listed(rows: DataFrame) -> Iterator:
    """Files by name, one partition at a time."""
    return rows.toLocalIterator()


def _escaped(spark: SparkSession, folder: str) -> str:
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(folder)


def write_csv(df: DataFrame, path: str, folder: Column, order: list[str], columns: list[str] | None = None, part_bytes: int = PART_BYTES) -> dict[str, int]:
    """``df`` as compressed CSV under ``path``, the same bytes for the same rows; rows alike in ``order`` are alike in all columns or follow their line."""
    columns = columns or df.columns
    lines = df.withColumn("line", csv_line(columns))
    return write_parts(parts_of(lines, folder, [*order, "line"], part_bytes), path, ".csv.gz", ",".join(columns))


def write_json(df: DataFrame, path: str, folder: Column, order: list[str], part_bytes: int = PART_BYTES) -> dict[str, int]:
    """``df`` as JSON, a line a row, in parts that a page can fetch; the same bytes for the same rows."""
    lines = df.withColumn("line", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}))
    return write_parts(parts_of(lines, folder, [*order, "line"], part_bytes), path, ".json", compressed=False)


def catalogue(spark: SparkSession, path: str) -> str:
    """What lies under ``path`` as one small JSON document: folders with their parts' numbers of rows and digests. A row a file."""
    out: dict[str, list] = {}
    for r in manifest(spark, path).orderBy("folder", "part").toLocalIterator():
        out.setdefault(r["folder"], []).append({"rows": r["rows"], "sha256": r["sha256"]})
    return json.dumps(out, sort_keys=True, separators=(",", ":"))
