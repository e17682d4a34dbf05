"""Names, pages, JSON, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import round_even
from .adapters import table
from .catalog import query


@query("name_normalise", f"SELECT doc_id, {T.normalise_sql('text')} AS key FROM documents")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise_name(F.col("text")).alias("key"))


@query("initial_surname", "SELECT p_partkey, CASE WHEN k LIKE '% %' THEN k[1:1] || ' ' || split_part(k, ' ', -1) ELSE k END AS short FROM (SELECT p_partkey, " + T.normalise_sql("p_name") + " AS k FROM part)")
def initial_surname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.initial_and_surname(T.normalise_name(F.col("p_name"))).alias("short"))


@query("html_unescape", "SELECT page_id, " + "replace(" * 6 + "html" + "".join(f", '{e}', '{c.replace(chr(39), chr(39) * 2)}')" for e, c in T.ENTITIES.items()) + " AS html FROM pages")
def html_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.unescape(F.col("html")).alias("html"))


@query(
    "page_glimpse",
    r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS glimpse FROM pages",
)
def page_glimpse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.glimpse(F.col("html")).alias("glimpse"))


@query("regex_extract", "SELECT c_custkey, TRY_CAST(NULLIF(regexp_extract(c_name, '#0*([0-9]+)$', 1), '') AS BIGINT) AS tm_id FROM customer")
def regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.id_from(F.col("c_name"), "#0*([0-9]+)$").alias("tm_id"))


@query(
    "season_label",
    "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y, year(o_orderdate) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS of_start, (year(o_orderdate) - 1) || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') AS of_end FROM orders",
)
def season_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return years.select("y", T.season_of_start(F.col("y")).alias("of_start"), T.season_of_end(F.col("y")).alias("of_end"))


@query("padded_ids", "SELECT p_partkey, 'X' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS id FROM part")
def padded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.padded_id("X", F.col("p_partkey")).alias("id"))


@query(
    "ordinals",
    "SELECT p_partkey, p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS place FROM part",
)
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.ordinal(F.col("p_size")).alias("place"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '{\"user\":' || user_id || ',\"k\":' || json_extract(props, '$.k') || '}' AS doc FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("user_id").alias("user"), k.alias("k"))).alias("doc"))


@query(
    "age_datediff",
    "SELECT o_orderkey, round_even(date_diff('day', CAST(o_orderdate AS DATE), DATE '2026-01-01') / 365.25::DOUBLE, 1) AS age, CAST(make_date(year(o_orderdate) + 1, 7, 1) AS VARCHAR) AS as_of FROM orders",
)
def age_datediff(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.date_diff(F.lit("2026-01-01").cast("date"), F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", round_even(days / 365.25, 1).alias("age"), F.make_date(F.year("o_orderdate") + 1, F.lit(7), F.lit(1)).cast("string").alias("as_of"))


@query(
    "clock_minutes",
    "SELECT event_id, CAST(minute(ts) AS DOUBLE) + CAST(second(ts) AS DOUBLE) / 60 AS m FROM events",
)
def clock_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.concat(F.lpad(F.minute("ts").cast("string"), 2, "0"), F.lit(":"), F.lpad(F.second("ts").cast("string"), 2, "0"))
    return table(spark, sf_dir, "events").select("event_id", T.clock_minutes(clock).alias("m"))


@query(
    "same_person",
    """WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')) AS b FROM part) SELECT p_partkey, list_has_all(b, a) AS same FROM p""",
)
def same_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.same_person(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")).alias("same"))
