"""The driver's tables read as player analytics: orders and their lines as player-seasons, orders as valuations, events as matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import count_if


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def player_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's year as a player-season: segment, nation and region as position group, team and league; quantities as minutes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("team"), F.col("r_name").alias("league"))
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    # Lines are added up by order, and orders by player and year, before anything wide is joined to them; so orders are counted, not told apart.
    each = lines.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("minutes"),
        F.count("*").cast("double").alias("attempts"),
        count_if(F.col("l_returnflag") == "R").alias("completed"),
        count_if(F.col("l_discount") >= 0.08).alias("shots"),
        count_if((F.col("l_discount") >= 0.08) & (F.col("l_returnflag") == "A")).alias("goals"),
        count_if(F.col("l_linestatus") == "F").alias("tackles"),
        count_if(F.col("l_tax") >= 0.04).alias("passes"),
        count_if((F.col("l_tax") >= 0.04) & (F.col("l_linestatus") == "O")).alias("assists"),
    )
    added = ("minutes", "attempts", "completed", "shots", "goals", "tackles", "passes", "assists")
    per = each.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "season").agg(*[F.sum(c).alias(c) for c in added], F.count("*").alias("matches"))
    return per.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("player_id"), "season", F.col("c_mktsegment").alias("position_group"), "team", "league", "minutes", "matches", "attempts", "completed", "shots", "goals",
        "tackles", "passes", "assists", (16.0 + F.pmod(F.col("o_custkey") * 7, F.lit(23)) + F.col("season") % 7).alias("age"), F.col("c_acctbal").alias("value"),
    )


#: The same as a common table expression; needs no other.
PS = """ps AS (
  SELECT o_custkey AS player_id, CAST(year(o_orderdate) AS INT) AS season, c_mktsegment AS position_group, n_name AS team, r_name AS league,
    SUM(l_quantity) AS mins, CAST(COUNT(DISTINCT o_orderkey) AS BIGINT) AS matches, CAST(COUNT(*) AS DOUBLE) AS attempts,
    CAST(COUNT(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS completed, CAST(COUNT(*) FILTER (l_discount >= 0.08::DOUBLE) AS DOUBLE) AS shots,
    CAST(COUNT(*) FILTER (l_discount >= 0.08::DOUBLE AND l_returnflag = 'A') AS DOUBLE) AS goals,
    CAST(COUNT(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS tackles, CAST(COUNT(*) FILTER (l_tax >= 0.04::DOUBLE) AS DOUBLE) AS passes,
    CAST(COUNT(*) FILTER (l_tax >= 0.04::DOUBLE AND l_linestatus = 'O') AS DOUBLE) AS assists,
    CAST(16 + (o_custkey * 7) % 23 + year(o_orderdate) % 7 AS DOUBLE) AS age, c_acctbal AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
)"""


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a day as a match, in order, with their number in it."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


EV = """ev AS (SELECT event_id, user_id, event_type, value, ts, CAST(ts AS DATE) AS day, epoch_us(ts) AS us FROM events)"""
