"""Reading season tables, feeds and nested match data into one shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.numbers import measured, true
from ..scratch import held

IDENTITY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("player_id", "player", "position", "position_group", "team", "league", "season")]
    + [T.StructField("league_tier", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("league_strength", "age", "height_cm", "team_possession", "minutes", "matches", "starts")]
)
REQUIRED = ("player", "position", "team", "league", "season", "minutes", "age")

_name = T.StructType([T.StructField("name", T.StringType())])
_person = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
_flag, _point = T.BooleanType(), T.ArrayType(T.DoubleType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One match event; details of other kinds of event are null.
EVENT = _struct(
    match_id=T.LongType(), id=T.StringType(), index=T.IntegerType(), period=T.IntegerType(), minute=T.IntegerType(), second=T.IntegerType(), type=_name, team=_name, player=_person,
    possession=T.IntegerType(), possession_team=_name, location=_point, under_pressure=_flag, counterpress=_flag, play_pattern=_name, related_events=T.ArrayType(T.StringType()),
    **{
        "pass": _struct(
            end_location=_point, length=T.DoubleType(), outcome=_name, recipient=_person, cross=_flag, switch=_flag, through_ball=_flag, shot_assist=_flag, goal_assist=_flag, aerial_won=_flag,
            technique=_name,
        )
    },
    carry=_struct(end_location=_point), shot=_struct(statsbomb_xg=T.DoubleType(), key_pass_id=T.StringType(), type=_name, outcome=_name, end_location=_point, aerial_won=_flag),
    dribble=_struct(outcome=_name), duel=_struct(type=_name, outcome=_name), interception=_struct(outcome=_name), clearance=_struct(aerial_won=_flag), miscontrol=_struct(aerial_won=_flag),
    ball_recovery=_struct(recovery_failure=_flag), ball_receipt=_struct(outcome=_name), goalkeeper=_struct(type=_name),
)
SPELL = _struct(position=T.StringType(), start_reason=T.StringType(), end_reason=T.StringType(), **{"from": T.StringType(), "to": T.StringType()})
LINEUP = _struct(match_id=T.LongType(), match_end=T.DoubleType(), player_id=T.LongType(), spells=T.ArrayType(SPELL))


def season_table(spark: SparkSession, path: str, stats: list[str], fmt: str = "parquet") -> DataFrame:
    """A season table with its identity columns and all ``stats``; those that the file lacks are null, NaN is null."""
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path)
    have = set(df.columns)
    identity = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in IDENTITY]
    counts = [(measured(F.col(s).try_cast("double")) if s in have else F.lit(None).cast("double")).alias(s) for s in stats]
    return df.select(*identity, *counts)


def external_table(df: DataFrame, column_map: dict[str, str]) -> DataFrame:
    """Somebody's own table: columns renamed, required ones checked, the rest given defaults; ids by name where it has none."""
    df = df.withColumnsRenamed(column_map)
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    defaults = {"team_possession": F.lit(50.0), "league_tier": F.lit(1), "league_strength": F.lit(1.0)}
    df = df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
    if "player_id" not in df.columns:
        df = df.join(numbered(df.select("player").distinct(), "player", "_n").select("player", X.padded_id("X", F.col("_n")).alias("player_id")), "player", "left")
    return df


def numbered(names: DataFrame, name: str, out: str) -> DataFrame:
    """Distinct names numbered from 0 in their order, without one task seeing them all: counted by their first two letters, then numbered within those."""
    known = names.where(F.col(name).isNotNull()).withColumn("_part", F.substring(name, 1, 2))
    counts = known.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a beginning
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(name)) - 1
    return known.withColumn("_in", inside).join(F.broadcast(before), "_part").select(name, (F.col("_before") + F.col("_in")).alias(out))


@dataclass(frozen=True)
class Source:
    """A feed: where it lies, what its positions are, and how it counts shots."""

    key: str
    path: str
    taxonomy: str = "detailed"
    shots_include_penalties: bool = False
    default_seasons: tuple = ()
    fmt: str = "parquet"


def load_source(spark: SparkSession, sources: dict[str, Source], key: str, stats: list[str], fallback: str | None = None) -> tuple[DataFrame, Source]:
    """A registered feed's season table, or the fallback's where its file is missing; and which it was."""
    for name in dict.fromkeys([key, *([fallback] if fallback else [])]):
        source = sources[name]
        if spark._jvm.org.apache.hadoop.fs.Path(source.path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(source.path)):
            df = season_table(spark, source.path, stats, source.fmt)
            return (df.where(F.col("season").isin(*source.default_seasons)) if source.default_seasons else df), source
    raise FileNotFoundError(sources[key].path)


def tolerant_csv(spark: SparkSession, path: str, schema: T.StructType, fields: int = 256) -> tuple[DataFrame, DataFrame]:
    """(rows, audit) of CSV files that differ in encoding, in their columns' order and in care.

    Each file has a header of its own; ``schema`` names the columns wanted, cast where they can be and null where a file lacks them or a cell doesn't fit. A file is read as UTF-8 if all of
    its lines are, else as Latin-1. Lines with more fields than their file's header are left out, and counted; those with fewer end in nulls. rows: the schema's columns and ``file``.
    audit: file, encoding, lines, too_long. A quoted line break ends its line. Headers have up to ``fields`` columns.
    """
    # A line comes as its bytes are, whatever they mean.
    line = F.rtrim(F.col("value"), F.lit("\r"))
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), line.cast("binary").alias("_raw"))
    raw = held(raw)
    cells = ", ".join(f"c{k} string" for k in range(fields + 1))

    def parsed(df: DataFrame, line: Column, out: str) -> DataFrame:
        whole = df.withColumn("_s", F.from_csv(line, cells, {"escape": '"'}))
        return whole.withColumn(out, F.array(*[F.col(f"_s.c{k}") for k in range(fields + 1)])).drop("_s")

    utf8 = F.is_valid_utf8(F.col("_raw").cast("string"))
    heads = raw.where("_start = 0").groupBy("file").agg(F.min_by("_raw", "_at").alias("_head"), F.min("_at").alias("_first"))
    about = held(raw.groupBy("file").agg(F.bool_and(utf8).alias("_utf8")).join(heads, "file"))  # a row a file
    decoded = F.when(F.col("_utf8"), F.col("_raw").cast("string")).otherwise(F.decode("_raw", "ISO-8859-1"))
    head = about.withColumn("_raw", F.col("_head")).select("file", "_utf8", "_first", F.ltrim(decoded, F.lit("\ufeff")).alias("_head"))
    head = parsed(head, F.col("_head"), "_all").withColumn("_names", F.transform(F.array_compact("_all"), F.trim)).withColumn("_width", F.size("_names")).drop("_all")
    lines = raw.join(head, "file").where((F.col("_at") != F.col("_first")) & (F.length("_raw") > 0)).withColumn("_line", decoded)
    # A cell beyond the header's width is a field too many, if only an empty one: the line is read with a mark after its end.
    marked = parsed(lines, F.concat("_line", F.lit(",\u0001")), "_cells")
    marked = marked.withColumn("_n", F.array_position("_cells", "\u0001") - 1).withColumn("_long", (F.col("_n") > F.col("_width")) | (F.col("_n") < 0))
    at = lambda f: F.array_position("_names", f.name).cast("int") - 1  # noqa: E731  (of columns of one name the first)
    value = lambda f: F.when((at(f) >= 0) & (at(f) < F.col("_n")), F.get("_cells", at(f))).try_cast(f.dataType).alias(f.name)
    rows = marked.where(~F.col("_long")).select(*[value(f) for f in schema], "file")
    counts = marked.groupBy("file").agg(F.count("*").alias("lines"), F.count_if("_long").alias("too_long"))
    audit = about.join(counts, "file", "left").select("file", F.when(F.col("_utf8"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("too_long", F.lit(0)).alias("too_long"))
    return rows, audit


def columns_of(spark: SparkSession, path: str, columns: list[str], name: str = "player") -> DataFrame:
    """Only some columns of a Parquet table, and the normalised name as key."""
    return spark.read.parquet(path).select(*columns).withColumn("key", X.normalise_name(F.col(name)))


def events(spark: SparkSession, path: str) -> DataFrame:
    """Match events from JSON lines."""
    return spark.read.schema(EVENT).json(path)


def lineups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINEUP).json(path)


def preferred(frames: list[DataFrame], key: list[str], order: Column | str | None = None) -> DataFrame:
    """Rows of several feeds, one a key: the first feed that has it; within a feed by ``order``."""
    both = None
    for rank, f in enumerate(frames):
        f = f.withColumn("_feed", F.lit(rank))
        both = f if both is None else both.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_feed", *([order] if order is not None else []))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_feed")


def first_known(frames: list[DataFrame], key: str) -> DataFrame:
    """One row a key with, in each column, the first feed's known value."""
    both = None
    for rank, f in enumerate(frames):
        f = f.withColumn("_feed", F.lit(rank))
        both = f if both is None else both.unionByName(f, allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "_feed")]
    return both.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_feed"))).alias(c) for c in columns])


def valuations(*feeds: DataFrame) -> DataFrame:
    """(tm_id, date, value) of several feeds: positive values only, one a day, the first feed's."""
    cleaned = [f.select(F.col("tm_id").try_cast("bigint").alias("tm_id"), F.to_date("date").alias("date"), F.col("value").try_cast("double").alias("value")) for f in feeds]
    cleaned = [f.where("tm_id IS NOT NULL AND date IS NOT NULL").where(true(F.col("value") > 0)) for f in cleaned]
    return preferred(cleaned, ["tm_id", "date"], F.desc("value"))


def enriched(features: DataFrame, market: DataFrame, columns: list[str], normaliser=X.normalise_name) -> DataFrame:
    """Market columns joined by name and season, where the name is unique there; the market's value wins if known."""
    once = market.withColumn("_key", normaliser(F.col("player"))).groupBy("_key", "season").agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_new_{c}") for c in columns]).where("_n = 1").drop("_n")
    joined = features.withColumn("_key", normaliser(F.col("player"))).join(once, ["_key", "season"], "left")
    merged = {c: F.coalesce(f"_new_{c}", c) if c in features.columns else F.col(f"_new_{c}") for c in columns}
    return joined.withColumns(merged).drop("_key", *[f"_new_{c}" for c in columns])


def squad_rows(payload: DataFrame) -> DataFrame:
    """Rows of a nested squad payload (club, season, players: array of id, name, height, nationality, value)."""
    each = payload.select("club", "season", F.explode("players").alias("p"))
    height = F.when(F.col("p.height") > 250, F.col("p.height") / 10).otherwise(F.col("p.height"))
    return each.select(
        "club", "season", F.col("p.id").alias("tm_id"), F.col("p.name").alias("player"), height.alias("height_cm"), F.get("p.nationality", F.lit(0)).alias("nationality"), (F.col("p.value") * 1e6).alias("market_value_eur")
    )


def map_headers(headers: list[str], aliases: dict[str, list[str]]) -> tuple[dict[str, str], list[str]]:
    """{header: metric} by normalised endings, and the metrics that found none."""
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum() or c in "/#")
    found = {}
    for metric, names in aliases.items():
        for h in headers:
            if h not in found and any(plain(h).endswith(plain(n)) for n in names):
                found[h] = metric
                break
    return found, [m for m in aliases if m not in found.values()]
