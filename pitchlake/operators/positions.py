"""Where players play: positions of several feeds held against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mapped, same_person

# A broad role's group and position, each group's broad role, and the roles next to one.
BROAD = {"GK": "GK", "DF": "DEF", "MF": "MID", "FW": "FWD"}
ROLE_OF_GROUP = {
    "GK": "GK", "CB": "DF", "FB": "DF", "DEF": "DF", "DM": "MF", "CM": "MF", "AM": "MF", "WM": "MF", "MID": "MF", "SS": "FW", "W": "FW", "FW": "FW", "FWD": "FW",
}
NEXT_ROLES = {"GK": "GK", "DF": "DF,MF", "MF": "DF,MF,FW", "FW": "MF,FW"}
# The side of a detailed position, and where a broad role plays on it.
LEFT, RIGHT = ("LB", "LW", "LM"), ("RB", "RW", "RM")
MOVED = {
    "DF|L": "FB|LB", "DF|R": "FB|RB", "DF|": "CB|CB", "FW|L": "W|LW", "FW|R": "W|RW", "FW|": "FW|CF", "GK|": "GK|GK",
}
# A feed's four buckets and the role letter of each.
BUCKETS = {"Goalkeeper": "GK", "Defender": "DEF", "Midfield": "MID", "Attack": "FWD"}
LETTERS = {"GK": "GK", "DEF": "D", "MID": "M", "FWD": "F"}
#: Columns that come with a link to somebody, and go with it.
LINKED = ("age", "height_cm", "foot", "nationality", "tm_id", "date_of_birth", "contract_expiry", "position_starts", "position_share", "positions_played", "captain_starts")


def broad_roles(listed: Column) -> Column:
    """'FW,MF' -> [FW, MF]; only roles there are."""
    return F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), ","), F.trim), lambda r: r.isin(*BROAD))


def fits(group: Column, listed: Column) -> Column:
    """Whether a position group is one of the listed roles or next to one; keepers only fit keepers. True where nothing speaks against it."""
    roles, role = broad_roles(listed), mapped(group, ROLE_OF_GROUP)
    keeper = F.array_contains(roles, "GK")
    beside = F.arrays_overlap(F.split(mapped(role, NEXT_ROLES), ","), roles)
    return F.when((F.size(roles) == 0) | role.isNull(), True).when((role == "GK") != keeper, False).otherwise(F.coalesce(beside, F.lit(False)))


def resolved_position(position: Column, listed: Column, detailed: dict[str, tuple[str, str]], broad: dict[str, tuple[str, str]]) -> Column:
    """A struct (group, position, source): a feed's position where the listed roles allow it, else the first listed role on its side.

    ``detailed`` and ``broad``: {the feed's name: (group, position)}, of exact positions and of mere lines.
    """
    pack = lambda table: {k: "|".join(v) for k, v in table.items()}
    key, first = F.trim(position), F.trim(F.split(F.coalesce(listed, F.lit("")), ",")[0])
    exact = mapped(key, pack(detailed)) if detailed else F.lit(None).cast("string")
    own = F.coalesce(exact, mapped(key, pack(broad)) if broad else F.lit(None).cast("string"))
    group, place = F.split(own, r"\|")[0], F.split(own, r"\|")[1]
    side = F.when(first == "GK", "").when(place.isin(*LEFT), "L").when(place.isin(*RIGHT), "R").otherwise("")
    moved = F.when(group != "GK", mapped(F.concat(first, F.lit("|"), side), MOVED))
    line = F.coalesce(mapped(first, BROAD), F.lit("MID"))
    out = lambda g, p, s: F.struct(g.alias("group"), p.alias("position"), F.lit(s).alias("source"))
    return (
        F.when(own.isNull(), out(line, line, "listed role"))
        .when(fits(group, listed), F.struct(group.alias("group"), place.alias("position"), F.when(exact.isNotNull(), "profile").otherwise("profile (broad)").alias("source")))
        .when(moved.isNotNull(), out(F.split(moved, r"\|")[0], F.split(moved, r"\|")[1], "listed role, profile's side"))
        .otherwise(out(line, line, "listed role (profile contradicts it)"))
    )


def assigned_positions(df: DataFrame, detail_buckets: dict[str, str]) -> DataFrame:
    """position_group, position and position_source by precedence: that season's position, the profile's, then what the row had.

    A position counts only if the season's role letters (``roles``, blank-separated) hold its bucket's. Needs season_detail, season_how,
    profile_bucket, profile_detail. ``detail_buckets``: {detailed position: bucket}.
    """
    roles = F.split(F.coalesce("roles", F.lit("")), r"\s+")
    then, now = mapped(mapped(F.col("season_detail"), detail_buckets), BUCKETS), mapped(F.col("profile_bucket"), BUCKETS)
    in_roles = lambda bucket: F.coalesce(F.array_contains(roles, mapped(bucket, LETTERS)), F.lit(False))
    by_season, by_profile = in_roles(then), in_roles(now)
    return df.withColumns(
        {
            "position_group": F.when(by_season, then).when(by_profile, now).otherwise(F.col("position_group")),
            "position": F.when(by_season, F.col("season_detail")).when(by_profile, F.coalesce("profile_detail", now)).otherwise(F.col("position")),
            "position_source": F.when(by_season, F.concat(F.lit("that season: "), F.coalesce("season_how", F.lit("unknown")))).when(by_profile, F.lit("profile")).otherwise(F.col("position_source")),
        }
    )


def without_wrong_links(df: DataFrame, group: Column, listed: str, name: str, url: str, linked: list[str]) -> DataFrame:
    """Linked columns go where the link's name is another's and its position contradicts the listed roles."""
    wrong = F.col(url).isNotNull() & group.isNotNull() & ~same_person(F.col(name), F.regexp_replace(F.col(url), "[-/_]", " ")) & ~fits(group, F.col(listed))
    return df.withColumns({c: F.when(~F.coalesce(wrong, F.lit(False)), F.col(c)) for c in linked})


def without_other_people(df: DataFrame, born: str, linked_born: str, name: str, linked_name: str, linked: list[str]) -> DataFrame:
    """Linked columns go where years of birth are two or more apart and the names don't match either."""
    other = (F.abs(F.col(born) - F.col(linked_born)) >= 2) & ~same_person(F.col(name), F.col(linked_name))
    return df.withColumns({c: F.when(~F.coalesce(other, F.lit(False)), F.col(c)) for c in linked})


def without_odd_ages(df: DataFrame, bounds: tuple[float, float] = (15.0, 45.0), linked: tuple[str, ...] = LINKED) -> DataFrame:
    """An impossible age shows that somebody else was linked: all that came with the link goes."""
    odd = F.coalesce(~F.col("age").between(*bounds), F.lit(False))
    marked = df.withColumn("_odd", odd)
    return marked.withColumns({c: F.when(~F.col("_odd"), F.col(c)) for c in linked if c in df.columns}).drop("_odd")
