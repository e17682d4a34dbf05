"""Names, labels and small text repairs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that decompose to a base letter, and those that are spelled out.
ACCENTED = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđð", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľł",
    "n": "ñńņň", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşšș", "t": "ţťŧț", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
# Words that don't tell clubs apart.
CLUB_STOP_WORDS = (
    "fc", "cf", "ac", "as", "sc", "club", "de", "afc", "ssc", "us", "sv", "vfl", "vfb", "rc", "ud", "cd", "rcd", "ogc", "fk", "tsg", "and", "calcio",
)
LETTERS = "".join(x for xs in ACCENTED.values() for x in xs)
PLAIN = "".join(k * len(xs) for k, xs in ACCENTED.items())


def normalise_name(name: Column) -> Column:
    """Lower case, without accents, letters a-z and single blanks only."""
    s = F.translate(F.lower(name), LETTERS, PLAIN)
    for special, plain in SPELLED.items():
        s = F.replace(s, F.lit(special), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z ]", " "), " +", " "))


def normalise_sql(name: str) -> str:
    """The same in SQL."""
    s = f"translate(lower({name}), '{LETTERS}', '{PLAIN}')"
    for special, plain in SPELLED.items():
        s = f"replace({s}, '{special}', '{plain}')"
    return f"trim(regexp_replace(regexp_replace({s}, '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'))"


def words(name: Column) -> Column:
    """Distinct words of a name, normalised."""
    return F.array_distinct(F.filter(F.split(normalise_name(name), " "), lambda w: w != ""))


def initial_and_surname(key: Column) -> Column:
    """'kylian mbappe' -> 'k mbappe'; one word stays as it is."""
    parts = F.split(key, " ")
    return F.when(F.size(parts) > 1, F.concat(F.substring(key, 1, 1), F.lit(" "), F.element_at(parts, -1))).otherwise(key)


def club_tokens(club: Column) -> Column:
    """Words of a club's name of two letters and more that tell clubs apart."""
    return F.filter(words(club), lambda w: (F.length(w) > 1) & ~w.isin(*CLUB_STOP_WORDS))


def same_person(name: Column, other: Column) -> Column:
    """Whether the words of the shorter name are all in the longer; true where either has none."""
    a, b = words(name), words(other)
    fits = F.when(F.size(a) <= F.size(b), F.size(F.array_except(a, b)) == 0).otherwise(F.size(F.array_except(b, a)) == 0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), True).otherwise(F.coalesce(fits, F.lit(True)))


def id_from(url: Column, pattern: str) -> Column:
    """The first group of a pattern as a number, or null."""
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")).try_cast("bigint")


def unescape(html: Column) -> Column:
    for entity, char in ENTITIES.items():
        html = F.replace(html, F.lit(entity), F.lit(char))
    return html


def glimpse(html: Column) -> Column:
    """The text of a page: scripts, styles and tags out, blanks collapsed."""
    s = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "(?s)<[^>]*>", " "), r"\s+", " "))


def season_of_start(year: Column) -> Column:
    """2025 -> '2025-26'."""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def season_of_end(year: Column) -> Column:
    """2019 -> '2018-19'."""
    return season_of_start(year - 1)


def start_year(label: Column) -> Column:
    return F.split(label, "[-/]")[0].try_cast("int")


def ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def clock_minutes(clock: Column) -> Column:
    """'74:32' -> 74.533...; null where it isn't a clock."""
    parts = F.split(clock, ":")
    return F.when(F.size(parts) == 2, F.get(parts, 0).try_cast("double") + F.get(parts, 1).try_cast("double") / 60)


def market_value(euros: Column) -> Column:
    """1,500,000 -> '€1.5m', 250,000 -> '€250k'."""
    return (
        F.when(euros >= 1e6, F.concat(F.lit("€"), F.format_string("%.1f", euros / 1e6), F.lit("m")))
        .when(euros >= 1e3, F.concat(F.lit("€"), F.format_string("%.0f", euros / 1e3), F.lit("k")))
        .when(euros.isNotNull(), F.concat(F.lit("€"), F.format_string("%.0f", euros)))
    )


def padded_id(prefix: str, n: Column, width: int = 5) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def height_cm(text: Column) -> Column:
    """'1,85 m' -> 185.0; metres and centimetres alike."""
    h = F.replace(F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(h < 3, h * 100).otherwise(h)


def without_number(name: Column) -> Column:
    """'Ana Silva (4711)' -> 'Ana Silva'."""
    return F.trim(F.regexp_replace(name, r"\s*\(\d+\)\s*$", ""))


def first_of(listed: Column) -> Column:
    """'Spain  Brazil' -> 'Spain': the first of values parted by two blanks or more."""
    return F.nullif(F.split(listed, r"\s{2,}")[0], F.lit(""))


def last_part(path: Column) -> Column:
    """'Defender - Centre-Back' -> 'Centre-Back'."""
    return F.nullif(F.element_at(F.split(path, " - "), -1), F.lit(""))


def mapped(value: Column, table: dict[str, str]) -> Column:
    """A look-up in a small fixed table; null where it lacks the key."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value]
