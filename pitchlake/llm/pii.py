"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Fixed rules find seed entities. The words around an entity are its lexical patterns: the one, two and three before it, and the
words on both sides; what comes after it tells too little alone. Patterns and instances (distinct values) form a graph whose two sides score each other in turns,
until nothing new is known: a pattern by the share of its instances that are known to be of a kind, an instance by the patterns it
stands in. What no rule covers, but stands in high-confidence patterns and is of that kind's broad class (about as many digits with
any separators, or an @ however written; or the shape of a known value), is found by it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
# The base rules. Repetitions of groups are possessive, so long runs need no stack; where a match starts is as before: a run of
# a rule's first characters is only tried at its start or where the last match ended, as a later start in it would fail alike.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
#: Runs of single digits with a blank or hyphen between at most; those under 14 digits fail anyway.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What may be an identifier that no rule knows: a token with digits.
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
#: More of them: groups of digits with blanks between, emails with (at) or [at], tokens with an @ and no digit.
GROUPS = r"(?<!\S)[(]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)++"
SPELT = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[a-z0-9-]++)*+"
HANDLE = r"(?<!\S)[^\s0-9@]*+@[^\s0-9]*+(?!\S)"
#: Digits of what a pattern may find, as shares of the fewest and the most that the kind's known values have.
FEWEST, MOST = 0.6, 1.4
#: Distinct known values that a pattern needs (so that a few chance ones prove nothing, whatever the table's size), its share of them, and an instance's score.
SUPPORT, CONFIDENCE, ACCEPT = 10, 0.8, 0.9
#: Words before an entity that patterns are made of.
BEFORE = 3


def _blanks(part: Column) -> Column:
    return F.translate(F.lower(part), "\n\t\r\f\x0b\x85\xa0", "       ")


def _words(part: Column) -> Column:
    return F.filter(F.split(part, " ", -1), lambda w: w != "")


def _matches(text: Column, pattern: str, guard: Column, kind: str) -> Column:
    """An array of what the pattern finds: kind, place in order, code points before it since the last match, value, last words before it and first after it."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(gap: Column, following: Column, value: Column) -> Column:
        before = _words(F.substring_index(F.rtrim(_blanks(gap)), " ", -BEFORE))
        after = F.substring_index(F.ltrim(_blanks(following)), " ", 1)
        return F.struct(F.char_length(gap).alias("gap"), value.alias("value"), before.alias("before"), F.regexp_replace(after, r"[^\p{L}\p{N}]+$", "").alias("after"))

    around = F.zip_with(gaps, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(1))), lambda gap, following: F.struct(gap.alias("gap"), following.alias("following")))
    found = F.zip_with(around, values, lambda g, value: one(g["gap"], g["following"], value))
    placed = F.transform(found, lambda m, k: F.struct(F.lit(kind).alias("kind"), k.alias("place"), m["gap"].alias("gap"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))
    none = F.expr("array()").cast("array<struct<kind:string,place:int,gap:int,value:string,before:array<string>,after:string>>")
    return F.when(guard, F.filter(placed, lambda m: m["value"].isNotNull())).otherwise(none)


def _patterns() -> Column:
    """The lexical patterns of a match: k words before it as k|words, and the words on both sides as =|word|word."""
    n = F.size("before")
    before = [F.when(n >= k, F.concat(F.lit(f"{k}|"), F.array_join(F.slice("before", F.lit(-k), F.lit(k)), " "))) for k in range(1, BEFORE + 1)]
    both = F.when((n >= 1) & (F.col("after") != ""), F.concat(F.lit("=|"), F.element_at("before", F.lit(-1)), F.lit("|"), "after"))
    return F.array_compact(F.array(*before, both))


def _luhn(digits: Column) -> Column:
    def place(total, k):
        d = F.substring(digits, F.lit(0) - k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), place) % 10 == 0


def _holds() -> Column:
    """Whether a match passes its kind's test."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    parts = F.transform(F.split("value", r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: F.when(F.length(p) > 3, F.lit(False)).otherwise(p.cast("int") <= 255))
    card = F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return (
        F.when(F.col("kind") == "ip", small).when(F.col("kind") == "card", card).when(F.col("kind") == "phone", F.length(digits).between(10, 15)).otherwise(True)
    )


def _digits() -> Column:
    return F.length(F.regexp_replace("value", "[^0-9]", ""))


def _shape(value: Column) -> Column:
    """Digits as 9, letters as a, repeats once."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]{9,}", "999"), "[0-9]+", "9")


def _spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, value, before, after) of all matches of (doc_id, h, text): base ones, and candidates."""
    text, digit = F.col("text"), F.col("text").rlike("[0-9]")
    found = F.concat(
        _matches(text, EMAIL, F.contains("text", F.lit("@")), "email"),
        _matches(text, IP, digit & text.rlike(r"\.[0-9]+\.[0-9]"), "ip"),
        _matches(text, CARD, digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "card"),
        _matches(text, PHONE, F.contains("text", F.lit("+")), "phone"),
        _matches(text, TOKEN, digit, "token"),
        _matches(text, GROUPS, digit & text.rlike(r"[0-9().-]\x20[(]?[0-9]"), "groups"),
        _matches(text, SPELT, text.rlike(r"(?i)\(at\)|\[at\]"), "spelt"),
        _matches(text, HANDLE, F.contains("text", F.lit("@")), "handle"),
    )
    each = docs.select("doc_id", "h", F.explode(found).alias("m")).select("doc_id", "h", "m.*").distinct()
    so_far = Window.partitionBy("doc_id", "h", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("value")).over(so_far).cast("int")
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("value"))
    return placed.where(_holds()).select("doc_id", "h", "kind", "start", "end", "value", "before", "after")


def _discovered(spans: DataFrame, scratch: common.Scratch, support: int) -> DataFrame:
    """Spans (doc_id, h, kind, start, end) of candidates that high-confidence patterns find."""
    spark = spans.sparkSession
    earlier = Window.partitionBy("doc_id", "h").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("doc_id", "h").orderBy("start", "end", "kind").rowsBetween(1, Window.unboundedFollowing)
    base = F.col("kind").isin(*KINDS)
    free = (
        spans.withColumn("reached", F.max(F.when(base, F.col("end"))).over(earlier))
        .withColumn("next", F.min(F.when(base, F.col("start"))).over(later))
        .withColumn("free", (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))
    )
    free = scratch.write(free.where(base | F.col("free")).select("doc_id", "h", "kind", "start", "end", "value", _patterns().alias("patterns"), _shape(F.col("value")).alias("shape")), "instances")
    stands = free.select("kind", "value", "shape", F.explode("patterns").alias("pattern"))
    edges = stands.groupBy("pattern", "value", "shape").agg(F.max(F.when(base, F.col("kind"))).alias("seed"), F.max(base | (F.col("kind") == "token")).alias("counts"))
    edges = scratch.write(edges, "edges")
    shapes = scratch.write(free.where(base).select("kind", "shape").distinct(), "shapes")
    ranges = F.broadcast(free.where(base).groupBy("kind").agg(F.min(_digits()).alias("fewest"), F.max(_digits()).alias("most")))  # a row a kind

    def alike(rows: DataFrame) -> DataFrame:
        """Those rows (kind, shape, value, ...) of the kind's broad class, or with a known value's shape."""
        near = F.when(F.col("kind") == "email", F.col("value").rlike(r"(?i)@|\(at\)|\[at\]")).otherwise(
            ~F.col("value").rlike(r"\p{L}") & _digits().between(F.col("fewest") * FEWEST, F.col("most") * MOST)
        )
        return rows.join(shapes.withColumn("same", F.lit(True)), ["kind", "shape"], "left").join(ranges, "kind").where(near | F.col("same")).drop("same", "fewest", "most")

    # Groups and the like begin where a token does or have no digit, so a pattern's share counts tokens only.
    counted = edges.where("counts")
    totals = counted.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    counted = scratch.write(counted.select("pattern", "value").join(totals, "pattern"), "counted")
    open_edges = scratch.write(alike(edges.where("seed IS NULL").crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in KINDS], "kind string")))), "open")  # four rows
    known = scratch.write(edges.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind")).distinct(), "known")
    new = known
    # What is known only grows, so this ends; as a rule after two or three turns.
    while True:
        scored = counted.join(known, "value").groupBy("pattern", "kind", "n").agg(F.count("*").alias("k")).where((F.col("k") >= support) & (F.col("k") >= CONFIDENCE * F.col("n")))
        patterns = scratch.write(scored.select("pattern", "kind", (F.col("k") / F.col("n")).alias("confidence")), "patterns")
        # A product of chances, rounded, so that it doesn't hang on the order of its factors.
        doubt = F.round(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))), 9)
        better = open_edges.join(patterns, ["pattern", "kind"]).groupBy("value", "kind").agg(doubt.alias("doubt")).where(1 - F.exp("doubt") >= ACCEPT)
        new = scratch.write(better.select("value", "kind").join(known, ["value", "kind"], "left_anti"), "new")
        if new.isEmpty():
            break
        known = scratch.write(known.union(new), "known")
    found = alike(free.where(~base).drop("kind").withColumn("pattern", F.explode("patterns")).join(patterns, "pattern"))
    met = found.join(known, ["value", "kind"]).select("doc_id", "h", F.concat(F.lit("context_"), "kind").alias("kind"), "start", "end").distinct()
    # Of candidates within each other, the longest.
    outer = Window.partitionBy("doc_id", "h", "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("reached", F.max("end").over(outer)).where(F.coalesce("reached", F.lit(0)) < F.col("end")).drop("reached")


def find_pii(docs: DataFrame, support: int = SUPPORT, *, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id and spans (array of kind, start, end; code points, end exclusive; by start, then kind) for each row of ``docs``.

    Kinds: email, ip, card, phone by rule, and context_<kind> by context: patterns with ``support`` distinct known values and more; a table with
    fewer teaches none. Whole texts of any length are searched. Null and empty texts have no spans; null ids and repeated rows
    are kept. Other columns are ignored. With ``carry``, all columns are kept and ``_spans`` is added instead, or replaced.
    """
    scratch = common.Scratch(docs.sparkSession, "pii")
    # Names that no column of the caller's has.
    key_name, h_name, found_name = (f"_{c}_{uuid.uuid4().hex}" for c in ("key", "h", "found"))
    key = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias(key_name), F.xxhash64(F.col(text)).alias(h_name)]
    keyed = docs.select("*" if carry else F.col(doc_id).alias("doc_id"), *key)
    rows = docs.select(key[0].alias("doc_id"), key[1].alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = scratch.write(_spans(rows), "spans")
    all_spans = spans.where(F.col("kind").isin(*KINDS)).select("doc_id", "h", "kind", "start", "end").union(_discovered(spans, scratch, support))
    order = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, *(f"context_{k}" for k in KINDS))]), F.col("kind"))
    per = all_spans.groupBy(F.col("doc_id").alias(key_name), F.col("h").alias(h_name)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("start", order.alias("o"), "end", "kind"))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias(found_name)
    )
    none = F.expr("array()").cast("array<struct<kind:string,start:int,end:int>>")
    out = keyed.join(per, [key_name, h_name], "left").withColumn("_spans", F.coalesce(found_name, none))
    return out.drop(key_name, h_name, found_name) if carry else out.select("doc_id", F.col("_spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span (in order) replaced by its kind in brackets; a span that starts within an earlier one is joined to it."""

    def step(done, s):
        apart = s["start"] >= done["at"]
        more = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(apart, more).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
