"""Operators 11 to 13 against brute force and DuckDB, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import lexical, queries, repeats, resampling
from pitchlake.llm.words import word_counts, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, shard string, t string, score string, rank string"
ODD = [
    (1, None), (2, ""), (3, "one two three four five six seven"), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (None, "nobody's text"), (6, " \n\t "),
    (7, "x" * 30_000), (8, "the cat sat on the mat " * 3_000), (9, "short"), (10, "naïve café İstanbul 漢字 ١٢ <|endoftext|> 🙂́"), (None, "x" * 500), (11, "Ab ab AB éÉ"), (12, "the cat " + "ab" * 700),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "s", "t", "c", "r") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- long repeats -----------------------------------------------------------


def removed(texts, length):
    data = [(t or "").encode() for t in texts]
    where = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        flags = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if where[b[i : i + length]] > 1:
                flags[i : i + length] = True
        out.append(flags)
    return out


def runs(flags):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(4)
    parts = ["".join(rng.choices("abc d", k=rng.randint(20, 120))) for _ in range(12)]
    texts = ["".join(rng.choice(parts)[: rng.randint(1, 120)] for _ in range(rng.randint(0, 12))) for _ in range(200)]
    texts += [None, "", "x" * 3000, "ab" * 800, "xyz" * 500, texts[3], texts[3], "é" * 500]
    # A hot passage: all have it, each between other letters.
    return texts + ["".join(rng.choices("abcdefgh", k=60)) + parts[0] + parts[1] + "".join(rng.choices("abcdefgh", k=60)) for _ in range(200)]


@pytest.mark.parametrize(("length", "gram", "most"), [(40, 20, 1000), (40, 25, 7), (30, 10, 20), (60, 30, 2), (20, 20, 3)])
def test_repeats_are_those_of_brute_force(spark, passages, length, gram, most):
    df = spark.createDataFrame(list(enumerate(passages)), "doc_id long, text string")
    got = {r.doc_id: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in repeats.without_repeats(df, length, gram, most).collect()}
    for i, flags in enumerate(removed(passages, length)):
        data = np.frombuffer((passages[i] or "").encode(), np.uint8)
        assert got[i] == (runs(flags), data[~flags].tobytes()), i


def test_repeats_over_pieces_of_a_long_text(spark, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh", k=700))
    long = "".join(rng.choices("abcdefgh", k=repeats.CHUNK - 350)) + passage + "".join(rng.choices("abcdefgh", k=repeats.CHUNK)) + passage[:500]
    df = spark.createDataFrame([(1, long), (2, "z" + passage[100:600])], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in repeats.without_repeats(df).collect()}
    at = repeats.CHUNK - 350
    assert got == {1: [(at, at + 600), (len(long) - 500, len(long))], 2: [(1, 501)]}


def test_parts_of_a_hot_anchor_are_not_grouped_in_one_task(spark, monkeypatch, passages):
    """Parts are added up as dealt by all their columns, never by the anchor alone."""
    write, plans = repeats.common.Scratch.write, []

    def watched(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(repeats.common.Scratch, "write", watched)
    monkeypatch.setattr(repeats, "_compared", lambda contexts, length: spark.createDataFrame([], f"h long, c long, r {repeats._RANGES_SQL}"))
    repeats.without_repeats(spark.createDataFrame(list(enumerate(passages)), "doc_id long, text string"), 40, 20, 20)
    grouped = [p for p in plans if "SortAggregate(key=[h#" in p and "first(s#" in p and "o#" in p]
    assert grouped
    for p in grouped:
        assert not re.search(r"hashpartitioning\(h#\d+L?, \d+\)", p[p.index("first(s#") :])


def test_column_bwt():
    """The order, symbols and common prefixes of each column are those of sorting by what begins there."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab", k=rng.randint(3, 12))).encode() for _ in range(40)]
    before, group = np.array([rng.randint(0, len(t) - 1) for t in texts]), np.sort(np.array([rng.randint(0, 3) for _ in texts]))
    for column, order, symbols, shared in repeats.columns(texts, before, group):
        rest = lambda k: texts[k][max(column + before[k], 0) :] if 0 <= column + before[k] < len(texts[k]) else b""  # noqa: B023, E731
        for a, b in zip(order, order[1:], strict=False):
            assert group[a] < group[b] or group[a] == group[b] and (rest(a) <= rest(b) or not rest(a))
        for place, k in enumerate(order):
            at = column - 1 + before[k]
            assert symbols[place] == (texts[k][at] + 1 if 0 <= at < len(texts[k]) else 0)
            if place and group[order[place - 1]] == group[k] and rest(k) and rest(order[place - 1]):
                x, y = rest(order[place - 1]), rest(k)
                assert shared[place] == next((n for n in range(min(len(x), len(y))) if x[n] != y[n]), min(len(x), len(y)))


def test_repeats_of_odd_rows(odd, none):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(repeats.without_repeats(odd)).collect())
    want = Counter()
    for (i, t), flags in zip(ODD, removed([t for _, t in ODD], 400), strict=True):
        data = np.frombuffer((t or "").encode(), np.uint8)
        want[i, len(data), int(flags.sum()), len(runs(flags)), hashlib.sha256(data[~flags].tobytes()).hexdigest()] += 1
    assert got == want and repeats.without_repeats(none).count() == 0


def test_repeats_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    flags = dict(zip(texts, removed(list(texts.values()), 400), strict=True))
    for r in queries.op11_column_bwt(spark, SF).collect():
        data = np.frombuffer(texts[r.doc_id].encode(), np.uint8)
        f = flags[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), f.sum(), len(runs(f)), hashlib.sha256(data[~f].tobytes()).hexdigest())
    assert any(f.any() for f in flags.values()) and not all(f.any() for f in flags.values())


# --- words ------------------------------------------------------------------


def test_words():
    rng = random.Random(7)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "B", "Z", "9", " ", "_", "é", "É", "İ", "漢", "\x00", "\x7f", "-", "@", "`", "{", "\x80"]) for _ in range(rng.randint(0, 10)))
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        assert [w.decode() for w in words(t)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        assert word_counts([t, None, t + "a", ""]).tolist() == [len(words(t)), 0, len(words(t + "a")), 0]
    assert words(None) == [] and word_counts([]).tolist() == []


# --- resampling -------------------------------------------------------------


def test_suffix_arrays():
    rng = np.random.default_rng(8)
    ids, ends = rng.integers(0, 3, 200).astype(np.int32), np.repeat(np.cumsum(np.full(10, 20)), 20)
    for longest in (1, 2, 3, 5):
        order, lcp = resampling.suffix_array(ids, ends, longest)
        grams = [tuple(ids[p : min(p + longest, ends[p])]) for p in order]
        assert sorted(order) == list(range(200)) and grams == sorted(grams)
        for k in range(1, 200):
            x, y = grams[k - 1], grams[k]
            assert lcp[k] == next((n for n in range(min(len(x), len(y))) if x[n] != y[n]), min(len(x), len(y)))


def drawn(docs, target, longest, buckets=10_000, percent=10, least=20, seed=2024):
    def features(t):
        w = words(t)
        return [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(x for _, d in docs for x in features(d)), Counter(x for d in target for x in features(d))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {x: math.floor(1000 * math.log((t[x] + 1) * (s_all + buckets) / ((s[x] + 1) * (t_all + buckets)))) for x in s}
    out = []
    for i, d in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in features(d))
        out.append([i, len(features(d)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, (_, d) in zip(out, docs, strict=True) if len(words(d)) >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, longest):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = Counter(tuple(r) for r in resampling.resampled(docs, target, longest=longest).collect())
    assert got == drawn([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], longest)


def test_resampling_of_odd_rows(odd, none):
    many = odd.unionByName(odd)
    got = Counter(tuple(r) for r in resampling.resampled(many, odd, longest=2, percent=50, least_words=2).collect())
    want = drawn([*ODD, *ODD], [t for _, t in ODD], 2, percent=50, least=2)
    assert Counter({r[:4]: n for r, n in got.items()}).keys() == Counter({r[:4]: n for r, n in want.items()}).keys() and sorted(r[4] for r in got.elements() if r[4]) == sorted(r[4] for r in want.elements() if r[4])
    assert {r[3] for r in got if r[4] == 1} == {r[3] for r in want if r[4] == 1}
    assert resampling.resampled(none, odd).count() == 0 and resampling.resampled(odd, none).count() == len(ODD)


def test_ranks_cross_ranges(spark, tmp_path):
    from pitchlake.llm.common import Scratch

    rows = spark.range(5000, numPartitions=7).select((F.col("id") % 13).alias("score"), "id")
    got = resampling.ranked(rows, [F.col("score").desc(), F.col("id")], Scratch(spark, "t")).collect()
    assert [(r.score, r.id) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((i % 13, i) for i in range(5000)), key=lambda x: (-x[0], x[1])) and {r["rank"] for r in got} == set(range(1, 5001))


# --- search -----------------------------------------------------------------


def test_blocks_are_packed():
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 129, 50)
    starts, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    gaps, counts = rng.integers(0, 2 ** rng.integers(0, 17, n)), rng.integers(1, 2 ** rng.integers(1, 12, n) + 1)
    gaps[starts] = 0
    at, data = lexical.pack_blocks(starts, gaps, counts)
    for k, (s, size) in enumerate(zip(starts, sizes, strict=True)):
        d, c = lexical.unpack_block(data[at[k] :], 5, size)
        assert (d == 5 + np.cumsum(gaps[s : s + size])).all() and (c == counts[s : s + size]).all()


def best(docs, items, top=20):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n_all, terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * n_all // terms
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scored[:top])]
    return Counter(out)


def test_search(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = best([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for settings in ({}, {"shard_bytes": 20_000}, {"item_bytes": 500}):
        assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(docs, items, **settings).collect()) == want, settings


def test_search_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "the cat x"), (1, "two two ab"), (2, None), (3, ""), (4, "!!"), (5, "unheard"), (None, "É café 漢字 text")], "item_id long, text string")
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(odd, items, 3).collect())
    assert got == best(ODD, [(r.item_id, r.text) for r in items.collect()], 3)
    assert lexical.search(none, items).count() == 0 and lexical.search(odd, none, item_id="doc_id").count() == 0


def test_blocks_are_skipped():
    """Blocks that cannot reach the best so far are not decompressed, and the result is that of reading all."""
    rng = np.random.default_rng(10)
    n = 200_000
    lists, m = [], np.full(n, 100, np.int64)
    score = np.zeros(n, np.int64)
    for df, weight, among in ((150_000, 3, n), (60_000, 50, n), (900, 900, 20_000)):
        doc = np.sort(rng.choice(among, df, replace=False))
        count = rng.geometric(0.7, df)
        starts = np.arange(0, df, lexical.BLOCK)
        ends = np.append(starts[1:], df) - 1
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = 0
        at, data = lexical.pack_blocks(starts, gaps, count)
        peak = np.maximum.reduceat(lexical.impact(count, m[doc]), starts)
        lists.append((lexical.Postings({"df": df, "first": doc[starts], "last": doc[ends], "peak": peak, "at": at, "data": data.tobytes()}), weight))
        score[doc] += weight * lexical.impact(count, m[doc])
    d, s = lexical.best_documents(lists, m, 20)
    least = np.sort(score)[-20]
    assert dict(zip(d.tolist(), s.tolist(), strict=True)) == {int(k): int(score[k]) for k in np.flatnonzero(score >= least)}
    assert sum(len(x.held) for x, _ in lists) < 0.3 * sum(len(x.first) for x, _ in lists)


# --- SQL --------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = c.sql(queries.ORACLE_SQL[name])
    mine = queries.QUERIES[name](spark, SF)
    held = defaultdict(int)
    for r in mine.select(*theirs.columns).collect():
        held[tuple(r)] += 1
    assert held == Counter(theirs.fetchall())
