"""Benchmark items in documents, verbatim or with other parameters.

Texts become templates: numbers, units after numbers, and names turn into typed placeholders. Windows of five template tokens
are hashed; those of the documents meet those of the items in a hash join. An item is in a document if enough of its windows
are, and if what stands in its slots is consistent, in the whole document or in one occurrence: one value of the item always
became one value of the document, and two values two.
Names are told by their capital, which any word has at a sentence's start, and which a copied passage can lose or gain at its
ends; so every window is first hashed with names left as they are, again with those inside sentences replaced, and again with
every capitalised word replaced, where there are any.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .minhash import _PLACE, WORDS, _mixed

#: Share of an item's windows that a document must hold.
SIMILARITY = 0.8
#: Item windows up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 200_000
#: Bits of the filter that spares the join document windows which no item has; it only ever lets too many through.
FILTER_BITS = 22
MEMO_ENTRIES = 300_000
#: Characters of documents whose tokens are made at once.
CHUNK = 1 << 20

# Fixed word lists of the placeholders.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams pound pounds ounce ounces ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars cent cents euro euros percent degree degrees kmh mph watt watts volt volts".split()
)
NUMERALS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand".split())
PLAIN, NUMBER, UNIT, TITLE = 0, 1, 2, 3
#: A number with its unit in one word.
JOINED = re.compile(r"([0-9][0-9.,]*)([A-Za-z]+)")
#: A name: a capital, and small letters, with further capitals, hyphens and apostrophes between.
NAME = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


class Canon:
    """Template tokens of texts, with what each distinct word gives remembered."""

    def __init__(self):
        self.placeholder = {k: np.uint64(xxhash.xxh3_64_intdigest(f"\0{k}")) for k in (NUMBER, UNIT, TITLE)}
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.new: list[tuple[int, int, bool]] = []
        self.hash, self.kind, self.ends, self.unit = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(0, np.int64)
        self.joined: dict[int, int] = {}

    def _kind(self, core: str, low: str) -> int:
        if not core:
            return -1
        alone = core.isalpha()
        if low in NUMERALS or (not alone and core[0].isdigit() and core.translate(str.maketrans("", "", ".,")).isdigit()):
            return NUMBER
        if low in UNITS:
            return UNIT
        return TITLE if len(core) > 1 and core[0].isupper() and not core.isupper() and (alone or NAME.fullmatch(core)) else PLAIN

    def _learn(self, word: str) -> int:
        start, end = 0, len(word)
        while start < end and not word[start].isalnum():
            start += 1
        while start < end and not word[end - 1].isalnum():
            end -= 1
        core = word[start:end]
        if "0" <= core[:1] <= "9" and (joined := JOINED.fullmatch(core)) and joined[2].lower() in UNITS:
            # Two tokens: the number's, which points to the unit's.
            number, unit = self._add(joined[1], NUMBER, False), self._add(joined[2].lower(), UNIT, word[-1] in ".!?:")
            self.joined[number] = unit
            self.memo[word] = number
            return number
        low = core.lower()
        self.memo[word] = k = self._add(low, self._kind(core, low), word[-1] in ".!?:")
        return k

    def _add(self, low: str, kind: int, ends: bool) -> int:
        self.new.append((xxhash.xxh3_64_intdigest(low), kind, ends))
        return len(self.hash) + len(self.new) - 1

    def _keep(self) -> None:
        """Puts what was learned where arrays of tokens look it up."""
        if self.new:
            for name, values in zip(("hash", "kind", "ends"), zip(*self.new, strict=True), strict=True):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.array(values, old.dtype)]))
            self.unit = np.concatenate([self.unit, np.full(len(self.new), -1, np.int64)])
            self.unit[list(self.joined)] = list(self.joined.values())
            self.new, self.joined = [], {}

    def tokens(self, text: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """The hash of each word, and for each variant the hash of each template token; where they differ is a slot.

        Variant 0 leaves names as they are, variant 1 replaces those inside sentences, variant 2 every capitalised word. A variant that replaces no more than the one before is the same array.
        """
        h, variants, _ = self.batch([text])
        return h, variants

    def batch(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """``tokens`` of texts one after another, and where each begins, with the end of the last."""
        if len(self.hash) > MEMO_ENTRIES:
            self._forget()
        get, learn = self.memo.get, self._learn
        split = [text.split() for text in texts]
        first = np.concatenate([[0], np.cumsum([len(words) for words in split], dtype=np.int64)])
        words = pa.array(list(itertools.chain.from_iterable(split)), pa.string()).dictionary_encode()
        known = np.array([k if (k := get(w)) is not None else learn(w) for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()], np.int64)
        self._keep()
        at = known[words.indices.to_numpy()]
        joined = np.flatnonzero(self.unit[at] >= 0)
        if len(joined):
            at = np.insert(at, joined + 1, self.unit[at[joined]])
            first = first + np.searchsorted(joined, first)
        kind, ends = self.kind[at], self.ends[at]
        starts = np.ones(len(at), bool)
        starts[1:] = ends[:-1]
        starts[first[:-1][first[:-1] < len(at)]] = True
        if (kind < 0).any():
            real = np.flatnonzero(kind >= 0)
            at, kind, starts = at[real], kind[real], starts[real]
            first = np.searchsorted(real, first)
        h = self.hash[at]
        number, typed = kind == NUMBER, h
        if number.any():
            unit = np.zeros(len(at), bool)
            unit[1:] = (kind[1:] == UNIT) & number[:-1]
            unit[first[:-1][first[:-1] < len(at)]] = False
            typed = np.where(number, self.placeholder[NUMBER], np.where(unit, self.placeholder[UNIT], h))
        variants, title = [typed], kind == TITLE
        for names in (title & ~starts, title & starts):
            variants.append(np.where(names, self.placeholder[TITLE], variants[-1]) if names.any() else variants[-1])
        return h, variants, first


def _hashed(h: np.ndarray, at: np.ndarray | slice, n: int) -> np.ndarray:
    """Hashes of the windows that start at ``at``, ``n`` of them; a text of fewer tokens is one window."""
    wide = min(len(h), WORDS)
    total = np.full(n, wide, np.uint64)
    for k in range(wide):
        total += (h[k : k + n] if isinstance(at, slice) else h[at + k]) * _PLACE[k]
    return _mixed(total)


def _windows(h: np.ndarray) -> np.ndarray:
    return _hashed(h, slice(None), max(len(h) - WORDS + 1, 1)) if len(h) else h


def _all_windows(variants: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash) of the windows of all variants of texts one after another; a window that a variant leaves as it was is not hashed again."""
    size, n = np.diff(first), len(variants[0]) - WORDS + 1
    text = np.repeat(np.arange(len(size)), size)
    inside = text[: max(n, 0)] == text[WORDS - 1 :]  # windows that don't run over a text's end
    at, hashes = [text[: max(n, 0)][inside]], [_windows(variants[0])[inside] if n > 0 else variants[0][:0]]
    for before, after in zip(variants, variants[1:], strict=False):
        if after is not before and n > 0:
            touched, changed = np.zeros(len(after), bool), np.flatnonzero(before != after)
            for k in range(WORDS):
                touched[np.maximum(changed - k, 0)] = True
            places = np.flatnonzero(touched[:n] & inside)
            at.append(text[places])
            hashes.append(_hashed(after, places, len(places)))
    for k in np.flatnonzero((size > 0) & (size < WORDS)):  # one window each
        for v in variants:
            at.append(np.array([k]))
            hashes.append(_windows(v[first[k] : first[k + 1]]))
    return np.concatenate(at), np.concatenate(hashes)


def _item_windows(items: DataFrame) -> DataFrame:
    """(id, key, variant, h) of rows (id, key, text)."""
    kind = items.schema["id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            at, which, hashes = [], [], [np.zeros(0, np.uint64)]
            for row, text in enumerate(batch.column(2)):
                variants = canon.tokens(text.as_py() or "")[1]
                for v, typed in enumerate(variants):
                    if v == 0 or typed is not variants[v - 1]:
                        h = np.unique(_windows(typed))
                        at += [row] * len(h)
                        which += [v] * len(h)
                        hashes.append(h)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in (0, 1)), pa.array(which, pa.int32()), pa.array(np.concatenate(hashes).view(np.int64))], ["id", "key", "variant", "h"])

    return items.mapInArrow(make, f"id {kind}, key long, variant int, h long")


def _doc_windows(docs: DataFrame, keep) -> DataFrame:
    """(id, key, h) of rows (id, key, text), of all variants, as far as they pass the filter."""
    kind = docs.schema["id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, wanted = Canon(), np.frombuffer(keep.value, np.uint8)
        for batch in batches:
            size = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_numpy().cumsum()
            edges = [0, *(np.flatnonzero(np.diff(size // CHUNK)) + 1).tolist(), batch.num_rows]
            for start, end in itertools.pairwise(edges):
                part = batch.slice(start, end - start)
                at, h = _all_windows(*canon.batch([text or "" for text in part.column(2).to_pylist()])[1:])
                low = h >> np.uint64(64 - FILTER_BITS)
                passed = np.flatnonzero(wanted[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                at, h = np.unique(np.stack([at[passed].astype(np.uint64), h[passed]]), axis=1)
                rows = pa.array(at.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in (0, 1)), pa.array(h.view(np.int64))], ["id", "key", "h"])

    return docs.mapInArrow(make, f"id {kind}, key long, h long")


class _Match:
    """One item against one document, in one variant: where their windows meet, and what stands in the slots there."""

    def __init__(self, item: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray], similarity: float):
        (self.item, typed), (self.doc, theirs) = item, doc
        self.slot, self.wide = typed != self.item, min(len(typed), WORDS)
        a, b = _windows(typed), _windows(theirs)
        distinct, self.group = np.unique(a, return_inverse=True)
        near = np.minimum(np.searchsorted(distinct, b), len(distinct) - 1)
        at = np.flatnonzero(distinct[near] == b)
        order = np.argsort(near[at], kind="stable")
        self.at, self.of = at[order], near[at][order]
        self.n, self.m, self.windows = len(b), len(a), len(distinct)
        self.found = len(np.unique(self.of))
        self.need, self.least = (int(np.ceil(similarity * k - 1e-9)) for k in (self.windows, self.m))

    def best(self) -> tuple[int, str] | None:
        """(windows found, kind), of the whole document or else of one occurrence."""
        if self.found < self.need:
            return None
        if kind := self._anywhere():
            return self.found, kind
        return self._occurrence()

    def _anywhere(self) -> str | None:
        """The kind if all windows of the document taken together map each value of the item to one value, or each to itself too."""
        there: dict[tuple[int, int], set[int]] = {}
        met = np.zeros(self.windows, bool)
        met[self.of] = True
        first = np.zeros(self.windows, np.int64)
        first[self.group[::-1]] = np.arange(self.m)[::-1]
        for k in range(self.wide):
            slot = self.slot[first[self.of] + k]
            for g, value in zip(self.of[slot].tolist(), self.doc[self.at[slot] + k].tolist(), strict=True):
                there.setdefault((g, k), set()).add(value)
        became, own, same, consistent = {}, set(), set(), True
        for k in range(self.wide):
            q = np.flatnonzero(met[self.group])
            q = q[self.slot[q + k]]
            for g, value in zip(self.group[q].tolist(), self.item[q + k].tolist(), strict=True):
                values = there[g, k]
                own.add(value)
                if value in values:
                    same.add(value)
                if len(values) > 1 or became.setdefault(value, next(iter(values))) not in values:
                    consistent = False
        # Of values that each became one, no two may have become the same.
        consistent = consistent and len(set(became.values())) == len(became)
        return "verbatim" if own == same else "reparameterised" if consistent else None

    def _occurrence(self) -> tuple[int, str] | None:
        """The same for one occurrence: an item's windows on one diagonal (place in the document less place in the item), or on those next to it.

        An occurrence must hold its share of the item's windows at all their places, too. How far the diagonals may be from the first one,
        as words were put in or left out, is doubled until something is found or the whole document is taken.
        """
        bounds = np.searchsorted(self.of, np.arange(self.windows + 1))
        count = np.zeros(self.n + self.m - 1, np.int64)
        for q, g in enumerate(self.group.tolist()):
            count[self.at[bounds[g] : bounds[g + 1]] - q + self.m - 1] += 1
        total = np.concatenate([[0], np.cumsum(count)])
        places, slack, best = np.arange(len(count)), 0, None
        while best is None:
            inside = total[np.minimum(places + slack + 1, len(count))] - total[np.maximum(places - slack, 0)]
            diagonals = np.flatnonzero((count > 0) & (inside >= self.least))
            taken = np.zeros(len(count), bool)
            for d in diagonals[np.argsort(-count[diagonals], kind="stable")].tolist():
                if taken[d]:
                    continue
                taken[max(d - slack, 0) : d + slack + 1] = True
                if (got := self._kind(*self._along(d - self.m + 1, slack))) and (best is None or got[1] == "verbatim"):
                    best = got
                    if got[1] == "verbatim":
                        break
            if slack >= len(count):
                break
            slack = max(2 * slack, 1)
        return best

    def _along(self, d: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the item, in the document) of each item window and its like nearest to diagonal ``d``, ``slack`` from it at most."""
        q = np.arange(self.m)
        aim, keys = q + d, self.of * (self.n + 1) + self.at
        after = np.searchsorted(keys, self.group * (self.n + 1) + np.clip(aim, 0, self.n))
        off = []
        for k in (after - 1, after):
            inside = np.clip(k, 0, len(keys) - 1)
            good = (k >= 0) & (k < len(keys)) & (self.of[inside] == self.group)
            off.append(np.where(good, np.abs(self.at[inside] - aim), np.iinfo(np.int64).max))
        pick = np.clip(np.where(off[0] < off[1], after - 1, after), 0, len(keys) - 1)
        near = np.minimum(*off) <= slack
        return q[near], self.at[pick[near]]

    def _kind(self, q: np.ndarray, p: np.ndarray) -> tuple[int, str] | None:
        found = len(np.unique(self.group[q]))
        if len(q) < self.least or found < self.need:
            return None
        slots = [(q[s] + k, p[s] + k) for k in range(self.wide) for s in [self.slot[q + k]]]
        was, now = (np.concatenate([tokens[x[side]] for x in slots]) for side, tokens in enumerate((self.item, self.doc)))
        if (was == now).all():
            return found, "verbatim"
        pairs = np.unique(np.stack([was, now]), axis=1)
        one_to_one = len(np.unique(was)) == pairs.shape[1] == len(np.unique(now))
        return (found, "reparameterised") if one_to_one else None


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """(id, item_id, found, windows, kind, key) of those rows (id, key, item_id, text, item_text) whose slots agree; the variant with most windows."""
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("id", "item_id")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            at, found, windows, kind = [], [], [], []
            for row, (text, item) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                (words, theirs), (own, ours) = canon.tokens(text.as_py()), canon.tokens(item.as_py())
                best = None
                for v, (a, b) in enumerate(zip(ours, theirs, strict=True)):
                    if v and a is ours[v - 1] and b is theirs[v - 1]:
                        continue
                    match = _Match((own, a), (words, b), similarity)
                    if (got := match.best()) and (best is None or got[0] / match.windows > best[0] / best[1]):
                        best = (got[0], match.windows, got[1])
                if best:
                    for to, x in zip((at, found, windows, kind), (row, *best), strict=True):
                        to.append(x)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(found, pa.int64()), pa.array(windows, pa.int64()), pa.array(kind, pa.string()), batch.column(1).take(rows)],
                ["id", "item_id", "found", "windows", "kind", "key"],
            )

    return pairs.select("id", "key", "item_id", "text", "item_text").mapInArrow(make, f"id {kinds[0]}, item_id {kinds[1]}, found long, windows long, kind string, key long")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, found, windows, similarity, kind for each document and item in it; ``_key``, a hash of the text, tells rows with one id apart.

    kind: 'verbatim' if all slots hold the item's own values, else 'reparameterised'. Windows count once. An item of fewer than five tokens is
    one window. Null or blank texts on either side hold nothing. Of variants with the same share of windows the one that replaces least counts.
    Whole texts of any length are searched. Equal rows give one row. Null ids are kept. No rows on a side, none out.
    """
    spark = docs.sparkSession
    common.ship(spark)
    scratch = common.Scratch(spark, "decontaminate")
    rows = lambda df, i, t: df.select(F.col(i).alias("id"), F.xxhash64(F.col(t)).alias("key"), F.col(t).alias("text"))
    items = scratch.write(_item_windows(rows(benchmark, item_id, item_text)).distinct(), "items")
    totals = items.groupBy(F.col("id").alias("_id"), F.col("key").alias("_k"), F.col("variant").alias("_v")).agg(F.count("*").alias("windows"))
    # The filter in words of 64 bits, put together in Spark: 2 ** (FILTER_BITS - 6) rows at most.
    place = F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int")
    words = items.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63))).alias("bits")).collect()
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    for r in words:
        bits[r["w"]] = r["bits"]
    found = _doc_windows(rows(docs, doc_id, text), spark.sparkContext.broadcast(bits.tobytes())).distinct()
    same_item = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_k")) & (F.col("variant") == F.col("_v"))
    theirs = items.join(totals, same_item).select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), "variant", "h", "windows")
    if items.count() <= BROADCAST_WINDOWS:
        theirs = F.broadcast(theirs)
    # Only documents that hold enough of an item's windows, wherever they are, are compared with it place by place.
    per = found.join(theirs, "h").groupBy("id", "key", "item_id", "item_key", "variant", "windows").agg(F.count("*").alias("found"))
    enough = per.where(F.col("found") >= F.ceil(F.lit(similarity) * F.col("windows") - 1e-9))
    pairs = scratch.write(enough.select(F.col("id").alias("_id"), F.col("key").alias("_k"), "item_id", "item_key").distinct(), "pairs")
    texts = rows(benchmark, item_id, item_text).select(F.col("id").alias("_item"), F.col("key").alias("_ik"), F.col("text").alias("item_text")).distinct()
    pairs = pairs.join(texts, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_key") == F.col("_ik"))).select("_id", "_k", "item_id", "item_text")
    both = rows(docs, doc_id, text).join(pairs, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_k")))
    return _verified(both, similarity).select(
        F.col("id").alias("doc_id"), "item_id", "found", "windows", (F.col("found") / F.col("windows")).alias("similarity"), "kind", F.col("key").alias("_key")
    ).distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no item."""
    # Names that no column of the caller's has.
    bad_id, bad_key = f"_id_{uuid.uuid4().hex}", f"_key_{uuid.uuid4().hex}"
    bad = leaks(docs, benchmark, similarity, doc_id=doc_id, text=text).select(F.col("doc_id").alias(bad_id), F.col("_key").alias(bad_key)).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(F.col(bad_id)) & (F.xxhash64(docs[text]) == F.col(bad_key)), "left_anti")
