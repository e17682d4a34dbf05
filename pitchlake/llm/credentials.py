"""Secrets in texts: fixed rules, and formats learned by grammar inference.

For each credential format, a prefix tree is built from labelled examples; states whose counts are statistically compatible
(Hoeffding's bound, in all that follows them) are merged into a probabilistic automaton. As merging forgets how long the examples
were, an automaton keeps the law of their lengths beside its states, which decides where a credential ends whose alphabet holds
separators. Labelled are the public formats' examples and values that the fixed rules confirm in the documents themselves. Every
run of credential characters is then read once by all automata beside a model of ordinary text, the pairs of characters counted
over all documents: the spans of a run that the automata make likeliest against it, by enough, are its credentials. What no
example is near in length has no likelihood, so runs shorter than every example need not be read.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed rules of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "format")
#: Every access and hex span lies in one of these runs.
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: Where a credential may begin after, or end before, within a run; it may begin with what all examples of a format begin with, too.
BREAKS = frozenset("+/_=.-")

#: The log-likelihood ratio that a span needs, in all and for each character.
RATIO, RATIO_EACH = 12.0, 0.25
#: Confidence of the merging test; how many observations a character's overall share stands for at each state; probability of a
#: character that an automaton never saw.
ALPHA, SHARED, UNSEEN = 0.05, 4.0, 1e-9
#: How far a reading may fall behind before it is given up, as a log-ratio.
BEHIND = 45.0
#: Share of the length law that is even over all lengths up to twice the longest example; half width, as a share of the examples' range, that
#: an example's length stands for.
ANY_LENGTH, LENGTH_SPREAD = 0.02, 0.125
#: Confirmed values of each base kind that are learned from, at most: those of least hash; characters that they have at least.
CONFIRMED, CONFIRMED_LENGTH = 200, 16
#: Weight of fixed shares of characters beside what is counted, in the model of ordinary text: words that the documents lack are ordinary too.
PRIOR = 0.3

_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
# Fixed public formats: prefix, alphabet and lengths of the rest.
FORMATS = {
    "cloud access key": ("AKIA", _UPPER + "234567", (16, 16)),
    "code host token": ("ghp_", _LOWER + _UPPER + _DIGITS, (36, 36)),
    "chat token": ("xoxb-", _DIGITS + "-" + _LOWER + _UPPER, (40, 56)),
    "map service key": ("AIza", _LOWER + _UPPER + _DIGITS + "_-", (35, 35)),
    "payment key": ("sk_live_", _LOWER + _UPPER + _DIGITS, (24, 32)),
    "signed web token": ("eyJ", _LOWER + _UPPER + _DIGITS + "_-", (60, 120)),
    "hexadecimal key": ("", _DIGITS + "abcdef", (24, 64)),
    "base-64 secret": ("", _LOWER + _UPPER + _DIGITS + "+/", (40, 40)),
}


def labelled_credentials(each: int = 150, seed: int = 20_261) -> dict[str, list[str]]:
    """Examples of the public formats, drawn from their definitions."""
    rng = random.Random(seed)
    return {
        name: [prefix + "".join(rng.choices(alphabet, k=rng.randint(*lengths))) for _ in range(each)] for name, (prefix, alphabet, lengths) in FORMATS.items()
    }


class Automaton:
    """A probabilistic automaton inferred from strings by state merging."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.passes, self.ends, self.next = [0], [0], [{}]
        for text in examples:
            state = 0
            self.passes[0] += 1
            for c in text:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.passes)
                    self.passes.append(0)
                    self.ends.append(0)
                    self.next.append({})
                state = self.next[state][c]
                self.passes[state] += 1
            self.ends[state] += 1
        self._merge()
        seen: dict[str, int] = {}
        for text in examples:
            for c in text:
                seen[c] = seen.get(c, 0) + 1
        share = {c: n / sum(seen.values()) for c, n in seen.items()}
        #: For each state the log-probability of each character, if one follows, and the state after it.
        self.read = {}
        for s in self.kept:
            weight = self.passes[s] - self.ends[s] + SHARED
            self.read[s] = {c: (math.log((self.flow.get((s, c), 0) + SHARED * p) / weight), self.next[s].get(c, s)) for c, p in share.items()}
        self.ends_at, self.goes_on = length_law([len(x) for x in examples])

    def _merge(self) -> None:
        # How often each edge was taken; in a tree, as often as its target was passed.
        self.flow = {(s, c): self.passes[t] for s in range(len(self.next)) for c, t in self.next[s].items()}
        self.kept = [0]
        border = [(0, c) for c in sorted(self.next[0])]
        while border:
            border.sort(key=lambda e: (-self.flow[e], e))
            source, c = border.pop(0)
            new = self.next[source][c]
            if new in self.kept:
                continue
            # Of the states that could be it, that which makes what follows likeliest: few observations are compatible with many.
            into = max((s for s in self.kept if self._compatible(s, new)), key=lambda s: self._likelihood(s, new), default=None)
            if into is None:
                self.kept.append(new)
            else:
                self.next[source][c] = into
                self._fold(into, new)
            known = set(self.kept)
            border = [(s, x) for s in self.kept for x in sorted(self.next[s]) if self.next[s][x] not in known]

    def _likelihood(self, s: int, new: int) -> float:
        weight = self.passes[s] + SHARED
        ending = self.ends[new] * math.log((self.ends[s] + SHARED / 64) / weight)
        return ending + sum(self.flow[new, c] * math.log((self.flow.get((s, c), 0) + SHARED / 64) / weight) for c in self.next[new])

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, s: int, t: int) -> bool:
        todo, seen = [(s, t)], set()
        while todo:
            s, t = todo.pop()
            if (s, t) in seen or s == t:
                continue
            seen.add((s, t))
            n, m = self.passes[s], self.passes[t]
            if self._differ(self.ends[s], n, self.ends[t], m):
                return False
            for c in self.next[s].keys() | self.next[t].keys():
                if self._differ(self.flow.get((s, c), 0), n, self.flow.get((t, c), 0), m):
                    return False
                if c in self.next[s] and c in self.next[t]:
                    todo.append((self.next[s][c], self.next[t][c]))
        return True

    def _fold(self, into: int, new: int) -> None:
        """Add the tree below ``new`` to what follows ``into``."""
        todo = [(into, new)]
        while todo:
            s, t = todo.pop()
            self.passes[s] += self.passes[t]
            self.ends[s] += self.ends[t]
            for c, target in self.next[t].items():
                self.flow[s, c] = self.flow.get((s, c), 0) + self.flow[t, c]
                if c in self.next[s]:
                    todo.append((self.next[s][c], target))
                else:
                    self.next[s][c] = target


def length_law(lengths: list[int]) -> tuple[list[float], list[float]]:
    """(log-probability of ending at each length, of going on from there), from 0 to twice the longest; each given that it was reached."""
    longest = 2 * max(lengths)
    half = math.ceil((max(lengths) - min(lengths)) * LENGTH_SPREAD)
    law = [0.0] + [ANY_LENGTH / longest] * longest
    for n in lengths:
        near = range(max(1, n - half), n + half + 1)
        for k in near:
            law[k] += (1 - ANY_LENGTH) / len(lengths) / len(near)
    left, ends_at, goes_on = sum(law), [], []
    for p in law:
        ends_at.append(math.log(p / left) if p else -math.inf)
        left -= p
        goes_on.append(math.log(left / (left + p)) if left > 1e-12 else -math.inf)
    return ends_at, goes_on


CHARACTERS = _LOWER + _UPPER + _DIGITS + "+/_=.-"
#: 0: what is no character of a run.
_CLASS = np.zeros(256, np.uint8)
_CLASS[np.frombuffer(CHARACTERS.encode(), np.uint8)] = np.arange(1, len(CHARACTERS) + 1)
_KINDS_OF_PAIR = len(CHARACTERS) + 1


def pair_counts(docs: DataFrame, text: str, longest: int) -> np.ndarray:
    """How often each credential character follows each other, or none, in the runs of up to ``longest`` characters of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_KINDS_OF_PAIR**2, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if not (t := t.as_py()):
                    continue
                c = _CLASS[np.frombuffer(f" {t} ".encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int32)
                gaps = np.flatnonzero(c == 0)
                long = np.flatnonzero(np.diff(gaps) > longest + 1)
                pairs = c[:-1] * _KINDS_OF_PAIR + c[1:]
                total += np.bincount(pairs, minlength=len(total))
                for k in long:  # such runs are candidates, not ordinary text
                    total -= np.bincount(pairs[gaps[k] : gaps[k + 1]], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["pair", "n"])

    out = np.zeros(_KINDS_OF_PAIR**2, np.int64)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # a row a pair of characters
        out[r["pair"]] = r["n"]
    return out.reshape(_KINDS_OF_PAIR, _KINDS_OF_PAIR)


def _ordinary(counts: np.ndarray | None) -> dict[str, dict[str, float]]:
    """Log-probability of each character after another, or after none (""), in ordinary runs: as counted, with fixed shares as the prior; digits follow digits."""
    usual, number = {_LOWER: 0.75, _UPPER: 0.1, _DIGITS: 0.07, "+/_=.-": 0.08}, {_LOWER: 0.08, _UPPER: 0.02, _DIGITS: 0.75, "+/_=.-": 0.15}
    counts = np.zeros((_KINDS_OF_PAIR, _KINDS_OF_PAIR)) if counts is None else counts
    out = {}
    for before in ("", *CHARACTERS):
        row = counts[CHARACTERS.index(before) + 1 if before else 0, 1:]
        total = row.sum()
        known = (1 - PRIOR) / total if total else 0.0
        prior = {c: share / len(chars) for chars, share in (number if before and before in _DIGITS else usual).items() for c in chars}
        out[before] = {c: math.log(row[k] * known + (PRIOR if total else 1.0) * prior[c]) for k, c in enumerate(CHARACTERS)}
    return out


class Formats:
    """The automata of all formats, and the model of ordinary text that they are held against."""

    def __init__(self, labelled: dict[str, list[str]], counts: np.ndarray | None = None):
        examples = [list(v) for _, v in sorted(labelled.items()) if v]
        self.automata = [Automaton(v) for v in examples]
        self.ordinary = _ordinary(counts)
        #: Runs that may hold a candidate: none is shorter than every example.
        self.shortest = min((len(x) for v in examples for x in v), default=0)
        self.run = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % max(self.shortest, 1))
        #: Characters that a credential may begin with in the midst of a run, where no separator is before them.
        self.prefixes = tuple(sorted({p for v in examples if len(p := _common_prefix(v)) >= 3}))

    def spans(self, run: str) -> list[tuple[int, int, float]]:
        """(start, end, log-ratio) of the spans of a run that together are likeliest to be credentials.

        One reading: at each place, each state of an automaton keeps the beginnings that are not far behind, as how a credential ends goes by
        where it began. A span must win ``RATIO`` and ``RATIO_EACH`` for each character, so that those chosen are the ones of the largest total.
        """
        best, back = [0.0], [None]  # of what lies before each place: the total won, the last span
        readings: dict[tuple[int, int, int], float] = {}
        unseen, found = math.log(UNSEEN), []
        for at, c in enumerate(run):
            if not at or run[at - 1] in BREAKS or (c not in BREAKS and run.startswith(self.prefixes, at)):
                for k in range(len(self.automata)):
                    readings[k, 0, at] = best[-1] - RATIO
            cost = self.ordinary[run[at - 1] if at and run[at - 1] in self.ordinary else ""][c] + RATIO_EACH
            moved: dict[tuple[int, int, int], float] = {}
            least = best[-1] - RATIO - BEHIND
            for (k, state, begun), won in readings.items():
                automaton = self.automata[k]
                if at - begun >= len(automaton.goes_on):
                    continue
                log, to = automaton.read[state].get(c) or (unseen, state)
                won += log + automaton.goes_on[at - begun] - cost
                if won >= least and won > moved.get((k, to, begun), -math.inf):
                    moved[k, to, begun] = won
            readings = moved
            total, last = best[-1], None
            if readings and (at + 1 == len(run) or run[at + 1] in BREAKS or run.startswith(self.prefixes, at + 1)):
                for (k, _, begun), won in readings.items():
                    ends_at = self.automata[k].ends_at
                    if at + 1 - begun < len(ends_at) and won + ends_at[at + 1 - begun] > total:
                        total, last = won + ends_at[at + 1 - begun], begun
            best.append(total)
            back.append(last)
        at = len(run)
        while at > 0:
            if (begun := back[at]) is None:
                at -= 1
            else:
                found.append((begun, at, best[at] - best[begun] + RATIO + RATIO_EACH * (at - begun)))
                at = begun
        return found[::-1]


def _common_prefix(examples: list[str]) -> str:
    low, high = min(examples), max(examples)
    return low[: next((k for k, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))]


@lru_cache(maxsize=2)
def _formats(labelled: tuple, counts: bytes | None) -> Formats:
    table = None if counts is None else np.frombuffer(counts, np.int64).reshape(_KINDS_OF_PAIR, _KINDS_OF_PAIR)
    return Formats({name: list(examples) for name, examples in labelled}, table)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the fixed rules."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for run in RUN.finditer(text):
        at, part = run.start(), run[0]
        if "AKIA" in part:
            found += [("access", at + m.start(), at + m.end(), m[0]) for m in ACCESS.finditer(part) if len(m[0]) >= 16]
        if len(part) >= 32:
            found += [("hex", at + m.start(), at + m.end(), m[0]) for m in HEX.finditer(part) if len(m[0]) >= 32]
    return found


def spans(text: str, formats: Formats) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by start, then kind as in KINDS; base kinds score 1. All runs are read whole, so a format span may lie in a base one or reach over it."""
    found = [(kind, s, e, 1.0) for kind, s, e, _ in base_spans(text)]
    if formats.automata:
        found += [("format", run.start() + a, run.start() + b, score) for run in formats.run.finditer(text) for a, b, score in formats.spans(run[0])]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return found


def confirmed_credentials(docs: DataFrame, each: int = CONFIRMED, least: int = CONFIRMED_LENGTH, *, text: str = "text") -> dict[str, list[str]]:
    """Values that the fixed rules confirm in the documents, by kind: at most ``each`` of a kind, those of least hash, of ``least`` characters and more."""
    common.ship(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = sorted({(kind, value) for t in batch.column(0) for kind, _, _, value in base_spans(t.as_py() or "")})
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["kind", "value"])

    # A value is a label by the rule that names it, not by its shape alone.
    values = docs.select(F.col(text).alias("text")).mapInArrow(find, "kind string, value string").where(F.length("value") >= least).distinct()
    chosen = [values.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(each) for k in BASE]
    out: dict[str, list[str]] = {}
    for r in chosen[0].union(chosen[1]).union(chosen[2]).collect():  # ``each`` of a kind at most
        out.setdefault(f"confirmed {r['kind']}", []).append(r["value"])
    return out


def find_secrets(docs: DataFrame, labelled: dict[str, list[str]] | None = None, each: int = CONFIRMED, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, end exclusive, score) for each row.

    ``labelled``: credentials by format to learn from (bounded: it is sent to every task); by default the public formats, and what
    the fixed rules confirm in ``docs``, ``each`` of a kind at most. Null and empty texts have no spans; texts and runs of any length are read whole; null ids and
    repeated rows are kept. Other columns are ignored.
    """
    common.ship(docs.sparkSession)
    if labelled is None:
        labelled = labelled_credentials() | confirmed_credentials(docs, each, text=text)
    examples = tuple((k, tuple(sorted(v))) for k, v in sorted(labelled.items()) if v)
    shortest = min((len(x) for _, v in examples for x in v), default=0)
    counts = pair_counts(docs, text, max(shortest - 1, 0)).tobytes()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = _formats(examples, counts)
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t.as_py() or "", formats)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, out)], ["doc_id", "spans"])

    return rows.mapInArrow(find, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int, score: double>>")


def digests(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as one string, from (doc_id, spans)."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
