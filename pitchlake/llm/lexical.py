"""Ranked lexical search by Block-Max WAND over an index of written tables.

Documents are dealt into shards of bounded text. A shard's index has a row a term: postings in blocks of fixed size, gaps and counts in as
many bits as the block needs, and beside them each block's first and last document and its highest impact. Impacts depend on the
number and mean length of all documents, which are counted first; a term's weight comes in when the index is asked.

A search moves shallow pointers over the blocks of all terms of an item: between two ends of blocks, of whichever term, the
sum of the blocks' highest impacts bounds every document's score. Stretches whose bound is below the lowest score of the best so far are
skipped without decompressing a block; those above are decompressed and scored. The stretches of the highest bounds go first, so that the
threshold is high from the start; then the rest in order of documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .words import Ids, word_counts, words

#: Postings of a block; the best documents of an item that are wanted.
BLOCK, TOP = 128, 20
#: Bytes of text and documents of a shard, unless one document has more.
SHARD_BYTES, SHARD_DOCUMENTS = 16 << 20, 1 << 16
#: Bytes of items' texts that are searched for at a time; an item that has more is searched for alone.
ITEM_BYTES = 4 << 20
#: Stretches decompressed before the threshold is looked at again.
STRETCHES = 32


def pack_blocks(starts: np.ndarray, gaps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each block begins, bytes): each block's widths in bits, then its gaps, then its counts less one. ``starts``: of blocks among the postings."""
    n = len(gaps)
    sizes = np.diff(np.append(starts, n))
    widths = [np.frexp(np.maximum.reduceat(x, starts).astype(np.float64))[1].astype(np.int64) if n else np.empty(0, np.int64) for x in (gaps, counts - 1)]
    lengths = [(sizes * w + 7) // 8 for w in widths]
    at = np.concatenate([[0], np.cumsum(2 + lengths[0] + lengths[1])])
    bits = np.zeros(int(at[-1]) * 8, np.uint8)
    inside = np.arange(n) - np.repeat(starts, sizes)
    for values, width, begin in ((gaps, widths[0], at[:-1] + 2), (counts - 1, widths[1], at[:-1] + 2 + lengths[0])):
        mine = np.repeat(width, sizes)
        place = np.repeat(begin * 8, sizes) + inside * mine
        for k in range(int(width.max(initial=0))):
            wide = mine > k
            bits[place[wide] + k] = (values[wide] >> k) & 1
    out = np.packbits(bits, bitorder="little")
    out[at[:-1]], out[at[:-1] + 1] = widths[0], widths[1]
    return at, out


def unpack_block(data: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, counts) of a block of ``n`` postings from document ``first`` on."""
    a, b = int(data[0]), int(data[1])
    split = 2 + (n * a + 7) // 8

    def numbers(part: np.ndarray, width: int) -> np.ndarray:
        if not width:
            return np.zeros(n, np.int64)
        return np.unpackbits(part, bitorder="little")[: n * width].reshape(n, width).astype(np.int64) @ (1 << np.arange(width))

    return first + np.cumsum(numbers(data[2:split], a)), numbers(data[split:], b) + 1


def impact(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1_000 * counts + 12 * m)


_POSTINGS = {"term": pa.string(), "df": pa.int64(), "first": pa.list_(pa.int32()), "last": pa.list_(pa.int32()), "peak": pa.list_(pa.int64()), "at": pa.list_(pa.int32()), "data": pa.binary()}
_POSTINGS_SQL = "term string, df long, first array<int>, last array<int>, peak array<long>, at array<int>, data binary"


def _shard_rows(shard: int, ids: pa.Array, vocabulary: Ids, texts: list[np.ndarray], all_documents: int, all_terms: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The index of one shard of texts (as numbers of words): a row with its documents' ids and length terms, and a row a term."""
    parts = [np.unique(t, return_counts=True) for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    m = 75 + (25 * sizes * all_documents) // max(all_terms, 1)
    term = np.concatenate([p[0] for p in parts]).astype(np.int64)
    count = np.concatenate([p[1] for p in parts]).astype(np.int64)
    doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(term, kind="stable")
    term, count, doc = term[order], count[order], doc[order]
    n = len(vocabulary)
    df = np.bincount(term, minlength=n)
    of_term = np.cumsum(df) - df
    inside = np.arange(len(term)) - of_term[term]
    starts = np.flatnonzero(inside % BLOCK == 0)
    ends = np.append(starts[1:], len(term)) - 1
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = 0
    at, data = pack_blocks(starts, gaps, count)
    peak = np.maximum.reduceat(impact(count, m[doc]), starts) if len(term) else np.empty(0, np.int64)
    blocks = -(-df // BLOCK)
    edge = np.concatenate([[0], np.cumsum(blocks)])  # of terms among the blocks
    lists = lambda values: pa.ListArray.from_arrays(pa.array(edge, pa.int32()), values)
    own = pa.array(np.concatenate([at[s:e] - at[s] for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]) if n else [], pa.int32())
    payload = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at[edge].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    columns = [pa.array([w.decode("utf-8", "surrogatepass") for w in vocabulary], pa.string()), pa.array(df, pa.int64()), lists(pa.array(doc[starts], pa.int32())), lists(pa.array(doc[ends], pa.int32())), lists(pa.array(peak, pa.int64())), lists(own), payload]
    names = ["shard", *_POSTINGS, "ids", "m"]
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int64()), *(pa.nulls(1, t) for t in _POSTINGS.values()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), pa.array(m))], names
    )
    for s in range(0, n, 8_192):
        e = min(n, s + 8_192)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(e - s, shard), pa.int64()), *(c.slice(s, e - s) for c in columns), pa.nulls(e - s, pa.list_(kind)), pa.nulls(e - s, pa.list_(pa.int64()))], names)


class Index:
    """The written index of a collection: ``rows`` (a row a shard and term, and one a shard with its documents), and how many documents have terms."""

    def __init__(self, rows: DataFrame, documents: int):
        self.rows, self.documents = rows, documents


def build(docs: DataFrame, scratch: common.Scratch, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every row of ``docs``. Null and empty texts have no terms and are never found."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("octet_length(text) > 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = word_counts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["documents", "terms"])

    counted = rows.select("text").mapInArrow(count, "documents long, terms long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    all_documents, all_terms = counted
    kind = rows.schema["doc_id"].dataType

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts, size, id_kind, vocabulary = TaskContext.get().partitionId() << 32, [], [], 0, pa.null(), Ids()
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py()
                if texts and (size + len(t) > shard_bytes or len(texts) == SHARD_DOCUMENTS):
                    yield from _shard_rows(shard, pa.array(ids, id_kind), vocabulary, texts, all_documents, all_terms, id_kind)
                    shard, ids, texts, size, vocabulary = shard + 1, [], [], 0, Ids()
                ids.append(i.as_py())
                texts.append(vocabulary.of(words(t)))
                size += len(t)
        if texts:
            yield from _shard_rows(shard, pa.array(ids, id_kind), vocabulary, texts, all_documents, all_terms, id_kind)

    made = rows.mapInArrow(index, f"shard long, {_POSTINGS_SQL}, ids array<{kind.simpleString()}>, m array<long>")
    return Index(scratch.write(made, "index"), all_documents)


class Postings:
    """A term's blocks in a shard; those that were decompressed are kept for the next item that has the term."""

    def __init__(self, row: dict):
        self.df, self.held = row["df"], {}
        self.first, self.last, self.at, self.peak = (np.asarray(row[k]) for k in ("first", "last", "at", "peak"))
        self.data = np.frombuffer(row["data"], np.uint8)

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.held:
            self.held[k] = unpack_block(self.data[self.at[k] :], int(self.first[k]), min(BLOCK, self.df - k * BLOCK))
        return self.held[k]


def best_documents(lists: list[tuple[Postings, int]], m: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard for terms of these weights: the ``top`` highest scores above 0, and all that tie with the last of them."""
    none = np.empty(0, np.int64)
    if not lists:
        return none, none
    ends = np.unique(np.concatenate([x.last for x, _ in lists]))
    bound, held = np.zeros(len(ends), np.int64), []
    begin = np.concatenate([[-1], ends[:-1]]) + 1
    for x, weight in lists:  # the shallow pointers: the block of each term that each stretch lies in, if any
        k = np.minimum(np.searchsorted(x.last, ends), len(x.last) - 1)
        k = np.where((x.first[k] <= ends) & (x.last[k] >= begin), k, -1)
        bound += np.where(k >= 0, x.peak[k] * weight, 0)
        held.append(k)
    score = np.zeros(len(m), np.int64)
    documents, scores, least = none, none, 1

    def take(chosen: np.ndarray) -> None:
        nonlocal documents, scores, least
        wanted = np.zeros(len(ends), bool)
        wanted[chosen] = True
        touched = []
        for (x, weight), k in zip(lists, held, strict=True):
            blocks = np.unique(k[chosen])
            for b in blocks[blocks >= 0].tolist():
                d, c = x.block(b)
                mine = wanted[np.searchsorted(ends, d)]
                d, c = d[mine], c[mine]
                score[d] += weight * impact(c, m[d])
                touched.append(d)
        found = np.unique(np.concatenate(touched)) if touched else none
        documents = np.concatenate([documents, found])
        scores = np.concatenate([scores, score[found]])
        if len(scores) > top:
            least = max(least, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
        keep = scores >= least
        documents, scores = documents[keep], scores[keep]

    first = np.argsort(-bound, kind="stable")[:STRETCHES]
    take(np.sort(first))
    left = np.setdiff1d(np.arange(len(ends)), first)
    while len(left):
        left = left[bound[left] >= least]
        take(left[:STRETCHES]) if len(left) else None
        left = left[STRETCHES:]
    return documents, scores


def _of_items(spark: SparkSession, index: Index, items: list[tuple[int, list[str]]], top: int, kind: str) -> DataFrame:
    """(q, doc_id, score): the best of each shard for ``items`` (number, terms), whose texts have a bounded size."""
    wanted = sorted({t for _, terms in items for t in terms})
    asked = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term string"))  # bounded as the items are
    postings = index.rows.where("term IS NOT NULL").join(asked, "term")
    df = postings.groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a term of the items
    weight = {r["term"]: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * r["df"] + 1))) for r in df}
    weighted = [(q, [(t, weight[t] * n) for t, n in sorted(Counter(terms).items()) if weight.get(t, 0) > 0]) for q, terms in items]

    def search(batch: pa.Table) -> pa.Table:
        rows = {r["term"]: r for r in batch.to_pylist()}
        of_shard = rows.pop(None)
        lists = {t: Postings(r) for t, r in rows.items()}
        m, out = np.asarray(of_shard["m"], np.int64), []
        for q, terms in weighted:
            d, s = best_documents([(lists[t], w) for t, w in terms if t in lists], m, top)
            found = sorted(((-int(x), of_shard["ids"][k] is None, of_shard["ids"][k]) for k, x in zip(d.tolist(), s.tolist(), strict=True)), key=lambda r: r[:2] if r[1] else r)
            out += [(q, i, -x) for x, _, i in found[:top]]
        ids = batch.schema.field("ids").type.value_type
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), ids, pa.int64()))], names=["q", "doc_id", "score"])

    shards = postings.unionByName(index.rows.where("term IS NULL"))
    best = shards.groupBy("shard").applyInArrow(search, f"q long, doc_id {kind}, score long")
    # A shard's best first meet those of some others, so that no task gets those of all shards of a large collection.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    return _first(_first(best.withColumn("_part", part), ["q", "_part"], top).drop("_part", "rank"), ["q"], top)


def _first(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of the highest scores above 0 for each row of ``items``, ties to the smaller id (null ids last).

    Null or empty texts find nothing and are never found. Rows of ``items`` that share an id are each ranked by themselves; rows of ``docs`` that share
    one are documents each. Items are searched for in blocks of ``item_bytes`` of text, over the one index. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "lexical")
    index = build(docs, scratch, doc_id=doc_id, text=text, shard_bytes=shard_bytes)
    kind = docs.schema[doc_id].dataType.simpleString()
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).withColumn("q", F.monotonically_increasing_id())
    asked = scratch.write(asked.where("octet_length(text) > 0").withColumn("size", F.octet_length("text").cast("long")), "items")
    out = None
    for block in _blocks(asked, item_bytes):
        held = [(r["q"], [w.decode("utf-8", "surrogatepass") for w in words(r["text"])]) for r in asked.where(F.col("q").between(*block)).select("q", "text").collect()]  # of bounded size
        if any(terms for _, terms in held):
            found = _of_items(spark, index, held, top, kind)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"q long, doc_id {kind}, score long, rank int")
    return out.join(asked.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _blocks(asked: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of q that hold up to ``most`` bytes of text each, or one item."""
    out, size = [], 0
    for r in asked.select("q", "size").orderBy("q").toLocalIterator():  # two numbers an item, one partition at a time
        if out and size + r["size"] <= most:
            out[-1] = (out[-1][0], r["q"])
            size += r["size"]
        else:
            out.append((r["q"], r["q"]))
            size = r["size"]
    return out


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: For ids of documents and items that are not repeated.
ORACLE_SQL = f"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM documents),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM benchmark) GROUP BY ALL),
postings AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS documents, sum(n)::BIGINT AS terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, whole GROUP BY term, documents),
m AS (SELECT doc_id, 75 + (25 * n * documents) // terms AS m FROM lengths, whole),
scored AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= {TOP}
"""
