"""The stages one by one against what each should have kept, and all together."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import brute_components, brute_pii, word_shingles
from tokenizers import Tokenizer

import corpus_pipeline as P
from pitchlake.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, kept):
    docs, good, single, clean, private, packed = kept
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert all(d.columns == list(P.COLUMNS) for d in kept[1:5])
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= P.QUALITY}
    sets = {r.doc_id: word_shingles(r.text) for r in good.collect()}
    label = brute_components(sets, 80)
    assert {r.doc_id for r in single.collect()} == {i for i in sets if label[i] == i}
    leaks = {r.doc_id for r in decontaminate.leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaks
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in private.collect():
        assert not brute_pii(r.text) and r.n_chars == len(r.text) and (r.text == before[r.doc_id]) == (not brute_pii(before[r.doc_id]))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in private.collect()}
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want


def test_run_is_the_stages(spark, kept):
    assert sorted(P.run(spark, SF).select("doc_id", "start", "ids_crc32").collect()) == sorted(kept[-1].select("doc_id", "start", "ids_crc32").collect())
    assert P.ORACLE_SQL is None


ODD = [
    (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \n\t ", None, None, 4), (4, "short", "en", "s", 5), (4, "short", "en", "s", 5), (5, "one two three four five six seven", "de", "s", 33),
    (6, "one two three four five six seven", "de", "s", 33), (7, "x" * 30_000, "en", "s", 30_000), (8, "the cat sat on the mat " * 2_000, "en", "s", 46_000), (None, "nobody's own text", "en", "s", 17), (9, "mail a@b.cc now", "en", "s", 15),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("stage", [n for n, _ in P.STAGES])
def test_stages_on_odd_tables(spark, stage):
    """Nulls in every column, empty and very long texts, repeated rows, further columns of any name, no rows."""
    f = dict(P.STAGES)[stage]
    df = spark.createDataFrame(ODD, DOCS)
    clash = df.withColumns({c: F.lit(7) for c in ("a", "b", "n", "h", "key", "kind", "first", "component_id", "_id", "_key", "_h", "_found", "_spans", "_score", "_s", "_turn", "shard", "label", "start", "filter", "id", "v")})
    for one in (df, clash):
        got = f(spark, one, SF).collect()
        if stage == "packing":
            assert sum(r.length for r in got if r.start == 0) > 0 and {r.doc_id for r in got} == {r[0] for r in ODD}
            continue
        assert list(got[0].asDict()) == list(P.COLUMNS)
        ids = sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
        if stage == "near_duplicates":
            assert ids == [None, 1, 2, 3, 4, 5, 7, 8, 9]
        elif stage != "quality":
            assert ids == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
        if stage == "personal_data":
            assert {r.doc_id: r.text for r in got}[9] == "mail [EMAIL] now"
    assert f(spark, spark.createDataFrame([], DOCS), SF).count() == 0


def test_entry_registers_all():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
