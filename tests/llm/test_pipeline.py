"""The corpus pipeline, stage by stage, against what each stage's operator should leave."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests_llm_brute import brute_cut, brute_hits, brute_links

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame((df := stage(spark, out[-1], SF)).collect(), df.schema))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_run(spark, stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect())) == sorted(map(tuple, stages[-1].select("doc_id", "doc_tokens").distinct().collect()))


def test_clean_documents_stay(stages):
    assert stages[1].count() == stages[0].count()  # all sample texts are in a language


def test_one_of_each_class_stays(stages):
    ids, values = zip(*sorted(texts(stages[1]).items()), strict=True)
    classes = brute_links(list(values))
    assert set(texts(stages[2])) == {ids[c] for c, _, _ in classes.values()}


def test_repeats_are_cut(stages):
    before, after = texts(stages[2]), texts(stages[3])
    for i, (n, gone, _) in brute_cut(sorted(before.items()), 50).items():
        assert (i not in after) == (gone > 0 and gone == n)
        if i in after:
            assert len(after[i].split()) == n - gone and (gone > 0 or after[i] == before[i])


def test_contaminated_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = texts(stages[3])
    want = {i for i, h in zip(before, brute_hits(before.values(), items), strict=True) if not h[4]}
    assert set(texts(stages[4])) == want


def test_all_that_is_left_is_packed(stages):
    tokens = collections.Counter()
    size = {}
    for p in stages[5].collect():
        tokens[p["doc_id"]] += p["length"]
        size[p["doc_id"]] = p["doc_tokens"]
    assert set(tokens) == set(texts(stages[4])) and dict(tokens) == size


def test_odd_rows(spark, folder):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the and of " * 30, "en", None, 1), (3, "the and of " * 30, "en", "s", 1), (3, "the and of " * 30, "en", "s", 1), (4, "x" * 5000, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(i) for i, c in enumerate(("hits", "Score", "kept", "node", "key", "copy", "n_words", "_gone", "a.b"))})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r["Score"] == 1 and r["a.b"] == 8 for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert sorted(r["doc_id"] for r in rows) == [3, 4]
