import pytest
from pyspark.sql import functions as F
from test_jaccard import brute

import corpus_pipeline
from karst.llm.decontaminate import contamination, decontaminate, words_of
from karst.llm.quality import quality

SF = "/root/testdata/sf0.001"
ODD = [(0, None, "en", "a", 0), (1, "", None, None, 0), (2, " \n", "en", None, None), (None, "word " * 40, "en", "a", 200), (3, "x" * 50000, "xx", "b", 1), (3, "x" * 50000, "xx", "b", 1)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns_and_effects(steps):
    docs = steps[0]
    for s in steps[1:-1]:
        assert s.columns == docs.columns and s.dtypes == docs.dtypes
    counts = [s.count() for s in steps]
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0 and counts[5] > 0


def test_near_duplicates_equal_brute_force(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].select("doc_id", "text").collect()]
    want = sorted(d for d, _, c in brute(rows, 5, 80) if d == c)
    assert sorted(r.doc_id for r in steps[2].select("doc_id").collect()) == want


def test_clean_documents_stay(spark, steps):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_of(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [words_of(t)] for i in range(len(w) - 9))
    want = {r.doc_id for r in steps[2].collect() if not hit(r.text)}
    assert {r.doc_id for r in steps[3].collect()} == want
    assert len(want) < steps[2].count()


def test_personal_data_is_gone_and_all_is_packed(steps):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in steps[3:5])
    changed = [d for d in before if before[d] != after[d]]
    assert changed and all("@" in before[d] or any(c.isdigit() for c in before[d]) for d in changed)
    assert not any("@mail" in t for t in after.values())
    assert {r.doc_id for r in steps[5].select("doc_id").distinct().collect()} == set(after)


def test_odd_and_empty_inputs(spark):
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            docs_out = stage(spark, docs, SF)
            assert docs_out.count() <= max(1, 200 * len(rows))
    assert {r.kept for r in quality(spark.createDataFrame(ODD, DOCS)).collect()} == {False}


def test_extra_columns_keep_their_values(spark):
    names = ["n_words", "kept", "pii", "_kept", "item", "hit_runs", "_cases", "low"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_blocks_of_a_large_benchmark_give_the_same(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "of the"), (901, None), (902, "")], items.schema)
    items = items.union(extra)
    key = lambda df: sorted((r.doc_id, r.n_words, tuple(r.hit_runs), tuple(r.item_ids), r.full_window) for r in df.collect())
    one, many = contamination(docs, items), contamination(docs, items, block_bytes=3000)
    assert key(one) == key(many)
    texts = {r.doc_id: r.text for r in docs.collect()}
    cut = {r.doc_id: r.text for r in decontaminate(docs, items, remove="spans").collect()}
    assert set(cut) == set(texts) and any(cut[d] != texts[d] for d in cut)
    again = contamination(decontaminate(docs, items.where("item_id < 900"), remove="spans"), items.where("item_id < 900"))
    assert again.where("full_window").count() <= 2
