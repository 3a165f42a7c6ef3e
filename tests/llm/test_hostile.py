"""The same hostile rows through every operator and every stage: very long texts of one kind, nulls, repeated ids and rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from karst.llm.alignment import alignment
from karst.llm.conversations import damage, repair, repaired_turns
from karst.llm.decontaminate import contamination, decontaminate
from karst.llm.html_extract import main_text
from karst.llm.jaccard_join import jaccard_components, keep_one
from karst.llm.lm_score import score
from karst.llm.minhash_dedup import keep_first, near_duplicates
from karst.llm.packing import pack
from karst.llm.paragraph_dedup import remove_repeats, repeated_paragraphs, repeated_passages
from karst.llm.pii import personal_data, redact
from karst.llm.quality import keep_good, quality
from karst.llm.token_counts import token_counts
from karst.llm.warc import archive_pages, read_pages

N = 1_000_000
LONG = {"blanks": " " * N, "lines": "\n" * N, "letters": "a" * N, "digits": "7" * N, "dots": "." * N, "numbers": " ".join(str(i) for i in range(N // 8)), "words": "word " * (N // 5), "tags": "<div>" * (N // 10), "quotes": "'\"" * (N // 2), "wide": "\U0001f600é" * (N // 8)}
#: Names that operators use inside or give their results.
CLASHING = "n_words hit_runs item_ids full_window kept low high bucket _n_upper _words _lines item n_shingles component_id _key _alone _row block ids n words seq spots rank start length ids_crc32 _part _at _ids tokens content_digest _text pii _cases _found _email removed class_id background_loss target n_tokens _digest".split()
COLUMNS = ["doc_id", "text", "source", "lang", *CLASHING]


def rows():
    out = [(i, t, "hot", "en") for i, t in enumerate(LONG.values())]
    para = " ".join(f"w{i}" for i in range(70))
    out += [(100, None, None, None), (101, "", "hot", ""), (None, para, "b", "en"), (None, "other " + para, "b", "en"), (7, para + " x", None, "en"), (7, "seven differs", "b", None), (102, para, "hot", "en"), (102, para, "hot", "en")]
    return [(*r, *["z"] * len(CLASHING)) for r in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hostile") / "documents.parquet")
    spark.createDataFrame(rows(), ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in COLUMNS)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())


ALL = sorted(-1 if r[0] is None else r[0] for r in rows())


def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (None, None), (2, "")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(7, 1, 0), (None, 1, 0), (102, 0, 1)], "doc_id long, quality int, toxic int")


#: Operators that give a row for each row of their input.
EACH = {
    "op1": lambda s, d: contamination(d, benchmark(s)),
    "op3": lambda s, d: quality(d),
    "op5": lambda s, d: jaccard_components(d),
    "op7": lambda s, d: score(d, labels(s)),
    "op8": lambda s, d: token_counts(d),
    "op9": lambda s, d: remove_repeats(d),
    "op10": lambda s, d: personal_data(d),
    "op12": lambda s, d: near_duplicates(d),
    "op13": lambda s, d: alignment(d)[0],
    "redact": lambda s, d: redact(d),
    "spans": lambda s, d: decontaminate(d, benchmark(s), remove="spans"),
}


@pytest.mark.parametrize("name", sorted(EACH))
def test_a_row_for_each(spark, docs, name):
    assert ids(EACH[name](spark, docs)) == ALL
    assert EACH[name](spark, docs.limit(0)).count() == 0


def test_what_goes_and_what_stays(spark, docs):
    for keep in (keep_good, keep_one, keep_first, lambda d: decontaminate(d, benchmark(spark))):
        kept = keep(docs)
        assert kept.columns == COLUMNS and set(ids(kept)) <= set(ALL) and keep(docs.limit(0)).count() == 0
    one = keep_one(docs).where("text LIKE '%w0 w1%'").collect()
    assert len(one) == 1 and one[0].doc_id == 7  # of equal and nearly equal texts one, with the smallest id
    assert decontaminate(docs, benchmark(spark)).where("text LIKE '%w0 w1%'").count() == 0
    found = repeated_passages(docs).where("n_words >= 69 AND NOT doc_id <=> 6").collect()
    assert len(found) == 5 and sum(not r.removed for r in found) == 1
    assert repeated_paragraphs(docs.limit(0)).count() == 0 and repeated_paragraphs(docs).where("paragraph = 0 AND n_words BETWEEN 70 AND 71").count() == 5


def test_conversations(spark, docs):
    """One hot conversation of all rows, of null turns and texts of a million characters; and one a row."""
    named = docs.withColumns({"conv_id": F.lit("all"), "turn": F.col("doc_id"), "role": F.col("source")})
    rows = docs.count()
    one = repair(named).collect()
    assert len(one) == 1 and one[0].blank + one[0].duplicate + one[0].truncated <= rows and one[0].cost > 0
    each = named.drop("conv_id").withColumn("conv_id", F.monotonically_increasing_id())
    assert repair(each).count() == rows and repair(damage(each), ids=each).count() == rows
    assert repair(named.limit(0)).count() == 0 and repaired_turns(named).where("edit = 'K' AND text IS NULL").count() == 0


def test_packing_is_whole(spark, docs):
    tokens = token_counts(docs).agg(F.sum(F.col("n_tokens") + 1)).first()[0]
    pieces = pack(docs, mixture="equal").cache()
    assert pieces.agg(F.sum("length")).first()[0] == tokens and set(ids(pieces)) == set(ALL)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_pages(spark, docs, tmp_path):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "block", "n")
    texts = {r.page_id: r.text for r in main_text(pages).collect()}
    assert set(texts) == {r[0] for r in rows()} and texts[0] == "" and texts[100] == ""
    archive_pages(pages, str(tmp_path / "warc"))
    back = read_pages(spark, str(tmp_path / "warc"))
    assert sorted(-1 if r.page_id is None else r.page_id for r in back.collect()) == ALL


def test_every_stage(spark, docs, tmp_path):
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name != "packing":
            assert out.columns == COLUMNS, name
            out.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
        assert set(ids(out)) <= set(ALL)
