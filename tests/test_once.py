"""Values that many places use are computed once, and what one task reads is bounded."""

from pyspark.sql import functions as F

from karst import evaluation
from karst.functions import citations, text
from karst.operators import planning


def plans(df):
    q = df._jdf.queryExecution()
    return q.optimizedPlan().toString(), q.executedPlan().toString()


def test_citations_are_looked_for_once(spark):
    rows = spark.range(3).select(F.concat(F.lit("نص [المادة "), F.col("id").cast("string"), F.lit("]")).alias("a"), F.array(F.col("id").cast("int")).alias("s"), F.array(F.lit(1), F.lit(2)).alias("ok"))
    state = rows.withColumn("state", citations.citation_state(F.col("a"), F.col("s"), F.col("ok"))).select(*[F.col("state")[c].alias(c) for c in ("inline", "final", "invalid_inline", "invalid_structured", "needs_retry")])
    assert plans(state)[0].count("regexp_extract_all") == 2
    assert [r.needs_retry for r in state.collect()] == [True, False, False]


def test_repair_of_any_number_of_digits(spark):
    given = spark.createDataFrame([("x [[مادة " + "٧" * 70 + "]] y",), ("[مادة ٠٠] [[المادة 007]]",), ("بلا",), ("",), (None,)], "a string")
    out = given.select(citations.repair_brackets(F.col("a")).alias("r"))
    assert [r.r for r in out.collect()] == ["x [المادة " + "7" * 70 + "] y", "[المادة 0] [المادة 7]", "بلا", "", None]
    assert plans(out)[0].count("regexp_replace") <= 3


def test_a_selection_is_looked_at_once(spark):
    item = lambda i, yes, n: F.struct(F.lit(i).alias("issue_index"), F.lit(yes).alias("covered"), F.array(*map(F.lit, n)).cast("array<int>").alias("supporting_article_numbers"), F.lit(0.5).alias("confidence"), F.lit("").alias("reason"))
    coverage = F.array(item(2, True, [7, 5]), item(1, True, []), item(2, False, [99]), item(1, True, [6]), item(9, True, [98]), item(3, True, [6, 6]))
    selection = F.struct(F.array(F.lit(4), F.lit(7)).alias("selected_article_numbers"), coverage.alias("issue_coverage"), F.lit(0.9).alias("confidence"), F.lit("").alias("reason"))
    rows = spark.range(1).select(selection.alias("sel"), F.array(*map(F.lit, [4, 5, 6, 7])).alias("cat"))
    out = rows.select(planning.normalize_selection(F.col("sel"), F.col("cat"), F.lit(4)).alias("s"))
    s = out.first().s
    assert s.error is None and s.selected == [7, 5, 6]
    assert [(c.issue_index, c.covered, c.supporting_article_numbers, c.confidence) for c in s.coverage] == [(1, False, [], 0.5), (2, True, [7, 5], 0.5), (3, True, [6], 0.5), (4, False, [], 0.0)]
    plain = spark.createDataFrame([(1,)], "k int").select(planning.normalize_selection(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in planning.SELECTION]), F.array(F.col("k")), F.col("k")).alias("s"))
    assert plain.first().s.selected == [] and plans(out)[0].count("array_distinct") <= 4


def test_content_words_are_a_difference_of_sets(spark):
    rows = spark.createDataFrame([("اجر من 60 اجر س عامل",), ("",)], "n string").select(text.content_tokens(F.col("n")).alias("t"))
    assert "array_except" in plans(rows)[0] and [r.t for r in rows.collect()] == [["اجر", "60", "عامل"], []]


def test_a_slice_numbers_its_first_cases_only(spark):
    cases = spark.range(0, 1000, 1, 4).select((F.col("id") * 3).alias("case_index"), F.col("id").alias("x"))
    out = evaluation.sliced(cases, 20, 100)
    assert [(r.case_index, r.x) for r in out.orderBy("case_index").collect()] == [(i, i + 20) for i in range(100)]
    assert "TakeOrderedAndProject" in plans(out)[1]
    assert evaluation.sliced(cases, 990).count() == 10 and evaluation.sliced(cases, 999, 5).count() == 1
