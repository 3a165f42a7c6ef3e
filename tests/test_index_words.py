from pyspark.sql import functions as F

from karst.operators import lexicon


def test_words_are_cut_without_a_lambda(spark):
    rows = spark.createDataFrame([(" B, a-é9 ",), ("",), (None,)], "t string").select(lexicon.words(F.col("t")).alias("w"))
    assert [r.w for r in rows.collect()] == [["b", "a", "é9"], [], []]
    assert "lambdafunction" not in rows._jdf.queryExecution().optimizedPlan().toString()
