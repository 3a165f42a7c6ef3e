from karst.llm.jaccard_join import keep_one


def test_one_row_of_each_component(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(100))
    near = text("a").replace("a99", "x")
    rows = [(5, text("a"), "k")] * 3 + [(9, near, "k"), (None, text("a"), "k"), (5, text("b"), "k"), (5, text("b"), "l")]
    rows += [(None, text("c"), "k")] * 3 + [(None, text("c").replace("c99", "y"), "k")] + [(None, text("d"), None), (7, text("d"), None)]
    rows += [(None, None, None)] * 2 + [(1, "", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = sorted((r.doc_id or 0, (r.text or "-")[:1]) for r in keep_one(docs).collect())
    assert got == [(0, "-"), (0, "-"), (0, "c"), (1, "-"), (1, "-"), (5, "a"), (5, "b"), (7, "d")]
