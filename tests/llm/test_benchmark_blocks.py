from karst.llm.decontaminate import contamination, decontaminate


def test_blocks_keep_repeated_and_null_ids_apart(spark):
    gram = lambda c: " ".join(f"{c}{i}" for i in range(12))
    items = spark.createDataFrame([(k, gram(c)) for k, c in enumerate("abc")], "item_id long, text string")
    fill = " ".join(["x"] * 12)
    rows = [(1, gram("a")), (1, gram("b")), (1, fill), (1, fill), (None, gram("c")), (None, fill), (None, fill), (None, None), (None, None), (2, gram("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda df: sorted((r.doc_id or 0, r.n_words, tuple(r.hit_runs), tuple(r.item_ids), r.full_window) for r in df.collect())
    one, many = key(contamination(docs, items)), key(contamination(docs, items, block_bytes=20))
    assert len(one) == len(rows) and one == many
    for remove in ("spans", "documents"):
        texts = [sorted((r.doc_id or 0, r.text or "") for r in decontaminate(docs, items, remove=remove, **o).collect()) for o in ({}, {"block_bytes": 20})]
        assert texts[0] == texts[1] and len(texts[0]) == (10 if remove == "spans" else 6)
