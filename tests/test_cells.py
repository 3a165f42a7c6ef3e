import numpy as np
import pytest
from plan_fixture import moved

from karst.operators import cells, search

KEYS = ["q"]


def frames(spark, vectors, queries):
    nodes = spark.createDataFrame([(f"u{i:05}", v.tolist()) for i, v in enumerate(vectors)] + [("none", None)], "uri string, embedding array<double>")
    return nodes, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)] + [(999, None)], "q int, vector array<double>")


def rows(df):
    return sorted(map(tuple, df.select("q", "rank", "uri", "distance").collect()))


def clustered(seed, n=4000, dim=24, groups=60):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(groups, size=n)] + 0.25 * rng.normal(size=(n, dim)), centres[rng.integers(groups, size=40)] + 0.25 * rng.normal(size=(40, dim))


def test_recall_and_exact_search(spark):
    vectors, queries = clustered(1)
    nodes, asked = frames(spark, np.concatenate([vectors, np.zeros((2, 24)), vectors[:50]]), queries)
    index = cells.build_scratch(nodes)
    exact = rows(search.vector_topk(asked, nodes, 10, KEYS))
    run = cells.Search(index, asked, 10, KEYS, 8)
    near = rows(run.topk())
    total = index.table(spark, "cells").count()
    read = run.asked(run.queries).select("q", "cell").distinct().count() / 40
    assert read == 8 and total > 50  # a query reads eight of the cells
    assert len({r[:1] + r[2:3] for r in exact} & {r[:1] + r[2:3] for r in near}) >= 0.95 * len(exact)
    assert rows(run.topk(exact=True)) == exact
    index.drop(spark)


@pytest.mark.parametrize("kind", ["random", "copies"])
def test_exact_on_hard_vectors(spark, kind, monkeypatch):
    """Without clusters, and with a vector that a third of all rows have; cells in parts of 64."""
    monkeypatch.setattr(cells, "PART", 64)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 16))
    if kind == "copies":
        vectors[::3] = vectors[0]
    nodes, asked = frames(spark, vectors, np.concatenate([rng.normal(size=(12, 16)), vectors[:3]]))
    index = cells.build_scratch(nodes, cells=20, buckets=3)
    if kind == "copies":
        assert index.table(spark, "cells").agg({"parts": "max"}).first()[0] >= 5
    assert rows(cells.topk(index, asked, 10, KEYS, probes=2, exact=True)) == rows(search.vector_topk(asked, nodes, 10, KEYS))
    index.drop(spark)


def test_empty_index_and_no_exchange_of_vectors(spark):
    nodes, asked = frames(spark, np.zeros((0, 4)), np.ones((2, 4)))
    index = cells.build_scratch(nodes)
    assert cells.topk(index, asked, 3, KEYS, exact=True).count() == 0
    nodes, asked = frames(spark, *clustered(5, 500))
    index = cells.build_scratch(nodes, buckets=3)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = cells.topk(index, asked, 3, KEYS)._jdf.queryExecution().executedPlan().toString()
        assert not moved(plan.replace("FlatMapCoGroupsInArrow", "Join"), "_vectors"), plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
