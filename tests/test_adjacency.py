import random

import pytest
from plan_fixture import moved
from pyspark.sql import functions as F

from karst.operators import adjacency, graph
from karst.settings import Settings

KEYS = ["question_id", "issue_index"]
SEEDS = "question_id int, issue_index int, uri string, seed_score double, seed_label string, seed_rank int"


def view(spark, edges):
    rows = [(a, r, "uri", b) for a, r, b in edges]
    frame = spark.createDataFrame(rows, "source_uri string, predicate_local_name string, object_kind string, target_uri string")
    return graph.edge_view(frame, {r: 0.5 + 0.4 / (1 + i) for i, r in enumerate(sorted({r for _, r, _ in edges}))}, lambda u: u.startswith("a"))


def random_edges(seed, n=400):
    rng = random.Random(seed)
    node = lambda: rng.choice([f"c{rng.randrange(40)}", f"a{rng.randrange(60)}", "c0"])
    return [(node(), rng.choice(["r1", "r2", "r3"]), node()) for _ in range(n)] + [("c1", "r1", "c1"), ("c1", "r1", "c2"), ("c1", "r1", "c2")]


@pytest.fixture(params=[4096, 5])
def shard(request, monkeypatch):
    monkeypatch.setattr(adjacency, "SHARD", request.param)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_degrees_and_hops_equal_the_edges(spark, shard):
    edges = view(spark, random_edges(1)).cache()
    store = adjacency.build_scratch(edges, buckets=3)
    assert rows(store.degrees(spark)) == rows(graph.degrees(edges))
    asked = spark.createDataFrame([("c0", 1), ("c1", 2), ("a3", 3), ("nowhere", 4)], "cur string, n int")
    cols = ["n", "cur", "nbr", "direction", "relation", "source", "target", "weight", "to_article"]
    assert rows(store.hop(asked).select(cols)) == rows(edges.join(asked, "cur").select(cols))
    store.drop(spark)


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_kept_walks_equal_all_walks(spark, hops):
    edges = view(spark, random_edges(hops, 150)).cache()
    seeds = spark.createDataFrame([(1, 1, "c0", 0.9, "x", 1), (1, 1, "c5", 0.8, "y", 2), (2, 1, "c0", 0.4, "x", 1)], SEEDS)
    s = Settings(max_hops=hops)
    arrivals = graph.expand(seeds, edges, s)
    evidence, related = graph.walk(seeds, adjacency.build_scratch(edges), s)
    assert rows(evidence) == rows(graph.article_evidence(arrivals, s)) and evidence.count() > 5
    assert rows(related.select(*KEYS, "uri", "score")) == rows(graph.related_concepts(arrivals, seeds).select(*KEYS, "uri", "score"))


def test_a_hub_of_a_hundred_thousand_walks(spark):
    """Five paths of each article are kept where the walks are made, and they are the first five of all."""
    mids = [("c0", "r1", f"c{i}") for i in range(1, 335)]
    ways = [(f"c{i}", f"q{j:03}", "a1") for i in range(1, 335) for j in range(300)]
    edges = view(spark, mids + ways).cache()
    seeds = spark.createDataFrame([(1, 1, "c0", 1.0, "x", 1)], SEEDS)
    s = Settings(max_hops=2)
    store = adjacency.build_scratch(edges)
    evidence, _ = graph.walk(seeds, store, s)
    arrivals = graph.expand(seeds, edges, s)
    assert arrivals.where("to_article").count() >= 100_000
    assert rows(evidence) == rows(graph.article_evidence(arrivals, s)) and evidence.first().n_paths == 5
    plan = graph.first_paths(store.hop(seeds.withColumnRenamed("uri", "cur")).select(*KEYS, "seed_rank", F.col("nbr").alias("uri"), F.lit(1).alias("hop"), F.array("direction").alias("steps")), 5)._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[exchange:] and "WindowGroupLimit" in plan[:exchange]  # before the exchange, and after


def test_a_hop_moves_its_frontier_only(spark):
    edges = view(spark, random_edges(4, 3000))
    store = adjacency.build_scratch(edges, buckets=4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = store.hop(spark.createDataFrame([("c0", 1)], "cur string, n int"))._jdf.queryExecution().executedPlan().toString()
        assert not moved(plan, "_heads") and not moved(plan, "_edges"), plan
        assert plan.count("Exchange hashpartitioning") == 2  # the frontier to its nodes, and to their shards
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
