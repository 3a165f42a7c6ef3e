"""What a graph moves and keeps for an edge, and what one task reads of an issue's evidence."""

from pyspark.sql import functions as F
from test_adjacency import random_edges, rows, view

from karst.operators import adjacency, graph, rank
from karst.settings import Settings


def test_an_edge_is_a_neighbour_and_a_number(spark):
    edges = view(spark, random_edges(7)).cache()
    store = adjacency.build_scratch(edges, buckets=3)
    assert dict(store.table(spark, "edges").dtypes) | {"degree": "", "article_degree": ""} == {"cur": "string", "shard": "int", "nbrs": "array<string>", "kinds": "array<int>", "degree": "", "article_degree": ""}
    assert store.table(spark, "kinds").count() == edges.select("direction", "relation", "weight", "to_article").distinct().count()
    assert rows(store.degrees(spark)) == rows(graph.degrees(edges))
    none = adjacency.build_scratch(edges.where("false"), buckets=2)
    assert none.hop(spark.createDataFrame([("c0",)], "cur string")).count() == 0
    for s in (store, none):
        s.drop(spark)


def test_no_task_reads_all_evidence_of_an_issue(spark):
    evidence = spark.range(0, 3000, 1, 4).select(F.lit(1).alias("question_id"), F.lit(1).alias("issue_index"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("uri"), (F.col("id") % 1000 / 1000 + 0.001).alias("graph_score"), F.lit(1).alias("n_paths"))
    articles = evidence.where("uri <> 'a999'").select("question_id", "issue_index", "uri", F.substring("uri", 2, 9).cast("int").alias("article_number"), F.lit(0.5).alias("issue_relevance"))
    out = rank.rank_articles(evidence, articles, Settings())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "max(graph_score" not in plan  # ranks alone are windows, kept to their first few before they move
    assert [(r.uri, r["rank"]) for r in out.orderBy("rank").collect()][:3] == [("a1999", 1), ("a2999", 2), ("a998", 3)]
