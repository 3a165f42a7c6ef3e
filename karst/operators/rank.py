"""Articles and concepts: ranking per issue, merging across issues, keeping the best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karst.functions import scoring
from karst.operators.graph import KEYS
from karst.settings import Settings
from karst.sources.scratch import written

#: Rows that a task sorts to number them, about.
NUMBERED = 500_000
#: Kinds of nodes that are structure, not concepts.
STRUCTURAL_KINDS = ["Article", "Paragraph", "Definition", "Law", "Ontology", "OntologyClass", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "Resource"]


def rank_articles(evidence: DataFrame, articles: DataFrame, s: Settings, keys: list[str] = KEYS) -> DataFrame:
    """The issue's best articles: evidence with relevance, final_score and rank.

    evidence: keys, uri, graph_score, n_paths; articles: keys, uri, article_number, issue_relevance (those that are valid).
    Scores are shares of the issue's highest graph score, which counts articles that are then dropped too.
    """
    # A number an issue, so that no task reads all evidence of an issue; of the ranks each task keeps the first few before it sends them on.
    highest = written(evidence.groupBy(*keys).agg(F.max("graph_score").alias("_highest")), "highest")
    joined = evidence.join(articles, [*keys, "uri"]).where(F.col("article_number").isNotNull()).join(F.broadcast(highest), keys)
    final = scoring.article_final(s, F.col("graph_score"), F.col("_highest"), F.col("issue_relevance"), F.col("n_paths"))
    order = Window.partitionBy(*keys).orderBy(F.desc("final_score"), F.desc("graph_score"), F.asc_nulls_last("article_number"), "uri")
    ranked = joined.withColumn("final_score", final).drop("_highest").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= s.issue_article_candidates)


def merge_candidates(ranked: DataFrame, s: Settings, with_paths: bool = True) -> DataFrame:
    """A question's candidates across its issues: the best scores, a bonus for each further issue, and all distinct paths.

    Paths are the same when seed, article and the triples of their steps are; the direction does not count.
    """
    aggregates = [F.max(c).alias(c) for c in ("graph_score", "issue_relevance", "final_score")]
    aggregates += [F.countDistinct("issue_index").alias("n_issues"), F.min("article_number").alias("article_number")]
    if with_paths:
        aggregates.append(F.array_sort(F.collect_list(F.struct("issue_index", "support_paths"))).alias("_paths"))
    merged = ranked.groupBy("question_id", "uri").agg(*aggregates)
    if with_paths:
        flat = F.flatten(F.transform("_paths", lambda x: x["support_paths"]))
        same = F.transform(flat, lambda p: F.struct(p["seed_uri"], p["article_uri"], F.transform(p["steps"], lambda t: F.struct(t["source_uri"], t["relation"], t["target_uri"]))))
        firsts = F.transform(F.array_distinct(same), lambda k: F.get(flat, F.array_position(same, k).cast("int") - 1))
        merged = merged.withColumn("support_paths", firsts).drop("_paths")
    merged = merged.withColumn("final_score", scoring.across_issues(F.col("final_score"), F.col("n_issues")))
    order = Window.partitionBy("question_id").orderBy(F.desc("final_score"), F.desc("graph_score"), F.asc_nulls_last("article_number"), "uri")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(s.reranker_candidate_limit, s.article_top_k))


def keep_best(rows: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """Of each key the row with the highest score; of equal ones the one with the smallest ``tie``."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, group: str, order: str, most: int = NUMBERED) -> DataFrame:
    """Rows with n, their place in their group by ``order`` (from 1): row_number, with a large group spread over many tasks.

    All rows are sorted, ``most`` of them a task; what is added to a row's place in its task is how many of its group lie in the
    tasks before.  That is one number a group and task, which all tasks get, so groups are few.  A null group is one group.
    """
    rows = written(rows, "numbered-rows")  # counted, sampled and moved
    tasks = max(1, -(-rows.count() // most))
    placed = rows.repartitionByRange(tasks, group, order).sortWithinPartitions(group, order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "numbered-places")
    task = F.shiftright("_at", 33)
    parts = placed.groupBy(F.col(group).alias("_group"), task.alias("_task")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.select("_group", "_task", (F.col("_first") - 1 - F.coalesce(before, F.lit(0))).alias("_zero")), "numbered-parts")
    out = placed.join(F.broadcast(parts), F.col(group).eqNullSafe(F.col("_group")) & (task == F.col("_task")))
    return out.select(*rows.columns, (F.col("_at") - F.col("_zero")).cast("int").alias("n"))


def merge_concepts(hits: DataFrame, s: Settings) -> DataFrame:
    """A question's concepts across its issues, each at its best (the earlier issue's on ties)."""
    best = keep_best(hits, ["question_id", "uri"], "seed_score", "issue_index")
    order = Window.partitionBy("question_id").orderBy(F.desc("seed_score"), "uri")
    issues = hits.groupBy("question_id").agg(F.greatest(F.lit(s.concept_top_k), 4 * F.max("issue_index")).alias("_limit"))
    ranked = best.withColumn("rank", F.row_number().over(order)).join(issues, "question_id")
    return ranked.where("rank <= _limit").drop("_limit")


def expanded_concepts(related: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """A question's concepts that the walks reached, the best first; structure is no concept."""
    best = related.groupBy("question_id", "uri").agg(F.max("score").alias("graph_score"))
    kept = best.join(nodes.where(~F.col("node_kind").isin(STRUCTURAL_KINDS)).select("uri", "local_name"), "uri")
    order = Window.partitionBy("question_id").orderBy(F.desc("graph_score"), "uri")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.concept_top_k)


def selected_articles(selections: DataFrame, candidates: DataFrame, s: Settings) -> DataFrame:
    """The candidates whose numbers were selected, in the order of the selection; at most the top k."""
    chosen = selections.select("question_id", F.posexplode(F.array_distinct("selected_article_numbers")).alias("position", "article_number"))
    joined = candidates.withColumnRenamed("rank", "candidate_rank").join(chosen, ["question_id", "article_number"])
    order = Window.partitionBy("question_id").orderBy("position", "uri")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.article_top_k).drop("position")


def eligible(nodes: DataFrame) -> DataFrame:
    """The nodes that a search may find."""
    return nodes.where("retrieval_eligible")


def valid_articles(nodes: DataFrame) -> DataFrame:
    """The nodes that can be evidence: articles with a number."""
    return nodes.where("node_kind = 'Article' AND article_number IS NOT NULL")
