"""Weighted, bounded traversal from concepts to articles, for all questions at once.

Frames are keyed by (question_id, issue_index).  Articles end a walk; they enter results only
through edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karst.functions import scoring
from karst.operators import adjacency
from karst.operators.adjacency import Adjacency
from karst.settings import Settings
from karst.sources.scratch import written

#: The weights of relations that lead to evidence and between concepts.
EVIDENCE_WEIGHTS = {"supportedByArticle": 1.00, "regulatedBy": 0.95, "regulates": 0.90, "hasDefinition": 0.90}
SEMANTIC_WEIGHTS = {
    "hasCondition": 0.88, "violatesRight": 0.86, "breachesObligation": 0.86, "resultsIn": 0.82, "basedOnEvent": 0.82, "hasRight": 0.74, "hasObligation": 0.74,
    "defines": 0.78, "definedIn": 0.78, "isPartyTo": 0.68, "hasEmployer": 0.64, "hasWorker": 0.64, "committedBy": 0.62, "sufferedBy": 0.62,
}
RELATION_WEIGHTS = EVIDENCE_WEIGHTS | SEMANTIC_WEIGHTS
KEYS = ["question_id", "issue_index"]


def edge_view(edges: DataFrame, weights: dict[str, float], is_article) -> DataFrame:
    """The edges as they are walked: cur, nbr, direction, relation, source, target, weight, to_article.

    edges: source_uri, predicate_local_name, object_kind, target_uri.  Only edges between resources with a
    weighted relation are walked, in both directions.  is_article: a predicate on a URI column.
    """
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    kept = edges.where((F.col("object_kind") == "uri") & F.col("predicate_local_name").isin(list(weights)))
    kept = kept.select(F.col("source_uri").alias("source"), F.col("predicate_local_name").alias("relation"), F.col("target_uri").alias("target"))
    kept = kept.where("source <> '' AND target <> ''").withColumn("weight", weight[F.col("relation")].cast("double"))
    # One scan: each edge gives its two orientations.
    sides = F.array(
        F.struct(F.col("source").alias("cur"), F.col("target").alias("nbr"), F.lit("outgoing").alias("direction")),
        F.struct(F.col("target").alias("cur"), F.col("source").alias("nbr"), F.lit("incoming").alias("direction")),
    )
    out = kept.withColumn("_side", F.explode(sides)).select("_side.*", "relation", "source", "target", "weight")
    return out.withColumn("to_article", is_article(F.col("nbr")))


def pack(edges: DataFrame, s: Settings, name: str | None = None) -> Adjacency:
    """The walked edges of a law, packed: the catalogue's under a name, else for this request."""
    view = edge_view(edges, RELATION_WEIGHTS, is_uri_of(s.namespace))
    return adjacency.build(view, name) if name else adjacency.build_scratch(view)


def packed(spark: SparkSession, name: str) -> Adjacency | None:
    """The catalogue's packed edges under a name, if there are any."""
    return Adjacency(name) if spark.catalog.tableExists(f"{name}_heads") else None


def edges_of(view: DataFrame, frontier: DataFrame, column: str = "uri") -> DataFrame:
    """The walked edges from the URIs of a frontier."""
    return view.join(frontier.select(F.col(column).alias("cur")).distinct(), "cur", "left_semi")


def degrees(view: DataFrame) -> DataFrame:
    """uri, degree (distinct neighbours), article_degree (distinct neighbouring articles)."""
    # Distinct pairs first, so that no task holds the set of a hub's neighbours.
    pairs = view.groupBy("cur", "nbr").agg(F.first("to_article").alias("to_article"))
    return pairs.groupBy(F.col("cur").alias("uri")).agg(F.count(F.lit(1)).alias("degree"), F.count(F.when(F.col("to_article"), 1)).alias("article_degree"))


def select_seeds(hits: DataFrame, s: Settings, keys: list[str] = KEYS) -> DataFrame:
    """Of each issue's concepts with a positive score the best few that are near the best one, with ``seed_rank``; the best one in any case."""
    by = Window.partitionBy(*keys)
    ranked = hits.where("seed_score > 0").withColumns({"seed_rank": F.row_number().over(by.orderBy(F.desc("seed_score"), "uri")), "_top": F.max("seed_score").over(by)})
    enough = F.col("seed_score") >= F.greatest(F.lit(s.seed_min_score), s.seed_relative_threshold * F.col("_top"))
    return ranked.where((enough | (F.col("seed_rank") == 1)) & (F.col("seed_rank") <= s.seed_count)).drop("_top")


#: The steps of a path.
STEPS = "array<struct<direction:string,source_uri:string,relation:string,target_uri:string>>"
_SEED = ["seed_uri", "seed_label", "seed_score", "seed_rank"]


def _start(seeds: DataFrame, keys: list[str]) -> DataFrame:
    score = F.greatest(F.col("seed_score"), F.lit(1e-6))
    return seeds.select(*keys, F.col("uri").alias("seed_uri"), "seed_label", "seed_score", "seed_rank", F.col("uri").alias("cur"), score.alias("score"), F.array().cast(STEPS).alias("steps"))


def _hop(frontier: DataFrame, view: DataFrame | Adjacency, s: Settings, keys: list[str], hop: int, in_namespace) -> DataFrame:
    """Every arrival of one hop: keys, the seed, uri, to_article, score, steps, hop."""
    if isinstance(view, Adjacency):
        gone = view.spread(written(view.reach(frontier), "hop-reached"))  # written packed, as each aggregate of the hop reads it
    else:  # only edges from the frontier, and only its degrees; written, as both are read
        edges = written(edges_of(view, frontier, "cur"), "hop-edges")
        gone = frontier.join(edges, "cur").join(degrees(edges).select(F.col("uri").alias("cur"), "article_degree"), "cur")
    step = F.struct(F.col("direction"), F.col("source").alias("source_uri"), F.col("relation"), F.col("target").alias("target_uri"))
    score = F.col("score") * F.col("weight") * s.hop_decay
    score = F.when(F.col("to_article"), score / scoring.hub_damping(F.col("article_degree"))).otherwise(score)
    here = gone.select(*keys, *_SEED, F.col("nbr").alias("uri"), "to_article", score.alias("score"), F.array_append("steps", step).alias("steps"), F.lit(hop).alias("hop"))
    return here if in_namespace is None else here.where(F.col("to_article") | in_namespace(F.col("uri")))


def _best_states(here: DataFrame, keys: list[str]) -> DataFrame:
    """Of each concept that a seed reached in the hop the best walk; the smallest steps break ties (the least struct of the negated score)."""
    best = here.where(~F.col("to_article")).groupBy(*keys, *_SEED, "uri").agg(F.min(F.struct((-F.col("score")).alias("loss"), F.col("steps"))).alias("b"))
    return best.select(*keys, *_SEED, "uri", (-F.col("b.loss")).alias("score"), F.col("b.steps").alias("steps"))


def _better(best: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The states whose score is better than any before."""
    known = seen.groupBy(*keys, "seed_uri", "uri").agg(F.max("best").alias("best"))
    return best.join(known, [*keys, "seed_uri", "uri"], "left").where("best IS NULL OR score > best").drop("best")


def expand(seeds: DataFrame, view: DataFrame | Adjacency, s: Settings, *, keys: list[str] = KEYS, in_namespace=None) -> DataFrame:
    """Every arrival of the walks: keys, seed_uri, hop, uri, to_article, score, and ``steps``.

    seeds: keys, uri, seed_score, seed_label, seed_rank.  In each hop every state goes along all its edges; a step
    into an article is damped by the number of articles that the node has.  A node is walked on from only if its best
    score in the hop is better than any before; of equal ones the first in the order of paths goes on.  ``walk`` keeps what is wanted of the arrivals only.
    """
    frontier = written(_start(seeds, keys), "frontier")
    seen = frontier.select(*keys, "seed_uri", F.col("cur").alias("uri"), F.col("score").alias("best"))
    arrivals = None
    for hop in range(1, s.max_hops + 1):
        here = _hop(frontier, view, s, keys, hop, in_namespace)
        arrivals = here if arrivals is None else arrivals.unionByName(here)
        if hop == s.max_hops:
            break
        best = written(_better(_best_states(here, keys), seen, keys), "frontier")
        frontier = best.withColumnRenamed("uri", "cur")
        seen = seen.unionByName(best.select(*keys, "seed_uri", "uri", F.col("score").alias("best")))
    return arrivals


def first_paths(found: DataFrame, k: int, keys: list[str] = KEYS) -> DataFrame:
    """Of each article's arrivals the k first in the order of seed, hop and steps: kept before anything is shuffled, and merged after."""
    order = Window.partitionBy(*keys, "uri").orderBy("seed_rank", "hop", "steps")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def walk(seeds: DataFrame, view: DataFrame | Adjacency, s: Settings, *, keys: list[str] = KEYS, in_namespace=None) -> tuple[DataFrame, DataFrame]:
    """The articles' evidence and the related concepts of the walks that ``expand`` describes.

    Of a hop only three bounded aggregates are written: the best score of each article, its first paths, and the best
    walk to each concept of each seed; each is made in the map tasks first, so that no task holds more of a key than it keeps,
    and the hop's arrivals, however many, are nowhere.
    """
    frontier = written(_start(seeds, keys), "frontier")
    seen = frontier.select(*keys, "seed_uri", F.col("cur").alias("uri"), F.col("score").alias("best"))
    scores, paths, states = [], [], []
    for hop in range(1, s.max_hops + 1):
        here = _hop(frontier, view, s, keys, hop, in_namespace)
        found = here.where("to_article")
        scores.append(written(found.groupBy(*keys, "uri").agg(F.max("score").alias("graph_score")), "hop-scores"))
        paths.append(written(first_paths(found, s.paths_per_article, keys), "hop-paths"))
        states.append(written(_best_states(here, keys), "hop-states"))
        better = _better(states[-1], seen, keys)
        frontier = better.withColumnRenamed("uri", "cur")
        if hop < s.max_hops:
            frontier = written(frontier, "frontier")
            seen = seen.unionByName(frontier.select(*keys, "seed_uri", F.col("cur").alias("uri"), F.col("score").alias("best")))
    every = lambda tables: reduce(DataFrame.unionByName, tables)
    evidence = _evidence(every(scores).groupBy(*keys, "uri").agg(F.max("graph_score").alias("graph_score")), every(paths), s, keys)
    return evidence, related_concepts(every(states).withColumn("to_article", F.lit(False)), seeds, keys)


def _evidence(best: DataFrame, found: DataFrame, s: Settings, keys: list[str]) -> DataFrame:
    path = F.struct("seed_uri", "seed_label", "seed_score", F.col("uri").alias("article_uri"), "score", "steps")
    order = F.struct("seed_rank", "hop", "steps")
    kept = first_paths(found, s.paths_per_article, keys).groupBy(*keys, "uri").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), path.alias("p")))).alias("ps"))
    return best.join(kept, [*keys, "uri"]).select(*keys, "uri", "graph_score", F.size("ps").alias("n_paths"), F.transform("ps", lambda x: x["p"]).alias("support_paths"))


def article_evidence(arrivals: DataFrame, s: Settings, keys: list[str] = KEYS) -> DataFrame:
    """keys, uri, graph_score (the best), n_paths (as kept), support_paths: the first few in the order of seed, hop and steps."""
    found = arrivals.where("to_article")
    return _evidence(found.groupBy(*keys, "uri").agg(F.max("score").alias("graph_score")), found, s, keys)


def related_concepts(arrivals: DataFrame, seeds: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, uri, score: the best of every concept that was reached, without the seeds."""
    best = arrivals.where(~F.col("to_article")).groupBy(*keys, "uri").agg(F.max("score").alias("score"))
    return best.join(seeds.select(*keys, "uri").distinct(), [*keys, "uri"], "left_anti")


def is_uri_of(prefix: str):
    def test(uri: Column) -> Column:
        return uri.rlike("^" + prefix.replace(".", r"\.") + "article_[0-9]+$")

    return test
