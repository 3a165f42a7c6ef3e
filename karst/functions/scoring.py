"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from karst.settings import Settings


def semantic(rank: Column, distance: Column) -> Column:
    """Of a vector hit: half its rank, half its similarity; a null distance counts as 0."""
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(distance, F.lit(0.0))))
    return F.when(rank.isNotNull(), 0.5 / F.sqrt(rank) + 0.5 * near)


def by_rank(rank: Column) -> Column:
    return F.when(rank.isNotNull(), 1 / F.sqrt(rank))


def specificity(degree: Column) -> Column:
    return 1 / (1 + F.log1p(F.coalesce(degree, F.lit(0)).cast("double")))


def reciprocal_rank(s: Settings, vector: Column, bm25: Column, hint: Column) -> Column:
    part = lambda rank, weight: F.coalesce(weight / (s.rrf_k + rank), F.lit(0.0))
    return part(vector, F.lit(1.0)) + part(bm25, F.lit(1.0)) + part(hint, F.lit(1.5))


def seed(s: Settings, semantic_score: Column, lexical_score: Column, hint_score: Column, specificity_score: Column) -> Column:
    """Weighted mean over the channels that a concept was found in; specificity is always there."""
    top, bottom = s.specificity_weight * specificity_score, F.lit(s.specificity_weight)
    for value, weight in ((semantic_score, s.semantic_weight), (lexical_score, s.lexical_weight), (hint_score, s.hint_weight)):
        top += F.coalesce(weight * value, F.lit(0.0))
        bottom += F.when(value.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def hub_damping(article_degree: Column) -> Column:
    """The divisor of a step into an article, from a node with so many articles."""
    return F.sqrt(1 + F.log1p(F.greatest(article_degree, F.lit(1)).cast("double")))


def article_final(s: Settings, graph: Column, highest: Column, relevance: Column, paths: Column) -> Column:
    share = F.when(highest > 0, graph / highest).otherwise(graph)
    bonus = 0.03 * F.least(F.lit(3), F.greatest(F.lit(0), paths - 1))
    return F.least(F.lit(1.25), s.article_graph_weight * share + s.article_relevance_weight * relevance + bonus)


def across_issues(best: Column, issues: Column) -> Column:
    return best + 0.05 * (issues - 1)
