"""Graph tables from triples: nodes, edges, eligibility, reachability, and the inspection report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.text import article_number, local_name
from karst.operators.rank import STRUCTURAL_KINDS
from karst.settings import Settings
from karst.sources.scratch import written

_RDF, _RDFS, _OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
_SKOS = "http://www.w3.org/2004/02/skos/core#"
TYPE, SUBCLASS = _RDF + "type", _RDFS + "subClassOf"
#: The literal groups, the kinds in their order, the classes of concepts, the bridges to articles.
LITERALS = {"labels": _RDFS + "label", "aliases": _SKOS + "altLabel", "comments": _RDFS + "comment"}
DOMAIN_KINDS = ["Article", "Paragraph", "Definition", "Law"]
OWL_KINDS = {"Class": "OntologyClass", "ObjectProperty": "ObjectProperty", "DatatypeProperty": "DatatypeProperty", "AnnotationProperty": "AnnotationProperty", "Ontology": "Ontology"}
CONCEPT_CLASSES = ["LegalConcept", "LaborDomainConcept", "StatutoryConcept"]
CONCEPT_TO_ARTICLE, ARTICLE_TO_CONCEPT = ["supportedByArticle", "regulatedBy"], ["regulates"]
GROUPS = ["labels_ar", "labels_en", "labels_other", "aliases_ar", "aliases_en", "aliases_other", "comments_ar", "comments_en", "comments_other"]


def language(tag: Column) -> Column:
    """ar, en or other; a tag with a region is its language."""
    tag = F.lower(F.coalesce(tag, F.lit("")))
    return F.when((tag == "ar") | tag.startswith("ar-"), F.lit("ar")).when((tag == "en") | tag.startswith("en-"), F.lit("en")).otherwise(F.lit("other"))


def literal_groups(triples: DataFrame) -> DataFrame:
    """s, and the nine groups of its labels, aliases and comments by language: trimmed, not blank, distinct, sorted."""
    names = F.create_map(*[F.lit(x) for kv in LITERALS.items() for x in (kv[1], kv[0])])
    rows = triples.where((F.col("o_kind") == "literal") & F.col("p").isin(list(LITERALS.values())))
    rows = rows.select("s", F.concat_ws("_", names[F.col("p")], language(F.col("o_lang"))).alias("g"), F.trim("o").alias("v")).where("v <> ''")
    rows = rows.distinct()
    return rows.groupBy("s").agg(*[F.sort_array(F.collect_list(F.when(F.col("g") == g, F.col("v")))).alias(g) for g in GROUPS])


def closure(pairs: DataFrame, roots: list[str]) -> DataFrame:
    """uri: the roots and all that is below them by pairs (child, parent), at any depth; cycles end.

    Nulls and links of a resource to itself count for nothing.  Each round goes one level down from what the last one
    found and then shortens what is left, so that links never grow: links of what is known go, links to a resource that
    is neither known nor has a parent go (nothing leads on from there), and a link to a resource with a single parent
    becomes one to that parent, since either is reached if and only if the other is.  Chains and trees away from the
    roots thus end in as many rounds as their depth has bits, and only levels of several parents take a round each.
    Rounds are written, so plans stay small.
    """
    spark = pairs.sparkSession
    found = written(spark.createDataFrame([(r,) for r in roots], "uri string").where("uri IS NOT NULL").distinct(), "closure-found")
    levels = [found]
    own = pairs.select(F.col("child").alias("a"), F.col("parent").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    links = written(own.join(found, F.expr("a = uri"), "left_anti"), "closure-links")
    while True:
        found = written(links.join(found, F.expr("b = uri"), "left_semi").select(F.col("a").alias("uri")).distinct(), "closure-found")
        if found.isEmpty():
            return written(reduce(DataFrame.union, levels), "closure")
        levels.append(found)
        left = links.join(found, F.expr("a = uri"), "left_anti")
        ways = left.groupBy(F.col("a").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("up"))
        ways = ways.union(found.select("uri", F.lit(2).cast("long"), F.lit(None).cast("string")))  # where the next level begins: kept
        shorter = left.join(ways, F.expr("b = m")).select("a", F.when(F.col("n") == 1, F.col("up")).otherwise(F.col("b")).alias("b"))
        links = written(shorter.where("a <> b").distinct(), "closure-links")


def node_kind(types: Column, namespace: str) -> Column:
    """The first of the domain's and the ontology language's kinds that a node has, or else its first own type, or Resource."""
    out = F.coalesce(F.array_min(F.transform(F.filter(types, lambda t: t.startswith(namespace)), local_name)), F.lit("Resource"))
    for name, kind in reversed(OWL_KINDS.items()):
        out = F.when(F.array_contains(types, _OWL + name), F.lit(kind)).otherwise(out)
    for name in reversed(DOMAIN_KINDS):
        out = F.when(F.array_contains(types, namespace + name), F.lit(name)).otherwise(out)
    return out


def searchable_text(uri: Column, kind: Column, types: Column, groups: dict[str, Column]) -> Column:
    """Titled lines in a fixed order; empty groups have none."""
    titles = [("Arabic labels", "labels_ar"), ("Arabic aliases", "aliases_ar"), ("English labels", "labels_en"), ("English aliases", "aliases_en"), ("Other labels", "labels_other"), ("Other aliases", "aliases_other"), ("Arabic text", "comments_ar"), ("English text", "comments_en"), ("Other text", "comments_other")]
    lines = [F.concat(F.lit("Local name: "), local_name(uri)), F.concat(F.lit("Node kind: "), kind)]
    lines.append(F.when(F.size(types) > 0, F.concat(F.lit("RDF types: "), F.array_join(F.sort_array(F.transform(types, local_name)), ", "))))
    lines += [F.when(F.size(groups[g]) > 0, F.concat(F.lit(f"{t}: "), F.array_join(groups[g], "\n"))) for t, g in titles]
    return F.concat_ws("\n", *lines)


def nodes_of(triples: DataFrame, s: Settings) -> DataFrame:
    """The node table: every resource that is a subject or an object."""
    uris = triples.select(F.col("s").alias("uri")).union(triples.where("o_kind = 'uri'").select("o")).distinct()
    typed = triples.where((F.col("p") == TYPE) & (F.col("o_kind") == "uri"))
    types = typed.groupBy(F.col("s").alias("uri")).agg(F.sort_array(F.collect_set("o")).alias("rdf_types"))
    below = closure(triples.where((F.col("p") == SUBCLASS) & (F.col("o_kind") == "uri")).select(F.col("s").alias("child"), F.col("o").alias("parent")), [s.namespace + c for c in CONCEPT_CLASSES])
    concepts = typed.join(below, typed["o"] == below["uri"], "left_semi").select(F.col("s").alias("uri")).distinct().withColumn("_concept", F.lit(True))
    rows = uris.join(types, "uri", "left").join(literal_groups(triples).withColumnRenamed("s", "uri"), "uri", "left").join(concepts, "uri", "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, empty) for c in ["rdf_types", *GROUPS]}).withColumn("node_kind", node_kind(F.col("rdf_types"), s.namespace))
    text = searchable_text(F.col("uri"), F.col("node_kind"), F.col("rdf_types"), {g: F.col(g) for g in GROUPS})
    eligible = F.coalesce("_concept", F.lit(False)) & ~F.col("node_kind").isin(STRUCTURAL_KINDS)
    return rows.select("uri", local_name(F.col("uri")).alias("local_name"), "node_kind", "rdf_types", *GROUPS, F.when(F.col("node_kind") == "Article", article_number(F.col("uri"))).alias("article_number"), eligible.alias("retrieval_eligible"), text.alias("searchable_text"))


def edges_of_triples(triples: DataFrame) -> DataFrame:
    """The edge table: one row per triple, resources and literals apart."""
    is_uri = F.col("o_kind") == "uri"
    return triples.select(
        F.col("s").alias("source_uri"), F.col("p").alias("predicate_uri"), local_name(F.col("p")).alias("predicate_local_name"), F.col("o_kind").alias("object_kind"),
        F.when(is_uri, F.col("o")).alias("target_uri"), F.when(~is_uri, F.col("o")).alias("literal_value"), F.col("o_lang").alias("literal_language"), F.col("o_datatype").alias("literal_datatype"),
    )


def edge_key(columns: list[str]) -> Column:
    """The same key for the same values, nulls told from empty strings: for upserts."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def reachable_articles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """uri, article_number: articles that an eligible concept is bridged to."""
    eligible = nodes.where("retrieval_eligible").select(F.col("uri").alias("_c"))
    there = edges.where(F.col("predicate_local_name").isin(CONCEPT_TO_ARTICLE)).select(F.col("source_uri").alias("_c"), F.col("target_uri").alias("uri"))
    back = edges.where(F.col("predicate_local_name").isin(ARTICLE_TO_CONCEPT)).select(F.col("target_uri").alias("_c"), F.col("source_uri").alias("uri"))
    met = there.union(back).join(eligible, "_c", "left_semi").select("uri").distinct()
    return met.withColumn("article_number", article_number(F.col("uri"))).where("article_number IS NOT NULL")


def inspection_report(triples: DataFrame, nodes: DataFrame, edges: DataFrame, s: Settings) -> DataFrame:
    """One row: counts, violations as sorted arrays, and whether all eight checks hold."""
    spark = triples.sparkSession
    kinds = ["Paragraph", "Definition", "OntologyClass", "ObjectProperty", "DatatypeProperty"]
    article = F.col("node_kind") == "Article"
    labelled = F.size("labels_ar") + F.size("labels_en") + F.size("labels_other") > 0
    sorted_set = lambda cond, c: F.sort_array(F.collect_set(F.when(cond, F.col(c))))
    counts = nodes.agg(
        F.count(F.lit(1)).alias("node_count"), F.count(F.when(article, 1)).alias("article_count"), *[F.count(F.when(F.col("node_kind") == k, 1)).alias(f"n_{k}") for k in kinds],
        F.count(F.when(F.col("retrieval_eligible"), 1)).alias("eligible_count"), sorted_set(article, "article_number").alias("article_numbers"),
        sorted_set(article & (F.size("comments_ar") == 0), "uri").alias("articles_without_arabic_text"), sorted_set(article & ~labelled, "uri").alias("articles_without_labels"),
    )
    expected = spark.range(1, s.article_count + 1).select(F.col("id").cast("int").alias("article_number"))
    numbers = nodes.where(article & F.col("article_number").isNotNull()).groupBy("article_number").agg(F.count(F.lit(1)).alias("n"))
    listed = lambda df, name: df.agg(F.sort_array(F.collect_set("article_number")).alias(name))
    reached = reachable_articles(edges, nodes)
    parts = [
        triples.agg(F.count(F.lit(1)).alias("triple_count")),
        edges.agg(F.count(F.lit(1)).alias("edge_count")),
        listed(expected.join(numbers, "article_number", "left_anti"), "missing_article_numbers"),
        listed(numbers.where("n > 1"), "duplicate_article_numbers"),
        listed(expected.join(reached, "article_number", "left_anti"), "unreachable_article_numbers"),
        reached.agg(F.countDistinct("article_number").alias("reachable_count")),
    ]
    for p in parts:  # one-row tables
        counts = counts.crossJoin(p)
    none = [F.size(c) == 0 for c in ("missing_article_numbers", "duplicate_article_numbers", "articles_without_arabic_text", "articles_without_labels", "unreachable_article_numbers")]
    valid = (F.col("triple_count") > 0) & (F.col("edge_count") == F.col("triple_count")) & (F.col("article_count") == s.article_count)
    for c in none:
        valid &= c
    return counts.withColumn("is_valid", valid)
