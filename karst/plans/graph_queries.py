"""Queries of graph building, traversal and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions import scoring
from karst.operators import build, graph, rank
from karst.plans import standin as g
from karst.settings import Settings
from karst.sources.scratch import written

NS = "http://example.org/law#"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _path(steps):
    return F.array_join(F.transform(steps, lambda t: F.concat_ws("|", t["direction"], t["source_uri"], t["relation"], t["target_uri"])), ">")


def edge_view(spark: SparkSession, d: str) -> DataFrame:
    return g.view(spark, d)


def edges_by_frontier(spark: SparkSession, d: str) -> DataFrame:
    frontier = g.table(spark, d, "nation").where("n_regionkey = 2").select(g.uri("n", "n_nationkey").alias("uri"))
    return graph.edges_of(g.view(spark, d), frontier).select("cur", "nbr", "direction", "relation")


def node_set(spark: SparkSession, d: str) -> DataFrame:
    """What edges begin or end at: the ends go through one exchange, so that a task holds its share of the URIs and no edges besides."""
    e = g.edges(spark, d, once=False).where("object_kind = 'uri' AND predicate_local_name <> 'partOf'")
    return e.select(F.col("source_uri").alias("uri")).union(e.select("target_uri")).distinct()


def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Multi-get by key: keys are deduplicated, those without a node drop out."""
    keys = g.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return g.table(spark, d, "part").join(keys, "p_partkey", "left_semi").select("p_partkey", "p_name")


def node_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    def typed(t: str, types) -> DataFrame:
        return g.table(spark, d, t).select(types.alias("types"))

    owl = "http://www.w3.org/2002/07/owl#"
    rows = (
        typed("customer", F.array(F.concat(F.lit(NS), F.col("c_mktsegment")), F.lit(NS + "ZZ")))
        .union(typed("orders", F.array(F.lit(NS + "Debt"), F.lit(NS + "Article"))))
        .union(typed("nation", F.array(F.lit(owl + "Class"))))
        .union(typed("region", F.array(F.lit(owl + "Ontology"))))
        .union(typed("part", F.array().cast("array<string>")))
    )
    return rows.groupBy(build.node_kind(F.col("types"), NS).alias("node_kind")).agg(F.count(F.lit(1)).alias("n"))


def dedupe_triples(spark: SparkSession, d: str) -> DataFrame:
    return g.table(spark, d, "lineitem").select(g.uri("o", "l_orderkey").alias("s"), F.lit("suppliedBy").alias("p"), g.uri("s", "l_suppkey").alias("o")).dropDuplicates()


def triple_keys(spark: SparkSession, d: str) -> DataFrame:
    e = g.edges(spark, d).where("predicate_local_name IN ('inRegion', 'label')")
    value = F.when(F.col("object_kind") == "literal", F.col("target_uri"))
    rows = e.select("source_uri", "predicate_local_name", "object_kind", F.when(value.isNull(), F.col("target_uri")).alias("target_uri"), value.alias("literal_value"))
    return rows.select("source_uri", "predicate_local_name", build.edge_key(rows.columns).alias("edge_key"))


def class_closure(spark: SparkSession, d: str) -> DataFrame:
    """What is below two regions: nations, suppliers in a chain as long as their number, and a cycle."""
    pairs = g.edges(spark, d).where("predicate_local_name IN ('inNation', 'inRegion') AND source_uri NOT LIKE 'c%' AND source_uri NOT LIKE 's%'").select(F.col("source_uri").alias("child"), F.col("target_uri").alias("parent"))
    suppliers = g.table(spark, d, "supplier")
    above = F.when(F.col("s_suppkey") == 1, F.lit("n3")).otherwise(F.concat(F.lit("s"), (F.col("s_suppkey") - 1).cast("string")))
    pairs = pairs.union(suppliers.select(g.uri("s", "s_suppkey"), above)).union(suppliers.where("s_suppkey = 7").select(F.lit("r1"), F.lit("s7")))
    return build.closure(pairs, ["r1", "r3"])


def searchable_text(spark: SparkSession, d: str) -> DataFrame:
    rows = g.table(spark, d, "customer").join(g.table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    none = F.array().cast("array<string>")
    groups = {k: none for k in build.GROUPS} | {"labels_en": F.array("c_name"), "aliases_en": F.array("n_name"), "comments_other": F.when(F.col("c_acctbal") > 5000, F.array("c_mktsegment", "c_name")).otherwise(none)}
    types = F.array(F.concat(F.lit(NS), F.col("c_mktsegment")), F.lit(NS + "Customer"))
    uri = F.concat(F.lit(NS + "customer_"), F.col("c_custkey").cast("string"))
    return rows.select("c_custkey", build.searchable_text(uri, F.lit("Customer"), types, groups).alias("searchable_text"))


def literal_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = g.table(spark, d, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    first = F.concat(F.lit(" "), F.col("text"), F.lit("  "))
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit(build.LITERALS["aliases"])).otherwise(F.lit(build.LITERALS["labels"]))
    triples = docs.select(F.col("source").alias("s"), kind.alias("p"), first.alias("o"), F.lit("literal").alias("o_kind"), F.when(F.col("lang") == "en", F.lit("EN-us")).otherwise(F.col("lang")).alias("o_lang"))
    joined = lambda c: F.sha2(F.array_join(c, "|").cast("binary"), 256).alias(c)
    return build.literal_groups(triples).select("s", *map(joined, ["labels_en", "labels_other", "aliases_en", "aliases_other"]))


def kg_report(spark: SparkSession, d: str) -> DataFrame:
    orders, customers = g.table(spark, d, "orders"), g.table(spark, d, "customer")
    none = F.array().cast("array<string>")
    number = F.floor(F.col("o_orderkey") / F.when(F.col("o_orderkey") % 100 == 1, 2).otherwise(1)).cast("int")
    article = F.concat(F.lit(NS + "article_"), F.col("o_orderkey").cast("string"))
    articles = orders.select(article.alias("uri"), F.lit("Article").alias("node_kind"), number.alias("article_number"), F.lit(False).alias("retrieval_eligible"), F.when(F.col("o_orderstatus") != "P", F.array("o_orderstatus")).otherwise(none).alias("comments_ar"), F.when(F.col("o_totalprice") > 20000, F.array("o_orderpriority")).otherwise(none).alias("labels_ar"))
    concept = F.concat(F.lit(NS + "c"), F.col("c_custkey").cast("string"))
    concepts = customers.select(concept.alias("uri"), F.col("c_mktsegment").alias("node_kind"), F.lit(None).cast("int").alias("article_number"), (F.col("c_acctbal") > 0).alias("retrieval_eligible"), none.alias("comments_ar"), F.array("c_name").alias("labels_ar"))
    nodes = articles.union(concepts).withColumns({"labels_en": none, "labels_other": none})
    e = orders.select(F.concat(F.lit(NS + "c"), F.col("o_custkey").cast("string")).alias("source_uri"), F.when(F.col("o_totalprice") > 100000, F.lit("regulatedBy")).otherwise(F.lit("mentions")).alias("predicate_local_name"), article.alias("target_uri"))
    report = build.inspection_report(e, nodes, e, Settings(article_count=orders.count()))
    sizes = ["article_numbers", "articles_without_arabic_text", "articles_without_labels", "missing_article_numbers", "duplicate_article_numbers", "unreachable_article_numbers"]
    return report.select("triple_count", "node_count", "article_count", "eligible_count", "reachable_count", "is_valid", *[F.size(c).alias(f"n_{c}") for c in sizes])


def store_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = [g.table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n")) for t in TABLES]
    return reduce(DataFrame.union, counts)


def distinct_degree(spark: SparkSession, d: str) -> DataFrame:
    return g.packed(spark, d).degrees(spark).select("uri", "degree", "article_degree", F.round(scoring.specificity(F.col("degree")), 6).alias("specificity"))


def seed_selection(spark: SparkSession, d: str) -> DataFrame:
    return graph.select_seeds(g.hits(spark, d), g.SETTINGS).select("question_id", "uri", F.round("seed_score", 6).alias("seed_score"), "seed_rank")


def _walk(spark: SparkSession, d: str, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Evidence and related concepts, over a stored graph."""
    return graph.walk(g.seeds(spark), g.packed(spark, d), Settings(max_hops=hops))


def graph_hop1(spark: SparkSession, d: str) -> DataFrame:
    e = _walk(spark, d, 1)[0]
    return e.select("question_id", "issue_index", "uri", F.round("graph_score", 6).alias("graph_score"), "n_paths")


def graph_two_hop(spark: SparkSession, d: str) -> DataFrame:
    e = _walk(spark, d)[0]
    return e.select("question_id", "issue_index", "uri", F.round("graph_score", 6).alias("graph_score"), "n_paths")


def path_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _walk(spark, d)[0]
    return e.select("question_id", "issue_index", "uri", "n_paths", _path(F.get("support_paths", F.lit(0))["steps"]).alias("first_path"))


def related_concepts(spark: SparkSession, d: str) -> DataFrame:
    r = _walk(spark, d)[1]
    return r.select("question_id", "issue_index", "uri", F.round("score", 6).alias("score"))


def expanded_concepts(spark: SparkSession, d: str) -> DataFrame:
    r = _walk(spark, d)[1]
    nodes = node_set(spark, d).select("uri", F.concat(F.lit("local_"), F.col("uri")).alias("local_name"), F.when(F.col("uri").startswith("r"), F.lit("Law")).otherwise(F.lit("Concept")).alias("node_kind"))
    return rank.expanded_concepts(r, nodes, g.SETTINGS).select("question_id", "uri", "local_name", F.round("graph_score", 6).alias("graph_score"), "rank")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    e = written(_walk(spark, d)[0], "evidence")  # read for the highest scores, the articles and the paths
    orders = g.table(spark, d, "orders").where("o_orderstatus <> 'P'")
    articles = orders.select(g.uri("o", "o_orderkey").alias("uri"), F.col("o_orderkey").cast("int").alias("article_number"), (F.col("o_orderkey") % 17 / 17).alias("issue_relevance"))
    keyed = e.select(*graph.KEYS, "uri").join(articles, "uri")
    return rank.rank_articles(e, keyed, g.SETTINGS)


def article_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("question_id", "issue_index", "uri", "article_number", F.round("final_score", 6).alias("final_score"), "n_paths", "rank")


def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    m = rank.merge_candidates(_ranked(spark, d), g.SETTINGS)
    return m.select("question_id", "uri", "article_number", "n_issues", F.round("graph_score", 6).alias("graph_score"), F.round("final_score", 6).alias("final_score"), F.size("support_paths").alias("n_paths"), "rank")


def selected_articles(spark: SparkSession, d: str) -> DataFrame:
    m = written(rank.merge_candidates(_ranked(spark, d), g.SETTINGS, with_paths=False), "merged")  # read twice
    # A selection in an order of its own, with a repeat and a number that is no candidate.
    chosen = m.groupBy("question_id").agg(F.reverse(F.array_sort(F.collect_list("article_number"))).alias("n"))
    chosen = chosen.select("question_id", F.concat(F.array(F.lit(-1)), "n", "n").alias("selected_article_numbers"))
    return rank.selected_articles(chosen, m, g.SETTINGS).select("question_id", "article_number", "candidate_rank", "rank")


def keep_best(spark: SparkSession, d: str) -> DataFrame:
    return rank.keep_best(g.table(spark, d, "events"), ["user_id"], "value", "event_id").select("user_id", "event_id", "value")


def merge_concepts(spark: SparkSession, d: str) -> DataFrame:
    e = g.table(spark, d, "events")
    hits = e.select((F.col("event_id") % 7).cast("int").alias("question_id"), (1 + F.col("event_id") % 5).cast("int").alias("issue_index"), g.uri("u", "user_id").alias("uri"), (F.floor("value") / 100).alias("seed_score"))
    return rank.merge_concepts(rank.keep_best(hits, ["question_id", "issue_index", "uri"], "seed_score", "uri"), g.SETTINGS).select("question_id", "uri", "issue_index", "seed_score", "rank")


_E = g.EXPAND_SQL
_RANKED = f"""{_E},
ranked AS (
  SELECT * FROM (
    SELECT e.question_id, e.issue_index, e.uri, e.article_number, e.issue_relevance, e.graph_score, e.n_paths, e.final_score,
           row_number() OVER (PARTITION BY question_id, issue_index ORDER BY final_score DESC, graph_score DESC, article_number, uri) AS rank
    FROM (
      SELECT e.*, CAST(o_orderkey AS INTEGER) AS article_number, o_orderkey % 17 / CAST(17 AS DOUBLE) AS issue_relevance,
             least(1.25, CAST(0.75 AS DOUBLE) * graph_score / highest + CAST(0.25 AS DOUBLE) * (o_orderkey % 17 / CAST(17 AS DOUBLE)) + CAST(0.03 AS DOUBLE) * least(3, greatest(0, n_paths - 1))) AS final_score
      FROM (SELECT *, max(graph_score) OVER (PARTITION BY question_id, issue_index) AS highest FROM evidence) e
      JOIN orders ON uri = 'o' || o_orderkey AND o_orderstatus <> 'P') e) WHERE rank <= 8
), merged AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, graph_score DESC, article_number, uri) AS rank FROM (
    SELECT question_id, uri, min(article_number) AS article_number, count(DISTINCT issue_index) AS n_issues, max(graph_score) AS graph_score,
           max(final_score) + CAST(0.05 AS DOUBLE) * (count(DISTINCT issue_index) - 1) AS final_score FROM ranked GROUP BY ALL)) WHERE rank <= 12
)"""

QUERIES = {f.__name__: f for f in (edge_view, edges_by_frontier, node_set, node_lookup, node_kind_counts, dedupe_triples, triple_keys, class_closure, searchable_text, literal_groups, kg_report, store_counts, distinct_degree, seed_selection, graph_hop1, graph_two_hop, path_counts, related_concepts, expanded_concepts, article_rank, candidate_merge, selected_articles, keep_best, merge_concepts)}

ORACLE_SQL = {
    "edge_view": f"WITH {g.VIEW_SQL} SELECT * FROM view",
    "edges_by_frontier": f"WITH {g.VIEW_SQL} SELECT cur, nbr, direction, relation FROM view WHERE cur IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 2)",
    "node_set": f"WITH {g.EDGES_SQL} SELECT source_uri AS uri FROM edges UNION SELECT target_uri FROM edges",
    "node_lookup": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)",
    "node_kind_counts": """SELECT node_kind, count(*) AS n FROM (
        SELECT least(c_mktsegment, 'ZZ') AS node_kind FROM customer UNION ALL SELECT 'Article' FROM orders UNION ALL SELECT 'OntologyClass' FROM nation
        UNION ALL SELECT 'Ontology' FROM region UNION ALL SELECT 'Resource' FROM part) GROUP BY node_kind""",
    "dedupe_triples": "SELECT DISTINCT 'o' || l_orderkey AS s, 'suppliedBy' AS p, 's' || l_suppkey AS o FROM lineitem",
    "triple_keys": """SELECT source_uri, predicate_local_name, sha256('{"source_uri":"' || source_uri || '","predicate_local_name":"' || predicate_local_name || '","object_kind":"' || object_kind || '","target_uri":' || coalesce('"' || target_uri || '"', 'null') || ',"literal_value":' || coalesce('"' || literal_value || '"', 'null') || '}') AS edge_key
        FROM (SELECT 'n' || n_nationkey AS source_uri, 'inRegion' AS predicate_local_name, 'uri' AS object_kind, 'r' || n_regionkey AS target_uri, NULL AS literal_value FROM nation
              UNION ALL SELECT 'n' || n_nationkey, 'label', 'literal', NULL, n_name FROM nation)""",
    "class_closure": """WITH RECURSIVE pairs AS (SELECT 's' || s_suppkey AS child, CASE WHEN s_suppkey = 1 THEN 'n3' ELSE 's' || (s_suppkey - 1) END AS parent FROM supplier UNION ALL SELECT 'r1', 's7' FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
        below(uri) AS (SELECT * FROM (VALUES ('r1'), ('r3')) UNION SELECT child FROM pairs JOIN below ON parent = uri) SELECT uri FROM below""",
    "searchable_text": """SELECT c_custkey, concat_ws(chr(10), 'Local name: customer_' || c_custkey, 'Node kind: Customer', 'RDF types: ' || least(c_mktsegment, 'Customer') || ', ' || greatest(c_mktsegment, 'Customer'),
        'English labels: ' || c_name, 'English aliases: ' || n_name, CASE WHEN c_acctbal > 5000 THEN 'Other text: ' || c_mktsegment || chr(10) || c_name END) AS searchable_text
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "literal_groups": """SELECT s, sha256(coalesce(string_agg(v, '|' ORDER BY v) FILTER (k = 'labels_en'), '')) AS labels_en, sha256(coalesce(string_agg(v, '|' ORDER BY v) FILTER (k = 'labels_other'), '')) AS labels_other,
        sha256(coalesce(string_agg(v, '|' ORDER BY v) FILTER (k = 'aliases_en'), '')) AS aliases_en, sha256(coalesce(string_agg(v, '|' ORDER BY v) FILTER (k = 'aliases_other'), '')) AS aliases_other
        FROM (SELECT DISTINCT source AS s, CASE WHEN doc_id % 3 = 0 THEN 'aliases_' ELSE 'labels_' END || CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS k, trim(text, ' ') AS v
              FROM documents WHERE source IS NOT NULL AND text IS NOT NULL) WHERE v <> '' GROUP BY s""",
    "kg_report": """WITH a AS (SELECT o_orderkey AS k, CAST(floor(o_orderkey / CASE WHEN o_orderkey % 100 = 1 THEN 2 ELSE 1 END) AS INTEGER) AS num, * FROM orders),
        x AS (SELECT CAST(range AS INTEGER) AS num FROM range(1, (SELECT count(*) + 1 FROM orders))),
        r AS (SELECT DISTINCT CAST(o_orderkey AS INTEGER) AS num FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_totalprice > 100000)
        SELECT (SELECT count(*) FROM orders) AS triple_count, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS node_count, (SELECT count(*) FROM orders) AS article_count,
        (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS eligible_count, (SELECT count(*) FROM r) AS reachable_count, false AS is_valid,
        CAST((SELECT count(DISTINCT num) FROM a) AS INTEGER) AS n_article_numbers, CAST((SELECT count(*) FROM a WHERE o_orderstatus = 'P') AS INTEGER) AS n_articles_without_arabic_text,
        CAST((SELECT count(*) FROM a WHERE o_totalprice <= 20000) AS INTEGER) AS n_articles_without_labels, CAST((SELECT count(*) FROM x WHERE num NOT IN (SELECT num FROM a)) AS INTEGER) AS n_missing_article_numbers,
        CAST((SELECT count(*) FROM (SELECT num FROM a GROUP BY num HAVING count(*) > 1)) AS INTEGER) AS n_duplicate_article_numbers, CAST((SELECT count(*) FROM x WHERE num NOT IN (SELECT num FROM r)) AS INTEGER) AS n_unreachable_article_numbers""",
    "store_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES),
    "distinct_degree": f"WITH {g.VIEW_SQL} SELECT uri, degree, article_degree, round(1 / (1 + ln(1 + CAST(degree AS DOUBLE))), 6) AS specificity FROM degrees",
    "seed_selection": """SELECT question_id, uri, round(seed_score, 6) AS seed_score, CAST(n AS INTEGER) AS seed_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seed_score DESC, uri) AS n, max(seed_score) OVER (PARTITION BY question_id) AS top FROM (
          SELECT n_regionkey AS question_id, 'n' || n_nationkey AS uri, CAST(0.02 AS DOUBLE) * n_nationkey AS seed_score FROM nation
          UNION ALL SELECT CAST(s_suppkey % 5 AS INTEGER), 's' || s_suppkey, s_acctbal / 10000 FROM supplier) WHERE seed_score > 0)
        WHERE (seed_score >= greatest(CAST(0.28 AS DOUBLE), CAST(0.70 AS DOUBLE) * top) OR n = 1) AND n <= 4""",
    "graph_hop1": f"WITH {_E} SELECT question_id, issue_index, uri, round(max(score), 6) AS graph_score, CAST(least(5, count(*)) AS INTEGER) AS n_paths FROM hop1 WHERE to_article GROUP BY ALL",
    "graph_two_hop": f"WITH {_E} SELECT question_id, issue_index, uri, round(graph_score, 6) AS graph_score, n_paths FROM evidence",
    "path_counts": f"WITH {_E} SELECT question_id, issue_index, uri, n_paths, replace(replace(first_path, chr(1), '|'), chr(2), '>') AS first_path FROM evidence",
    "related_concepts": f"WITH {_E} SELECT question_id, issue_index, uri, round(max(score), 6) AS score FROM arrivals a WHERE NOT to_article AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.question_id = a.question_id AND s.issue_index = a.issue_index AND s.uri = a.uri) GROUP BY ALL",
    "expanded_concepts": f"""WITH {_E}, related AS (SELECT question_id, uri, max(score) AS score FROM arrivals a WHERE NOT to_article AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.question_id = a.question_id AND s.issue_index = a.issue_index AND s.uri = a.uri) GROUP BY ALL)
        SELECT * FROM (SELECT question_id, uri, 'local_' || uri AS local_name, round(score, 6) AS graph_score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, uri) AS INTEGER) AS rank FROM related WHERE NOT starts_with(uri, 'r')) WHERE rank <= 16""",
    "article_rank": f"WITH {_RANKED} SELECT question_id, issue_index, uri, article_number, round(final_score, 6) AS final_score, n_paths, CAST(rank AS INTEGER) AS rank FROM ranked",
    "candidate_merge": f"""WITH {_RANKED}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, issue_index, uri ORDER BY seed_rank, hop, path) AS n FROM arrivals WHERE to_article) WHERE n <= 5),
        np AS (SELECT k.question_id, k.uri, CAST(count(DISTINCT seed_uri || ' ' || replace(replace(path, 'outgoing', ''), 'incoming', '')) AS INTEGER) AS n_paths FROM kept k JOIN ranked r ON k.question_id = r.question_id AND k.issue_index = r.issue_index AND k.uri = r.uri GROUP BY ALL)
        SELECT m.question_id, m.uri, article_number, n_issues, round(graph_score, 6) AS graph_score, round(final_score, 6) AS final_score, np.n_paths, CAST(rank AS INTEGER) AS rank FROM merged m JOIN np ON m.question_id = np.question_id AND m.uri = np.uri""",
    "selected_articles": f"""WITH {_RANKED} SELECT question_id, article_number, CAST(rank AS INTEGER) AS candidate_rank, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY article_number DESC) AS n FROM merged) WHERE n <= 5""",
    "keep_best": "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) = 1",
    "merge_concepts": """WITH h AS (SELECT CAST(event_id % 7 AS INTEGER) AS question_id, CAST(1 + event_id % 5 AS INTEGER) AS issue_index, 'u' || user_id AS uri, max(floor(value)) / 100 AS seed_score FROM events GROUP BY ALL),
        b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY question_id, uri ORDER BY seed_score DESC, issue_index) = 1)
        SELECT question_id, uri, issue_index, seed_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seed_score DESC, uri) AS rank FROM b) JOIN (SELECT question_id AS q, greatest(16, 4 * max(issue_index)) AS lim FROM h GROUP BY question_id) ON q = question_id WHERE rank <= lim""",
}
