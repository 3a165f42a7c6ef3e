"""Queries of stores, projections, documents, structured replies and benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst import evaluation
from karst.functions import text
from karst.operators import answers, build, graph, planning, rank
from karst.operators import evaluate as ev
from karst.plans import graph_queries
from karst.plans import standin as g
from karst.settings import Settings
from karst.sources import documents, models, store, versions
from karst.sources.scratch import shared_dir
from karst.sources.structured import structured

NS = "http://example.org/law#"


def _strings(*values) -> F.Column:
    return F.array(*values) if values else F.array().cast("array<string>")


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Customers: their nation, a name in one of three languages, and a typed balance."""
    c = g.table(spark, d, "customer")
    s, k = F.concat(F.lit(NS + "c"), F.col("c_custkey").cast("string")), F.col("c_custkey")
    null = F.lit(None).cast("string")
    parts = [
        (NS + "inNation", F.concat(F.lit(NS + "n"), F.col("c_nationkey").cast("string")), "uri", null, null),
        (build.LITERALS["labels"], F.col("c_name"), "literal", F.when(k % 3 == 0, F.lit("ar")).when(k % 3 == 1, F.lit("en")), null),
        (NS + "balance", F.floor("c_acctbal").cast("string"), "literal", null, F.lit("http://www.w3.org/2001/XMLSchema#integer")),
    ]
    rows = [c.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), lang.alias("o_lang"), data.alias("o_datatype")) for p, o, kind, lang, data in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def edge_extraction(spark: SparkSession, d: str) -> DataFrame:
    return build.edges_of_triples(_triples(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Node rows: orders are articles (some without a number), customers concepts."""
    o, c = g.table(spark, d, "orders"), g.table(spark, d, "customer")
    none = _strings()
    articles = o.select(g.uri("o", "o_orderkey").alias("uri"), F.lit("Article").alias("node_kind"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey").cast("int")).alias("article_number"), F.lit(False).alias("retrieval_eligible"), F.when(F.col("o_orderstatus") == "F", F.array("o_orderpriority")).otherwise(none).alias("labels_ar"), none.alias("labels_en"), F.col("o_orderpriority").alias("searchable_text"))
    concepts = c.select(g.uri("c", "c_custkey").alias("uri"), F.lit("Concept").alias("node_kind"), F.lit(None).cast("int").alias("article_number"), (F.col("c_acctbal") > 0).alias("retrieval_eligible"), none.alias("labels_ar"), F.array("c_name", "c_mktsegment").alias("labels_en"), F.col("c_mktsegment").alias("searchable_text"))
    return articles.union(concepts)


def stored_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Rows as they are stored: empty arrays are null, missing columns too."""
    rows = store.stored(_nodes(spark, d), store.NODE_SCHEMA)
    joined = lambda c: F.array_join(c, "|").alias(c)
    return rows.select("uri", "node_kind", "article_number", joined("labels_ar"), joined("labels_en"), F.col("embedding").isNull().alias("bare"), "local_name")


def stored_edges(spark: SparkSession, d: str) -> DataFrame:
    return store.stored(build.edges_of_triples(_triples(spark, d)).drop("literal_datatype"), store.EDGE_SCHEMA)


def store_columns(spark: SparkSession, d: str) -> DataFrame:
    """What the edge store's columns are for, and how many of its rows have each."""
    rows = store.stored(build.edges_of_triples(_triples(spark, d)), store.EDGE_SCHEMA)
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).unpivot([], rows.columns, "column", "filled")
    return store.described(spark, rows.schema).join(counts, "column")


def store_update(spark: SparkSession, d: str) -> DataFrame:
    """A store of customers and what an update makes of it: some are gone, some changed, some new; the version of each row tells which were written again."""
    c = g.table(spark, d, "customer")
    folder = shared_dir(spark, "store")
    name, schema = "store_" + folder.rpartition("-")[2], T.StructType([f for f in store.NODE_SCHEMA if f.name in ("uri", "labels_en", "searchable_text")])

    def rows(kept, text) -> DataFrame:
        return c.where(kept).select(g.uri("c", "c_custkey").alias("uri"), F.array("c_name").alias("labels_en"), text.alias("searchable_text"))

    for kept, segment in (("c_custkey % 4 > 0", F.col("c_mktsegment")), ("c_custkey % 3 > 0", F.when(F.col("c_custkey") % 5 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))):
        versions.update(spark, name, rows(kept, segment), schema, F.col("uri"), folder=folder)
    newest = spark.table(versions.log_of(name)).groupBy("uri").agg(F.max("_version").alias("version"))
    return spark.table(name).join(newest, "uri").select("uri", F.array_join("labels_en", "|").alias("labels_en"), "searchable_text", "version")


def eligible_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The projected scan of a search: eligible concepts only."""
    return rank.eligible(_nodes(spark, d)).select("uri", "searchable_text")


def valid_articles(spark: SparkSession, d: str) -> DataFrame:
    return rank.valid_articles(_nodes(spark, d)).select("uri", "article_number", text.article_text(F.col("labels_ar"), F.col("labels_en"), F.col("searchable_text")).alias("full"))


def article_uris(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    forms = F.array(F.concat(F.lit(NS + "article_"), k), F.concat(F.lit(NS + "xarticle_"), k), F.concat(F.lit(NS + "article_"), k, F.lit("b")), F.concat(F.lit("http://example.com/law#article_"), k))
    rows = g.table(spark, d, "pages").select("page_id", F.get(forms, (F.col("page_id") % 4).cast("int")).alias("uri"))
    return rows.select("page_id", graph.is_uri_of(NS)(F.col("uri")).alias("is_article"))


def namespace_walk(spark: SparkSession, d: str) -> DataFrame:
    """One hop in which neighbours beyond a namespace are left out unless they are articles."""
    walks = graph.expand(g.seeds(spark), g.view(spark, d), Settings(max_hops=1), in_namespace=lambda u: u.startswith("s"))
    return walks.select("question_id", "issue_index", "seed_uri", "uri", F.round("score", 6).alias("score"))


def evidence_export(spark: SparkSession, d: str) -> DataFrame:
    """Candidates as they are exported: numbers to eight places."""
    m = rank.merge_candidates(graph_queries._ranked(spark, d), g.SETTINGS, with_paths=False)
    return m.select("question_id", "article_number", F.round("graph_score", 8).alias("graph_score"), F.round("final_score", 8).alias("final_score"))


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("a"))] for t in texts]


def zip_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors meet their rows by position, whatever the batches."""
    rows = g.table(spark, d, "customer").select("c_custkey", "c_name")
    out = store.embed(rows, _lengths, "c_name", 7)
    return out.select("c_custkey", F.get("embedding", F.lit(0)).cast("int").alias("x"), F.get("embedding", F.lit(1)).cast("int").alias("y"))


def token_usage(spark: SparkSession, d: str) -> DataFrame:
    e = g.table(spark, d, "events").select("user_id", F.struct((F.col("event_id") % 100).alias("input_tokens"), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 10).alias("output_tokens")).alias("tokens"))
    return models.usage_total(e, ["user_id"])


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    p = g.table(spark, d, "orders").join(g.table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    hints = F.array(F.lit("  "), F.col("o_orderpriority"), F.col("c_mktsegment"))
    return p.select("o_orderkey", text.embedding_text(F.col("c_mktsegment"), F.concat(F.lit(" "), F.col("o_orderstatus")), hints).alias("text"))


def outermost_json(spark: SparkSession, d: str) -> DataFrame:
    e = g.table(spark, d, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.concat(F.lit("Here: "), F.col("props"), F.lit(" done")))
    return e.select("event_id", text.outermost_json(reply).alias("found"))


def compact_json(spark: SparkSession, d: str) -> DataFrame:
    o = g.table(spark, d, "orders")
    row = F.struct("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("priority"), F.array("o_custkey").alias("customers"))
    return o.select("o_orderkey", documents.to_document(row).alias("document"))


SCHEMA = {
    "type": "object", "required": ["n", "kind"],
    "properties": {"n": {"type": "integer", "minimum": 0, "maximum": 50}, "kind": {"type": "string", "enum": ["a", "b"]}, "share": {"type": ["number", "null"]}, "parts": {"type": "array", "maxItems": 2, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string", "minLength": 1}}}}},
}
PARSED = T.StructType([T.StructField("n", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("parts", T.ArrayType(T.StructType([T.StructField("k", T.StringType())])))])
#: Replies by the number of an event: its text, and what is wrong with it.
REPLIES = [
    ('{{"n": {k}, "kind": "a"}}', None), ('{{"n": {k}, "kind": "b", "share": null, "parts": [{{"k": "x"}}]}}', None), ('{{"n": "{k}", "kind": "a"}}', "wrong_type $.n"), ('{{"n": {k}.5, "kind": "a"}}', "wrong_type $.n"),
    ('{{"n": {k} }}', "missing_keys"), ('{{"n": {k}, "kind": "a", "z": 1}}', "unknown_keys"), ('{{"n": {k}, "kind": "c"}}', "not_in_enum $.kind"), ('{{"n": -1{k}, "kind": "a"}}', "out_of_bounds $.n"),
    ('{{"n": {k}, "kind": "a", "parts": [{{"k": "x"}}, {{"k": 1}}]}}', "wrong_type $.parts[].k"), ('{{"n": {k}, "kind": "a", "parts": [{{"q": 1}}]}}', "unknown_keys $.parts[]"), ('{{"n": {k}, "kind": "a", "parts": [1, 2, 3]}}', "out_of_bounds $.parts"), ('{{"n": {k}, "kind": "a"', "malformed"), ("[{k}]", "malformed"),
    ('{{"n": {k}, "kind": "a", "share": true}}', "wrong_type $.share"), ('{{"n": {k}, "kind": "a", "parts": [{{"k": ""}}]}}', "out_of_bounds $.parts[].k"),
]


def structured_output(spark: SparkSession, d: str) -> DataFrame:
    e = g.table(spark, d, "events")
    n = (F.col("event_id") % 51).cast("string")
    cases = [F.concat(*[x for part in t.replace("{{", "\0").replace("}}", "\1").split("{k}") for x in (F.lit(part.replace("\0", "{").replace("\1", "}")), n)][:-1]) for t, _ in REPLIES]
    reply = F.get(F.array(*cases), (F.col("event_id") % len(REPLIES)).cast("int"))
    x = structured(reply, SCHEMA, PARSED)
    return e.select("event_id", x["value"]["n"].alias("n"), x["error"].alias("error"))


def case_slice(spark: SparkSession, d: str) -> DataFrame:
    cases = g.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_index"), "o_custkey")
    return evaluation.sliced(cases, 20, 100)


def sorted_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of nodes in the order of their URIs, the first of each prefix."""
    nodes = graph_queries.node_set(spark, d).withColumn("prefix", F.substring("uri", 1, 2))
    return rank.numbered(nodes, "prefix", "uri").drop("prefix")


def out_of_scope_verdict(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    answer = F.when(k % 2 == 0, F.lit(answers.OUT_OF_SCOPE)).when(k % 3 == 0, F.lit("mixed خارج")).otherwise(F.lit(" "))
    verdict = evaluation.out_of_scope_correct(F.when(k % 5 > 0, F.lit("abstain")).otherwise(F.lit("retrieve")), F.when(k % 7 > 0, F.lit("out_of_scope")).otherwise(F.lit("generated")), answer, F.when(k % 11 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return g.table(spark, d, "events").select("event_id", verdict.alias("correct"))


def resume_identity(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a run that are of other cases than the benchmark's."""
    o = g.table(spark, d, "orders")
    cases = o.select(F.col("o_orderkey").alias("case_index"), g.uri("c", "o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("question"))
    rows = o.select(F.col("o_orderkey").alias("case_index"), F.when(F.col("o_orderkey") % 9 == 0, F.lit("other")).otherwise(g.uri("c", "o_orderkey")).alias("case_id"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("?")).otherwise(F.col("o_orderpriority")).alias("question"))
    return evaluation.foreign_rows(rows, cases).select("case_index")


def nested_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics over runs of numbers and truths that stand deep in their documents."""
    e = g.table(spark, d, "events")
    runs = e.groupBy((F.col("user_id") % 4).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    runs = runs.select(F.lit(True).alias("complete"), F.struct(F.struct(F.col("n").alias("cases"), (F.col("run") % 2 == 0).alias("passed")).alias("all"), F.col("top").alias("top")).alias("summary"))
    return ev.nested_stats(runs, ["summary.all.cases", "summary.all.passed", "summary.top"])


def issue_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = g.table(spark, d, "orders").join(g.table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    empty = F.array().cast("array<string>")
    one = lambda i, t: F.struct(F.concat(F.lit(i), F.col(t)).alias("issue"), F.col(t).alias("retrieval_query"), empty.alias("concept_hints"), empty.alias("actors"), empty.alias("conditions"), empty.alias("numbers"), F.lit("").alias("requested_result"))
    issues = F.slice(F.array(one("a ", "o_orderpriority"), one("b ", "c_mktsegment"), one("c ", "c_name")), F.lit(1), (F.col("o_orderkey") % 4).cast("int"))
    plan = F.struct(F.when(F.col("o_orderkey") % 6 == 0, F.lit("abstain")).otherwise(F.lit("retrieve")).alias("decision"), issues.alias("atomic_issues"))
    plans = o.select(F.col("o_orderkey").alias("question_id"), plan.alias("plan"))
    return planning.explode_issues(plans).select("question_id", "issue_index", "issue", "retrieval_query")


def citations_of(spark: SparkSession, d: str) -> DataFrame:
    lines = g.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("int").alias("n"))
    article = F.struct(F.col("n").alias("article_number"), F.array(F.concat(F.lit("A"), F.col("n").cast("string"))).alias("labels_ar"), g.uri("p", "n").alias("uri"), F.concat(F.lit(" text\n of  "), F.col("n").cast("string")).alias("text"))
    rows = lines.groupBy("l_orderkey").agg(F.collect_list(article).alias("articles"), F.sort_array(F.collect_set("n"), asc=False).alias("cited"))
    out = rows.select("l_orderkey", F.posexplode(answers.citations_of(F.slice("cited", 1, 2), F.col("articles"))).alias("place", "c"))
    return out.select("l_orderkey", "place", "c.article_number", "c.label", "c.uri", "c.excerpt")


def judge_grades(spark: SparkSession, d: str) -> DataFrame:
    e, k = g.table(spark, d, "events"), F.col("event_id")
    reply = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit('{"correctness": '), (k % 4 - 1).cast("string"), F.lit(', "faithfulness": '), (k % 5).cast("string"), F.lit("}")))
    x = structured(reply, evaluation.GRADES, evaluation.GRADED)
    return e.select("event_id", (x["value"]["correctness"] / 2).alias("correctness"), (x["value"]["faithfulness"] / 2).alias("faithfulness"), x["error"].alias("error"))


QUERIES = {f.__name__: f for f in (edge_extraction, stored_nodes, stored_edges, store_columns, store_update, eligible_nodes, valid_articles, article_uris, namespace_walk, evidence_export, zip_embeddings, token_usage, embedding_text, outermost_json, compact_json, structured_output, case_slice, sorted_nodes, out_of_scope_verdict, resume_identity, nested_metrics, issue_pairs, citations_of, judge_grades)}

_EDGES = f"""SELECT '{NS}c' || c_custkey AS source_uri, '{NS}inNation' AS predicate_uri, 'inNation' AS predicate_local_name, 'uri' AS object_kind, '{NS}n' || c_nationkey AS target_uri, NULL AS literal_value, NULL AS literal_language, NULL AS literal_datatype FROM customer
    UNION ALL SELECT '{NS}c' || c_custkey, '{build.LITERALS["labels"]}', 'label', 'literal', NULL, c_name, CASE c_custkey % 3 WHEN 0 THEN 'ar' WHEN 1 THEN 'en' END, NULL FROM customer
    UNION ALL SELECT '{NS}c' || c_custkey, '{NS}balance', 'balance', 'literal', NULL, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), NULL, 'http://www.w3.org/2001/XMLSchema#integer' FROM customer"""
_ERRORS = " ".join(f"WHEN {i} THEN " + ("NULL" if e is None else f"'{e}'") for i, (_, e) in enumerate(REPLIES))
_GOOD = ", ".join(str(i) for i, (_, e) in enumerate(REPLIES) if e is None)

_EDGE_COLUMNS = ("source_uri", "predicate_uri", "predicate_local_name", "object_kind", "target_uri", "literal_value", "literal_language", "literal_datatype")

ORACLE_SQL = {
    "edge_extraction": _EDGES,
    "stored_nodes": """SELECT 'o' || o_orderkey AS uri, 'Article' AS node_kind, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey AS INTEGER) END AS article_number, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS labels_ar, NULL AS labels_en, true AS bare, NULL AS local_name FROM orders
        UNION ALL SELECT 'c' || c_custkey, 'Concept', NULL, NULL, c_name || '|' || c_mktsegment, true, NULL FROM customer""",
    "stored_edges": f"SELECT * REPLACE (CAST(NULL AS VARCHAR) AS literal_datatype) FROM ({_EDGES})",
    "store_columns": "SELECT v.*, filled FROM (VALUES " + ", ".join(f"('{c}', 'string', '{'word' if c == 'literal_value' else 'field'}', {str(c == 'literal_value').lower()}, {str(c != 'literal_value').lower()})" for c in _EDGE_COLUMNS) + ') v("column", type, tokenization, searchable, filterable) JOIN (' + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS filled FROM ({_EDGES})" for c in _EDGE_COLUMNS) + ') USING ("column")',
    "store_update": """SELECT 'c' || c_custkey AS uri, c_name AS labels_en, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS searchable_text,
        CAST(CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM customer WHERE c_custkey % 3 > 0""",
    "eligible_nodes": "SELECT 'c' || c_custkey AS uri, c_mktsegment AS searchable_text FROM customer WHERE c_acctbal > 0",
    "valid_articles": "SELECT 'o' || o_orderkey AS uri, CAST(o_orderkey AS INTEGER) AS article_number, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ' ' ELSE '' END || o_orderpriority AS \"full\" FROM orders WHERE o_orderkey % 5 > 0",
    "article_uris": "SELECT page_id, page_id % 4 = 0 AS is_article FROM pages",
    "namespace_walk": f"WITH {g.EXPAND_SQL} SELECT question_id, issue_index, seed_uri, uri, round(score, 6) AS score FROM hop1 WHERE to_article OR starts_with(uri, 's')",
    "evidence_export": f"WITH {graph_queries._RANKED} SELECT question_id, article_number, round(graph_score, 8) AS graph_score, round(final_score, 8) AS final_score FROM merged",
    "zip_embeddings": "SELECT c_custkey, CAST(length(c_name) AS INTEGER) AS x, CAST(length(c_name) - length(replace(c_name, 'a', '')) AS INTEGER) AS y FROM customer",
    "token_usage": "SELECT user_id, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(coalesce(sum(event_id % 10) FILTER (event_id % 7 > 0), 0) AS BIGINT) AS output_tokens, CAST(sum(event_id % 100) + coalesce(sum(event_id % 10) FILTER (event_id % 7 > 0), 0) AS BIGINT) AS total_tokens FROM events GROUP BY user_id",
    "embedding_text": "SELECT o_orderkey, concat_ws(' ', c_mktsegment, o_orderstatus, o_orderpriority) AS text FROM orders JOIN customer ON o_custkey = c_custkey",
    "outermost_json": "SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN props END AS found FROM events",
    "compact_json": """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","priority":' || CASE WHEN o_orderkey % 2 = 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || ',"customers":[' || o_custkey || ']}' AS document FROM orders""",
    "structured_output": f"SELECT event_id, CASE WHEN event_id % {len(REPLIES)} IN ({_GOOD}) THEN event_id % 51 END AS n, CASE event_id % {len(REPLIES)} {_ERRORS} END AS error FROM events",
    "case_slice": "SELECT CAST(n - 20 AS BIGINT) AS case_index, o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n >= 20 AND n < 120",
    "sorted_nodes": f"WITH {g.EDGES_SQL}, nodes AS (SELECT source_uri AS uri FROM edges UNION SELECT target_uri FROM edges) SELECT uri, CAST(row_number() OVER (PARTITION BY substr(uri, 1, 2) ORDER BY uri) AS INTEGER) AS n FROM nodes",
    "out_of_scope_verdict": "SELECT event_id, event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 2 = 0 AND event_id % 11 > 0 AS correct FROM events",
    "resume_identity": "SELECT o_orderkey AS case_index FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 0",
    "nested_metrics": """WITH r AS (SELECT user_id % 4 AS run, CAST(count(*) AS DOUBLE) AS n, max(value) AS top FROM events GROUP BY user_id % 4),
        m AS (SELECT 'summary.all.cases' AS metric, n AS v FROM r UNION ALL SELECT 'summary.all.passed', CASE WHEN run % 2 = 0 THEN 1 ELSE 0 END FROM r UNION ALL SELECT 'summary.top', top FROM r)
        SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM m GROUP BY metric""",
    "issue_pairs": """SELECT question_id, i AS issue_index, CASE i WHEN 1 THEN 'a ' || p WHEN 2 THEN 'b ' || m ELSE 'c ' || c END AS issue, CASE i WHEN 1 THEN p WHEN 2 THEN m ELSE c END AS retrieval_query
        FROM (SELECT o_orderkey AS question_id, o_orderpriority AS p, c_mktsegment AS m, c_name AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 6 <> 0), (SELECT CAST(range AS INTEGER) AS i FROM range(1, 4)) WHERE i <= question_id % 4""",
    "citations_of": """SELECT l_orderkey, CAST(k - 1 AS INTEGER) AS place, n AS article_number, 'A' || n AS label, 'p' || n AS uri, 'text of ' || n AS excerpt FROM (
        SELECT l_orderkey, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC) AS k FROM (SELECT DISTINCT l_orderkey, CAST(l_partkey * 10 + l_linenumber AS INTEGER) AS n FROM lineitem)) WHERE k <= 2""",
    "judge_grades": """SELECT event_id, CASE WHEN event_id % 4 > 0 AND event_id % 5 < 3 THEN (event_id % 4 - 1) / CAST(2 AS DOUBLE) END AS correctness, CASE WHEN event_id % 4 > 0 AND event_id % 5 < 3 THEN (event_id % 5) / CAST(2 AS DOUBLE) END AS faithfulness,
        CASE WHEN event_id % 4 = 0 THEN 'malformed' WHEN event_id % 5 > 2 THEN 'out_of_bounds $.faithfulness' END AS error FROM events""",
}
