"""Queries of evaluation: metrics per case, summaries of runs, statistics, failures and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.operators import evaluate as ev
from karst.plans.standin import table

#: Details of failures, by the number of an event.
DETAILS = [
    "Query planner failed. Provider=p Error=ValueError: bad plan",
    "Structured-output validation failed for plan",
    "Answer generation failed. Error=TimeoutError: read timed out",
    "Article reranker failed. Error=ValidationError: 1",
    "Cohere request failed. status=429",
    "Connection error",
    "Answer generation failed. Error=RuntimeError: x",
    "citation-repair retry failed. ValidationError: y",
]
URLS = ["http://h/retrieve", "http://h/generate/?debug=1", "http://h/other", "http://h/retrieve/"]


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """A case per order: required are its parts of the highest price, given those of its lines in their order."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 20).cast("int").alias("n"), F.floor("l_extendedprice").alias("price"))
    x = F.collect_list(F.struct("l_linenumber", "n", "price"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(x).alias("x"))
    n = lambda a: F.transform(a, lambda e: e["n"])
    dear = F.filter("x", lambda e: e["price"] > 60000)
    return rows.select(
        F.col("l_orderkey").alias("case_id"),
        F.when(F.col("l_orderkey") % 9 == 0, F.lit("abstain")).otherwise(F.lit("retrieve")).alias("expected"),
        F.when(F.col("l_orderkey") % 13 == 0, F.lit("abstain")).otherwise(F.lit("retrieve")).alias("actual"),
        n(dear).alias("required"),
        F.slice(n("x"), 1, 1).alias("acceptable"),
        F.when(F.col("l_orderkey") % 4 > 0, n("x")).alias("diagnosed"),
        F.reverse(n("x")).alias("from_articles"),
        F.filter(n("x"), lambda k: k % 3 > 0).alias("cited"),
    )


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    rows = _cases(spark, d).withColumn("given", ev.actual_numbers(F.col("diagnosed"), F.lit(None).cast("array<int>"), F.col("from_articles")))
    rows = rows.withColumns(ev.retrieval_metrics(F.col("expected"), F.col("actual"), F.col("required"), F.col("acceptable"), F.col("given")))
    cited = ev.citations_given(F.col("cited"), F.lit(""))
    rows = rows.withColumns(ev.citation_metrics(F.col("expected"), cited, F.col("given"), F.col("required")))
    rows = rows.withColumns({"correctness_grade": (F.col("case_id") % 3).cast("int"), "faithfulness_grade": (F.col("case_id") % 5 % 3).cast("int"), "oos": F.col("case_id") % 2 == 0})
    parts = {"expected": "expected", "routing": "routing_correct", "oos": "oos", "recall": "article_recall_at_5", "correctness_grade": "correctness_grade", "faithfulness_grade": "faithfulness_grade", "validity": "citation_validity", "citation_recall": "citation_recall"}
    return rows.withColumn("end_to_end_pass", ev.end_to_end_pass({k: F.col(v) for k, v in parts.items()}))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _evaluated(spark, d).select("case_id", "routing_correct", "hit_at_1", r("article_recall_at_5"), r("article_precision"))


def citation_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("case_id", F.round("citation_validity", 6).alias("citation_validity"), F.round("citation_recall", 6).alias("citation_recall"))


def e2e_pass(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("case_id", "end_to_end_pass")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows of three runs: an event each."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    return e.select(
        (F.col("user_id") % 3).cast("int").alias("run"),
        F.when(k % 10 == 0, F.lit("boom")).alias("error"),
        F.when(k % 4 == 0, F.lit("abstain")).otherwise(F.lit("retrieve")).alias("expected_behavior"),
        F.when(k % 21 > 0, F.col("event_type")).alias("test_type"),
        (k % 3 > 0).alias("end_to_end_pass"),
        (k % 5 > 0).alias("routing_correct"),
        (k % 7 > 1).alias("hit_at_1"),
        (k % 4 / 4).alias("article_recall_at_5"),
        F.when(k % 6 > 0, k % 6 / 8).alias("article_precision"),
        F.when(k % 8 > 0, k % 3 / 2).alias("correctness"),
        (k % 2 / 2).alias("faithfulness"),
        (k % 9 / 9).alias("citation_validity"),
        F.lit(None).cast("double").alias("citation_recall"),
        (k % 8 > 3).alias("out_of_scope_response_correct"),
        (k % 100 / 10).alias("retrieval_seconds"),
        (k % 50 / 10).alias("generation_seconds"),
    )


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.run_summary(_rows(spark, d), ["run"])


def summary_by_type(spark: SparkSession, d: str) -> DataFrame:
    return ev.summary_by_type(_rows(spark, d), ["run"])


METRICS = ["end_to_end_success_rate", "routing_accuracy", "hit_at_1", "article_precision", "correctness", "retrieval_latency"]


def run_stats(spark: SparkSession, d: str) -> DataFrame:
    runs = ev.run_summary(_rows(spark, d), ["run"]).withColumns({"model": F.when(F.col("run") < 2, F.lit("a")).otherwise(F.lit("b")), "complete": F.lit(True)})
    third = runs.where("run = 0").withColumns({"model": F.lit("c"), "complete": F.lit(False)})
    return ev.run_stats(runs.unionByName(third), METRICS, ["model"])


def _failures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.when(k % 17 == 0, F.lit(503)).otherwise(F.lit(500)).alias("status"), pick(DETAILS, k).alias("detail"), pick(URLS, F.floor(k / 8)).alias("url"))


def failure_classifier(spark: SparkSession, d: str) -> DataFrame:
    return _failures(spark, d).select("event_id", ev.is_contract_failure(F.col("status"), F.col("detail")).alias("contract_failure"), ev.failure_stage(F.col("url")).alias("stage"))


def contract_scoring(spark: SparkSession, d: str) -> DataFrame:
    rows = _failures(spark, d).where(ev.is_contract_failure(F.col("status"), F.col("detail")))
    metrics = {"hit_at_1": F.col("event_id") % 2 == 0, "article_precision": F.col("event_id") % 4 / 4, "correctness": F.lit(1.0), "citation_validity": F.lit(1.0)}
    return rows.select("event_id", *[c.alias(k) for k, c in ev.contract_scores(ev.failure_stage(F.col("url")), metrics).items()])


def integrity_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    warnings = F.when(k % 5 == 0, F.array(F.lit("x"), F.lit("note: Pipeline answer generation failed. y"))).when(k % 5 == 1, F.array(F.lit("fine")))
    error = ev.integrity_error(k % 11 > 0, F.when(k % 4 == 0, F.lit("abstain")).otherwise(F.lit("retrieve")), F.lit("generated"), warnings, F.col("event_type"), F.lit("click"))
    return table(spark, d, "events").select("event_id", error.alias("integrity_error"))


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """The cases of a run whose rows are the first two thirds of them, the last of which failed."""
    orders = table(spark, d, "orders")
    cases = orders.select(F.col("o_orderkey").alias("case_index"), "o_orderstatus")
    last = orders.agg(F.floor(F.max("o_orderkey") * 2 / 3).alias("last"))
    rows = cases.crossJoin(F.broadcast(last)).where("case_index <= last").select("case_index", F.when(F.col("case_index") == F.col("last"), F.lit("timeout")).alias("error"))
    return ev.to_resume(cases, rows)


QUERIES = {f.__name__: f for f in (retrieval_metrics, citation_metrics, e2e_pass, run_summary, summary_by_type, run_stats, failure_classifier, contract_scoring, integrity_check, resume_anti_join)}

# --- The same in SQL ------------------------------------------------------------------------------
_CASES = """x AS (SELECT l_orderkey AS case_id, list({'n': CAST(l_partkey % 20 AS INTEGER), 'p': floor(l_extendedprice)} ORDER BY l_linenumber, l_partkey % 20, floor(l_extendedprice)) AS x FROM lineitem GROUP BY l_orderkey),
c AS (SELECT case_id, CASE WHEN case_id % 9 = 0 THEN 'abstain' ELSE 'retrieve' END AS expected, CASE WHEN case_id % 13 = 0 THEN 'abstain' ELSE 'retrieve' END AS actual,
  list_transform(list_filter(x, lambda e: e.p > 60000), lambda e: e.n) AS required, list_transform(x, lambda e: e.n) AS ns FROM x),
o AS (SELECT *, CASE WHEN case_id % 4 > 0 THEN ns ELSE list_reverse(ns) END AS raw FROM c),
g AS (SELECT *, list_filter(raw, lambda v, k: list_position(raw, v) = k) AS given, list_distinct(list_filter(ns, lambda v: v % 3 > 0)) AS cited FROM o),
m AS (SELECT *, given[1:5] AS five, list_concat(required, ns[1:1]) AS relevant FROM g),
e AS (
  SELECT case_id, expected, expected = actual AS routing_correct, expected = 'retrieve' AND list_contains(relevant, five[1]) AS hit_at_1,
    CASE WHEN expected = 'abstain' THEN 0 WHEN len(required) = 0 THEN 1 ELSE len(list_intersect(list_distinct(five), list_distinct(required))) / CAST(len(list_distinct(required)) AS DOUBLE) END AS recall,
    CASE WHEN expected = 'abstain' OR len(five) = 0 THEN 0 ELSE len(list_intersect(list_distinct(five), list_distinct(relevant))) / CAST(len(five) AS DOUBLE) END AS prec,
    CASE WHEN len(cited) = 0 THEN CASE WHEN expected = 'abstain' THEN 1 ELSE 0 END ELSE len(list_intersect(cited, given)) / CAST(len(cited) AS DOUBLE) END AS validity,
    CASE WHEN len(required) = 0 THEN 1 ELSE len(list_intersect(list_distinct(required), cited)) / CAST(len(list_distinct(required)) AS DOUBLE) END AS crecall
  FROM m)"""
_EVENTS = """r AS (SELECT CAST(user_id % 3 AS INTEGER) AS run, event_id % 10 <> 0 AS done, event_id % 4 = 0 AS abstain, CASE WHEN event_id % 21 > 0 THEN event_type ELSE 'unknown' END AS test_type, event_id AS k FROM events),
s AS (SELECT run, count(*) AS questions_requested, count(*) FILTER (done) AS questions_completed, count(*) FILTER (NOT done) AS questions_failed_to_run,
  {e2e} AS end_to_end_success_rate, {routing} AS routing_accuracy, {hit} AS hit_at_1, {recall} AS article_recall_at_5, {prec} AS article_precision, {oos} AS out_of_scope_accuracy,
  {corr} AS correctness, {faith} AS faithfulness, {valid} AS citation_validity, CAST(0 AS DOUBLE) AS citation_recall, {oosr} AS out_of_scope_response_accuracy, {rl} AS retrieval_latency, {gl} AS generation_latency FROM r GROUP BY run)""".format(
    **{
        k: f"coalesce(round(avg(CAST({v} AS DOUBLE)) FILTER ({w}), 6), 0)"
        for k, v, w in [
            ("e2e", "k % 3 > 0", "done"), ("routing", "k % 5 > 0", "done"), ("hit", "k % 7 > 1", "done AND NOT abstain"), ("recall", "k % 4 / 4", "done AND NOT abstain"),
            ("prec", "CASE WHEN k % 6 > 0 THEN k % 6 / 8 END", "done AND NOT abstain"), ("oos", "k % 5 > 0", "done AND abstain"), ("corr", "CASE WHEN k % 8 > 0 THEN k % 3 / 2 END", "done AND NOT abstain"),
            ("faith", "k % 2 / 2", "done AND NOT abstain"), ("valid", "k % 9 / 9", "done AND NOT abstain"), ("oosr", "k % 8 > 3", "done AND abstain"), ("rl", "k % 100 / 10", "done"), ("gl", "k % 50 / 10", "done"),
        ]
    }
)
_STATS = " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, count({m}) AS n, round(avg({m}), 6) AS mean, round(coalesce(stddev_samp({m}), 0), 6) AS std, round(min({m}), 6) AS min, round(max({m}), 6) AS max FROM (SELECT *, CASE WHEN run < 2 THEN 'a' ELSE 'b' END AS model FROM s) GROUP BY model"
    for m in METRICS
)
_likes = lambda c, marks: "(" + " OR ".join(f"contains({c}, '{m}')" for m in marks) + ")"
_DETAIL = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{t.lower()}'" for i, t in enumerate(DETAILS)) + " END"
_FAILED = f"""f AS (SELECT event_id, event_id % 17 = 0 AS other, {_DETAIL} AS t, CASE CAST(floor(event_id / 8) AS BIGINT) % 4 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'generation' WHEN 2 THEN 'pipeline' ELSE 'retrieval' END AS stage FROM events),
h AS (SELECT *, NOT other AND NOT {_likes('t', ev.INFRASTRUCTURE)} AND (contains(t, '{ev.CONTRACT}') OR ({_likes('t', ev.STAGE_FAILED)} AND {_likes('t', ev.VALIDATION)})) AS contract_failure FROM f)"""

ORACLE_SQL = {
    "retrieval_metrics": f"WITH {_CASES} SELECT case_id, routing_correct, hit_at_1, round(recall, 6) AS article_recall_at_5, round(prec, 6) AS article_precision FROM e",
    "citation_metrics": f"WITH {_CASES} SELECT case_id, round(validity, 6) AS citation_validity, round(crecall, 6) AS citation_recall FROM e",
    "e2e_pass": f"WITH {_CASES} SELECT case_id, CASE WHEN expected = 'abstain' THEN routing_correct AND case_id % 2 = 0 ELSE routing_correct AND recall = 1 AND case_id % 3 = 2 AND case_id % 5 % 3 >= 1 AND validity = 1 AND crecall = 1 END AS end_to_end_pass FROM e",
    "run_summary": f"WITH {_EVENTS} SELECT * FROM s",
    "summary_by_type": "WITH r AS (SELECT CAST(user_id % 3 AS INTEGER) AS run, CASE WHEN event_id % 21 > 0 THEN event_type ELSE 'unknown' END AS test_type, event_id AS k FROM events WHERE event_id % 10 <> 0) SELECT run, test_type, count(*) AS n, round(avg(CAST(k % 3 > 0 AS DOUBLE)), 6) AS end_to_end_success_rate, round(avg(CAST(k % 5 > 0 AS DOUBLE)), 6) AS routing_accuracy FROM r GROUP BY ALL",
    "run_stats": f"WITH {_EVENTS} {_STATS}",
    "failure_classifier": f"WITH {_FAILED} SELECT event_id, contract_failure, stage FROM h",
    "contract_scoring": f"WITH {_FAILED} SELECT event_id, CASE WHEN stage = 'retrieval' THEN 0 ELSE CAST(event_id % 2 = 0 AS DOUBLE) END AS hit_at_1, CASE WHEN stage = 'retrieval' THEN 0 ELSE CAST(event_id % 4 / 4 AS DOUBLE) END AS article_precision, CASE WHEN stage = 'generation' THEN CAST(0 AS DOUBLE) END AS correctness, CASE WHEN stage = 'generation' THEN CAST(0 AS DOUBLE) END AS citation_validity FROM h WHERE contract_failure",
    "integrity_check": "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'planner_not_used' WHEN event_id % 5 = 0 THEN 'provider_failure' WHEN event_id % 4 <> 0 AND event_type <> 'click' THEN 'wrong_model' END AS integrity_error FROM events",
    "resume_anti_join": "SELECT o_orderkey AS case_index, o_orderstatus FROM orders WHERE o_orderkey >= (SELECT floor(max(o_orderkey) * 2 / 3) FROM orders)",
}
