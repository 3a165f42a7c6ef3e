"""Evaluation of retrievals and answers against a benchmark, and statistics over runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.citations import evaluated_numbers

#: What failures of providers, of models and of stages look like, in lower case.
INFRASTRUCTURE = ["cohere request failed.", "status=429", "status=500", "status=502", "status=503", "status=504", "timeout", "timed out", "connection error", "connectionerror"]
CONTRACT = "structured-output validation failed"
STAGE_FAILED = ["query planner failed.", "article reranker failed.", "answer generation failed.", "citation-repair retry failed."]
VALIDATION = ["error=valueerror:", "error=validationerror:", "validationerror:"]
LOST_MODEL = ["Pipeline answer generation failed.", "PIPELINE_ANSWER_ENABLED is false", "no pipeline LLM provider is available"]
RETRIEVE_METRICS = ["hit_at_1", "article_recall_at_5", "article_precision"]
ANSWER_METRICS = ["correctness", "faithfulness", "citation_validity", "citation_recall"]


def _any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def _share(part: Column, whole: Column, empty: Column | float) -> Column:
    other = F.lit(empty) if isinstance(empty, float) else empty
    return F.when(F.size(whole) == 0, other).otherwise(F.size(F.array_intersect(part, whole)) / F.size(F.array_distinct(whole)))


def actual_numbers(diagnosed: Column, top: Column, from_articles: Column) -> Column:
    """The articles that a retrieval gave, by its diagnostics or else by its articles; each once, in order."""
    return F.array_distinct(F.coalesce(diagnosed, top, from_articles, F.array().cast("array<int>")))


def citations_given(structured: Column, answer: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(structured, F.array().cast("array<int>")), evaluated_numbers(answer)))


def retrieval_metrics(expected: Column, actual: Column, required: Column, acceptable: Column, given: Column) -> dict[str, Column]:
    """routing_correct, hit_at_1, article_recall_at_5, article_precision; the first five articles count."""
    five = F.slice(given, 1, 5)
    relevant = F.array_union(required, acceptable)
    on = expected == "retrieve"
    return {
        "routing_correct": expected == actual,
        "hit_at_1": on & F.coalesce(F.array_contains(relevant, F.get(five, F.lit(0))), F.lit(False)),
        "article_recall_at_5": F.when(on, _share(five, required, 1.0)).otherwise(F.lit(0.0)),
        "article_precision": F.when(on, _share(relevant, five, 0.0)).otherwise(F.lit(0.0)),
    }


def citation_metrics(expected: Column, cited: Column, retrieved: Column, required: Column) -> dict[str, Column]:
    """citation_validity (what was cited had been retrieved) and citation_recall (what is required was cited)."""
    none = F.when(expected == "abstain", F.lit(1.0)).otherwise(F.lit(0.0))
    return {"citation_validity": _share(retrieved, cited, none), "citation_recall": _share(cited, required, 1.0)}


def end_to_end_pass(r: dict[str, Column]) -> Column:
    """Whether a case counts as solved; grades are 0, 1 or 2."""
    answered = (r["recall"] == 1) & (r["correctness_grade"] == 2) & (r["faithfulness_grade"] >= 1) & (r["validity"] == 1) & (r["citation_recall"] == 1)
    return F.when(r["expected"] == "abstain", r["routing"] & r["oos"]).otherwise(r["routing"] & answered)


def mean(value: Column) -> Column:
    """The mean of what is there, truths as 0 and 1, to six places; 0 of nothing."""
    return F.coalesce(F.round(F.avg(value.cast("double")), 6), F.lit(0.0))


def run_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and the metrics of a run's rows: over completed ones, and over those that should retrieve or abstain."""
    done = F.col("error").isNull()
    retrieve, abstain = done & (F.col("expected_behavior") == "retrieve"), done & (F.col("expected_behavior") == "abstain")
    part = lambda cond, c: mean(F.when(cond, F.col(c).cast("double")))
    columns = [
        F.count(F.lit(1)).alias("questions_requested"), F.count(F.when(done, 1)).alias("questions_completed"), F.count(F.when(~done, 1)).alias("questions_failed_to_run"),
        part(done, "end_to_end_pass").alias("end_to_end_success_rate"), part(done, "routing_correct").alias("routing_accuracy"),
        *[part(retrieve, c).alias(c) for c in RETRIEVE_METRICS], part(abstain, "routing_correct").alias("out_of_scope_accuracy"),
        *[part(retrieve, c).alias(c) for c in ANSWER_METRICS], part(abstain, "out_of_scope_response_correct").alias("out_of_scope_response_accuracy"),
        part(done, "retrieval_seconds").alias("retrieval_latency"), part(done, "generation_seconds").alias("generation_latency"),
    ]
    return rows.groupBy(*(by or [])).agg(*columns)


def summary_by_type(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    done = rows.where("error IS NULL").withColumn("test_type", F.coalesce("test_type", F.lit("unknown")))
    return done.groupBy(*(by or []), "test_type").agg(F.count(F.lit(1)).alias("n"), mean(F.col("end_to_end_pass")).alias("end_to_end_success_rate"), mean(F.col("routing_correct")).alias("routing_accuracy"))


def run_stats(runs: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """metric, n, mean, std (of a sample; 0 of one), min, max over runs; nothing unless every run is complete."""
    long = runs.select(*(by or []), "complete", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m"))
    r = lambda c: F.round(c, 6)
    stats = long.groupBy(*(by or []), "m.metric").agg(
        F.count("m.value").alias("n"), r(F.avg("m.value")).alias("mean"), r(F.coalesce(F.stddev_samp("m.value"), F.lit(0.0))).alias("std"),
        r(F.min("m.value")).alias("min"), r(F.max("m.value")).alias("max"), F.bool_and("complete").alias("_all"),
    )
    return stats.where("_all").drop("_all")


def nested_stats(runs: DataFrame, paths: list[str]) -> DataFrame:
    """As ``run_stats``, of the numbers (truths count as 1 and 0) at dotted paths in the runs' documents."""
    names = {f"_m{i}": p for i, p in enumerate(paths)}
    picked = runs.select("complete", *[F.col(p).cast("double").alias(n) for n, p in names.items()])
    named = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return run_stats(picked, list(names)).withColumn("metric", named[F.col("metric")])


def is_contract_failure(status: Column, detail: Column) -> Column:
    """Whether a failure is the model's (and scored) or the infrastructure's (and retried)."""
    text = F.lower(F.coalesce(detail, F.lit("")))
    model = F.contains(text, F.lit(CONTRACT)) | (_any(text, STAGE_FAILED) & _any(text, VALIDATION))
    return (status == 500) & ~_any(text, INFRASTRUCTURE) & model


def failure_stage(url: Column) -> Column:
    endpoint = F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")
    return F.when(endpoint.endswith("/retrieve"), F.lit("retrieval")).when(endpoint.endswith("/generate"), F.lit("generation")).otherwise(F.lit("pipeline"))


def contract_scores(stage: Column, metrics: dict[str, Column]) -> dict[str, Column]:
    """A contract failure's metrics: at retrieval 0 and no answer's; at generation the retrieval's own and 0."""
    out = {}
    for name, value in metrics.items():
        if name in ANSWER_METRICS:
            out[name] = F.when(stage == "generation", F.lit(0.0))
        else:
            out[name] = F.when(stage == "retrieval", F.lit(0.0)).otherwise(value.cast("double"))
    return out


def integrity_error(planner_used: Column, expected: Column, status: Column, warnings: Column, model: Column, wanted: Column) -> Column:
    """Null, or why a case did not really go through the models."""
    lost = F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: _any(w, LOST_MODEL))
    return (
        F.when(~F.coalesce(planner_used, F.lit(False)), F.lit("planner_not_used"))
        .when(lost, F.lit("provider_failure"))
        .when((expected == "retrieve") & (status == "generated") & (F.coalesce(model, F.lit("")) != wanted), F.lit("wrong_model"))
    )


def to_resume(cases: DataFrame, rows: DataFrame, key: str = "case_index") -> DataFrame:
    """The cases that a run still has to do: those without a row, and a trailing one that failed.

    Rows must be a prefix of the cases, and only the last may have failed; else nothing can be resumed, which is an error.
    """
    bad = F.lit("the rows are no prefix of the cases, or one before the last failed")
    state = rows.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last"), F.count(F.when(F.col("error").isNotNull(), 1)).alias("failed"), F.max(F.when(F.col("error").isNotNull(), F.col(key))).alias("failed_at"))
    ok = (F.col("n") == F.coalesce(F.col("last") + 1, F.lit(0))) & ((F.col("failed") == 0) | ((F.col("failed") == 1) & (F.col("failed_at") == F.col("last"))))
    checked = state.select(F.when(ok, F.lit(True)).otherwise(F.raise_error(bad).cast("boolean")).alias("_ok"))
    left = cases.join(rows.where("error IS NULL"), key, "left_anti")
    return left.crossJoin(checked).where("_ok").drop("_ok")
