"""Question plans and article selections as the engine accepts them from a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.functions.once import once
from karst.settings import Settings

_TEXT, _INT, _REAL = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ISSUE = _struct(issue=_TEXT, retrieval_query=_TEXT, concept_hints=T.ArrayType(_TEXT), actors=T.ArrayType(_TEXT), conditions=T.ArrayType(_TEXT), numbers=T.ArrayType(_TEXT), requested_result=_TEXT)
PLAN = _struct(decision=_TEXT, confidence=_REAL, decision_reason=_TEXT, normalized_question=_TEXT, legal_domain=_TEXT, minimum_articles=_INT, maximum_articles=_INT, atomic_issues=T.ArrayType(ISSUE))
COVERAGE = _struct(issue_index=_INT, covered=T.BooleanType(), supporting_article_numbers=T.ArrayType(_INT), confidence=_REAL, reason=_TEXT)
SELECTION = _struct(selected_article_numbers=T.ArrayType(_INT), issue_coverage=T.ArrayType(COVERAGE), confidence=_REAL, reason=_TEXT)
#: The most of each that a plan may have, and the form of a leaked article number.
MAX_ISSUES, MAX_HINTS, MAX_ACTORS, MAX_CONDITIONS, MAX_NUMBERS, MAX_SELECTED = 5, 6, 6, 8, 8, 5
LEAKED_NUMBER = r"(?:المادة|مادة)\s*[0-9٠-٩۰-۹]+"
MIN_QUESTION = 3


def question_error(question: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(question, F.lit("")))) < MIN_QUESTION, F.lit("question_too_short"))


def needs_verification(decision: Column, confidence: Column, s: Settings) -> Column:
    """Only confident abstentions are asked about again."""
    return F.lit(s.verify_abstain) & (decision == "abstain") & (confidence >= s.abstain_verify_confidence)


def plan_error(plan: Column) -> Column:
    """Null for a plan that holds, or the first thing wrong with it."""
    issues = F.coalesce(plan["atomic_issues"], F.array().cast(T.ArrayType(ISSUE)))
    n, low, high = F.size(issues), plan["minimum_articles"], plan["maximum_articles"]
    text = lambda i: F.concat_ws(" ", i["issue"], i["retrieval_query"], F.array_join(i["concept_hints"], " "))
    abstain = plan["decision"] == "abstain"
    return (
        F.when(~plan["decision"].isin("retrieve", "abstain"), F.lit("unknown_decision"))
        .when(~plan["confidence"].between(0.0, 1.0), F.lit("confidence_out_of_range"))
        .when(n > MAX_ISSUES, F.lit("too_many_issues"))
        .when(abstain & (n > 0), F.lit("abstain_with_issues"))
        .when(abstain & ((low != 0) | (high != 0)), F.lit("abstain_with_articles"))
        .when(abstain, F.lit(None).cast("string"))
        .when(n == 0, F.lit("retrieve_without_issues"))
        .when(low < 1, F.lit("minimum_below_one"))
        .when(high < low, F.lit("maximum_below_minimum"))
        .when(F.exists(issues, lambda i: text(i).rlike(LEAKED_NUMBER)), F.lit("article_number_leaked"))
    )


def explode_issues(plans: DataFrame) -> DataFrame:
    """question_id, issue_index (from 1) and the fields of each issue of the plans that retrieve."""
    return plans.where("plan.decision = 'retrieve'").select("question_id", F.posexplode("plan.atomic_issues").alias("_i", "x")).select("question_id", (F.col("_i") + 1).alias("issue_index"), "x.*")


def normalize_selection(selection: Column, catalogue: Column, n_issues: Column) -> Column:
    """struct(selected, coverage, error) of a reranker's reply, as it counts.

    catalogue: the numbers that were offered.  Numbers beyond it are an error.  Of the coverage of an issue the
    first counts; covered without support is not covered; support joins the selection; an issue that
    is missing is not covered, with confidence 0.  What supports no covered issue is not selected.
    An empty catalogue selects nothing, with confidence 1.
    """
    ints, none = F.array().cast("array<int>"), F.array().cast("array<struct<issue_index:int,covered:boolean,supporting_article_numbers:array<int>,confidence:double>>")
    numbers = lambda a: F.array_distinct(F.coalesce(a, ints))
    per_issue = lambda f: F.when(n_issues > 0, F.transform(F.sequence(F.lit(1), F.greatest(n_issues, F.lit(1))), f)).otherwise(none)
    inside = F.filter(F.coalesce(selection["issue_coverage"], F.array().cast(SELECTION["issue_coverage"].dataType)), lambda c: c["issue_index"].between(1, n_issues))
    # Each with its support; covered only with some.
    held = lambda c, s: F.struct(c["issue_index"].alias("issue_index"), F.coalesce(c["covered"] & (F.size(s) > 0), F.lit(False)).alias("covered"), s.alias("support"), c["confidence"].alias("confidence"))
    inside = F.transform(inside, lambda c: once(numbers(c["supporting_article_numbers"]), lambda s: held(c, s)))
    given = F.struct(numbers(selection["selected_article_numbers"]).alias("selected"), catalogue.alias("catalogue"), inside.alias("inside"))

    def first(x: Column) -> Column:
        # The first of each issue counts, in the order in which the coverage was given; what comes after it is not looked at.
        firsts = once(F.transform(x["inside"], lambda c: c["issue_index"]), lambda n: F.filter(x["inside"], lambda c, i: F.array_position(n, c["issue_index"]) == i + 1))
        return F.struct(x["selected"].alias("selected"), x["catalogue"].alias("catalogue"), firsts.alias("firsts"))

    def row(i: Column, c: Column) -> Column:
        yes = F.coalesce(c["covered"], F.lit(False))
        return F.struct(i.alias("issue_index"), yes.alias("covered"), F.when(yes, F.slice(c["support"], 1, MAX_SELECTED)).otherwise(ints).alias("supporting_article_numbers"), F.coalesce(c["confidence"], F.lit(0.0)).alias("confidence"))

    def judged(x: Column) -> Column:
        beyond = lambda a: F.size(F.array_except(a, x["catalogue"])) > 0
        rows = per_issue(lambda i: once(F.get(F.filter(x["firsts"], lambda c: c["issue_index"] == i), F.lit(0)), lambda c: row(i, c)))
        # Support is appended in the order in which the coverage was given.
        joined = F.array_distinct(F.concat(x["selected"], F.flatten(F.transform(F.filter(x["firsts"], lambda c: c["covered"]), lambda c: c["support"]))))
        return F.struct((F.size(x["catalogue"]) == 0).alias("empty"), (beyond(x["selected"]) | F.exists(x["firsts"], lambda c: beyond(c["support"]))).alias("foreign"), rows.alias("rows"), joined.alias("joined"))

    def told(x: Column) -> Column:
        kept = once(F.flatten(F.transform(x["rows"], lambda r: r["supporting_article_numbers"])), lambda backed: F.slice(F.filter(x["joined"], lambda n: F.array_contains(backed, n)), 1, MAX_SELECTED))
        bare = per_issue(lambda i: F.struct(i.alias("issue_index"), F.lit(False).alias("covered"), ints.alias("supporting_article_numbers"), F.lit(1.0).alias("confidence")))
        return F.struct(
            F.when(x["empty"] | x["foreign"], ints).otherwise(kept).alias("selected"),
            F.when(x["empty"], bare).when(~x["foreign"], x["rows"]).alias("coverage"),
            F.when(~x["empty"] & x["foreign"], F.lit("outside_catalogue")).alias("error"),
        )

    return once(given, lambda g: once(first(g), lambda f: once(judged(f), told)))


def rerank_payload(candidates: DataFrame, s: Settings) -> DataFrame:
    """question_id, n_articles, payload: the candidates offered to the reranker, within the character budget.

    candidates: question_id, rank, article_number, text, final_score.
    """
    from pyspark.sql.window import Window

    from karst.functions.text import char_budget

    bounded = candidates.where(F.col("rank") <= s.reranker_candidate_limit)
    bounded = bounded.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("question_id")))
    budget = char_budget(F.col("n"), s.reranker_total_char_budget, s.reranker_article_char_limit)
    item = F.struct(F.col("rank").alias("graph_rank"), "article_number", F.round("final_score", 6).alias("graph_score"), F.substring(F.col("text"), F.lit(1), budget).alias("text"))
    return bounded.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_articles"), F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))
