"""Retrieval and answers end to end, for a table of questions at once.

Frames are keyed by question and issue from plan to result; abstained questions keep a row with empty lists.
What several later stages read is written to the shared folder once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.functions.text import article_text, embedding_text, first_text, normalize_arabic, relevance, seed_label
from karst.operators import answers, graph, planning, rank, search
from karst.operators.adjacency import Adjacency
from karst.operators.cells import Cells
from karst.operators.lexicon import Lexicon
from karst.settings import Settings
from karst.sources.models import ask, with_digest
from karst.sources.scratch import written
from karst.sources.store import embed
from karst.sources.structured import schema_of, structured

RETRIEVAL_VERSION, GENERATION_VERSION = "retrieval.v2", "generation.v2"

PLANNER = "Decide whether the question is within the law that the knowledge base covers. If it is, split it into one to five independent issues, each with a search text and concept hints, and never name article numbers. Reply as JSON."
VERIFIER = "Another reader proposed to reject this question. Check that again with care, and reply with a plan as JSON."
RERANKER = "Choose the articles that answer the issues, from the listed ones only, and tell for each issue which of them support it. Reply as JSON."
WRITER = "Answer in Arabic from the given articles alone, and cite each as [المادة N]. Reply as JSON."
REWRITER = "Your citations were not valid. Answer again, and cite only these articles: "
DRAFT = T.StructType([T.StructField("answer_ar", T.StringType()), T.StructField("cited_article_numbers", T.ArrayType(T.IntegerType())), T.StructField("limitations", T.ArrayType(T.StringType()))])


#: What a reply must have; everything else may be missing, but nothing unknown may be there.
_ISSUE = schema_of(planning.ISSUE, required=False) | {"required": ["issue", "retrieval_query"]}
_COVERED = schema_of(planning.COVERAGE, required=False) | {"required": ["issue_index", "covered"]}

def retrieved_type() -> T.StructType:
    """What a saved retrieval must be, to be answered from."""
    return T.StructType.fromDDL(
        "question_id int, schema_version string, status string, question string, decision struct<behavior:string,reason:string,planner_used:boolean,planner_verified:boolean,planner_confidence:double>, "
        "articles array<struct<uri:string,local_name:string,labels_ar:array<string>,labels_en:array<string>,article_number:int,text:string,graph_score:double,issue_relevance:double,final_score:double,"
        "support_paths:array<struct<seed_uri:string,seed_label:string,seed_score:double,article_uri:string,score:double,steps:array<struct<direction:string,source_uri:string,relation:string,target_uri:string>>>>>>, "
        "concepts array<struct<uri:string,local_name:string,seed_score:double,vector_rank:int,bm25_rank:int,hint_rank:int>>, expanded_concepts array<struct<uri:string,local_name:string,graph_score:double>>, "
        "diagnostics struct<article_numbers:array<int>,graph_candidate_article_numbers:array<int>,concept_local_names:array<string>,selected_seed_local_names:array<string>,concept_count:int,expanded_concept_count:int,graph_candidate_count:int,article_count:int>"
    )


def _reply(kind: T.StructType, required: list[str], **own: dict) -> dict:
    out = schema_of(kind, required=False)
    return out | {"required": required, "properties": out["properties"] | own}


_SHARE = {"type": "number", "minimum": 0, "maximum": 1}
SCHEMAS = {
    "plan": _reply(planning.PLAN, ["decision", "confidence", "atomic_issues"], decision={"type": "string", "enum": ["retrieve", "abstain"]}, confidence=_SHARE, atomic_issues={"type": "array", "items": _ISSUE}),
    "selection": _reply(planning.SELECTION, ["selected_article_numbers", "issue_coverage"], confidence=_SHARE, issue_coverage={"type": "array", "items": _COVERED}),
    "draft": _reply(DRAFT, ["answer_ar"], answer_ar={"type": "string", "minLength": 1}),
}


#: The schemas by stage, as providers are told them.
STAGE_SCHEMAS = {"planner": SCHEMAS["plan"], "verifier": SCHEMAS["plan"], "reranker": SCHEMAS["selection"], "writer": SCHEMAS["draft"], "rewriter": SCHEMAS["draft"]}


def _asked(rows: DataFrame, stage: str, instructions, payload, limit: int, completer: Callable, schema: T.StructType, name: str, store: str | None = None) -> DataFrame:
    """rows with ``name``, the parsed reply to each row's request, ``name``_error, and ``tokens`` (its input and output tokens).

    A call that fails and a reply that is not what the schema asks for are errors of their row alone.
    """
    requests = rows.withColumns({"stage": F.lit(stage), "instructions": instructions, "payload": payload, "max_output_tokens": F.lit(limit)})
    asked = with_digest(requests)
    replies = ask(asked.select("stage", "instructions", "payload", "max_output_tokens"), completer, store)
    parsed = structured(F.col("text"), SCHEMAS["plan" if name == "plan2" else name], schema)
    replies = replies.withColumn("_x", parsed).select("request_digest", F.col("_x.value").alias(name), F.concat(F.lit(f"{stage}_failed: "), F.coalesce("error", "_x.error")).alias(f"{name}_error"), F.struct("input_tokens", "output_tokens", "total_tokens").alias("tokens"))
    return asked.join(replies, "request_digest").drop("request_digest", "stage", "instructions", "payload", "max_output_tokens")


def plan_questions(questions: DataFrame, completer: Callable, s: Settings, store: str | None = None) -> DataFrame:
    """question_id, question, plan, plan_error, verified; confident abstentions are asked about a second time, and the second plan counts."""
    trimmed = questions.withColumn("question", F.trim("question"))
    good = trimmed.where(planning.question_error(F.col("question")).isNull())
    first = _asked(good, "planner", F.lit(PLANNER), F.to_json(F.struct("question")), s.planner_max_output_tokens, completer, planning.PLAN, "plan", store).drop("tokens")
    check = planning.needs_verification(F.col("plan")["decision"], F.col("plan")["confidence"], s)
    second = _asked(first.where(check).select("question_id", "question"), "verifier", F.lit(VERIFIER), F.to_json(F.struct("question")), s.planner_max_output_tokens, completer, planning.PLAN, "plan2", store).drop("tokens", "question")
    plans = first.join(second, "question_id", "left").select("question_id", "question", F.coalesce("plan2", "plan").alias("plan"), F.col("plan2").isNotNull().alias("verified"), F.coalesce("plan_error", "plan2_error").alias("_lost"))
    return plans.withColumn("plan_error", F.coalesce("_lost", planning.plan_error(F.col("plan")))).drop("_lost")


def retrieve_plans(plans: DataFrame, nodes: DataFrame, edges: DataFrame, embedder: Callable, completer: Callable, s: Settings, store: str | None = None, index: Lexicon | None = None, walks: Adjacency | None = None, nearby: Cells | None = None) -> DataFrame:
    """question_id, articles, concepts, expanded_concepts, seeds, candidate_numbers, selection_error for the plans that retrieve."""
    walks = walks or graph.pack(edges, s)
    issues = planning.explode_issues(plans.where("plan_error IS NULL"))
    text = embedding_text(F.col("issue"), F.col("retrieval_query"), F.col("concept_hints"))
    vectors = written(embed(issues.withColumn("_text", text), embedder, "_text", s.embedding_batch_size).select(*graph.KEYS, "issue", "retrieval_query", F.col("concept_hints").alias("hints"), F.col("embedding").alias("vector")), "vectors")
    degree = walks.degrees(nodes.sparkSession)
    facts = nodes.select("uri", "local_name", "node_kind", "labels_ar", "labels_en", "article_number", first_text(F.col("comments_ar"), F.col("comments_en"), F.col("searchable_text")).alias("text"))
    hits = written(search.search_concepts(vectors, nodes, degree, s, index=index, nearby=nearby).join(facts.drop("article_number", "text"), "uri"), "hits")
    seeds = written(graph.select_seeds(hits, s).withColumn("seed_label", seed_label(F.col("labels_ar"), F.col("labels_en"), F.col("local_name"))), "seeds")
    evidence, reached = graph.walk(seeds, walks, s, in_namespace=lambda u: u.startswith(s.namespace))
    evidence = written(evidence, "evidence")

    asked = issues.select(*graph.KEYS, normalize_arabic(F.concat_ws(" ", "issue", "retrieval_query", F.array_join("concept_hints", " "))).alias("_q"))
    told = rank.valid_articles(facts).withColumn("full", article_text(F.col("labels_ar"), F.col("labels_en"), F.col("text")))
    told = written(told.withColumn("_a", normalize_arabic(F.col("full"))), "articles")
    asked = written(asked, "asked")
    scored = evidence.select(*graph.KEYS, "uri").join(told, "uri").join(asked, graph.KEYS).withColumn("issue_relevance", relevance(F.col("_q"), F.col("_a")))
    ranked = rank.rank_articles(evidence, scored.select(*graph.KEYS, "uri", "article_number", "issue_relevance"), s)
    candidates = written(rank.merge_candidates(written(ranked, "ranked"), s).join(told.select("uri", "local_name", "labels_ar", "labels_en", "text", "full"), "uri"), "candidates")

    offered = planning.rerank_payload(candidates.select("question_id", "rank", "article_number", F.col("full").alias("text"), "final_score"), s)
    catalogue = candidates.where(F.col("rank") <= s.reranker_candidate_limit).groupBy("question_id").agg(F.array_sort(F.collect_list("article_number")).alias("catalogue"))
    wanted = plans.where("plan_error IS NULL AND plan.decision = 'retrieve'").select("question_id", "question", F.size("plan.atomic_issues").alias("n_issues"), F.transform("plan.atomic_issues", lambda i: F.struct(i["issue"], i["retrieval_query"])).alias("pairs"))
    requests = wanted.join(offered, "question_id").withColumn("payload", F.to_json(F.struct("question", "pairs", F.col("payload").alias("articles"))))
    replies = _asked(requests.select("question_id", "payload"), "reranker", F.lit(RERANKER), F.col("payload"), s.reranker_max_output_tokens, completer, planning.SELECTION, "selection", store).drop("tokens")
    replies = replies.withColumnRenamed("selection_error", "selection_lost")
    chosen = wanted.join(replies, "question_id", "left").join(catalogue, "question_id", "left")
    chosen = chosen.withColumn("s", planning.normalize_selection(F.col("selection"), F.coalesce("catalogue", F.array().cast("array<int>")), F.col("n_issues")))
    selections = written(chosen.select("question_id", F.col("s.selected").alias("selected_article_numbers"), F.coalesce("selection_lost", "s.error").alias("selection_error")), "selections")
    articles = rank.selected_articles(selections, candidates, s)
    concepts = rank.merge_concepts(hits, s)
    related = rank.expanded_concepts(reached, nodes, s)
    best_seeds = rank.keep_best(seeds, ["question_id", "uri"], "seed_score", "issue_index")

    def listed(df: DataFrame, name: str, order: str, item) -> DataFrame:
        return df.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("v")))), lambda x: x["v"]).alias(name))

    article = F.struct("uri", "local_name", "labels_ar", "labels_en", "article_number", "text", F.round("graph_score", 8).alias("graph_score"), F.round("issue_relevance", 8).alias("issue_relevance"), F.round("final_score", 8).alias("final_score"), "support_paths")
    concept = F.struct("uri", "local_name", F.round("seed_score", 8).alias("seed_score"), "vector_rank", "bm25_rank", "hint_rank")
    out = selections.select("question_id", "selection_error")
    for df, name, order, item in (
        (articles, "articles", "rank", article),
        (concepts, "concepts", "rank", concept),
        (related, "expanded_concepts", "rank", F.struct("uri", "local_name", F.round("graph_score", 8).alias("graph_score"))),
        (best_seeds.withColumn("_o", -F.col("seed_score")), "seeds", "_o", F.col("local_name")),
        (candidates, "candidate_numbers", "rank", F.col("article_number")),
    ):
        out = out.join(listed(df, name, order, item), "question_id", "left")
    return out


def retrieve(questions: DataFrame, nodes: DataFrame, edges: DataFrame, *, completer: Callable, embedder: Callable, settings: Settings | None = None, store: str | None = None, index: Lexicon | None = None, walks: Adjacency | None = None, nearby: Cells | None = None) -> DataFrame:
    """One row per question: question_id, schema_version, status, question, decision, articles, concepts, expanded_concepts, diagnostics.

    questions: question_id, question.  Questions that are too short, plans that don't hold and selections beyond
    the catalogue have the status error, and say which in decision.reason, as do calls that failed and replies that are
    not what was asked for; the other questions go on.  store: a folder of replies that are never asked for again.
    index, walks, nearby: the stored indexes of the nodes' words, of the edges and of the vectors; of the first two what is not given is made for this call.
    """
    s = settings or Settings()
    plans = written(plan_questions(questions, completer, s, store), "plans")
    found = written(retrieve_plans(plans, nodes, edges, embedder, completer, s, store, index, walks, nearby), "found")
    rows = questions.select("question_id", F.trim("question").alias("question")).join(plans.drop("question"), "question_id", "left").join(found, "question_id", "left")
    error = F.coalesce(planning.question_error(F.col("question")), F.col("plan_error"), F.col("selection_error"))
    decision = F.struct(
        F.coalesce("plan.decision", F.lit("abstain")).alias("behavior"), F.coalesce(error, F.col("plan.decision_reason")).alias("reason"), F.col("plan").isNotNull().alias("planner_used"),
        F.coalesce("verified", F.lit(False)).alias("planner_verified"), F.col("plan.confidence").alias("planner_confidence"),
    )
    types = dict((f.name, f.dataType) for f in found.schema.fields)
    lists = {c: F.coalesce(c, F.array().cast(types[c])) for c in ("articles", "concepts", "expanded_concepts", "seeds", "candidate_numbers")}
    rows = rows.withColumns(lists)
    diagnostics = F.struct(
        F.transform("articles", lambda a: a["article_number"]).alias("article_numbers"), F.col("candidate_numbers").alias("graph_candidate_article_numbers"), F.transform("concepts", lambda c: c["local_name"]).alias("concept_local_names"), F.col("seeds").alias("selected_seed_local_names"),
        F.size("concepts").alias("concept_count"), F.size("expanded_concepts").alias("expanded_concept_count"), F.size("candidate_numbers").alias("graph_candidate_count"), F.size("articles").alias("article_count"),
    )
    return rows.select("question_id", F.lit(RETRIEVAL_VERSION).alias("schema_version"), F.when(error.isNotNull(), F.lit("error")).otherwise(F.lit("ok")).alias("status"), "question", decision.alias("decision"), "articles", "concepts", "expanded_concepts", diagnostics.alias("diagnostics"))


def generate(retrieved: DataFrame, *, completer: Callable, settings: Settings | None = None, model: str = "recorded", store: str | None = None) -> DataFrame:
    """One row per retrieved question: question_id, schema_version, status, question, answer, citations, cited_article_numbers, grounded, warnings, model, usage.

    Abstained questions and those without citable articles never reach the model; drafts whose citations are not
    valid are asked for once more, and then fail closed.
    """
    s = settings or Settings()
    rows = retrieved.withColumn("citable", answers.citable(F.col("articles"))).withColumn("allowed", F.transform("citable", lambda a: a["article_number"]))
    rows = rows.withColumn("route", answers.route(F.col("decision.behavior"), F.size("allowed")))
    compact = F.transform("citable", lambda a: F.struct(a["article_number"].alias("article_number"), a["labels_ar"].alias("labels_ar"), a["text"].alias("text")))
    drafts = rows.where("route = 'draft'").select("question_id", "allowed", F.to_json(F.struct(F.col("question").alias("user_question"), compact.alias("articles"))).alias("body"))
    first = _asked(drafts, "writer", F.lit(WRITER), F.col("body"), s.generator_max_output_tokens, completer, DRAFT, "draft", store)
    judge = lambda df: answers.judge_drafts(df.withColumns({"answer": F.col("draft.answer_ar"), "cited": F.col("draft.cited_article_numbers"), "limitations": F.col("draft.limitations")}))
    judged = written(judge(first), "judged")
    again = judged.where("draft_error IS NULL AND state.needs_retry").select("question_id", "allowed", "body", F.col("tokens").alias("spent"))
    second = judge(written(_asked(again, "rewriter", F.concat(F.lit(REWRITER), F.array_join(F.transform("allowed", lambda n: n.cast("string")), ", ")), F.col("body"), s.generator_max_output_tokens, completer, DRAFT, "draft", store), "second"))
    total = lambda k: (F.col("tokens")[k] + F.coalesce(F.col("spent")[k], F.lit(0))).alias(k)
    used = F.struct(total("input_tokens"), total("output_tokens"), total("total_tokens"))
    columns = ["question_id", "state", "limitations", "draft_error"]
    settled = judged.where("draft_error IS NOT NULL OR NOT state.needs_retry").withColumn("spent", F.lit(None).cast(judged.schema["tokens"].dataType)).select(*columns, used.alias("usage"), F.lit(False).alias("retried"))
    settled = settled.unionByName(second.select(*columns, used.alias("usage"), F.lit(True).alias("retried")))
    out = answers.finish(rows.join(settled, "question_id", "left"))
    zero = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("input_tokens", "output_tokens", "total_tokens")])
    return out.select("question_id", F.lit(GENERATION_VERSION).alias("schema_version"), "status", "question", "answer", answers.citations_of(F.col("cited_article_numbers"), F.col("citable")).alias("citations"), "cited_article_numbers", "grounded", "warnings", F.when(F.col("route") == "draft", F.lit(model)).alias("model"), F.coalesce("usage", zero).alias("usage"))
