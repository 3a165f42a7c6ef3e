import json

import pytest
from graph_fixture import TTL
from pyspark.sql import functions as F

from karst.operators import build
from karst.plans.retrieve import generate, retrieve
from karst.settings import Settings
from karst.sources.documents import strict_json, write_document
from karst.sources.models import EmptyReply, complete_with_retry, recorded
from karst.sources.turtle import read_turtle

S = Settings(article_count=6)
WORDS = ["الأجر", "تأخير", "الإجازة", "المرض", "الراتب"]


def embedder(texts):
    return [[1.0 + t.count(w) for w in WORDS] for t in texts]


def plan(decision="retrieve", confidence=0.9, issues=(), low=1, high=3):
    rows = [{"issue": i, "retrieval_query": q, "concept_hints": h, "actors": [], "conditions": [], "numbers": [], "requested_result": ""} for i, q, h in issues]
    return json.dumps({"decision": decision, "confidence": confidence, "decision_reason": "r", "minimum_articles": low, "maximum_articles": high, "atomic_issues": rows}, ensure_ascii=False)


def completer(requests):
    """A model of fixed replies, by stage and question."""
    out = []
    for r in requests:
        body = json.loads(r["payload"])
        q = body.get("question") or body.get("user_question")
        if r["stage"] in ("planner", "verifier"):
            if "مطبخ" in q:
                text = plan("abstain", 0.95, low=0, high=0)
            elif "سري" in q:
                text = plan("abstain", 0.95, low=0, high=0) if r["stage"] == "planner" else plan(issues=[("تأخير الأجر", "تأخير الأجر", ["تأخير الأجر"])])
            elif "رقم" in q:
                text = plan(issues=[("x", "المادة 4", [])])
            else:
                text = plan(issues=[("تأخير الأجر", "تأخير الأجر", ["تأخير الأجر", " "]), ("إجازة مرضية", "الإجازة المرض", ["المرض"])])
        elif r["stage"] == "reranker":
            numbers = [a["article_number"] for a in json.loads(body["articles"])]
            text = json.dumps({"selected_article_numbers": numbers[:2], "issue_coverage": [{"issue_index": 1, "covered": True, "supporting_article_numbers": numbers[:2], "confidence": 1.0, "reason": ""}], "confidence": 0.9, "reason": ""})
        elif r["stage"] == "writer":
            text = json.dumps({"answer_ar": "نص [المادة 99]" if "سري" in q else f"نص [[المادة {body['articles'][0]['article_number']}]", "cited_article_numbers": [], "limitations": [" "]})
        else:
            text = json.dumps({"answer_ar": "نص", "cited_article_numbers": [body["articles"][0]["article_number"]], "limitations": ["ok"]})
        out.append({"text": text, "input_tokens": 10, "output_tokens": 5})
    return out


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ttl") / "law.ttl"
    path.write_text(TTL, encoding="utf-8")
    triples = read_turtle(spark, str(path))
    nodes, edges = build.nodes_of(triples, S), build.edges_of_triples(triples)
    from karst.sources.store import embed

    nodes, edges = embed(nodes, embedder).cache(), edges.cache()
    questions = spark.createDataFrame([(1, "ما حكم تأخير الأجر والإجازة؟"), (2, "كيف أصمم مطبخ"), (3, "سؤال سري"), (4, "سؤال رقم"), (5, " x ")], "question_id int, question string")
    return retrieve(questions, nodes, edges, completer=completer, embedder=embedder, settings=S).cache()


def test_retrieval(world):
    rows = {r.question_id: r for r in world.collect()}
    assert len(rows) == 5
    full = rows[1]
    assert full.status == "ok" and full.decision.behavior == "retrieve" and not full.decision.planner_verified
    assert len(full.articles) == 2 and full.diagnostics.article_count == 2
    assert full.articles[0].article_number == 4 and full.articles[0].support_paths
    assert all(a.support_paths for a in full.articles)
    assert set(full.diagnostics.concept_local_names) <= {"wage", "delay", "leave", "sick"}
    assert "delay" in full.diagnostics.selected_seed_local_names
    away = rows[2]
    assert away.decision.behavior == "abstain" and away.decision.planner_verified and away.articles == [] and away.concepts == []
    assert rows[3].decision.behavior == "retrieve" and rows[3].decision.planner_verified
    assert rows[4].status == "error" and rows[4].decision.reason == "article_number_leaked"
    assert rows[5].status == "error" and rows[5].decision.reason == "question_too_short" and not rows[5].decision.planner_used


def test_generation(world):
    rows = {r.question_id: r for r in generate(world, completer=completer).collect()}
    good = rows[1]
    assert good.status == "generated" and good.answer == "نص [المادة 4]" and good.cited_article_numbers == [4] and good.grounded and good.warnings == []
    assert good.citations[0].article_number == 4 and good.citations[0].excerpt and good.usage.total_tokens == 15
    assert rows[2].status == "out_of_scope" and rows[2].usage.total_tokens == 0 and rows[2].model is None
    mended = rows[3]
    assert mended.status == "generated" and mended.answer.startswith("نص [المادة ") and mended.usage.total_tokens == 30 and mended.warnings == ["ok"]
    assert rows[4].status == "insufficient_evidence"


def test_failing_closed(world):
    def stubborn(requests):
        return [{"text": json.dumps({"answer_ar": "نص [المادة 99]", "cited_article_numbers": [98], "limitations": []}), "input_tokens": 1, "output_tokens": 1} for _ in requests]

    row = generate(world.where("question_id = 1"), completer=stubborn).first()
    assert row.status == "insufficient_evidence" and not row.grounded and row.citations == []
    assert row.warnings == ["Cited without having been retrieved: 98, 99 No article is validly cited. The second draft did not mend this."]


def test_model_retries():
    calls = []

    def short(requests):
        calls.append(requests[0]["max_output_tokens"])
        return [{"text": "" if len(calls) == 1 else "{}", "input_tokens": 2, "output_tokens": 3}]

    reply = complete_with_retry(short, {"stage": "planner", "payload": "", "instructions": "", "max_output_tokens": 1000})
    assert calls == [1000, 3000] and reply["total_tokens"] == 10 and reply["attempts"] == 2
    with pytest.raises(EmptyReply):
        complete_with_retry(recorded({}), {"stage": "planner", "payload": "p", "instructions": "", "max_output_tokens": 10})


def test_documents(spark, tmp_path, world):
    path = str(tmp_path / "out")
    write_document(world, path)
    again = spark.read.schema(world.schema).json(path)
    assert sorted(r.question_id for r in again.collect()) == [1, 2, 3, 4, 5]
    assert again.where("question_id = 1").first().articles[0].article_number == 4
    schema = world.select("question_id", "status").schema
    rows = spark.createDataFrame([('{"question_id": 1, "status": "ok"}',), ('{"question_id": 1}',), ('{"question_id": 1, "status": "ok", "z": 1}',), ("[]",), (None,)], "t string")
    got = [(r.x.error, r.x.value.question_id if r.x.value else None) for r in rows.select(strict_json(F.col("t"), schema).alias("x")).collect()]
    assert got == [(None, 1), ("missing_keys", None), ("unknown_keys", None), ("malformed", None), ("malformed", None)]
