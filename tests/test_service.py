"""Providers, the server, the command line and benchmark runs, with models of fixed replies."""

import json
import pickle
import threading
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

import pytest
from graph_fixture import TTL
from test_retrieve import completer as writer
from test_retrieve import embedder

from karst import evaluation as runs
from karst import settings
from karst.__main__ import Engine, Models, debugged, main
from karst.server import Busy, Coalescer, Service
from karst.settings import Settings
from karst.sources import models as p_models
from karst.sources import providers as p
from karst.sources import store, versions
from karst.sources.models import ask, complete_with_retry
from karst.sources.structured import strict_schema

REQUEST = {"stage": "planner", "instructions": "do", "payload": "{}", "max_output_tokens": 5000}
REPLIES = {
    "openai": ({"output": [{"content": [{"type": "output_text", "text": "{}"}]}], "usage": {"input_tokens": 3, "output_tokens": 2}}, {"output": [], "incomplete_details": {"reason": "max_output_tokens"}, "usage": {"input_tokens": 3, "output_tokens": 2}}),
    "anthropic": ({"content": [{"type": "tool_use", "input": {}}], "usage": {"input_tokens": 3, "output_tokens": 2}, "stop_reason": "tool_use"}, {"content": [{"type": "text", "text": "{"}], "usage": {"input_tokens": 3, "output_tokens": 2}, "stop_reason": "max_tokens"}),
    "google": ({"candidates": [{"content": {"parts": [{"text": "{}"}]}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": 3, "candidatesTokenCount": 2}}, {"candidates": [{"finishReason": "MAX_TOKENS"}], "usageMetadata": {"promptTokenCount": 3, "candidatesTokenCount": 2}}),
    "opencode": ({"choices": [{"message": {"content": "{}"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}, {"choices": [{"message": {"content": "{"}, "finish_reason": "length"}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}),
    "cohere": ({"message": {"content": [{"type": "text", "text": "```json\n{}\n```"}]}, "finish_reason": "COMPLETE", "usage": {"tokens": {"input_tokens": 3, "output_tokens": 2}}}, {"message": {"content": []}, "finish_reason": "MAX_TOKENS", "usage": {"tokens": {"input_tokens": 3, "output_tokens": 2}}}),
    "ollama": ({"message": {"content": "{}"}, "done_reason": "stop", "prompt_eval_count": 3, "eval_count": 2}, {"message": {"content": "{"}, "done_reason": "length", "prompt_eval_count": 3, "eval_count": 2}),
}


@pytest.mark.parametrize("name", sorted(p.PROVIDERS))
def test_providers(name):
    """The reply, one retry with more tokens after a cut-off one, summed usage, the key in the headers and a strict schema in the body."""
    calls = []

    def transport(url, headers, body, timeout):
        calls.append((url, headers, json.loads(body)))
        return 200, json.dumps(REPLIES[name][1 if len(calls) == 1 else 0])

    s = Settings(llm_provider=name, llm_model="m-1")
    variable = p.PROVIDERS[name].key_variable
    environ = {variable: "secret"} if variable else {}
    if variable:
        with pytest.raises(ValueError, match=variable):
            p.build_completer(s, environ={})
    made = p.build_completer(s, schemas={"planner": {"type": "object", "properties": {"a": {"type": "string", "default": "x"}}}}, environ=environ, transport=transport)
    reply = complete_with_retry(made, REQUEST)
    assert reply == {"text": "{}", "input_tokens": 6, "output_tokens": 4, "total_tokens": 10, "attempts": 2}
    assert not variable or "secret" in json.dumps(calls[0][1])
    sent = [json.dumps(c[2]) for c in calls]
    assert ("4000" in sent[0]) == (name == "cohere") and ('"default"' not in sent[0]) and ('"additionalProperties": false' in sent[0])
    assert (str(10000) in sent[1]) == (name != "cohere")
    pickle.loads(pickle.dumps(p.build_completer(s, environ=environ)))


def test_refusals_and_errors():
    google = p.Completer("google", "m", "k", transport=lambda *a: (200, json.dumps({"candidates": [{"finishReason": "SAFETY"}]})))
    calls = []
    with pytest.raises(ValueError, match="no usable reply"):
        complete_with_retry(lambda r: calls.append(1) or google(r), REQUEST)
    assert len(calls) == 1  # a stop for safety is not tried again
    down = p.Completer("openai", "m", "k", transport=lambda *a: (503, json.dumps({"error": {"message": "x" * 9000}})))
    with pytest.raises(p.ProviderError, match="status=503"):
        down([REQUEST])
    for settings_ in (Settings(llm_provider="none"), Settings(llm_provider="ollama")):
        with pytest.raises(ValueError):
            p.build_completer(settings_, environ={})


def test_posts_and_connections():
    def late(*a):
        raise TimeoutError("read timed out")

    def gone(*a):
        raise OSError("refused")

    kinds = [p.post_json("u", {}, transport=t)["error"] for t in (late, gone, lambda *a: (500, "no"), lambda *a: (200, "[]"), lambda *a: (200, "{"), lambda *a: (200, "{}"))]
    assert kinds == ["timeout", "connection", "http", "malformed", "malformed", None]
    assert p.error_detail(json.dumps({"detail": "why"})) == "why" and p.error_detail("<html>") == "<html>" and len(p.error_detail("x" * 9000)) == 4000

    class Client:
        made, closed = 0, 0

        def __init__(self):
            Client.made += 1

        def close(self):
            Client.closed += 1

    waits = []
    assert p.connect(Client, lambda c: Client.made == 3, attempts=5, delay=7, sleep=waits.append) and Client.closed == 2 and waits == [7, 7]
    with pytest.raises(ConnectionError):
        p.connect(lambda: 1 / 0, attempts=2, sleep=waits.append)
    vectors = p.HttpEmbedder("u", "m", transport=lambda *a: (200, json.dumps({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]})))
    assert vectors(["a", "b"]) == [[1], [2]]
    with pytest.raises(p.ProviderError):
        vectors(["a"])


def test_strict_schemas():
    given = {"type": "object", "properties": {"a": {"type": "array", "default": [], "items": {"type": "object", "properties": {"b": {"type": "string", "default": ""}}}}}}
    out = strict_schema(given)
    assert out["required"] == ["a"] and out["additionalProperties"] is False and "default" not in json.dumps(out)
    assert out["properties"]["a"]["items"]["required"] == ["b"] and "default" in json.dumps(given)


def test_replies_are_stored_and_fail_by_row(spark, tmp_path):
    rows = spark.createDataFrame([("planner", "i", x, 10) for x in ("a", "b", "b")], "stage string, instructions string, payload string, max_output_tokens int")
    folder = str(tmp_path / "replies")

    def half(requests):
        if requests[0]["payload"] == "b":
            raise RuntimeError("down")
        return [{"text": "{}", "input_tokens": 1, "output_tokens": 1}]

    first = {r.error and r.error[:12]: r.text for r in ask(rows, half, folder).collect()}
    assert first == {None: "{}", "RuntimeError": None}

    def only_b(requests):
        assert requests[0]["payload"] == "b"
        return [{"text": "[]", "input_tokens": 1, "output_tokens": 1}]

    assert sorted(r.text for r in ask(rows, only_b, folder).collect()) == ["[]", "{}"]
    assert sorted(r.text for r in ask(rows, None, folder).collect()) == ["[]", "{}"]


def test_a_lost_task_asks_for_what_is_missing_only(spark, tmp_path):
    """A worker that dies in the middle loses the call under way; what came before it is read from the log, and the log ends in the store."""
    rows = spark.createDataFrame([("planner", "i", f"{k:02}", 10) for k in range(12)], "stage string, instructions string, payload string, max_output_tokens int").coalesce(1)
    folder, seen, armed = str(tmp_path / "replies"), tmp_path / "seen", tmp_path / "armed"
    seen.write_text("")
    armed.write_text("")

    def deadly(requests, seen=str(seen), armed=str(armed)):
        import os

        if os.path.exists(armed) and len(open(seen).read().split()) == 7:
            os.remove(armed)
            os._exit(1)
        with open(seen, "a") as f:
            f.write(requests[0]["payload"] + "\n")
        return [{"text": "r" + requests[0]["payload"], "input_tokens": 1, "output_tokens": 1}]

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        with pytest.raises(Exception):
            ask(rows, deadly, folder, calls=1).collect()
        before = seen.read_text().split()
        assert len(before) == 7 and len(list((tmp_path / "replies/_calls").rglob("*.json"))) == 7
        got = sorted(r.text for r in ask(rows, deadly, folder, calls=1).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == [f"r{k:02}" for k in range(12)] and sorted(seen.read_text().split()) == [f"{k:02}" for k in range(12)]
    assert not list((tmp_path / "replies/_calls").rglob("*.json")) and len(ask(rows, None, folder).collect()) == 12
    log = p_models.ReplyLog("nowhere://x/y")
    assert log.folder is None and log.get("ab") is None and log.put("ab", {}) is None and log.forget("ab") is None


def test_calls_of_a_task_overlap_within_their_bound(spark):
    rows = spark.createDataFrame([("planner", "i", str(k), 10) for k in range(24)], "stage string, instructions string, payload string, max_output_tokens int")
    under_way = []

    def slow(requests):
        under_way.append(1)
        now = len(under_way)
        time.sleep(0.05)
        under_way.pop()
        return [{"text": str(now), "input_tokens": 1, "output_tokens": 1}]

    most = max(int(r.text) for r in ask(rows, slow, calls=3).collect())
    assert 2 <= most <= 3
    with pytest.raises(ValueError, match="at least one"):
        ask(rows, slow, calls=0)


def test_embedding_errors_have_a_budget(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.write_text("")

    def flaky(texts):
        with open(calls, "a") as f:
            f.write("x")
        if any("bad" in t for t in texts):
            raise OSError("down")
        return [[1.0] for _ in texts]

    rows = spark.createDataFrame([(f"u{i:02}", "bad" if i % 2 else "good") for i in range(40)], "uri string, searchable_text string").coalesce(1)
    got = store.embed_within(rows, flaky, batch=1, budget=3).orderBy("uri").collect()
    assert [r.embedding for r in got[:6:2]] == [[1.0]] * 3 and got[1].embedding_error == "OSError: down"
    assert len(calls.read_text()) < 12 and "not asked" in got[39].embedding_error
    edges = spark.createDataFrame([], store.EDGE_SCHEMA)
    with pytest.raises(ValueError, match="could not be embedded, first u01"):
        store.ingest(spark, store.embed_within(rows, flaky, batch=1), edges, "never_nodes", "never_edges")
    assert not spark.catalog.tableExists("never_nodes")
    with pytest.raises(ValueError, match="at least one"):
        store.embed(rows, flaky, batch=0)


def test_server():
    def retrieve(body):
        if "question" not in body:
            raise ValueError("question must be a text")
        if body["question"] == "boom":
            raise RuntimeError("inside")
        return {"echo": body["question"]}

    closed, well = [], [True]
    with Service(retrieve, lambda b: {"answer": 1}, lambda: well[0], port=0, close=lambda: closed.append(1)) as service:
        assert service.start() is service

        def call(path, body=None):
            data = None if body is None else (body if isinstance(body, bytes) else json.dumps(body).encode())
            try:
                with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{service.port}{path}", data=data), timeout=20) as r:
                    return r.status, json.loads(r.read())
            except urllib.error.HTTPError as e:
                return e.code, json.loads(e.read())

        assert call("/")[0] == 200 and call("/health") == (200, {"status": "ok"})
        assert call("/retrieve", {"question": "س"}) == (200, {"echo": "س"}) and call("/generate/", {}) == (200, {"answer": 1})
        assert call("/retrieve", {})[0] == 400 and call("/retrieve", [1])[0] == 400 and call("/retrieve", b"{")[0] == 400
        assert call("/retrieve", {"question": "boom"}) == (500, {"detail": "RuntimeError: inside"})
        assert call("/nothing")[0] == 404 and call("/nothing", {})[0] == 404
        well[0] = False
        assert call("/health")[0] == 503
    assert closed == [1]


def posted(service, path, body):
    """Status and reply of a POST."""
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{service.port}{path}", data=json.dumps(body).encode()), timeout=120) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_requests_that_arrive_together_are_one_batch():
    batches, hold = [], threading.Event()

    def many(bodies):
        batches.append(len(bodies))
        if any(b["q"] == "poison" for b in bodies):
            raise OSError("all of it")
        hold.wait(20)
        return [ValueError("odd") if b["q"] % 7 == 3 else {"twice": 2 * b["q"]} for b in bodies]

    hold.set()
    together = Coalescer(many, gather=1.0)
    with Service(together, lambda b: b, port=0, close=together.close) as service, ThreadPoolExecutor(40) as pool:
        got = list(pool.map(lambda k: posted(service, "/retrieve", {"q": k}), range(32)))
        assert batches == [32] and got == [(400, {"detail": "odd"}) if k % 7 == 3 else (200, {"twice": 2 * k}) for k in range(32)]
        batches.clear()
        mixed = list(pool.map(lambda k: posted(service, "/retrieve", {"q": k}), [1, "poison", 2]))
        assert [s for s, _ in mixed] == [200, 500, 200] and sorted(batches) == [1, 1, 1, 3]  # an error is its own caller's
    with pytest.raises(Busy):
        together({"q": 1})

    hold.clear()
    narrow = Coalescer(many, batch=1, waiting=2, gather=0.0)
    with Service(narrow, lambda b: b, port=0) as service, ThreadPoolExecutor(8) as pool:
        first = pool.submit(posted, service, "/retrieve", {"q": 0})
        while len(batches) < 5:
            time.sleep(0.01)  # until the first request is under way
        rest = [pool.submit(posted, service, "/retrieve", {"q": 1}) for _ in range(5)]
        while sum(f.done() for f in rest) < 3:
            time.sleep(0.01)
        hold.set()
        assert first.result()[0] == 200 and sorted(f.result()[0] for f in rest) == [200, 200, 503, 503, 503]
    narrow.close()
    with pytest.raises(ValueError):
        Coalescer(many, batch=0)


#: A law without the two articles that nothing reaches.
WHOLE = "\n".join(x.replace(", law:article_6", "").replace("law:article_3 , ", "") for x in TTL.splitlines() if not x.startswith(("law:article_6", "law:article_3"))).replace("law:article_5", "law:article_3").replace("المادة 5", "المادة 3")


def judge(requests):
    return [{"text": json.dumps({"correctness": 2, "faithfulness": 1, "reason": ""}), "input_tokens": 1, "output_tokens": 1} for _ in requests]


def test_commands_end_to_end(spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "law.ttl"
    path.write_text(WHOLE, encoding="utf-8")
    for k, v in {"ARTICLE_COUNT": "4", "NODE_TABLE": "e2e_nodes", "EDGE_TABLE": "e2e_edges", "LLM_MODEL": "fixed"}.items():
        monkeypatch.setenv(k, v)
    settings.get_settings.cache_clear()
    models = Models(settings.get_settings(), writer, embedder, judge)

    def run(*args):
        code = main(list(args), models)
        got = capsys.readouterr()
        return code, json.loads(got.out) if got.out.strip() else json.loads(got.err.strip().splitlines()[-1])

    try:
        code, out = run("ingest", str(path), "--reset")
        assert code == 0 and out["dimensions"] == 5 and all(x["requested"] == x["stored"] for x in out["stored"]), out
        assert spark.table("e2e_nodes").where("embedding IS NULL").isEmpty()
        assert run("ingest", str(path))[0] == 1  # filled already
        assert run("describe")[1]["e2e_nodes"]["rows"] > 0
        code, found = run("retrieve", "ما حكم تأخير الأجر والإجازة؟", "--output", str(tmp_path / "found.json"))
        assert code == 0 and found["articles"] and json.loads((tmp_path / "found.json").read_text(encoding="utf-8")) == found
        small = debugged(found | {"x": 0.123456789123})
        assert "text" not in small["articles"][0] and small["x"] == 0.12345679
        assert run("retrieve", "x")[0] == 1
        code, said = run("generate", str(tmp_path / "found.json"))
        assert code == 0 and said["status"] == "generated" and said["citations"]
        (tmp_path / "bad.json").write_text(json.dumps({**found, "more": 1}))
        assert run("generate", str(tmp_path / "bad.json"))[1]["detail"].endswith("unknown_keys")
        engine, plans_run = Engine(spark, settings.get_settings(), models), []
        own = engine.retrieve_many
        engine.retrieve_many = lambda bodies: plans_run.append(len(bodies)) or own(bodies)
        with engine.serving(0, gather=1.0) as service, ThreadPoolExecutor(8) as pool:
            asked = [found["question"], "x", found["question"], 5]
            got = list(pool.map(lambda q: posted(service, "/retrieve", {"question": q}), asked))
            assert plans_run == [4] and [s for s, _ in got] == [200, 400, 200, 400] and got[0][1] == got[2][1] == found
            told = list(pool.map(lambda b: posted(service, "/generate", b), [found, {**found, "more": 1}, found | {"question_id": 9}, {}]))
            assert [s for s, _ in told] == [200, 400, 200, 400] and told[0][1] == said and told[2][1] == said | {"question_id": 9}
        assert run("smoke", "ما حكم تأخير الأجر والإجازة؟")[1]["generation"]["grounded"]

        cases = [
            {"case_id": "a", "question": "ما حكم تأخير الأجر والإجازة؟", "expected_behavior": "retrieve", "test_type": "x", "required_articles": [4], "reference_answer": "r"},
            {"case_id": "b", "question": "كيف أصمم مطبخ", "expected_behavior": "abstain", "test_type": "y", "required_articles": []},
            {"case_id": "c", "question": "سؤال رقم", "expected_behavior": "retrieve", "test_type": "x", "required_articles": [4]},
        ]
        bench = tmp_path / "bench.json"
        bench.write_text(json.dumps({"frozen": True, "cases": cases}, ensure_ascii=False), encoding="utf-8")
        code, total = run("evaluate", str(bench), "--runs", "1", "--limit", "2", "--batch", "2", "--output", str(tmp_path / "runs"))
        assert code == 0 and total["runs"] == 1 and total["complete"] and total["metrics"]["summary.routing_accuracy"]["mean"] == 1.0
        one = json.loads((tmp_path / "runs/run-1.json").read_text(encoding="utf-8"))
        assert one["summary"]["mean_latency_seconds"] > 0 and all(r["retrieval_seconds"] > 0 for r in one["rows"])
        assert one["summary"]["questions_completed"] == 2 and [r["end_to_end_pass"] for r in one["rows"]] == [True, True]
        assert run("evaluate", str(bench), "--limit", "2", "--judge-model", "other", "--output", str(tmp_path / "runs"))[1]["detail"].startswith("the run is of another identity: judge")
        bench.write_text(json.dumps({"frozen": False, "cases": cases}), encoding="utf-8")
        assert "not frozen" in run("evaluate", str(bench))[1]["detail"]
    finally:
        settings.get_settings.cache_clear()
        for t in ("e2e_nodes", "e2e_edges"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_a_failure_inside_a_batch_is_done_again(spark, tmp_path):
    """Cases 1 and 3 of one batch of five fail; the second start does those two only."""
    cases = spark.createDataFrame([(i, f"c{i}", f"q{i}") for i in range(5)], "case_index long, case_id string, question string")
    run, asked = runs.Run(spark, str(tmp_path / "run"), runs.Identity("d", 1, "p", "m", "j", 0, None)), []

    def do(part):
        own = part.collect()
        asked.append(sorted(r.case_index for r in own))
        rows = [(r.case_index, r.case_id, r.question, "down" if r.case_index in (1, 3) and len(asked) == 1 else None) for r in own]
        return spark.createDataFrame(rows, "case_index long, case_id string, question string, error string")

    assert runs.run_cases(run, cases, do, batch=5).where("error IS NOT NULL").count() == 2
    assert runs.run_cases(run, cases, do, batch=5).where("error IS NULL").count() == 5
    assert asked == [[0, 1, 2, 3, 4], [1, 3]]
    assert runs.run_cases(run, cases, do, batch=5).count() == 5 and len(asked) == 2


def test_cases_over_http(spark):
    """Endpoints are asked case by case, with the seconds of each; what a request loses is its case's error."""

    def retrieve(body):
        if body["question"] == "boom":
            raise RuntimeError("inside")
        time.sleep(0.05)
        return {"decision": {"behavior": "retrieve", "planner_used": True}, "diagnostics": {"article_numbers": [4, 5]}, "question": body["question"]}

    def generate(body):
        if body["question"] == "mute":
            raise ValueError("not a document")
        return {"status": "generated", "answer": "a", "cited_article_numbers": [4], "warnings": [], "model": "m"}

    cases = spark.createDataFrame([(0, "fine", None), (1, "boom", "t"), (2, "mute", "t")], "case_index long, question string, test_type string").coalesce(1)
    with Service(retrieve, generate, port=0) as service:
        rows = {r.question: r for r in runs.over_http(cases, f"http://127.0.0.1:{service.port}/", timeout=20, delay=0.01).collect()}
    fine = rows["fine"]
    assert (fine.behavior, fine.given, fine.status, fine.cited, fine.error) == ("retrieve", [4, 5], "generated", [4], None)
    assert fine.retrieval_seconds >= 0.05 and fine.generation_seconds > 0
    assert rows["boom"].error.startswith("retrieval_http: 500") and rows["boom"].generation_seconds is None
    assert rows["mute"].error.startswith("generation_http: 400") and rows["mute"].given == [4, 5]


def test_broken_runs_go_on(spark, tmp_path):
    cases = spark.createDataFrame([(i, f"c{i}", f"q{i}") for i in range(5)], "case_index long, case_id string, question string")
    own = runs.Identity("d", 1, "p", "m", "j", 0, None)
    done = []

    def do(part):
        rows = [(r.case_index, r.case_id, r.question, "down" if r.case_index == 2 and not done else None) for r in part.collect()]
        return spark.createDataFrame(rows, "case_index long, case_id string, question string, error string")

    run = runs.Run(spark, str(tmp_path / "run"), own)
    assert runs.run_cases(run, cases, do, batch=1, stop_on_error=True).count() == 3
    done.append(1)
    assert [r.case_index for r in run.left(cases).orderBy("case_index").collect()] == [2, 3, 4]
    assert {r.case_index: (r.state, r.attempt) for r in run.states(cases).collect()} == {0: ("done", 1), 1: ("done", 1), 2: ("failed", 1), 3: ("open", 0), 4: ("open", 0)}
    assert runs.run_cases(run, cases, do, batch=2).where("error IS NULL").count() == 5
    with pytest.raises(ValueError, match="other cases"):
        run.left(cases.replace("q1", "z", "question"))
    with pytest.raises(ValueError, match="another identity: model"):
        runs.Run(spark, str(tmp_path / "run"), runs.Identity("d", 1, "p", "n", "j", 0, None)).open()
    assert [r.case_id for r in runs.sliced(cases, 1, 2).orderBy("case_index").collect()] == ["c1", "c2"]
    documents = [{"identity": {"run": k, "model": "m"}, "complete": True, "summary": {"a": k, "b": True}} for k in (1, 2)]
    total = runs.aggregate(spark, documents, ["summary.a", "summary.b", "summary.none.x"])
    assert total["metrics"]["summary.a"]["mean"] == 1.5 and total["metrics"]["summary.b"]["mean"] == 1.0
    with pytest.raises(ValueError):
        runs.aggregate(spark, [documents[0], {"identity": {"run": 2, "model": "z"}, "complete": True}], ["summary.a"])
    assert "FAILED down" in runs.console_row({"case_index": 1, "case_id": "c", "error": "down"}) and "pass recall=1.00" in runs.console_row({"case_index": 1, "case_id": "c", "end_to_end_pass": True, "article_recall_at_5": 1.0})


def test_ingestion_by_updates(spark, tmp_path, capsys, monkeypatch):
    """The second ingestion of a file embeds nothing; a changed label embeds its node alone; retrieval reads the view."""
    path, calls = tmp_path / "law.ttl", tmp_path / "calls"
    path.write_text(WHOLE, encoding="utf-8")
    for k, v in {"ARTICLE_COUNT": "4", "NODE_TABLE": "upd_nodes", "EDGE_TABLE": "upd_edges", "LLM_MODEL": "fixed"}.items():
        monkeypatch.setenv(k, v)
    settings.get_settings.cache_clear()

    def counting(texts, own=embedder, log=str(calls)):
        with open(log, "a") as f:
            f.write("x" * len([t for t in texts if t != "probe"]))
        return own(texts)

    models = Models(settings.get_settings(), writer, counting, judge)

    def run(*args):
        assert main(list(args), models) == 0, capsys.readouterr().err[-2000:]
        return json.loads(capsys.readouterr().out)

    asked = lambda: len(calls.read_text()) if calls.exists() else 0
    try:
        first = run("ingest", str(path), "--update")["updated"]
        n = first["upd_nodes"]["inserted"]
        assert n > 20 and first["upd_nodes"]["embedded"] == asked() == n and first["upd_edges"]["inserted"] > n
        again = run("ingest", str(path), "--update")["updated"]
        assert asked() == n and again["upd_nodes"] == {"inserted": 0, "updated": 0, "unchanged": n, "removed": 0, "embedded": 0}
        path.write_text(WHOLE.replace('"الراتب"', '"المرتب"'), encoding="utf-8")
        third = run("ingest", str(path), "--update")["updated"]
        assert third["upd_nodes"]["updated"] == 1 and asked() == n + 1 and third["upd_edges"]["inserted"] == third["upd_edges"]["removed"] == 1
        assert run("retrieve", "ما حكم تأخير الأجر والإجازة؟")["articles"]
        assert run("create", "--reset")["upd_nodes"]["deleted"] and spark.table("upd_nodes").isEmpty()
    finally:
        settings.get_settings.cache_clear()
        for t in ("upd_nodes", "upd_edges"):
            versions.drop(spark, t) if versions.is_versioned(spark, t) else spark.sql(f"DROP TABLE IF EXISTS {t}")
