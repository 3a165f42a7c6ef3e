"""Command line: inspect and audit a Turtle file, create, fill, check and describe the stores, ask questions, run a benchmark.

    python -m karst inspect law.ttl            the report, first eligible nodes and bridge edges
    python -m karst audit law.ttl              articles that no concept reaches
    python -m karst create [--reset]           the two stores, and their columns
    python -m karst describe                   the columns and counts of the stores that are there
    python -m karst ingest law.ttl [--reset]   both tables with embeddings, counts compared
    python -m karst check law.ttl              stored against expected counts
    python -m karst retrieve QUESTION          one retrieval document [--output F] [--debug] [--compact]
    python -m karst generate retrieval.json    an answer from a saved retrieval document, which is never made again
    python -m karst smoke QUESTION             both, and what each took
    python -m karst evaluate benchmark.json    runs, their documents and their statistics
    python -m karst serve [--port 8000]        the endpoints
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from karst import evaluation as runs
from karst.operators import build, graph, search
from karst.operators import evaluate as ev
from karst.plans import retrieve as plans
from karst.server import Coalescer, Service
from karst.session import session
from karst.settings import Settings, get_settings
from karst.sources import store, versions
from karst.sources.documents import to_document
from karst.sources.providers import HttpEmbedder, build_completer
from karst.sources.scratch import written
from karst.sources.structured import schema_of, structured
from karst.sources.turtle import read_turtle


def _load(spark, path: str, s):
    triples = read_turtle(spark, path).persist()
    return triples, build.nodes_of(triples, s).persist(), build.edges_of_triples(triples).persist()


class Models:
    """The models of the settings; tests and offline runs give their own."""

    def __init__(self, s: Settings, completer: Callable | None = None, embedder: Callable | None = None, judge: Callable | None = None):
        self.s, self._completer, self._embedder, self._judge = s, completer, embedder, judge

    @property
    def completer(self) -> Callable:
        """Built when it is first needed."""
        self._completer = self._completer or build_completer(self.s, schemas=plans.STAGE_SCHEMAS | {"judge": runs.GRADES})
        return self._completer

    @property
    def embedder(self) -> Callable:
        if self._embedder is None:
            if not os.environ.get("EMBEDDING_URL"):
                raise ValueError("EMBEDDING_URL is not set")
            self._embedder = HttpEmbedder(os.environ["EMBEDDING_URL"], self.s.embedding_model, os.environ.get("EMBEDDING_API_KEY", ""))
        return self._embedder

    @property
    def judge(self) -> Callable:
        return self._judge or self.completer


def probe(embedder: Callable) -> int:
    """The embedder's dimensions, by one call before anything is dropped or written."""
    vectors = embedder(["probe"])
    if len(vectors) != 1 or not vectors[0]:
        raise ValueError("the embedder gives no vector")
    return len(vectors[0])


def debugged(found: dict) -> dict:
    """A retrieval document without the texts of its articles, all numbers to 8 places."""

    def rounded(x):
        if isinstance(x, float):
            return round(x, 8)
        if isinstance(x, list):
            return [rounded(v) for v in x]
        return {k: rounded(v) for k, v in x.items() if k != "text"} if isinstance(x, dict) else x

    return rounded(found)


def indexes(spark, s: Settings) -> dict:
    """The stored index and packed edges of the stores, as far as they are there."""
    return {"index": search.node_index(spark, f"{s.node_table}_words"), "walks": graph.packed(spark, f"{s.edge_table}_walks"), "nearby": search.vector_index(spark, f"{s.node_table}_near")}


def _indexed(spark, s: Settings) -> None:
    search.index_nodes(spark.table(s.node_table), f"{s.node_table}_words")
    search.index_vectors(spark.table(s.node_table), f"{s.node_table}_near")
    graph.pack(spark.table(s.edge_table), s, f"{s.edge_table}_walks")


def _update(spark, s: Settings, models: Models, nodes, edges, reset: bool) -> dict:
    """The stores updated by key; the indexes follow when anything changed."""
    out = {}
    for name, rows, schema, key, embedder in ((s.node_table, nodes, store.NODE_SCHEMA, F.col("uri"), models.embedder), (s.edge_table, edges, store.EDGE_SCHEMA, build.edge_key(edges.columns), None)):
        if reset:
            versions.drop(spark, name)
        if spark.catalog.tableExists(name) and not versions.is_versioned(spark, name):
            raise ValueError(f"{name} was not made by updates; use reset without --update, or another name")
        out[name] = versions.update(spark, name, rows, schema, key, embedder=embedder, batch=s.embedding_batch_size)
    if any(c[k] for c in out.values() for k in ("inserted", "updated", "removed")):
        _indexed(spark, s)
    return out


class Engine:
    """Questions over the stores, as the command line asks one and the server those that arrive together: one run of the plan for all of them."""

    def __init__(self, spark, s: Settings, models: Models):
        self.spark, self.s, self.models = spark, s, models

    def _documents(self, df) -> dict:
        """The documents of a batch by question_id."""
        return {r.question_id: json.loads(r.d) for r in df.select("question_id", to_document(F.struct(*df.columns)).alias("d")).collect()}  # a batch of requests

    def retrieve_many(self, bodies: list[dict]) -> list:
        """A retrieval document for each body, or what was wrong with it."""
        out: list = [None if isinstance(b.get("question"), str) else ValueError("question must be a text") for b in bodies]
        asked = [(k, b["question"]) for k, b in enumerate(bodies) if out[k] is None]
        if not asked:
            return out
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", "retrieve")
        questions = self.spark.createDataFrame(asked, "question_id int, question string")
        found = plans.retrieve(questions, self.spark.table(self.s.node_table), self.spark.table(self.s.edge_table), completer=self.models.completer, embedder=self.models.embedder, settings=self.s, **indexes(self.spark, self.s))
        for k, row in self._documents(found).items():
            reason = row["decision"]["reason"] if row["status"] == "error" else None
            out[k] = ValueError("the question is too short") if reason == "question_too_short" else RuntimeError(reason) if reason is not None else row | {"question_id": 1}
        return out

    def generate_many(self, bodies: list[dict]) -> list:
        """An answer for each retrieval document, or what was wrong with it."""
        out: list = [None if b.get("schema_version") == plans.RETRIEVAL_VERSION else ValueError(f"not a document of {plans.RETRIEVAL_VERSION}") for b in bodies]
        told = [(k, json.dumps(b)) for k, b in enumerate(bodies) if out[k] is None]
        if not told:
            return out
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", "generate")
        kind = plans.retrieved_type()
        wanted = schema_of(kind, required=False) | {"required": ["question", "decision", "articles"]}
        read = self.spark.createDataFrame(told, "k int, t string").select("k", structured(F.col("t"), wanted, kind).alias("x"))
        for r in read.where("x.error IS NOT NULL").select("k", "x.error").collect():
            out[r.k] = ValueError(f"not a retrieval document: {r.error}")
        if all(out[k] is not None for k, _ in told):
            return out
        good = read.where("x.error IS NULL").select("k", "x.value.*").drop("question_id").withColumnRenamed("k", "question_id")
        said = plans.generate(good, completer=self.models.completer, settings=self.s, model=self.s.llm_model)
        for k, row in self._documents(said).items():
            out[k] = row | {"question_id": bodies[k].get("question_id")}
        return out

    def retrieve(self, body: dict) -> dict:
        return self._one(self.retrieve_many([body]))

    def generate(self, body: dict) -> dict:
        return self._one(self.generate_many([body]))

    @staticmethod
    def _one(found: list) -> dict:
        if isinstance(found[0], Exception):
            raise found[0]
        return found[0]

    def serving(self, port: int, **limits) -> Service:
        """The endpoints, each with its queue."""
        retrieve, generate = Coalescer(self.retrieve_many, **limits), Coalescer(self.generate_many, **limits)
        return Service(retrieve, generate, self.healthy, port=port, close=lambda: (retrieve.close(), generate.close()))

    def healthy(self) -> bool:
        return all(self.spark.catalog.tableExists(t) and not self.spark.table(t).isEmpty() for t in (self.s.node_table, self.s.edge_table))


def _evaluate(spark, s: Settings, models: Models, args) -> dict:
    cases, digest = runs.load_cases(spark, args.path)
    cases = runs.sliced(cases, args.start, args.limit).persist()
    n, nodes, edges = cases.count(), spark.table(s.node_table), spark.table(s.edge_table)

    def engine(part):
        """The cases through the engine, a batch as one plan; each waits for its batch."""
        asked = part.select(F.col("case_index").cast("int").alias("question_id"), "question")
        found, seconds = runs.timed(plans.retrieve(asked, nodes, edges, completer=models.completer, embedder=models.embedder, settings=s, **indexes(spark, s)), "run-retrieved")
        said, more = runs.timed(plans.generate(found.where("status = 'ok'"), completer=models.completer, settings=s, model=s.llm_model).select("question_id", "status", "answer", F.col("cited_article_numbers").alias("cited"), "warnings", "model"), "run-generated")
        told = found.select("question_id", F.col("decision.behavior").alias("behavior"), F.col("diagnostics.article_numbers").alias("given"), F.col("decision.planner_used").alias("planner_used"), F.when(F.col("status") == "error", F.col("decision.reason")).alias("error")).join(said, "question_id", "left")
        told = told.withColumns({"retrieval_seconds": F.lit(seconds), "generation_seconds": F.lit(more)})
        return part.join(told, F.expr("case_index = question_id")).drop("question_id")

    def do(part):
        rows = runs.over_http(part, args.base_url, timeout=args.timeout, delay=args.delay) if args.base_url else engine(part)
        bad = F.when(F.col("error").isNull(), ev.integrity_error(F.col("planner_used"), F.lit("retrieve"), F.col("status"), F.col("warnings"), F.col("model"), F.lit(s.llm_model)))
        rows = rows.withColumn("error", F.coalesce("error", bad, F.when(F.col("status") == "error", F.element_at("warnings", 1)))).drop("planner_used")
        return runs.scored(runs.judged(written(rows, "run-rows"), models.judge))

    documents, folder = [], args.output or "runs"
    for k in range(1, args.runs + 1):
        run = runs.Run(spark, f"{folder}/run-{k}", runs.Identity(digest, k, s.llm_provider, s.llm_model, args.judge_model or s.llm_model, args.start, args.limit))
        rows = runs.run_cases(run, cases, do, batch=args.batch, stop_on_error=args.stop_on_error, delay=args.delay)
        documents.append(runs.document(rows, run.identity, n))
        runs.save(documents[-1], f"{folder}/run-{k}.json")
        for row in documents[-1]["rows"]:
            print(runs.console_row(row), file=sys.stderr)
        if not documents[-1]["complete"]:
            break  # what is there can be resumed
    paths = [f"summary.{m}" for m in ("end_to_end_success_rate", "routing_accuracy", *ev.RETRIEVE_METRICS, *ev.ANSWER_METRICS)]
    total = runs.aggregate(spark, documents, paths)
    runs.save(total, f"{folder}/aggregate.json")
    return total


def main(argv: list[str] | None = None, models: Models | None = None) -> int:
    parser = argparse.ArgumentParser(prog="karst", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["inspect", "audit", "create", "describe", "ingest", "check", "retrieve", "generate", "smoke", "evaluate", "serve"])
    parser.add_argument("path", nargs="?", help="a file, or the question")
    parser.add_argument("--reset", action="store_true", help="drop what is stored")
    parser.add_argument("--update", action="store_true", help="ingest: change the stores by key, and embed only what is new or changed")
    parser.add_argument("--output", help="write the document there (evaluate: the folder of the runs)")
    parser.add_argument("--debug", action="store_true", help="without texts, numbers to 8 places")
    parser.add_argument("--compact", action="store_true", help="on one line")
    parser.add_argument("--port", type=int, default=8000)
    parser.add_argument("--runs", type=int, default=3)
    parser.add_argument("--start", type=int, default=0)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--batch", type=int, default=16, help="cases to a checkpoint")
    parser.add_argument("--judge-model")
    parser.add_argument("--base-url", help="evaluate a server that runs there, case by case")
    parser.add_argument("--timeout", type=float, default=120.0, help="seconds for a request to it")
    parser.add_argument("--delay", type=float, default=0.0, help="seconds between batches, and between requests")
    parser.add_argument("--stop-on-error", action="store_true")
    args = parser.parse_args(argv)
    if args.command not in ("create", "describe", "serve") and not args.path:
        parser.error("a file or a question is needed")
    s, spark, held = get_settings(), session(), []
    models = models or Models(s)
    engine = Engine(spark, s, models)
    try:
        if args.command == "create":
            out = {t: store.ensure_store(spark, t, schema, args.reset) for t, schema in ((s.node_table, store.NODE_SCHEMA), (s.edge_table, store.EDGE_SCHEMA))}
            out |= {f"{t}_columns": [r.asDict() for r in store.describe_store(spark, t).collect()] for t in (s.node_table, s.edge_table)}
        elif args.command == "describe":
            out = {t: {"columns": [r.asDict() for r in store.describe_store(spark, t).collect()], "rows": spark.table(t).count()} if spark.catalog.tableExists(t) else None for t in (s.node_table, s.edge_table)}
        elif args.command == "retrieve":
            out = engine.retrieve({"question": args.path})
            out = debugged(out) if args.debug else out
        elif args.command == "generate":
            with open(args.path, encoding="utf-8-sig") as f:
                body = json.load(f)
            if not isinstance(body, dict):
                raise ValueError("a saved retrieval is a JSON object")
            out = engine.generate(body)
        elif args.command == "smoke":
            began = time.monotonic()
            found = engine.retrieve({"question": args.path})
            between = time.monotonic()
            said = engine.generate(found)
            out = {"retrieval": {"status": found["status"], "articles": found["diagnostics"]["article_numbers"], "seconds": round(between - began, 3)}, "generation": {"status": said["status"], "grounded": said["grounded"], "seconds": round(time.monotonic() - between, 3)}}
        elif args.command == "evaluate":
            out = _evaluate(spark, s, models, args)
            args.output = None
        elif args.command == "serve":
            with engine.serving(args.port) as service:
                print(json.dumps({"port": service.port}), flush=True)
                threading.Event().wait()
        else:
            triples, nodes, edges = held = _load(spark, args.path, s)
            report = build.inspection_report(triples, nodes, edges, s).first().asDict()
            if args.command == "inspect":
                bridges = edges.where(F.col("predicate_local_name").isin(build.CONCEPT_TO_ARTICLE + build.ARTICLE_TO_CONCEPT))
                out = report | {"eligible": [r.local_name for r in nodes.where("retrieval_eligible").orderBy("uri").limit(8).collect()]}
                out |= {"bridges": [[r.source_uri, r.predicate_local_name, r.target_uri] for r in bridges.orderBy("source_uri", "target_uri").limit(8).collect()]}
            elif args.command == "audit":
                out = {k: report[k] for k in ("article_count", "reachable_count", "unreachable_article_numbers")}
            elif args.command == "ingest":
                if not report["is_valid"]:
                    raise ValueError("the graph is not valid")
                dimensions = probe(models.embedder)
                if args.update:
                    out = {"updated": _update(spark, s, models, nodes, edges, args.reset), "dimensions": dimensions}
                else:
                    embedded = store.embed_within(nodes, models.embedder, "searchable_text", s.embedding_batch_size)
                    done = store.ingest(spark, embedded, edges, s.node_table, s.edge_table, reset=args.reset, valid=report["is_valid"])
                    out = {"stored": [r.asDict() for r in done.collect()], "dimensions": dimensions}
                    _indexed(spark, s)
            else:
                out = {t: {"stored": spark.table(t).count(), "expected": df.count()} for t, df in ((s.node_table, nodes), (s.edge_table, edges))}
        if args.output:
            runs.save(out, args.output)
        print(json.dumps(out, ensure_ascii=False, indent=None if args.compact else 2))
        return 0
    except Exception as e:  # a command line says what went wrong and how it ended
        print(json.dumps({"error": type(e).__name__, "detail": str(e)[:4000]}, ensure_ascii=False), file=sys.stderr)
        return 1
    finally:
        for df in held:  # else the next command of this session would read the file as it was
            df.unpersist()


if __name__ == "__main__":
    sys.exit(main())
