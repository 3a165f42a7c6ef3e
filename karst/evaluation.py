"""A benchmark run: cases through retrieval, answer and judge, row by row into a table that a broken run goes on from.

A run is a folder.  ``identity`` says what it is a run of; ``rows`` is a table to which every batch of cases is committed whole or not
at all, with the number of its attempt.  A case's state follows from its newest row, so that a run goes on with the cases that
have none and those that failed, wherever they stand; resuming demands the same identity.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from karst.functions.text import arabic_only
from karst.operators import evaluate as ev
from karst.sources.providers import http_transport, post_json
from karst.sources.scratch import written

JUDGE = "Grade an answer against the reference: correctness and faithfulness, each 0, 1 or 2, with a reason. Reply as JSON."
_GRADE = {"type": "integer", "minimum": 0, "maximum": 2}
GRADES = {"type": "object", "properties": {"correctness": _GRADE, "faithfulness": _GRADE, "reason": {"type": "string"}}, "required": ["correctness", "faithfulness"]}
GRADED = T.StructType([T.StructField("correctness", T.IntegerType()), T.StructField("faithfulness", T.IntegerType()), T.StructField("reason", T.StringType())])
_NUMBERS = T.ArrayType(T.IntegerType())
CASE = T.StructType([T.StructField(c, _NUMBERS if c.endswith("_articles") else T.StringType()) for c in ("case_id", "question", "expected_behavior", "test_type", "required_articles", "acceptable_articles", "reference_answer")])


@dataclass(frozen=True)
class Identity:
    """What a run is of; two runs are comparable, and one can be resumed, only when all of it is equal."""

    benchmark_sha256: str
    run: int
    provider: str
    model: str
    judge: str
    start: int
    limit: int | None


def load_cases(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(case_index and the fields of CASE, digest of the file); a benchmark must be frozen and not empty."""
    with open(path, encoding="utf-8-sig") as f:
        raw = f.read()
    document = json.loads(raw)
    if not isinstance(document, dict) or document.get("frozen") is not True:
        raise ValueError("the benchmark is not frozen")
    cases = document.get("cases") or []
    if not cases:
        raise ValueError("the benchmark has no cases")
    rows = [(i, *(c.get(f.name) for f in CASE.fields)) for i, c in enumerate(cases)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("case_index", T.LongType()), *CASE.fields])), hashlib.sha256(raw.encode()).hexdigest()


def sliced(cases: DataFrame, start: int = 0, limit: int | None = None, order: str = "case_index") -> DataFrame:
    """The cases from the start-th on (from 0), ``limit`` of them, numbered again in ``order``."""
    if start < 0 or (limit is not None and limit < 1):
        raise ValueError("start must be 0 or more and limit 1 or more")
    n = F.row_number().over(Window.orderBy(order)) - 1
    if limit is not None:  # only the first start + limit of each task go on to the one that numbers them
        cases = cases.orderBy(order).limit(start + limit)
    kept = cases.withColumn("_n", n).where(F.col("_n") >= start)
    return kept.withColumn(order, (F.col("_n") - start).cast("long")).drop("_n")


def out_of_scope_correct(behavior, status, answer, cited):
    """Whether an out-of-scope case was answered as one: abstained, said so, in Arabic alone, without citations."""
    return (behavior == "abstain") & (status == "out_of_scope") & arabic_only(answer) & (F.size(F.coalesce(cited, F.array().cast("array<int>"))) == 0)


def scored(results: DataFrame) -> DataFrame:
    """The rows of a run: results (the fields of CASE, behavior, given, status, answer, cited, grades, error) with every metric."""
    expected, done = F.col("expected_behavior"), F.col("error").isNull()
    none = F.array().cast("array<int>")
    required, acceptable = F.coalesce("required_articles", none), F.coalesce("acceptable_articles", none)
    given = ev.actual_numbers(F.col("given"), F.lit(None).cast("array<int>"), F.lit(None).cast("array<int>"))
    cited = ev.citations_given(F.col("cited"), F.col("answer"))
    metrics = ev.retrieval_metrics(expected, F.col("behavior"), required, acceptable, given) | ev.citation_metrics(expected, cited, given, required)
    rows = results.withColumns({k: F.when(done, v) for k, v in metrics.items()})
    rows = rows.withColumn("out_of_scope_response_correct", F.when(done, out_of_scope_correct(F.col("behavior"), F.col("status"), F.col("answer"), F.col("cited"))))
    rows = rows.withColumns({"correctness": F.col("grades.correctness") / 2, "faithfulness": F.col("grades.faithfulness") / 2})
    parts = {"expected": "expected_behavior", "routing": "routing_correct", "oos": "out_of_scope_response_correct", "recall": "article_recall_at_5", "correctness_grade": "grades.correctness", "faithfulness_grade": "grades.faithfulness", "validity": "citation_validity", "citation_recall": "citation_recall"}
    return rows.withColumn("end_to_end_pass", F.when(done, F.coalesce(ev.end_to_end_pass({k: F.col(v) for k, v in parts.items()}), F.lit(False))))


def judged(results: DataFrame, completer: Callable, store: str | None = None) -> DataFrame:
    """results with ``grades`` of the generated answers; a judge that fails or says nothing is the row's error."""
    from karst.sources.models import ask, with_digest
    from karst.sources.structured import structured

    wanted = results.where("error IS NULL AND status = 'generated'")
    payload = F.to_json(F.struct("question", "reference_answer", "answer"))
    requests = with_digest(wanted.select("case_index", F.lit("judge").alias("stage"), F.lit(JUDGE).alias("instructions"), payload.alias("payload"), F.lit(1000).alias("max_output_tokens")))
    replies = ask(requests.select("stage", "instructions", "payload", "max_output_tokens"), completer, store)
    parsed = replies.withColumn("x", structured(F.col("text"), GRADES, GRADED)).select("request_digest", F.col("x.value").alias("grades"), F.concat(F.lit("judge_failed: "), F.coalesce("error", "x.error")).alias("judge_error"))
    told = requests.select("case_index", "request_digest").join(parsed, "request_digest").drop("request_digest")
    return results.join(told, "case_index", "left").withColumn("error", F.coalesce("error", "judge_error")).drop("judge_error")


def foreign_rows(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """The rows whose case is not the benchmark's of that number: another id, another question, or none."""
    both = rows.select("case_index", F.col("case_id").alias("_id"), F.col("question").alias("_q")).join(cases, "case_index", "left")
    return both.where("NOT (_id <=> case_id) OR NOT (_q <=> question)")


class Run:
    """One run's folder."""

    def __init__(self, spark: SparkSession, folder: str, identity: Identity):
        self.spark, self.folder, self.identity = spark, folder.rstrip("/"), identity

    def _identity_path(self) -> str:
        return f"{self.folder}/identity"

    def open(self) -> None:
        """Makes the folder, or checks that it is a run of the same identity."""
        own = json.dumps(asdict(self.identity), sort_keys=True)
        if self._there(self._identity_path()):
            found = self.spark.read.text(self._identity_path(), wholetext=True).first()[0].strip()
            if found != own:
                was, now = json.loads(found), asdict(self.identity)
                raise ValueError("the run is of another identity: " + ", ".join(f"{k} {was.get(k)!r} is not {v!r}" for k, v in now.items() if was.get(k) != v))
            return
        self.spark.createDataFrame([(own,)], "value string").coalesce(1).write.mode("overwrite").text(self._identity_path())

    def _there(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def rows(self) -> DataFrame | None:
        """The run's rows so far; of a case that was done again the last one."""
        if not self._there(f"{self.folder}/rows"):
            return None
        rows = self.spark.read.parquet(f"{self.folder}/rows")
        newest = Window.partitionBy("case_index").orderBy(F.desc("attempt"))
        return rows.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")

    def states(self, cases: DataFrame) -> DataFrame:
        """case_index, state (done, failed or open) and attempt (of the newest row) of every case, checked to be the benchmark's."""
        rows = self.rows()
        if rows is None:
            return cases.select("case_index", F.lit("open").alias("state"), F.lit(0).alias("attempt"))
        if not foreign_rows(rows, cases).isEmpty():
            raise ValueError("the rows are of other cases")
        told = rows.select("case_index", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("s"), F.col("attempt").alias("a"))
        return cases.select("case_index").join(told, "case_index", "left").select("case_index", F.coalesce("s", F.lit("open")).alias("state"), F.coalesce("a", F.lit(0)).alias("attempt"))

    def left(self, cases: DataFrame) -> DataFrame:
        """The cases to do: those without a row, and those whose newest row failed."""
        return cases.join(self.states(cases).where("state <> 'done'").select("case_index"), "case_index", "left_semi")

    def append(self, results: DataFrame, attempt: int) -> None:
        results.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{self.folder}/rows")


def run_cases(run: Run, cases: DataFrame, do: Callable[[DataFrame], DataFrame], *, batch: int = 16, stop_on_error: bool = False, delay: float = 0.0) -> DataFrame:
    """Does what is left of the cases in batches, each a checkpoint; a batch with a failed case ends the run when asked to.

    do: cases -> case_index, case_id, question and the columns of ``scored``.  The batches are of a stated number of cases, as
    each is a number of model calls; delay: seconds between two of them.
    """
    run.open()
    before = run.rows()
    attempt = 1 + ((before.agg(F.max("attempt")).first()[0] or 0) if before is not None else 0)
    numbers = [r[0] for r in run.left(cases).select("case_index").orderBy("case_index").collect()]  # a benchmark's case numbers
    for k in range(0, len(numbers), batch):
        if k and delay:
            time.sleep(delay)
        mine = F.col("case_index").isin(numbers[k : k + batch])
        run.append(do(cases.where(mine)), attempt)
        if stop_on_error and not run.rows().where(mine & F.col("error").isNotNull()).isEmpty():
            break
    return run.rows()


def timed(df: DataFrame, name: str) -> tuple[DataFrame, float]:
    """df written, and the seconds that took: of a batch, what each of its cases waited."""
    began = time.monotonic()
    out = written(df, name)
    return out, time.monotonic() - began


_ASKED = "behavior string, planner_used boolean, given array<int>, status string, answer string, cited array<int>, warnings array<string>, model string, error string, retrieval_seconds double, generation_seconds double"


def over_http(part: DataFrame, base_url: str, *, timeout: float = 120.0, delay: float = 0.0, transport: Callable = http_transport) -> DataFrame:
    """The cases with what a server's endpoints say to each question, and the seconds of both; a request that fails is its case's error.

    One request at a time in a task, with ``delay`` seconds between two cases.
    """
    url = base_url.rstrip("/")

    def case(question: str) -> tuple:
        found = post_json(f"{url}/retrieve", {"question": question}, timeout=timeout, transport=transport)
        if found["error"]:
            return None, None, None, None, None, None, None, None, f"retrieval_{found['error']}: {found['status']} {found['detail']}", found["seconds"], None
        value = found["value"]
        decision = value.get("decision") or {}
        own = (decision.get("behavior"), decision.get("planner_used"), (value.get("diagnostics") or {}).get("article_numbers"))
        said = post_json(f"{url}/generate", value, timeout=timeout, transport=transport)
        if said["error"]:
            return *own, None, None, None, None, None, f"generation_{said['error']}: {said['status']} {said['detail']}", found["seconds"], said["seconds"]
        answer = said["value"]
        return *own, answer.get("status"), answer.get("answer"), answer.get("cited_article_numbers"), answer.get("warnings"), answer.get("model"), None, found["seconds"], said["seconds"]

    schema = T.StructType([*part.schema.fields, *T.StructType.fromDDL(_ASKED).fields])

    def run(batches):
        asked = False
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if asked and delay:
                    time.sleep(delay)
                asked = True
                row.update(zip(told, case(row["question"]), strict=True))
            yield pa.RecordBatch.from_pylist(rows, schema=wanted)

    wanted, told = to_arrow_schema(schema), T.StructType.fromDDL(_ASKED).names
    return part.mapInArrow(run, schema)


def document(rows: DataFrame, identity: Identity, n_cases: int) -> dict:
    """A run as one JSON document: identity, summary, summaries by type, whether it is complete, and its rows."""
    summary = ev.run_summary(rows).first().asDict()
    by_type = {r.test_type: r.asDict() for r in ev.summary_by_type(rows).orderBy("test_type").collect()}
    waited = F.col("retrieval_seconds") + F.coalesce("generation_seconds", F.lit(0.0))
    summary["mean_latency_seconds"] = rows.where("error IS NULL").agg(F.round(F.avg(waited), 6)).first()[0] if {"retrieval_seconds", "generation_seconds"} <= set(rows.columns) else None
    own = [json.loads(x) for x in rows.orderBy("case_index").toJSON().collect()]  # the report of one benchmark
    return {"schema_version": "run.v2", "identity": asdict(identity), "complete": summary["questions_completed"] == n_cases, "summary": summary, "by_test_type": by_type, "rows": own}


def _picked(run: dict, path: str) -> float | None:
    """The number at a dotted path; truths count as 1 and 0, all else as nothing."""
    for key in path.split("."):
        run = run.get(key) if isinstance(run, dict) else None
    return float(run) if isinstance(run, (bool, int, float)) else None


def aggregate(spark: SparkSession, runs: list[dict], paths: list[str]) -> dict:
    """Statistics of the numbers at dotted paths over the documents of runs; all must be complete and of one identity but for the run number."""
    if not runs:
        raise ValueError("no runs")
    kinds = {json.dumps({k: v for k, v in r["identity"].items() if k != "run"}, sort_keys=True) for r in runs}
    if len(kinds) > 1:
        raise ValueError("the runs are not of the same benchmark, model and judge")
    names = [f"m{i}" for i in range(len(paths))]
    table = spark.createDataFrame([(bool(r["complete"]), *(_picked(r, p) for p in paths)) for r in runs], ", ".join(["complete boolean", *(f"{n} double" for n in names)]))
    stats = {r.metric: r for r in ev.run_stats(table, names).collect()}
    return {"schema_version": "runs.v2", "runs": len(runs), "complete": all(r["complete"] for r in runs), "metrics": {p: ({k: stats[n][k] for k in ("n", "mean", "std", "min", "max")} if n in stats else None) for n, p in zip(names, paths, strict=True)}}


def save(value: dict, path: str) -> None:
    """Writes a JSON document whole or not at all: to a file beside it, which then takes its name."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(path + ".part", path)


def console_row(row: dict) -> str:
    """One line that tells how a case went."""
    if row.get("error"):
        return f"[{row['case_index']}] {row['case_id']} FAILED {row['error'][:120]}"
    share = lambda k: "-" if row.get(k) is None else f"{row[k]:.2f}"
    return f"[{row['case_index']}] {row['case_id']} {'pass' if row.get('end_to_end_pass') else 'miss'} recall={share('article_recall_at_5')} citations={share('citation_validity')} correctness={share('correctness')}"
