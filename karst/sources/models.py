"""Calls of language models behind one interface, with their responses kept.

A completer is any picklable function from a list of requests (dicts of stage, instructions, payload,
max_output_tokens) to a list of replies (dicts of text, input_tokens, output_tokens).  It is called by several threads of
a task at once.  A reply is logged under the digest of its request as it comes, and stored before anything reads it; what is
logged or stored is never asked for again, so a task that is lost costs the calls that were under way, and no others.
A call that fails is a row with an error, not the end of the batch, and is neither logged nor stored.
"""

from __future__ import annotations

import contextlib
import functools
import json
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.sources.scratch import shared_dir, written

RESPONSES = "request_digest string, text string, input_tokens long, output_tokens long, total_tokens long, attempts int, error string"
#: Calls of one task that are under way at once.
CALLS = 4


class EmptyReply(ValueError):
    """A model gave no usable text, twice."""


def complete_with_retry(completer: Callable, request: dict) -> dict:
    """One call, and a second with max(2 x limit, 3000) tokens when the first reply is empty or cut off; usage adds up."""
    used = [0, 0]
    for attempt, limit in enumerate((request["max_output_tokens"], max(2 * request["max_output_tokens"], 3000)), 1):
        reply = completer([request | {"max_output_tokens": limit}])[0]
        used[0] += reply.get("input_tokens", 0)
        used[1] += reply.get("output_tokens", 0)
        if (reply.get("text") or "").strip() and not reply.get("cut_off"):
            return {"text": reply["text"], **usage(*used), "attempts": attempt}
        if reply.get("refused"):
            break
    raise EmptyReply(f"no usable reply at stage {request['stage']}")


def recorded(replies: dict[str, str]) -> Callable:
    """A completer that answers from a table of payload -> text, for tests and offline runs."""

    def complete(requests: list[dict]) -> list[dict]:
        return [{"text": replies.get(r["payload"], ""), "input_tokens": len(r["payload"]), "output_tokens": len(replies.get(r["payload"], ""))} for r in requests]

    return complete


def with_digest(requests: DataFrame) -> DataFrame:
    """requests (stage, instructions, payload, max_output_tokens) with request_digest."""
    return requests.withColumn("request_digest", F.sha2(F.to_json(F.struct("stage", "instructions", "payload", "max_output_tokens")), 256))


def usage(input_tokens, output_tokens) -> dict:
    """A usage record: the total is the sum."""
    return {"input_tokens": int(input_tokens or 0), "output_tokens": int(output_tokens or 0), "total_tokens": int(input_tokens or 0) + int(output_tokens or 0)}


def usage_total(calls: DataFrame, by: list[str]) -> DataFrame:
    """by, input_tokens, output_tokens, total_tokens: what calls (tokens: a usage record, null counts as 0) used."""
    n = lambda k: F.coalesce(F.sum(F.col("tokens")[k]), F.lit(0)).cast("long")
    used = calls.groupBy(*by).agg(n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"))
    return used.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


@functools.cache
def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there, once a process."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


class ReplyLog:
    """The good replies of calls, a file each, named by the digest of the request.

    A file is written beside its place and then moved there, so it is whole or not there, and writing it twice leaves
    one.  Its folder must be of a kind that Arrow opens (local, HDFS, S3, GCS); of any other kind nothing is logged,
    and a lost task asks for its replies again.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        try:
            self._open()
        except (pa.ArrowException, OSError, ValueError):
            self.folder = None

    def _open(self) -> tuple[fs.FileSystem, str]:
        return _opened(self.folder)

    def _place(self, digest: str) -> tuple[fs.FileSystem, str]:
        files, root = self._open()
        return files, f"{root}/{digest[:2]}/{digest}.json"

    def get(self, digest: str) -> dict | None:
        if self.folder is None:
            return None
        files, path = self._place(digest)
        if files.get_file_info(path).type != fs.FileType.File:
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def put(self, digest: str, reply: dict) -> None:
        """A reply that can't be logged is still a reply."""
        with contextlib.suppress(OSError):
            self._put(digest, reply)

    def _put(self, digest: str, reply: dict) -> None:
        if self.folder is None:
            return
        files, path = self._place(digest)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex[:8]}"
        with files.open_output_stream(part) as f:
            f.write(json.dumps(reply).encode())
        files.move(part, path)

    def forget(self, digest: str) -> None:
        """Of what the store holds by now."""
        if self.folder is not None:
            files, path = self._place(digest)
            if files.get_file_info(path).type == fs.FileType.File:
                files.delete_file(path)


def ask(requests: DataFrame, completer: Callable, store: str | None = None, calls: int = CALLS) -> DataFrame:
    """The responses to distinct requests, written: those of ``store`` (a folder, made where there is none), and those of the calls that are left.

    Requests are dealt by digest over as many tasks as shuffles have partitions, ``calls`` of a task are under way at once, and each good reply is
    logged as it comes: below the store, where a later run finds it too, or else in the shared folder for this run's own
    further attempts.  Failed calls have a null text and an error; only good replies go to the log and the store.
    """
    if calls < 1:
        raise ValueError("at least one call must be under way")
    spark = requests.sparkSession
    log = ReplyLog(shared_dir(spark, "calls") if store is None else f"{store.rstrip('/')}/_calls")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = with_digest(requests).repartition(tasks, "request_digest").dropDuplicates(["request_digest"])
    if store is not None:
        spark.createDataFrame([], RESPONSES).write.mode("append").parquet(store)
        known = spark.read.schema(RESPONSES).parquet(store).dropDuplicates(["request_digest"])
        asked = asked.join(known.select("request_digest"), "request_digest", "left_anti")

    def answer(row: dict) -> dict:
        request = json.loads(json.dumps(row, default=int))
        digest = request["request_digest"]
        try:
            reply = log.get(digest)
            if reply is None:
                reply = complete_with_retry(completer, request)
                log.put(digest, reply)
            return {"request_digest": digest, **reply, "error": None}
        except Exception as e:
            return {"request_digest": digest, "text": None, **usage(0, 0), "attempts": 0, "error": f"{type(e).__name__}: {e}"[:4000]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(calls) as pool:
            for batch in batches:
                rows = list(pool.map(answer, batch.to_dict("records")))
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RESPONSES.split(", ")])

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for digest in batch["request_digest"]:
                log.forget(digest)
            yield batch.iloc[:0]

    new = written(asked.select("request_digest", "stage", "instructions", "payload", "max_output_tokens").mapInPandas(run, RESPONSES), "replies")
    if store is not None:
        new.where("error IS NULL").write.mode("append").parquet(store)
    new.where("error IS NULL").select("request_digest").mapInPandas(stored, "request_digest string").write.format("noop").mode("overwrite").save()
    if store is None:
        return new
    wanted = with_digest(requests).select("request_digest").distinct()
    return new.unionByName(known).join(wanted, "request_digest", "left_semi")
