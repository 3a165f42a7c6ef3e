"""Operator 1, benchmark decontamination.

The normalised n-grams ("windows") of the benchmark form a broadcast hash set.  One pass over
the documents looks every token window up in it, verifies the hits word by word, and yields the
hit words, from which spans or whole documents are removed.  No shuffle touches the documents, unless the benchmark is
larger than a broadcast may be.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.llm.common import bounded, free_name, sheltered, table, tidy, without, written

WINDOW = 10
#: Benchmark text that one broadcast may hold; a larger benchmark is taken in blocks of this size.
BLOCK_BYTES = 16 << 20

#: ASCII other than letters and digits separates words; A-Z becomes a-z; bytes of other characters stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MULTIPLIER = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class NgramSet:
    """Windows of the benchmark by length, over ids of the benchmark's own words (0: any other word).

    Some twenty bytes a window: its hash, sorted, and its place in the items' words, which verify it.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.ids: dict[bytes, int] = {}
        self.window, self.names, parts = window, [], []
        for item, text in items:
            words = words_of(text)
            if words:
                parts.append(np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int32))
                self.names.append(item)
        size = np.array([len(p) for p in parts], np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.starts = np.cumsum(size) - size
        self.tables = {}
        for length in sorted(set(np.minimum(size, window).tolist())):
            own = np.flatnonzero(np.minimum(size, window) == length)
            n = size[own] - length + 1
            at = np.repeat(self.starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keys = self._hash(self.words, at, length)
            order = np.argsort(keys)
            bits = max(16, (len(keys) * 16).bit_length())
            marks = np.zeros(1 << bits, dtype=bool)
            marks[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables[length] = (keys[order], at[order].astype(np.int64), bits, marks)

    @staticmethod
    def _hash(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(length):
            h = (h ^ words[at + j].astype(np.uint64)) * np.uint64(_MULTIPLIER)
            h ^= h >> np.uint64(29)
        return h

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str], bool]:
        """Which words are hit (None: none), the items that occur, and whether a full window does."""
        if not words or not self.ids:
            return None, set(), False
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int32, count=len(words))
        known = np.append(0, np.cumsum(ids != 0))
        hit, items, full = None, set(), False
        for length, (keys, places, bits, marks) in self.tables.items():
            if len(words) < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            h = self._hash(ids, at, length)
            some = marks[(h >> np.uint64(64 - bits)).astype(np.int64)]
            at, h = at[some], h[some]
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            for i, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                spots = places[a:b]
                spots = spots[(self.words[spots[:, None] + np.arange(length)] == ids[i : i + length]).all(axis=1)]
                if len(spots):
                    if hit is None:
                        hit = np.zeros(len(words), dtype=bool)
                    hit[i : i + length] = True
                    items.update(self.names[k] for k in np.unique(np.searchsorted(self.starts, spots, "right") - 1).tolist())
                    full |= length == self.window
        return hit, items, full


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """text without what stretches from the first to the last word of each run of hit words."""
    raw = text.encode("utf-8", "surrogatepass")
    spots = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, end = [], 0
    for a, b in runs:
        out.append(raw[end : spots[a][0]])
        end = spots[b - 1][1]
    return b"".join([*out, raw[end:]]).decode("utf-8", "surrogatepass")


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_runs", T.ArrayType(T.LongType())),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("full_window", T.BooleanType()),
    ]
)


def _cut_all(texts: list[str | None], runs: list[list[int]]) -> list[str | None]:
    return [cut(t, list(zip(r[::2], r[1::2], strict=True))) if r else t for t, r in zip(texts, runs, strict=True)]


def _scanner(shared, at: list[int], text: int, cut_spans: bool):
    """The Arrow function: the input columns at these places (hit runs cut out of the text, if asked), then n_words, hit_runs (start, end, start, ...), item_ids, full_window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: NgramSet = shared.value
        for batch in batches:
            n_words, runs, items, full = [], [], [], []
            for value in batch.column(text):
                words = words_of(value.as_py())
                hit, found, whole = grams.hits(words)
                n_words.append(len(words))
                runs.append([] if hit is None else [x for r in _runs(hit) for x in r])
                items.append(sorted(found))
                full.append(whole)
            yield _found(batch, at, text if cut_spans else None, n_words, runs, items, full)

    return tidy(run)


def _found(batch: pa.RecordBatch, at: list[int], text: int | None, n_words: list, runs: list, items: list, full: list) -> pa.RecordBatch:
    own = [batch.column(i) for i in at]
    if text is not None and any(runs):
        k = at.index(text)
        own[k] = pa.array(_cut_all(own[k].to_pylist(), runs), own[k].type)
    more = [pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(full, pa.bool_())]
    return pa.RecordBatch.from_arrays([*own, *more], names=[*(batch.schema.names[i] for i in at), *_FOUND.names])


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[list[tuple[str, str | None]]]:
    """The benchmark in blocks of bounded bytes; rows are streamed, so that no more than one partition and one block are held."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).where(F.col(text).isNotNull())
    blocks, size = [[]], 0
    for r in rows.toLocalIterator():
        own = len(r["t"].encode("utf-8", "surrogatepass"))
        if size and size + own > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((r["i"], r["t"]))
        size += own
    return blocks


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    keep_columns: bool = False,
    cut_spans: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Hit words of every document: id, n_words, hit_runs, item_ids, full_window (and, if asked, all input columns).

    With cut_spans, which needs the input columns, the hit runs are cut out of the text.

    A benchmark within ``block_bytes`` of text is one hash set, broadcast.  A larger one is a stated query set: it is
    taken in blocks of that size, each block scans the documents once and gives only the rows that it hits, and these meet their
    documents again by a number; so a broadcast never outgrows its bound, and the rows are the same at every block size.

    Null or empty texts have no words and no hits.  Rows that repeat an id each get a row (with
    several blocks the documents are written with a number of their own, by which the blocks' rows are merged).  Benchmark rows without text are
    ignored, those without an id are called "null".  Empty tables give empty results or no hits.
    Columns of the input named like the result's are dropped.
    """
    spark = docs.sparkSession
    docs = bounded(docs)
    docs = without(docs, _FOUND.names) if keep_columns else docs.select(id_col, text_col)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    names = docs.columns if keep_columns else [c for c in docs.columns if c != text_col or c == id_col]
    out = T.StructType([*(docs.schema[c] for c in names), *_FOUND.fields])

    def scan(frame: DataFrame, items: list, names: list[str], schema: T.StructType, cut: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(NgramSet(items, window))
        at = [frame.columns.index(c) for c in names]
        return frame.mapInArrow(_scanner(shared, at, frame.columns.index(text_col), cut), schema)

    if len(blocks) == 1:
        return scan(docs, blocks[0], names, out, cut_spans)
    # Many blocks: the hits of each, merged by row.  Rows are numbered and written, as numbers given in a scan may differ in the next.
    row = free_name([*docs.columns, *_FOUND.names], "_row")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    hits = T.StructType([docs.schema[row], *_FOUND.fields])
    parts = [scan(docs.select(row, text_col), b, [row], hits, False).where(F.size("hit_runs") > 0) for b in blocks]

    def join(group: pa.Table) -> pa.Table:
        n = group.column("n_words")[0].as_py()
        hit = np.zeros(n, dtype=bool)
        for r in group.column("hit_runs").to_pylist():
            for a, b in zip(r[::2], r[1::2], strict=True):
                hit[a:b] = True
        items = sorted({i for r in group.column("item_ids").to_pylist() for i in r})
        whole = any(group.column("full_window").to_pylist())
        return pa.Table.from_batches([_found(group.slice(0, 1).combine_chunks().to_batches()[0], [0], None, [n], [[x for r in _runs(hit) for x in r]], [items], [whole])])

    merged = reduce(DataFrame.unionByName, parts).groupBy(row).applyInArrow(join, hits).drop("n_words").withColumnRenamed(row, "_of")
    told = docs.join(written(merged, "benchmark-hits"), F.col(row) == F.col("_of"), "left").select(*docs.columns, "hit_runs", "item_ids", "full_window")
    at, text = [told.columns.index(c) for c in names], told.columns.index(text_col)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, items, full = ([x or e for x in batch.column(len(batch.columns) - k).to_pylist()] for k, e in ((3, []), (2, []), (1, False)))
            yield _found(batch, at, text if cut_spans else None, [len(words_of(x.as_py())) for x in batch.column(text)], runs, items, full)

    return told.mapInArrow(tidy(finish), out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """docs with their columns, cleaned.

    remove="spans": hit runs are cut out of the text.  remove="documents": documents with a
    full window go; those with hits of short items only (items of fewer words than a window,
    which any text may hold by chance) lose these spans.  Clean documents pass unchanged.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'")

    def run(d: DataFrame) -> DataFrame:
        found = contamination(d, benchmark, text_col=text_col, keep_columns=True, cut_spans=True, **options)
        return found.where(~F.col("full_window")) if remove == "documents" else found

    return sheltered(docs, _FOUND.names, run)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    runs = F.col("hit_runs")
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda s, x: x - s)  # starts and ends alternate: sum(end - start)
    n_hit = F.when(F.size(runs) > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(runs) > 0).alias("contaminated"),
    )


#: Words are unnested with their positions; windows of a document meet those of the items by an equi-join.
OP1_SQL = r"""
WITH dw AS (
  SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM grams),
found AS (
  SELECT d.rid, d.p, d.n, g.item_id
  FROM (SELECT rid, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)) d
  JOIN grams g ON g.g = d.g AND g.n = d.n
), hit AS (
  SELECT rid, count(DISTINCT p + k) AS n_hit
  FROM (SELECT rid, p, unnest(range(0, n)) AS k FROM (SELECT DISTINCT rid, p, n FROM found)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY rid
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""
