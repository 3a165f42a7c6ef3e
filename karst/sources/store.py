"""Node and edge stores as tables: definition, reset, ingestion with validated counts, description."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.operators.build import GROUPS
from karst.sources.scratch import written


def _text(name: str, kind: T.DataType, searchable: bool) -> T.StructField:
    """A column with what it is for: matched as a whole, or searched by words."""
    return T.StructField(name, kind, True, {"tokenization": "word" if searchable else "field", "searchable": searchable, "filterable": not searchable})


_S, _A = T.StringType(), T.ArrayType(T.StringType())
NODE_SCHEMA = T.StructType(
    [
        _text("uri", _S, False), _text("local_name", _S, False), _text("node_kind", _S, False), _text("rdf_types", _A, False),
        *[_text(g, _A, True) for g in GROUPS],
        T.StructField("article_number", T.IntegerType()), T.StructField("retrieval_eligible", T.BooleanType()),
        _text("searchable_text", _S, True), T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
EDGE_SCHEMA = T.StructType([_text(c, _S, c == "literal_value") for c in ("source_uri", "predicate_uri", "predicate_local_name", "object_kind", "target_uri", "literal_value", "literal_language", "literal_datatype")])


def ensure_store(spark: SparkSession, name: str, schema: T.StructType, reset: bool = False) -> dict[str, bool]:
    """Drops the table when reset, creates it when missing; tells what was done."""
    there = spark.catalog.tableExists(name)
    if there and reset:
        spark.sql(f"DROP {'VIEW' if spark.catalog.getTable(name).tableType == 'VIEW' else 'TABLE'} {name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}_versions")
    made = not there or reset
    if made:
        spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)
    return {"deleted": there and reset, "created": made, "retained": there and not reset}


def describe_store(spark: SparkSession, name: str) -> DataFrame:
    """column, type, tokenization, searchable, filterable of a table."""
    return described(spark, spark.table(name).schema)


def described(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """column, type, tokenization, searchable, filterable of a schema."""
    fields = schema.fields
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("tokenization"), f.metadata.get("searchable"), f.metadata.get("filterable")) for f in fields]
    return spark.createDataFrame(rows, "column string, type string, tokenization string, searchable boolean, filterable boolean")


def stored(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows as they are stored: the schema's columns, empty arrays as null."""
    out = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in rows.columns else F.lit(None)
        out.append((F.when(F.size(c) > 0, c) if isinstance(f.dataType, T.ArrayType) and f.name in rows.columns else c).cast(f.dataType).alias(f.name, metadata=f.metadata))
    return rows.select(out)


def ingest(spark: SparkSession, nodes: DataFrame, edges: DataFrame, node_table: str, edge_table: str, *, reset: bool = False, valid: bool = True) -> DataFrame:
    """Writes both tables and returns table, requested, stored; counts that differ, an invalid graph and a filled store without reset are errors.

    A write is committed whole or not at all, so no rows of a failed attempt stay.
    """
    if not valid:
        raise ValueError("the graph is not valid")
    if "embedding_error" in nodes.columns:  # nothing is dropped or written while a row has none
        nodes = written(nodes, "embedded-nodes")
        failed = nodes.where("embedding_error IS NOT NULL").select("uri", "embedding_error")
        first = failed.orderBy("uri").first()
        if first is not None:
            raise ValueError(f"{failed.count()} nodes could not be embedded, first {first.uri}: {first.embedding_error}")
    counts = []
    for name, rows, schema in ((node_table, nodes, NODE_SCHEMA), (edge_table, edges, EDGE_SCHEMA)):
        ensure_store(spark, name, schema, reset)
        if not spark.table(name).isEmpty():
            raise ValueError(f"{name} is not empty; use reset")
        rows = stored(rows, schema)
        rows.write.mode("append").format("parquet").saveAsTable(name)
        spark.catalog.refreshTable(name)
        counts.append((name, rows.count(), spark.table(name).count()))
    if any(a != b for _, a, b in counts):
        raise ValueError(f"stored counts differ from what was asked for: {counts}")
    return spark.createDataFrame(counts, "table string, requested long, stored long")


def _vectors(embedder, texts: list[str], size: int | None) -> list[list[float]]:
    if not all(texts):
        raise ValueError("a text to embed is empty")
    vectors = [list(map(float, v)) for v in embedder(texts)]
    if len(vectors) != len(texts) or any(len(v) != (size or len(vectors[0])) for v in vectors) or not all(math.isfinite(x) for v in vectors for x in v):
        raise ValueError("the embedder's vectors are not one finite vector of the same size for each text")
    return vectors


def embed(rows: DataFrame, embedder, text_col: str = "searchable_text", batch: int = 32) -> DataFrame:
    """rows with ``embedding`` by embedder(list of texts) -> list of vectors; blank texts, wrong counts or dimensions and values that are not finite are errors."""
    return _embed(rows, embedder, text_col, batch, None)


def embed_within(rows: DataFrame, embedder, text_col: str = "searchable_text", batch: int = 32, budget: int = 10) -> DataFrame:
    """The same with ``embedding_error``: a batch that fails is told in its rows, and a task with more than ``budget`` failed batches asks no more."""
    return _embed(rows, embedder, text_col, batch, budget)


def _embed(rows: DataFrame, embedder, text_col: str, batch: int, budget: int | None) -> DataFrame:
    if batch < 1:
        raise ValueError("a batch has at least one text")
    more = [T.StructField("embedding", T.ArrayType(T.FloatType()))] + ([T.StructField("embedding_error", T.StringType())] if budget is not None else [])
    schema = T.StructType([*[f for f in rows.schema.fields if f.name not in ("embedding", "embedding_error")], *more])

    def run(frames):
        size, failed = None, 0
        for frame in frames:
            texts = [str(t or "").strip() for t in frame[text_col]]
            vectors, errors = [], []
            for k in range(0, len(texts), batch):
                own = texts[k : k + batch]
                try:
                    if budget is not None and failed > budget:
                        raise RuntimeError(f"not asked for after {failed} failed batches")
                    found = _vectors(embedder, own, size)
                    size = size or len(found[0])
                    vectors += found
                    errors += [None] * len(own)
                except Exception as e:
                    if budget is None:
                        raise
                    failed += 1
                    vectors += [None] * len(own)
                    errors += [f"{type(e).__name__}: {e}"[:1000]] * len(own)
            frame = frame.drop(columns=["embedding", "embedding_error"], errors="ignore").assign(embedding=vectors)
            yield frame if budget is None else frame.assign(embedding_error=errors)

    return rows.mapInPandas(run, schema)
