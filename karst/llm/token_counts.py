"""Operator 8, token counts through a digest cache.

Content digests are joined to a stored cache keyed by (content digest, tokenizer digest).  Only one
representative of each distinct missing content is encoded; its count is appended to the cache,
and every document then reads its count from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import bounded, shared_dir, table, tidy, without, written
from karst.llm.tokens import default_vocabulary, encoder, file_digest

#: Bytes that a digest takes in a broadcast, at most, and what a broadcast may have.
SPECIAL_BYTES, BROADCAST_BYTES = 200, 32 << 20
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def read_cache(spark: SparkSession, path: str, tokenizer_digest: str) -> DataFrame:
    """Counts stored for one tokenizer version, one row a digest, even where a retried run appended it twice."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)  # makes the table where there is none
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return stored.where(F.col("tokenizer_digest") == tokenizer_digest).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _count(vocabulary: str, tokenizer_digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            counts = [len(enc.ids(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([tokenizer_digest] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["content_digest", "tokenizer_digest", "n_tokens"],
            )

    return tidy(run)


def token_counts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    cache_path: str | None = None,
    limit: int = 1024,
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row of docs.

    Normalised content is the text as UTF-8, null as empty (other normalisation would change
    counts).  Repeated contents, however many, are encoded once: the representative is chosen on
    digests alone, with a map-side minimum, so that copies of a text never meet in one task with their
    texts.  Texts stay where they are while the digests of repeated and stored contents fit a broadcast of
    BROADCAST_BYTES; beyond it they are joined by digest, and the planner splits a hot one.  Without ``cache_path`` the cache lives in a fresh shared folder.  Repeated rows each
    get a row (and are encoded each); null ids are kept; an empty table gives an empty result.
    """
    spark = bounded(docs).sparkSession
    vocabulary = vocabulary or default_vocabulary()
    version = file_digest(vocabulary)
    path = cache_path or shared_dir(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = docs.select(
        F.col(id_col),
        text.alias("_text"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_digest"),
    )
    keys = written(content.select(id_col, "content_digest", F.octet_length("_text").cast("long").alias("n_bytes")), "content-keys")
    first = keys.groupBy("content_digest").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col(id_col).isNull(), F.col(id_col))).getField(id_col).alias("_first"))
    # Contents that occur twice or that the cache has; of all others the row at hand is the only one, and is encoded where it lies.
    known = read_cache(spark, path, version).withColumnRenamed("n_tokens", "_known")
    special = first.join(known, "content_digest", "left").where("_n > 1 OR _known IS NOT NULL")
    special = written(special.select(F.col("content_digest").alias("_digest"), "_first", F.col("_known").isNotNull().alias("_done")), "content-special")
    small = special.count() * SPECIAL_BYTES <= BROADCAST_BYTES
    told = content.join(F.broadcast(special) if small else special, F.expr("content_digest = _digest"), "left")
    mine = F.col("_digest").isNull() | (~F.col("_done") & F.col(id_col).eqNullSafe(F.col("_first")))
    told.where(mine).select("content_digest", "_text").mapInArrow(_count(vocabulary, version), CACHE_SCHEMA).write.mode("append").parquet(path)
    # Written, so that both sides of the last join are plain exchanges, of which the planner splits a hot text's.
    counts = written(first.select("content_digest").join(read_cache(spark, path, version), "content_digest"), "content-counts")
    counted = keys.join(counts, "content_digest")
    return counted.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(without(table(spark, sf_dir, "documents"), ["content_digest", "_text"]))
