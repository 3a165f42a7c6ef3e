"""Stores that are updated by key: a log of versions, bucketed by key, and a view of the newest of each.

An update compares content digests and appends what is new, changed or gone as one version, committed whole or not at all; rows that did not change
are neither written nor embedded again.  The view takes the newest version of each key, for which the log's buckets are enough.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.sources.scratch import written
from karst.sources.store import embed_within, stored

_OWN = ["_key", "_digest", "_version", "_deleted"]


def log_of(name: str) -> str:
    return f"{name}_versions"


def drop(spark: SparkSession, name: str) -> None:
    """The view and its log, whatever of them is there."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    spark.sql(f"DROP TABLE IF EXISTS {log_of(name)}")


def is_versioned(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(log_of(name))


def _newest(spark: SparkSession, name: str) -> DataFrame:
    """Of each key the newest row, deleted ones too."""
    log = spark.table(log_of(name))
    return log.withColumn("_newest", F.expr("max(_version) OVER (PARTITION BY _key)")).where("_version = _newest").drop("_newest")


def content_digest(rows: DataFrame, columns: list[str]) -> tuple[int, int]:
    """The number of rows and an order-free sum of their digests: equal for equal contents, in whatever order and files."""
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(_content(columns)).cast("decimal(38,0)")).alias("h")).first()
    return told.n, int(told.h or 0)


def _content(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def update(spark: SparkSession, name: str, rows: DataFrame, schema: T.StructType, key: Column, *, embedder: Callable | None = None, batch: int = 32, buckets: int | None = None, folder: str | None = None) -> dict[str, int]:
    """Makes the store's rows those of ``rows``: inserted, updated, unchanged, removed, and embedded (of them those that were sent to the embedder).

    key: of a row, not null; rows with one key are one, that with the least content digest.  With an embedder, rows are embedded by
    their ``searchable_text`` when they are new or changed; if any fails nothing is written.  folder: where a new log's files are, else where the catalogue has its own.  The view ``name`` has the schema's columns.
    """
    columns = [f.name for f in schema.fields if f.name != "embedding"]
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = stored(rows.withColumn("_key", F.sha2(key.cast("string").cast("binary"), 256)), T.StructType([*[f for f in schema.fields if f.name != "embedding"], T.StructField("_key", T.StringType())]))
    now = now.withColumn("_digest", _content(columns))
    now = now.groupBy("_key").agg(F.min_by(F.struct(*columns), "_digest").alias("_row"), F.min("_digest").alias("_digest"))
    known = is_versioned(spark, name)
    old = _newest(spark, name).where("NOT _deleted").select(F.col("_key").alias("_k"), F.col("_digest").alias("_d")) if known else spark.createDataFrame([], "_k string, _d string")
    state = F.expr("CASE WHEN _k IS NULL THEN 'inserted' WHEN _key IS NULL THEN 'removed' WHEN _digest <> _d THEN 'updated' ELSE 'unchanged' END")
    diff = written(now.join(old, F.expr("_key = _k"), "full").withColumn("_state", state), "update-diff")
    counts = {s: 0 for s in ("inserted", "updated", "unchanged", "removed")} | {r._state: r["count"] for r in diff.groupBy("_state").count().collect()}
    fresh = diff.where("_state IN ('inserted', 'updated')").select("_key", "_digest", "_row.*")
    counts["embedded"] = 0
    if embedder is not None and counts["inserted"] + counts["updated"]:
        fresh = written(embed_within(fresh, embedder, "searchable_text", batch), "update-embedded")
        failed = fresh.where("embedding_error IS NOT NULL")
        first = failed.orderBy("_key").first()
        if first is not None:
            raise ValueError(f"{failed.count()} rows could not be embedded, first: {first.embedding_error}")
        fresh, counts["embedded"] = fresh.drop("embedding_error"), counts["inserted"] + counts["updated"]
    if not known or counts["inserted"] + counts["updated"] + counts["removed"]:
        version = 1 + ((spark.table(log_of(name)).agg(F.max("_version")).first()[0] or 0) if known else 0)
        gone = diff.where("_state = 'removed'").select(F.col("_k").alias("_key"), F.col("_d").alias("_digest"), F.lit(True).alias("_deleted"))
        added = fresh.withColumn("_deleted", F.lit(False)).unionByName(gone, allowMissingColumns=True).withColumn("_version", F.lit(version).cast("long"))
        full = added.select(*_OWN, *[(F.col(f.name) if f.name in added.columns else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields])
        writer = full.repartition(n, "_key").write.mode("append").format("parquet").bucketBy(n, "_key").sortBy("_key")
        (writer.option("path", f"{folder}/{log_of(name)}") if folder else writer).saveAsTable(log_of(name))
        spark.catalog.refreshTable(log_of(name))
        if not known:
            listed = ", ".join(f"`{f.name}`" for f in schema.fields)
            spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {listed} FROM (SELECT *, max(_version) OVER (PARTITION BY _key) AS _newest FROM {log_of(name)}) WHERE _version = _newest AND NOT _deleted")
    # What is stored must be what was asked for, told by contents and not by counts alone.
    if content_digest(spark.table(name), columns) != content_digest(now.select("_row.*"), columns):
        raise ValueError(f"the contents of {name} differ from what was asked for")
    return counts


def compact(spark: SparkSession, name: str) -> int:
    """Rewrites the log to the newest row of each key; the number of rows that went.  Readers of the old log must be done."""
    log, rows = log_of(name), spark.table(log_of(name))
    before = rows.count()
    n = int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {log}").collect() if r.col_name == "Num Buckets"))
    kept = _newest(spark, name).where("NOT _deleted")
    spark.sql(f"DROP TABLE IF EXISTS {log}_new")
    kept.repartition(n, "_key").write.format("parquet").bucketBy(n, "_key").sortBy("_key").saveAsTable(f"{log}_new")
    after = spark.table(f"{log}_new").count()
    spark.sql(f"ALTER TABLE {log} RENAME TO {log}_old")
    spark.sql(f"ALTER TABLE {log}_new RENAME TO {log}")
    spark.sql(f"DROP TABLE {log}_old")
    return before - after
