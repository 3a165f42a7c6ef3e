"""Tables written between stages, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local session without that setting gets one of its own, on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="karst-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/karst/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns the table read back.

    This cuts the lineage: a lost executor costs no recomputation of what stands before, and plans stay small.
    compression: "none" for tables of what is compressed already.
    """
    path = shared_dir(df.sparkSession, name)
    (df.write if compression is None else df.write.option("compression", compression)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
