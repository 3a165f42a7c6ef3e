"""JSON documents: strict reading, and files of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.sources.structured import schema_of, structured


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per file, which must be an object of this schema (a byte order mark is skipped); malformed files fail the query."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST", encoding="UTF-8")


def strict_json(text: Column, schema: T.StructType) -> Column:
    """struct(value, error): the parsed object, or why it is none: malformed, wrong types, unknown or missing keys, at any depth."""
    return structured(text, schema_of(schema), schema)


def read_documents(spark: SparkSession, path: str, schema: T.StructType, required: bool = True) -> DataFrame:
    """path, value, error: files of one JSON object each (a byte order mark is skipped), held against the schema; a bad file is a row with its error."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.ltrim(F.regexp_replace("value", "^\ufeff", "")).alias("text"))
    return files.select("path", structured(F.col("text"), schema_of(schema, required), schema).alias("x")).select("path", "x.value", "x.error")


def to_document(row: Column, pretty: bool = False) -> Column:
    """A struct as JSON with all its keys."""
    return F.to_json(row, {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def write_document(df: DataFrame, path: str, pretty: bool = False) -> None:
    """Writes each row as a JSON document; files appear whole."""
    df.select(to_document(F.struct(*df.columns), pretty)).write.mode("overwrite").text(path)


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
