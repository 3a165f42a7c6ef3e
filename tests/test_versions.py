import pytest
from plan_fixture import moved
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.sources import versions

SCHEMA = T.StructType([T.StructField("uri", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("searchable_text", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def rows(spark, *own):
    return spark.createDataFrame([(u, list(labels), t) for u, labels, t in own], "uri string, labels array<string>, searchable_text string")


def embedder(texts):
    if "bad" in texts:
        raise RuntimeError("down")
    return [[float(len(t)), 1.0] for t in texts]


def stored(spark, name):
    return {r.uri: (r.labels, r.searchable_text, r.embedding) for r in spark.table(name).collect()}


@pytest.fixture
def name(spark):
    versions.drop(spark, "t_versions")
    yield "t_versions"
    versions.drop(spark, "t_versions")


def update(spark, name, *own):
    return versions.update(spark, name, rows(spark, *own), SCHEMA, F.col("uri"), embedder=embedder, buckets=3)


def counts(inserted=0, updated=0, unchanged=0, removed=0, embedded=0):
    return {"inserted": inserted, "updated": updated, "unchanged": unchanged, "removed": removed, "embedded": embedded}


def test_updates_by_key(spark, name):
    a, b, c = ("a", "x", "text"), ("b", "", "words"), ("c", "yz", "third")
    assert update(spark, name, a, b, c) == counts(inserted=3, embedded=3)
    assert stored(spark, name)["b"] == (None, "words", [5.0, 1.0])  # an empty array is stored as null
    files = set(spark.table("t_versions_versions").inputFiles())
    assert update(spark, name, c, b, a, a) == counts(unchanged=3)  # the same again: nothing is embedded or written
    assert set(spark.table("t_versions_versions").inputFiles()) == files
    b2, d = ("b", "", "other words"), ("d", "q", "new")
    assert update(spark, name, a, b2, d) == counts(inserted=1, updated=1, unchanged=1, removed=1, embedded=2)
    assert stored(spark, name) == {"a": (["x"], "text", [4.0, 1.0]), "b": (None, "other words", [11.0, 1.0]), "d": (["q"], "new", [3.0, 1.0])}
    assert update(spark, name, a, b2, c, d) == counts(inserted=1, unchanged=3, embedded=1)  # what was removed comes back
    assert versions.compact(spark, name) == 3 and set(stored(spark, name)) == set("abcd")
    assert update(spark, name, a, b2, c, d) == counts(unchanged=4)
    assert update(spark, name) == counts(removed=4) and stored(spark, name) == {}


def test_a_failed_embedding_writes_nothing(spark, name):
    update(spark, name, ("a", "x", "text"))
    with pytest.raises(ValueError, match="RuntimeError: down"):
        update(spark, name, ("a", "x", "text"), ("b", "", "bad"))
    assert set(stored(spark, name)) == {"a"}


def test_of_one_key_one_row_stays(spark, name):
    own = [("a", "x", "one"), ("a", "y", "two"), ("a", "x", "one")]
    update(spark, name, *own)
    first = stored(spark, name)
    update(spark, name, *reversed(own))
    assert len(first) == 1 and stored(spark, name) == first and spark.table("t_versions_versions").count() == 1


def test_the_view_reads_its_buckets(spark, name):
    update(spark, name, *[(f"u{i}", "x", f"t{i}") for i in range(50)])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = spark.table(name)._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and not moved(plan, "versions_versions"), plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
