"""What a task holds of the node set, and of a group whose rows are numbered."""

import os

import duckdb
from pyspark.sql import functions as F
from test_once import plans

from karst.operators import rank
from karst.plans import graph_queries, store_queries

SF = "/root/testdata/sf0.001"


def tables(spark, folder):
    """The given tables, with lines told twice and ends that are null."""
    for t in graph_queries.TABLES:
        os.path.exists(f"{folder}/{t}.parquet") or os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    con = duckdb.connect()
    for t, more in {"lineitem": "UNION ALL SELECT * REPLACE (NULL AS l_suppkey) FROM t WHERE l_orderkey < 50 UNION ALL SELECT * REPLACE (NULL AS l_orderkey) FROM t WHERE l_suppkey < 3", "orders": "UNION ALL SELECT * REPLACE (NULL AS o_custkey) FROM t WHERE o_orderkey < 9"}.items():
        os.remove(f"{folder}/{t}.parquet")
        con.sql(f"COPY (WITH t AS (FROM '{SF}/{t}.parquet') SELECT * FROM t UNION ALL SELECT * FROM t {more}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    for t in graph_queries.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def test_nodes_are_made_distinct_once(spark, tmp_path):
    con = tables(spark, tmp_path)
    nodes = graph_queries.node_set(spark, str(tmp_path))
    assert plans(nodes)[0].count("Aggregate [") == 1  # of URIs; pairs of an order and a supplier are not kept beside them
    mine, theirs = [r.uri for r in nodes.collect()], [u for (u,) in con.sql(graph_queries.ORACLE_SQL["node_set"]).fetchall()]
    assert sorted(map(repr, mine)) == sorted(map(repr, theirs)) and None in mine


def test_nodes_are_numbered_by_many_tasks(spark, tmp_path, monkeypatch):
    con = tables(spark, tmp_path)
    monkeypatch.setattr(rank.numbered, "__defaults__", (100,))
    out = store_queries.sorted_nodes(spark, str(tmp_path))
    assert "row_number" not in plans(out)[0]  # which takes a group whole
    sql = con.sql(store_queries.ORACLE_SQL["sorted_nodes"])
    assert out.columns == sql.columns and dict(out.dtypes)["n"] == "int"
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, sql.fetchall()))


def test_one_large_group_beside_small_ones(spark):
    rows = spark.range(0, 3000, 1, 7).select(F.when(F.col("id") % 10 > 0, F.lit("a")).when(F.col("id") % 20 > 0, F.concat(F.lit("b"), F.col("id") % 7)).alias("g"), (F.col("id") * 7919 % 3001).alias("o"), F.col("id").alias("x"))
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        seen[r.g] = want[r.x] = seen.get(r.g, 0) + 1
        want[r.x] = (r.g, r.o, want[r.x])
    out = rank.numbered(rows, "g", "o", 100)
    assert {r.x: (r.g, r.o, r.n) for r in out.collect()} == want and out.columns == ["g", "o", "x", "n"]
    assert len([f for f in out.inputFiles() if "/numbered-places-" in f]) > 20  # a file for each task that sorted rows, 2,700 of 3,000 of one group
    assert rank.numbered(rows.where("false"), "g", "o").count() == 0
