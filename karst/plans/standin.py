"""A stand-in graph over the driver's tables: orders play the articles, the other entities the concepts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.operators import adjacency
from karst.operators.graph import edge_view
from karst.settings import Settings

WEIGHTS = {"suppliedBy": 1.00, "placedBy": 0.95, "inNation": 0.74, "inRegion": 0.62}
SETTINGS = Settings()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def uri(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def name_of(kind: str, rows: DataFrame) -> str:
    """A name that what is stored of these rows' files has for as long as they are the same: paths, sizes and times."""
    files = rows.sparkSession.read.format("binaryFile").load(sorted(rows.inputFiles())).select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    told = files.agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).first()
    return f"{kind}_{hashlib.sha256(f'{kind} {told.h} {told.n}'.encode()).hexdigest()[:16]}"


def edges(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """source_uri, predicate_local_name, object_kind, target_uri; names are literals, lines an unweighted relation.

    once: an order's lines of one supplier are one edge; for who asks for the ends only, that sorts out nothing.
    """

    def side(df: DataFrame, s, relation: str, o, kind: str = "uri") -> DataFrame:
        return df.select(s.alias("source_uri"), F.lit(relation).alias("predicate_local_name"), F.lit(kind).alias("object_kind"), o.alias("target_uri"))

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    lines = lines.distinct() if once else lines
    customer, supplier, nation = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    return (
        side(table(spark, d, "orders"), uri("o", "o_orderkey"), "placedBy", uri("c", "o_custkey"))
        .union(side(lines, uri("o", "l_orderkey"), "suppliedBy", uri("s", "l_suppkey")))
        .union(side(customer, uri("c", "c_custkey"), "inNation", uri("n", "c_nationkey")))
        .union(side(supplier, uri("s", "s_suppkey"), "inNation", uri("n", "s_nationkey")))
        .union(side(nation, uri("n", "n_nationkey"), "inRegion", uri("r", "n_regionkey")))
        .union(side(nation, uri("n", "n_nationkey"), "label", F.col("n_name"), "literal"))
        .union(side(nation, uri("n", "n_nationkey"), "partOf", uri("x", "n_regionkey")))
    )


def is_article(c):
    return c.startswith("o")


def view(spark: SparkSession, d: str) -> DataFrame:
    return edge_view(edges(spark, d), WEIGHTS, is_article)


def packed(spark: SparkSession, d: str) -> adjacency.Adjacency:
    """The stored graph, packed by the first query that walks it."""
    own = view(spark, d)
    return adjacency.build_scratch(own, name=name_of("graph", own))


#: Seeds of three issues of two questions.
SEEDS = [(1, 1, "n3", 0.9, 1), (1, 1, "n7", 0.7, 2), (1, 1, "s5", 0.65, 3), (1, 2, "n7", 0.8, 1), (1, 2, "n11", 0.8, 2), (2, 1, "s2", 0.5, 1), (2, 1, "c4", 0.45, 2)]


def seeds(spark: SparkSession) -> DataFrame:
    rows = [(q, i, u, s, u, r) for q, i, u, s, r in SEEDS]
    return spark.createDataFrame(rows, "question_id int, issue_index int, uri string, seed_score double, seed_label string, seed_rank int")


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Concept hits: every nation and supplier for each region as a question."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("question_id"), uri("n", "n_nationkey").alias("uri"), (F.lit(0.02) * F.col("n_nationkey")).alias("seed_score"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 5).cast("int").alias("question_id"), uri("s", "s_suppkey").alias("uri"), (F.col("s_acctbal") / 10000).alias("seed_score"))
    return n.union(s).withColumn("issue_index", F.lit(1))


# --- The same in SQL ------------------------------------------------------------------------------
EDGES_SQL = """
edges AS (
  SELECT 'o' || o_orderkey AS source_uri, 'placedBy' AS relation, 'c' || o_custkey AS target_uri FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'suppliedBy', 's' || l_suppkey FROM lineitem
  UNION ALL SELECT 'c' || c_custkey, 'inNation', 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'inNation', 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'inRegion', 'r' || n_regionkey FROM nation
)"""
VIEW_SQL = (
    EDGES_SQL
    + """,
weights(relation, weight) AS (VALUES ('suppliedBy', CAST(1.0 AS DOUBLE)), ('placedBy', CAST(0.95 AS DOUBLE)), ('inNation', CAST(0.74 AS DOUBLE)), ('inRegion', CAST(0.62 AS DOUBLE))),
view AS (
  SELECT source_uri AS cur, target_uri AS nbr, 'outgoing' AS direction, relation, source_uri AS source, target_uri AS target, weight, starts_with(target_uri, 'o') AS to_article FROM edges JOIN weights USING (relation)
  UNION ALL SELECT target_uri, source_uri, 'incoming', relation, source_uri, target_uri, weight, starts_with(source_uri, 'o') FROM edges JOIN weights USING (relation)
),
degrees AS (SELECT cur AS uri, count(DISTINCT nbr) AS degree, count(DISTINCT CASE WHEN to_article THEN nbr END) AS article_degree FROM view GROUP BY cur)"""
)
SEEDS_SQL = "seeds(question_id, issue_index, uri, seed_score, seed_rank) AS (VALUES " + ", ".join(f"({q}, {i}, '{u}', CAST({s} AS DOUBLE), {r})" for q, i, u, s, r in SEEDS) + ")"
#: Steps are joined by characters below all others, so that their strings sort as their fields do.
_STEP = "direction || chr(1) || source || chr(1) || v.relation || chr(1) || target"
EXPAND_SQL = f"""
{VIEW_SQL}, {SEEDS_SQL},
hop1 AS (
  SELECT question_id, issue_index, s.uri AS seed_uri, seed_rank, v.nbr AS uri, v.to_article,
         greatest(seed_score, 1e-6) * weight * CAST(0.72 AS DOUBLE) / CASE WHEN v.to_article THEN sqrt(1 + ln(1 + CAST(greatest(article_degree, 1) AS DOUBLE))) ELSE 1 END AS score,
         {_STEP} AS path
  FROM seeds s JOIN view v ON v.cur = s.uri JOIN degrees d ON d.uri = s.uri
), front AS (
  SELECT h.* FROM (
    SELECT question_id, issue_index, seed_uri, seed_rank, uri, score, path,
           row_number() OVER (PARTITION BY question_id, issue_index, seed_uri, uri ORDER BY score DESC, path) AS n
    FROM hop1 WHERE NOT to_article) h
  JOIN seeds s ON s.question_id = h.question_id AND s.issue_index = h.issue_index AND s.uri = h.seed_uri
  WHERE n = 1 AND (h.uri <> h.seed_uri OR h.score > s.seed_score)
), hop2 AS (
  SELECT question_id, issue_index, seed_uri, seed_rank, v.nbr AS uri, v.to_article,
         score * weight * CAST(0.72 AS DOUBLE) / CASE WHEN v.to_article THEN sqrt(1 + ln(1 + CAST(greatest(article_degree, 1) AS DOUBLE))) ELSE 1 END AS score,
         path || chr(2) || {_STEP} AS path
  FROM front f JOIN view v ON v.cur = f.uri JOIN degrees d ON d.uri = f.uri
), arrivals AS (SELECT *, 1 AS hop FROM hop1 UNION ALL SELECT *, 2 FROM hop2),
evidence AS (
  SELECT question_id, issue_index, uri, max(score) AS graph_score, CAST(least(5, count(*)) AS INTEGER) AS n_paths,
         arg_min(path, printf('%04d %d %s', seed_rank, hop, path)) AS first_path
  FROM arrivals WHERE to_article GROUP BY ALL
)"""
