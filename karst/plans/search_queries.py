"""Queries of concept search: vector, lexical and hint channels, and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.operators import cells, lexicon, search
from karst.plans.standin import SETTINGS, name_of, table, uri

KEYS = ["question_id"]
BOOSTS = {"url": 3.0, "html": 1.0}


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, against all vectors."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    nodes = e.select(uri("d", "vec_id").alias("uri"), "embedding")
    return search.vector_topk(queries, nodes, 10, KEYS).select("question_id", "uri", F.round("distance", 5).alias("distance"), "rank")


def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same by the stored index of cells: the nearest cells first, then those that may hold a nearer vector."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    nodes = e.select(uri("d", "vec_id").alias("uri"), "embedding")
    found = cells.topk(cells.build_scratch(nodes, name=name_of("near", nodes)), queries, 10, KEYS, exact=True)
    return found.select("question_id", "uri", F.round("distance", 5).alias("distance"), "rank")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(uri("d", "doc_id").alias("uri"), "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.posexplode(F.split("text", r"\.\s*")).alias("hint_index", "query")).where("trim(query) <> ''")


def _index(rows: DataFrame) -> lexicon.Lexicon:
    """The stored index, made by the first query that asks it."""
    return lexicon.build_scratch(rows, "uri", {"text": (F.col("text"), 1.0)}, name=name_of("words", rows))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = lexicon.topk(_index(_rows(spark, d)), _items(spark, d), 10, KEYS)
    return found.select("question_id", "uri", F.round("score", 6).alias("score"), "rank")


def bm25_multifield(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(uri("p", "page_id").alias("uri"), "url", "html")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(F.lit("example blog "), F.col("text")).alias("query"))
    out = lexicon.topk(lexicon.build_scratch(rows, "uri", {c: (F.col(c), b) for c, b in BOOSTS.items()}, name=name_of("pages", rows)), queries, 10, KEYS)
    return out.select("question_id", "uri", F.round("score", 6).alias("score"), "rank")


def _hints(hints: DataFrame, index: lexicon.Lexicon) -> DataFrame:
    return search.interleave(lexicon.topk(index, hints, 10, [*KEYS, "hint_index"]), 40, KEYS)


def hint_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return _hints(_sentences(spark, d), _index(_rows(spark, d))).select("question_id", "uri", F.round("score", 6).alias("score"), "rank")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """All three channels over one index; a document beyond the degree table counts as of degree 0."""
    e = table(spark, d, "embeddings")
    items, index = _items(spark, d), _index(_rows(spark, d))
    queries = e.join(items, F.expr("vec_id = question_id")).select("question_id", F.col("embedding").alias("vector"))
    near = search.vector_topk(queries, e.select(uri("d", "vec_id").alias("uri"), "embedding"), SETTINGS.vector_candidates, KEYS)
    degree = table(spark, d, "documents").select(uri("d", "doc_id").alias("uri"), (F.col("n_chars") % 13).alias("degree"))
    lexical = lexicon.topk(index, items, SETTINGS.bm25_candidates, KEYS)
    return search.fuse(near, lexical, _hints(_sentences(spark, d), index), degree, SETTINGS, KEYS)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("question_id", "uri", "vector_rank", "bm25_rank", "hint_rank", F.round("fused_score", 6).alias("fused_score"))


def seed_scores(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 5).alias(c)
    return _fused(spark, d).select("question_id", "uri", r("semantic_score"), r("lexical_score"), r("planner_hint_score"), r("specificity_score"), r("seed_score"), "rank")


def _tokens(text: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _bm25_sql(rows: str, fields: dict[str, float], queries: str, keys: str, k: int) -> str:
    """CTEs up to ``top``: keys, uri, score, rank.  rows: uri and the fields; queries: keys, query."""
    own = " UNION ALL ".join(f"SELECT uri, '{f}' AS field, CAST({b} AS DOUBLE) AS boost, {_tokens(f)} AS w FROM corpus" for f, b in fields.items())
    by = ", ".join(f"a.{x}" for x in keys.split(", "))
    return f"""corpus AS ({rows}), asked0 AS ({queries}), fields AS ({own}),
posts AS (SELECT uri, field, boost, token, len(w) AS n, count(*) AS tf FROM (SELECT *, unnest(w) AS token FROM fields) GROUP BY uri, field, boost, token, len(w)),
average AS (SELECT field, avg(len(w)) AS average FROM fields WHERE len(w) > 0 GROUP BY field),
asked AS (SELECT {keys}, token, count(*) AS times FROM (SELECT {keys}, unnest({_tokens('query')}) AS token FROM asked0) GROUP BY ALL),
idf AS (SELECT token, ln(1 + ((SELECT count(*) FROM corpus) - count(DISTINCT uri) + CAST(0.5 AS DOUBLE)) / (count(DISTINCT uri) + CAST(0.5 AS DOUBLE))) AS idf FROM posts GROUP BY token),
weight AS (SELECT uri, token, sum(boost * (tf / (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n / average))) AS f FROM posts JOIN average USING (field) GROUP BY ALL),
scored AS (SELECT {by}, w.uri, round(sum(times * idf * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE))), 9) AS score FROM asked a JOIN weight w ON a.token = w.token JOIN idf i ON i.token = a.token GROUP BY ALL),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, uri) AS INTEGER) AS rank FROM scored QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, uri) <= {k})"""


_DOCS = "SELECT 'd' || doc_id AS uri, text FROM documents"
_ITEMS = "SELECT item_id AS question_id, text AS query FROM benchmark"
_HINTS = r"SELECT question_id, CAST(p - 1 AS INTEGER) AS hint_index, parts[p] AS query FROM (SELECT question_id, parts, unnest(range(1, len(parts) + 1)) AS p FROM (SELECT item_id AS question_id, string_split_regex(text, '\.\s*') AS parts FROM benchmark)) WHERE trim(parts[p]) <> ''"
_INTERLEAVED = "SELECT question_id, uri, f.score AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY f.rank, f.hint_index, uri) AS INTEGER) AS rank FROM (SELECT question_id, uri, min({'rank': rank, 'hint_index': hint_index, 'score': score}) AS f FROM top GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY f.rank, f.hint_index, uri) <= 40"


def _near(queries: str, k: int) -> str:
    return f"""SELECT question_id, uri, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, uri) AS rank FROM (
  SELECT q.question_id, 'd' || n.vec_id AS uri, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[])) AS distance FROM ({queries}) q, embeddings n)) WHERE rank <= {k}"""


_FUSED = f"""WITH near AS ({_near('SELECT item_id AS question_id, embedding FROM embeddings JOIN benchmark ON vec_id = item_id', 40)}),
lexical AS (WITH {_bm25_sql(_DOCS, {'text': 1.0}, _ITEMS, 'question_id', 40)} SELECT * FROM top),
hint AS (WITH {_bm25_sql(_DOCS, {'text': 1.0}, _HINTS, 'question_id, hint_index', 10)} {_INTERLEAVED}),
hits AS (
  SELECT question_id, uri, max(v) AS vector_rank, max(dist) AS distance, max(b) AS bm25_rank, max(h) AS hint_rank FROM (
    SELECT question_id, uri, rank AS v, distance AS dist, NULL AS b, NULL AS h FROM near UNION ALL SELECT question_id, uri, NULL, NULL, rank, NULL FROM lexical UNION ALL SELECT question_id, uri, NULL, NULL, NULL, rank FROM hint) GROUP BY ALL
), parts AS (
  SELECT h.*, coalesce(1 / CAST(60 + vector_rank AS DOUBLE), 0) + coalesce(1 / CAST(60 + bm25_rank AS DOUBLE), 0) + coalesce(CAST(1.5 AS DOUBLE) / (60 + hint_rank), 0) AS fused_score,
         0.5 / sqrt(vector_rank) + CAST(0.5 AS DOUBLE) * greatest(0, least(1, 1 - distance)) AS semantic_score, 1 / sqrt(bm25_rank) AS lexical_score, 1 / sqrt(hint_rank) AS planner_hint_score,
         1 / (1 + ln(1 + CAST(coalesce(d.n_chars % 13, 0) AS DOUBLE))) AS specificity_score
  FROM hits h LEFT JOIN documents d ON h.uri = 'd' || d.doc_id
), fused AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY seed_score DESC, fused_score DESC, uri) AS INTEGER) AS rank FROM (
    SELECT *, (CAST(0.15 AS DOUBLE) * specificity_score + coalesce(CAST(0.35 AS DOUBLE) * semantic_score, 0) + coalesce(CAST(0.25 AS DOUBLE) * lexical_score, 0) + coalesce(CAST(0.25 AS DOUBLE) * planner_hint_score, 0))
      / (CAST(0.15 AS DOUBLE) + CASE WHEN semantic_score IS NULL THEN 0 ELSE CAST(0.35 AS DOUBLE) END + CASE WHEN lexical_score IS NULL THEN 0 ELSE CAST(0.25 AS DOUBLE) END + CASE WHEN planner_hint_score IS NULL THEN 0 ELSE CAST(0.25 AS DOUBLE) END) AS seed_score FROM parts)
)"""

QUERIES = {f.__name__: f for f in (vector_topk, vector_index_topk, bm25_topk, bm25_multifield, hint_round_robin, rrf_fusion, seed_scores)}

ORACLE_SQL = {
    "vector_topk": f"SELECT question_id, uri, round(distance, 5) AS distance, rank FROM ({_near('SELECT vec_id AS question_id, embedding FROM embeddings WHERE vec_id % 50 = 0', 10)})",
    "vector_index_topk": f"SELECT question_id, uri, round(distance, 5) AS distance, rank FROM ({_near('SELECT vec_id AS question_id, embedding FROM embeddings WHERE vec_id % 50 = 0', 10)})",
    "bm25_topk": f"WITH {_bm25_sql(_DOCS, {'text': 1.0}, _ITEMS, 'question_id', 10)} SELECT question_id, uri, round(score, 6) AS score, rank FROM top",
    "bm25_multifield": f"""WITH {_bm25_sql("SELECT 'p' || page_id AS uri, url, html FROM pages", BOOSTS, "SELECT item_id AS question_id, 'example blog ' || text AS query FROM benchmark", 'question_id', 10)} SELECT question_id, uri, round(score, 6) AS score, rank FROM top""",
    "hint_round_robin": f"WITH {_bm25_sql(_DOCS, {'text': 1.0}, _HINTS, 'question_id, hint_index', 10)} SELECT question_id, uri, round(score, 6) AS score, rank FROM ({_INTERLEAVED})",
    "rrf_fusion": f"{_FUSED} SELECT question_id, uri, vector_rank, bm25_rank, hint_rank, round(fused_score, 6) AS fused_score FROM fused WHERE rank <= 16",
    "seed_scores": f"{_FUSED} SELECT question_id, uri, round(semantic_score, 5) AS semantic_score, round(lexical_score, 5) AS lexical_score, round(planner_hint_score, 5) AS planner_hint_score, round(specificity_score, 5) AS specificity_score, round(seed_score, 5) AS seed_score, rank FROM fused WHERE rank <= 16",
}
