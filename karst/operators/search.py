"""Concept search: exact vector top-k, BM25 over a stored index (``lexicon``), hints, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from karst.functions import scoring
from karst.operators import cells, lexicon, rank
from karst.operators.cells import Cells
from karst.operators.graph import KEYS
from karst.operators.lexicon import Lexicon
from karst.settings import Settings

#: The boosts of the node fields.
NODE_BOOSTS = {"labels_ar": 6.0, "aliases_ar": 5.0, "labels_en": 2.0, "aliases_en": 2.0, "searchable_text": 1.0}


def node_fields() -> dict[str, tuple[Column, float]]:
    """The texts of a node by field, with their boosts."""
    return {c: (F.concat_ws(" ", c), b) for c, b in NODE_BOOSTS.items()}


def index_nodes(nodes: DataFrame, name: str | None = None) -> Lexicon:
    """The index of the nodes that a search may find: the catalogue's under a name, else one for this request."""
    eligible = rank.eligible(nodes)
    return lexicon.build(eligible, "uri", node_fields(), name, reset=True) if name else lexicon.build_scratch(eligible, "uri", node_fields())


def node_index(spark: SparkSession, name: str) -> Lexicon | None:
    """The catalogue's index under a name, if there is one."""
    return Lexicon(name, tuple(NODE_BOOSTS.items())) if spark.catalog.tableExists(f"{name}_totals") else None


#: Bytes of query vectors and of their best hits that a task holds at once.
QUERY_BYTES = 16 << 20
#: Queries and nodes of one matrix of distances (8 MB), however many there are of either.
QUERIES_AT_ONCE, NODES_AT_ONCE = 2048, 512


def _nearest(block: Broadcast, k: int, names: list[str]):
    """uri, embedding -> the k nearest of a partition's nodes to each query of the block: its number, uri, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        best_d, best_u = np.full((len(queries), k), np.inf), np.full((len(queries), k), None, object)
        for batch in batches:
            uris, lists = batch.column(0).to_pylist(), batch.column(1)
            for size in lists.value_lengths().unique().to_pylist():
                if size != queries.shape[1]:
                    raise ValueError(f"vectors of {size} and {queries.shape[1]} numbers have no distance")
            nodes = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(uris), queries.shape[1])
            norm = np.sqrt((nodes * nodes).sum(axis=1, keepdims=True))
            nodes = nodes / np.where(norm > 0, norm, 1)
            for q in range(0, len(queries), QUERIES_AT_ONCE):
                own_d, own_u = best_d[q : q + QUERIES_AT_ONCE], best_u[q : q + QUERIES_AT_ONCE]
                for n in range(0, len(uris), NODES_AT_ONCE):
                    # Rounded, so that equal vectors tie whatever the order of a sum.
                    far = np.round(1 - queries[q : q + QUERIES_AT_ONCE] @ nodes[n : n + NODES_AT_ONCE].T, 12)
                    # All that is no farther than the k-th so far and the k-th of these, and of those the first by distance and uri.
                    edge = own_d[:, -1]
                    if far.shape[1] > k:
                        edge = np.minimum(edge, np.partition(far, k - 1, axis=1)[:, k - 1])
                    near = far <= edge[:, None]
                    for i in np.flatnonzero(near.any(axis=1)):
                        found = [(far[i, j], uris[n + j]) for j in np.flatnonzero(near[i])]
                        found += [(d, u) for d, u in zip(own_d[i], own_u[i], strict=True) if u is not None]
                        found = sorted(found)[:k]
                        own_d[i, : len(found)], own_u[i, : len(found)] = zip(*found, strict=True)
        for q in range(0, len(queries), QUERIES_AT_ONCE):
            rows, ranks = np.nonzero(np.not_equal(best_u[q : q + QUERIES_AT_ONCE], None))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(q + rows, pa.int32()), pa.array(best_u[q + rows, ranks].tolist(), pa.string()), pa.array(best_d[q + rows, ranks])], names=names)

    return run


def vector_topk(queries: DataFrame, nodes: DataFrame, k: int, keys: list[str] = KEYS) -> DataFrame:
    """keys, uri, distance, rank: the k nodes nearest by cosine, distances rounded to 12 places.  queries: keys, vector; nodes: uri, embedding.

    The queries are a stated set against all nodes.  They pass through the driver in blocks of QUERY_BYTES; each block
    is one pass over the nodes as matrix products of bounded size, and of every partition only its k best a query go on.  Queries and nodes without a
    vector give nothing; a zero vector is at distance 1 from all.
    """
    spark = queries.sparkSession
    nodes = nodes.where(F.col("embedding").isNotNull()).select("uri", F.col("embedding").cast("array<double>"))
    names = [f.split(" ")[0] for f in "_query int, uri string, distance double".split(", ")]
    schema = T.StructType([*(queries.schema[c] for c in keys), T.StructField("_query", T.IntegerType())])
    out, block, held = None, [], 0

    def scan(block: list[Row]) -> DataFrame:
        vectors = np.array([r["vector"] for r in block], float)
        norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        shared = spark.sparkContext.broadcast(vectors / np.where(norm > 0, norm, 1))
        found = nodes.mapInArrow(_nearest(shared, k, names), "_query int, uri string, distance double")
        asked = spark.createDataFrame([(*(r[c] for c in keys), i) for i, r in enumerate(block)], schema)
        return found.join(F.broadcast(asked), "_query").select(*keys, "uri", "distance")  # a block's keys, bounded as its vectors are

    for row in queries.where("vector IS NOT NULL").select(*keys, "vector").toLocalIterator():
        block.append(row)
        held += 8 * len(row["vector"]) + 16 * k
        if held >= QUERY_BYTES:
            out, block, held = scan(block) if out is None else out.unionByName(scan(block)), [], 0
    if block or out is None:
        last = scan(block) if block else spark.createDataFrame([], T.StructType([*(queries.schema[c] for c in keys), *T.StructType.fromDDL("uri string, distance double").fields]))
        out = last if out is None else out.unionByName(last)
    order = Window.partitionBy(*keys).orderBy("distance", "uri")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def interleave(hits: DataFrame, limit: int, keys: list[str] = KEYS) -> DataFrame:
    """keys, uri, score, rank: hint lists merged by round-robin.  hits: keys, hint_index, uri, score, rank.

    First all first ranks in the order of the hints, then all second ones; of a URI the first occurrence counts.
    """
    first = hits.groupBy(*keys, "uri").agg(F.min(F.struct("rank", "hint_index", "score")).alias("f"))
    order = Window.partitionBy(*keys).orderBy("f.rank", "f.hint_index", "uri")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select(*keys, "uri", F.col("f.score").alias("score"), F.col("n").alias("rank"))


def fuse(vector: DataFrame, lexical: DataFrame, hint: DataFrame, degree: DataFrame, s: Settings, keys: list[str] = KEYS) -> DataFrame:
    """One row per concept that any channel found, with the ranks and scores of the channels, fused_score, seed_score and rank; the best few.

    The channels are stacked and grouped, which takes one shuffle where two full outer joins take more.
    """
    null = lambda t: F.lit(None).cast(t)
    stacked = (
        vector.select(*keys, "uri", F.col("rank").alias("vector_rank"), F.col("distance").alias("vector_distance"), null("int").alias("bm25_rank"), null("double").alias("bm25_score"), null("int").alias("hint_rank"), null("double").alias("hint_score"))
        .unionByName(lexical.select(*keys, "uri", null("int").alias("vector_rank"), null("double").alias("vector_distance"), F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"), null("int").alias("hint_rank"), null("double").alias("hint_score")))
        .unionByName(hint.select(*keys, "uri", null("int").alias("vector_rank"), null("double").alias("vector_distance"), null("int").alias("bm25_rank"), null("double").alias("bm25_score"), F.col("rank").alias("hint_rank"), F.col("score").alias("hint_score")))
    )
    names = ["vector_rank", "vector_distance", "bm25_rank", "bm25_score", "hint_rank", "hint_score"]
    hits = stacked.groupBy(*keys, "uri").agg(*[F.max(c).alias(c) for c in names])
    hits = hits.join(degree.select("uri", "degree"), "uri", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ranks = [F.col(c) for c in ("vector_rank", "bm25_rank", "hint_rank")]
    hits = hits.withColumns(
        {
            "fused_score": scoring.reciprocal_rank(s, *ranks),
            "semantic_score": scoring.semantic(F.col("vector_rank"), F.col("vector_distance")),
            "lexical_score": scoring.by_rank(F.col("bm25_rank")),
            "planner_hint_score": scoring.by_rank(F.col("hint_rank")),
            "specificity_score": scoring.specificity(F.col("degree")),
        }
    )
    score = scoring.seed(s, *[F.col(c) for c in ("semantic_score", "lexical_score", "planner_hint_score", "specificity_score")])
    hits = hits.withColumn("seed_score", score)
    order = Window.partitionBy(*keys).orderBy(F.desc("seed_score"), F.desc("fused_score"), "uri")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.concept_top_k)


def index_vectors(nodes: DataFrame, name: str) -> Cells:
    """The catalogue's index of the vectors that a search may find."""
    nodes.sparkSession.sql(f"DROP TABLE IF EXISTS {name}_cells")
    return cells.build(rank.eligible(nodes), name)


def vector_index(spark: SparkSession, name: str) -> Cells | None:
    """The catalogue's vector index under a name, if there is one."""
    return Cells(name) if spark.catalog.tableExists(f"{name}_cells") else None


def search_concepts(issues: DataFrame, nodes: DataFrame, degree: DataFrame, s: Settings, keys: list[str] = KEYS, index: Lexicon | None = None, nearby: Cells | None = None) -> DataFrame:
    """The fused concepts of every issue.  issues: keys, vector, retrieval_query, hints; nodes: the node table with embeddings; index, nearby: of its eligible nodes' words and vectors; without a stored one words are indexed here and vectors scanned."""
    index = index or index_nodes(nodes)
    vectors = issues.select(*keys, "vector")
    near = cells.topk(nearby, vectors, s.vector_candidates, keys, exact=True) if nearby else vector_topk(vectors, rank.eligible(nodes), s.vector_candidates, keys)
    asked = issues.select(*keys, F.col("retrieval_query").alias("query"))
    hints = issues.select(*keys, F.posexplode("hints").alias("hint_index", "query")).where(F.trim("query") != "")
    lexical = lexicon.topk(index, asked, s.bm25_candidates, keys)
    per_hint = max(4, min(s.bm25_candidates, 10))
    hinted = interleave(lexicon.topk(index, hints, per_hint, [*keys, "hint_index"]), s.bm25_candidates, keys)
    return fuse(near, lexical, hinted, degree, s, keys)
