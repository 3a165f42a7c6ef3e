"""A stored graph: one row a node and shard with its packed neighbours of both directions, so that a hop reads only its frontier's rows.

What an edge is besides its ends (direction, relation, weight, whether to an article) is a number into a small table of kinds, so an edge is a string and an int.

A node of many edges has many shards, dealt by the neighbour, so that no row and no task holds all of a hub; parallel edges stay together.
Neighbours are bucketed by node and shard, the nodes' degrees and numbers of shards by node: a hop moves its frontier, never the edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.sources.scratch import shared_dir, written

#: Edges of a shard, about.
SHARD = 4096


@dataclass(frozen=True)
class Adjacency:
    """Names of the tables: ``heads`` (cur, degree, article_degree, shards), ``edges`` (cur, shard, nbrs, kinds) and ``kinds`` (kind, direction, relation, weight, to_article)."""

    name: str

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.table(f"{self.name}_{kind}")

    def drop(self, spark: SparkSession) -> None:
        for kind in ("heads", "edges", "kinds"):
            spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")

    def degrees(self, spark: SparkSession) -> DataFrame:
        """uri, degree (distinct neighbours), article_degree (distinct neighbouring articles)."""
        return self.table(spark, "heads").select(F.col("cur").alias("uri"), "degree", "article_degree")

    def reach(self, frontier: DataFrame) -> DataFrame:
        """The frontier's rows (with a column cur) by each shard of their node, whose edges stay packed: article_degree, nbrs and kinds besides."""
        spark, own = frontier.sparkSession, frontier.columns
        heads = self.table(spark, "heads").select("cur", "article_degree", "shards")
        asked = frontier.join(heads, "cur").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        return asked.join(self.table(spark, "edges").select("cur", "shard", "nbrs", "kinds"), ["cur", "shard"]).select(*own, "article_degree", "nbrs", "kinds")

    def spread(self, reached: DataFrame) -> DataFrame:
        """A row each edge of what ``reach`` gave: nbr, direction, relation, weight, to_article, source, target besides."""
        spark, own = reached.sparkSession, [c for c in reached.columns if c not in ("nbrs", "kinds")]
        kinds = self.table(spark, "kinds").orderBy("kind").collect()  # as many as there are relations, four times at most
        schema = ("direction", "relation", "weight", "to_article")
        known = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in schema]) for r in kinds]) if kinds else F.array().cast("array<struct<direction:string,relation:string,weight:double,to_article:boolean>>")
        gone = reached.select(*own, F.explode(F.arrays_zip("nbrs", "kinds")).alias("e")).select(*own, F.col("e.nbrs").alias("nbr"), F.get(known, F.col("e.kinds")).alias("k")).select(*own, "nbr", "k.*")
        out = F.col("direction") == "outgoing"
        return gone.withColumns({"source": F.when(out, F.col("cur")).otherwise(F.col("nbr")), "target": F.when(out, F.col("nbr")).otherwise(F.col("cur"))})

    def hop(self, frontier: DataFrame) -> DataFrame:
        """The frontier's rows by each edge of their node."""
        return self.spread(self.reach(frontier))


def _saved(df: DataFrame, name: str, buckets: int, by: list[str], folder: str | None) -> None:
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by).option("parquet.page.row.count.limit", "256")
    (writer.option("path", f"{folder}/{name}") if folder else writer).saveAsTable(name)


def build(view: DataFrame, name: str, *, buckets: int | None = None, folder: str | None = None) -> Adjacency:
    """Packs a view of edges (cur, nbr, direction, relation, source, target, weight, to_article) into the tables of ``name``, which are replaced."""
    spark, out = view.sparkSession, Adjacency(name)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    what = ["direction", "relation", "weight", "to_article"]
    view = written(view.select("cur", "nbr", *what), "adjacency-view")
    found = sorted(map(tuple, view.select(*what).distinct().collect()))
    kinds = spark.createDataFrame([(i, *r) for i, r in enumerate(found)], view.select(F.lit(0).alias("kind"), *what).schema)
    known = kinds.coalesce(1).write.mode("overwrite").format("parquet")
    (known.option("path", f"{folder}/{name}_kinds") if folder else known).saveAsTable(f"{name}_kinds")
    # Hubs alone are told to all tasks, at most one node in SHARD edges; so the edges move once, to where they stay.
    hubs = written(view.groupBy("cur").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts")).where("parts > 1"), "adjacency-hubs")
    numbered = view.join(F.broadcast(kinds), what).select("cur", "nbr", "kind")
    dealt = numbered.join(F.broadcast(hubs), "cur", "left").select("cur", F.expr("int(coalesce(pmod(xxhash64(nbr), parts), 0))").alias("shard"), "nbr", "kind").repartition(n, "cur", "shard")
    packed = dealt.groupBy("cur", "shard").agg(F.collect_list("nbr").alias("nbrs"), F.collect_list("kind").alias("kinds"))
    articles = F.array(*[F.lit(r[-1]) for r in found]) if found else F.array().cast("array<boolean>")
    count = lambda c: F.size(F.array_distinct(c))
    packed = packed.withColumns({"degree": count(F.col("nbrs")), "article_degree": count(F.filter("nbrs", lambda x, i: F.get(articles, F.get("kinds", i))))})
    _saved(packed, f"{name}_edges", n, ["cur", "shard"], folder)
    # Shards that got no edge are counted too: a hop finds nothing in them.
    heads = spark.table(f"{name}_edges").groupBy("cur").agg(F.sum("degree").alias("degree"), F.sum("article_degree").alias("article_degree"), (F.max("shard") + 1).alias("shards"))
    _saved(heads.repartition(n, "cur"), f"{name}_heads", n, ["cur"], folder)
    return out


def build_scratch(view: DataFrame, buckets: int | None = None, name: str | None = None) -> Adjacency:
    """A graph with its files in the shared scratch folder: for one request, or under a name, by which it is found again."""
    folder = shared_dir(view.sparkSession, "adjacency")
    if name and view.sparkSession.catalog.tableExists(f"{name}_heads"):  # the last that is written
        return Adjacency(name)
    return build(view, name or "adjacency_" + folder.rpartition("-")[2], buckets=buckets, folder=folder)
