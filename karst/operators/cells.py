"""A stored vector index of cells: every vector lies in the cell of its nearest centroid, and a query reads the cells near to it.

Centroids are fitted on a bounded sample (the SAMPLE vectors whose keys hash lowest); every vector is assigned.  Vectors are bucketed by cell and part, and a cell of many vectors
has many parts, so that no task holds more than some tens of thousands.  A search reads each query's nearest cells; made exact, it also reads those cells that
may hold a nearer vector, told by the angle to their centroid and their largest angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from karst.sources.scratch import shared_dir, written

#: Vectors that centroids are fitted on, cells at most, and vectors of a part of a cell.
SAMPLE, MOST_CELLS, PART = 20_000, 65_536, 32_768
#: What an angle may be off by.
SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """Names of the tables: ``vectors`` (cell, part, uri, embedding) and ``cells`` (cell, centroid, radius, n, parts)."""

    name: str

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.table(f"{self.name}_{kind}")

    def drop(self, spark: SparkSession) -> None:
        for kind in ("vectors", "cells"):
            spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1)


def centroids_of(sample: np.ndarray, cells: int, *, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means: unit centroids, begun at vectors far from those chosen before."""
    rng = np.random.default_rng(seed)
    sample = unit(np.unique(sample, axis=0))
    cells = min(cells, len(sample))
    chosen = [int(rng.integers(len(sample)))]
    far = 1 - sample @ sample[chosen[0]]
    while len(chosen) < cells:
        weight = np.maximum(far, 0)
        chosen.append(int(rng.choice(len(sample), p=weight / weight.sum())) if weight.sum() > 0 else int(rng.integers(len(sample))))
        far = np.minimum(far, 1 - sample @ sample[chosen[-1]])
    found = sample[chosen]
    for _ in range(rounds):
        own = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        found = np.where((np.bincount(own, minlength=cells) > 0)[:, None], unit(sums), found)
    return found


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    rows = column.to_pylist()
    for row in rows:
        if len(row) != size:
            raise ValueError(f"vectors of {len(row)} and {size} numbers have no distance")
    return np.array(rows, float).reshape(len(rows), size)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def build(nodes: DataFrame, name: str, *, cells: int | None = None, buckets: int | None = None, folder: str | None = None) -> Cells:
    """Indexes nodes (uri, embedding); those without a vector are left out.  cells: about the root of their number by default."""
    spark, out = nodes.sparkSession, Cells(name)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.where("embedding IS NOT NULL").select(F.col("uri").cast("string").alias("uri"), F.col("embedding").cast("array<double>").alias("embedding"))
    sample = np.array([r.embedding for r in nodes.orderBy(F.xxhash64("uri"), "uri").limit(SAMPLE).collect()], float)  # bounded by SAMPLE
    total = nodes.count()
    centroids = centroids_of(sample, cells or max(1, min(MOST_CELLS, SAMPLE // 8, round(total**0.5)))) if len(sample) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(centroids)  # at most MOST_CELLS

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                cosine = unit(_vectors(batch.column(1), own.shape[1])) @ own.T
                cell = np.argmax(cosine, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(_angle(cosine[np.arange(len(cell)), cell]))], names=["uri", "embedding", "cell", "angle"])

    assigned = written(nodes.mapInArrow(assign, "uri string, embedding array<double>, cell int, angle double"), "cells-assigned")
    sizes = assigned.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    sizes = written(table.join(sizes, "cell"), "cells-sizes")
    dealt = assigned.join(F.broadcast(sizes.select("cell", "parts")), "cell").select("cell", F.expr("int(pmod(xxhash64(uri), parts))").alias("part"), "uri", "embedding")  # at most MOST_CELLS rows
    for rows, kind, by in ((dealt.repartition(n, "cell", "part"), "vectors", ["cell", "part"]), (sizes.repartition(1), "cells", ["cell"])):
        writer = rows.write.mode("overwrite").format("parquet").bucketBy(n if kind == "vectors" else 1, *by).sortBy(*by)
        (writer.option("path", f"{folder}/{name}_{kind}") if folder else writer).saveAsTable(f"{name}_{kind}")
    return out


def build_scratch(nodes: DataFrame, *, cells: int | None = None, buckets: int | None = None, name: str | None = None) -> Cells:
    """An index with its files in the shared scratch folder: for one request, or under a name, by which it is found again."""
    folder = shared_dir(nodes.sparkSession, "cells")
    if name and nodes.sparkSession.catalog.tableExists(f"{name}_cells"):  # the last that is written
        return Cells(name)
    return build(nodes, name or "cells_" + folder.rpartition("-")[2], cells=cells, buckets=buckets, folder=folder)


def _asked(shared, probes: int, at: int, names: list[str], rest: bool):
    """Queries (keys, vector[, last]) -> keys, vector, cell, part: of the nearest cells, or of the others that may hold a vector within ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centroids, radius, parts = shared.value
        for batch in batches:
            if not batch.num_rows or not len(cells):
                continue
            angle = _angle(unit(_vectors(batch.column(at), centroids.shape[1])) @ centroids.T)
            near = np.argsort(angle, axis=1, kind="stable")[:, :probes]
            chosen = np.zeros(angle.shape, bool)
            np.put_along_axis(chosen, near, True, axis=1)
            if rest:  # a vector is no nearer than its centroid's angle less the cell's largest
                last = np.array([2.0 if x is None else x for x in batch.column(at + 1).to_pylist()])
                chosen = ~chosen & (np.maximum(angle - radius, 0) <= _angle(1 - last)[:, None] + SLACK)
            row, cell = np.nonzero(chosen)
            times = parts[cell]
            part = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, int)
            row, cell = np.repeat(row, times), np.repeat(cells[cell], times)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns[: at + 1]), pa.array(cell, pa.int32()), pa.array(part, pa.int32())], names=names)

    return run


def _nearest(k: int, keys: list[str], names: list[str]):
    """Of one part of a cell the k nearest to each query that asks it."""

    def run(asked: pa.Table, vectors: pa.Table) -> pa.Table:
        found = {c: asked.column(c).slice(0, 0).combine_chunks() for c in keys}
        if not asked.num_rows or not vectors.num_rows:
            return pa.table({**found, "uri": pa.array([], pa.string()), "distance": pa.array([], pa.float64())}).select(names)
        size = len(asked.column("vector")[0])
        own, uris = unit(_vectors(vectors.column("embedding"), size)).T, np.array(vectors.column("uri").to_pylist(), object)
        order = np.argsort(uris, kind="stable")
        own, uris = own[:, order], uris[order]
        rows, us, ds = [], [], []
        step = max(1, (8 << 20) // max(1, 8 * own.shape[1]))
        for at in range(0, asked.num_rows, step):
            far = np.round(1 - unit(_vectors(asked.column("vector").slice(at, step), size)) @ own, 12)
            best = np.argsort(far, axis=1, kind="stable")[:, :k]  # of equal distances the first URIs
            rows.append(np.repeat(np.arange(at, at + len(far)), best.shape[1]))
            us.append(uris[best].ravel())
            ds.append(np.take_along_axis(far, best, axis=1).ravel())
        take = pa.array(np.concatenate(rows))
        return pa.table({**{c: asked.column(c).take(take) for c in keys}, "uri": pa.array(np.concatenate(us).tolist(), pa.string()), "distance": pa.array(np.concatenate(ds))}).select(names)

    return run


class Search:
    """A set of queries (keys, vector) against an index."""

    def __init__(self, index: Cells, queries: DataFrame, k: int, keys: list[str], probes: int):
        self.spark, self.index, self.k, self.keys, self.probes = queries.sparkSession, index, k, keys, probes
        self.queries = written(queries.where("vector IS NOT NULL").select(*keys, F.col("vector").cast("array<double>").alias("vector")), "cell-queries")
        rows = index.table(self.spark, "cells").orderBy("cell").collect()  # at most MOST_CELLS
        told = (np.array([r.cell for r in rows], int), np.array([r.centroid for r in rows], float), np.array([r.radius for r in rows], float), np.array([r.parts for r in rows], int))
        self.shared = self.spark.sparkContext.broadcast(told)

    def asked(self, queries: DataFrame, rest: bool = False) -> DataFrame:
        """keys, vector, cell, part: what the queries read."""
        schema = T.StructType([*(queries.schema[c] for c in (*self.keys, "vector")), *T.StructType.fromDDL("cell int, part int").fields])
        return queries.mapInArrow(_asked(self.shared, self.probes, len(self.keys), schema.names, rest), schema)

    def found(self, asked: DataFrame) -> DataFrame:
        schema = T.StructType([*(asked.schema[c] for c in self.keys), *T.StructType.fromDDL("uri string, distance double").fields])
        vectors = self.index.table(self.spark, "vectors")
        near = asked.groupBy("cell", "part").cogroup(vectors.groupBy("cell", "part")).applyInArrow(_nearest(self.k, self.keys, schema.names), schema)
        order = Window.partitionBy(*self.keys).orderBy("distance", "uri")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

    def topk(self, exact: bool = False) -> DataFrame:
        first = self.found(self.asked(self.queries))
        if not exact:
            return first
        first = written(first, "cell-first")
        last = first.groupBy(*self.keys).agg(F.when(F.count(F.lit(1)) >= self.k, F.max("distance")).alias("last"))
        rest = self.queries.join(last, self.keys, "left").select(*self.keys, "vector", "last")
        both = first.drop("rank").unionByName(self.found(self.asked(rest, rest=True)).drop("rank"))
        order = Window.partitionBy(*self.keys).orderBy("distance", "uri")
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)


def topk(index: Cells, queries: DataFrame, k: int, keys: list[str], *, probes: int = 16, exact: bool = True) -> DataFrame:
    """keys, uri, distance, rank: the k nearest by cosine (rounded to 12 places): of all, or, not exact, of each query's ``probes`` nearest cells.

    queries: keys (not null), vector; those without a vector give nothing.
    """
    return Search(index, queries, k, keys, probes).topk(exact)
