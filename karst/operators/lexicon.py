"""A stored inverted index: postings in blocks with their largest weights, and exact top-k by block maxima.

Documents are numbered in the order of their URIs; a block is what a token has in one range of RANGE numbers, as offsets
from the range's first.  A block also has the largest frequency and the least length of each field, from which its highest
score follows for whatever averages the index has by then, so that additions are segments of their own and rewrite nothing.  The postings are bucketed by token and
shard (a run of ranges; a token of many documents has many), the documents by range: neither is shuffled by a query.

A query first adds up the bounds of its tokens by range, scores the ranges of the highest bounds, as many as it wants hits, and then
only those ranges whose bound reaches the score of the last hit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karst.sources.scratch import shared_dir, written

#: BM25's constants.
K1, B = 1.2, 0.75
#: Bits of a document's number within its range, and within its shard.
RANGE_BITS, SHARD_BITS = 7, 20
#: Bits of a document's number within its segment.
SEGMENT_BITS = 52
#: Asked tokens that a scan is told as literals, so that other tokens' pages are not read; more are joined only.
LITERALS = 1000
#: What a bound may be off by, as sums are made in any order.
SLACK = 1e-6


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


@dataclass(frozen=True)
class Lexicon:
    """Names of an index's tables, and its fields with their boosts in the order of the arrays in them."""

    name: str
    boosts: tuple[tuple[str, float], ...]

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.table(f"{self.name}_{kind}")

    def drop(self, spark: SparkSession) -> None:
        for kind in ("postings", "documents", "tokens", "totals"):
            spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")


def _saved(df: DataFrame, name: str, buckets: int, by: list[str], sort: list[str], folder: str | None) -> None:
    """Appends to a bucketed table, one file a bucket; small pages, so that few are read for a token."""
    writer = df.write.mode("append").format("parquet").bucketBy(buckets, *by).sortBy(*sort).option("parquet.page.row.count.limit", "256")
    (writer.option("path", f"{folder}/{name}") if folder else writer).saveAsTable(name)


def add(lexicon: Lexicon, rows: DataFrame, id_col: str, fields: dict[str, Column], *, buckets: int | None = None, folder: str | None = None) -> Lexicon:
    """Adds rows to the index as a new segment, making its tables where there are none (under ``folder``, or as the catalogue's own).

    Every row is a document of its own, an id that was added before too.  Texts are cut into words once; what is shuffled is a token of a
    field of a document with its frequency, once, to where it stays.
    """
    spark = rows.sparkSession
    if tuple(fields) != tuple(f for f, _ in lexicon.boosts):
        raise ValueError(f"the index has the fields {[f for f, _ in lexicon.boosts]}")
    exists = spark.catalog.tableExists(f"{lexicon.name}_totals")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if exists:
        n = int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {lexicon.name}_postings").collect() if r.col_name == "Num Buckets"))
    segment = lexicon.table(spark, "totals").count() if exists else 0
    # Numbers ascend with the ids, so that of equal scores the first number is the first id.
    texts = [f"w{i}" for i in range(len(fields))]
    cut = rows.select(F.col(id_col).cast("string").alias("uri"), *[c.alias(w) for c, w in zip(fields.values(), texts, strict=True)])
    cut = cut.repartitionByRange("uri").sortWithinPartitions("uri").withColumn("place", F.monotonically_increasing_id() + (segment << SEGMENT_BITS))
    cut = cut.withColumns({w: F.sort_array(words(F.col(w))) for w in texts})  # both compiled, without a lambda a word
    cut = written(cut, "lexicon-words")
    documents = cut.select(F.shiftright("place", RANGE_BITS).alias("range"), "place", "uri").repartition(n, "range")
    _saved(documents, f"{lexicon.name}_documents", n, ["range"], ["range", "place"], folder)

    for i in range(len(fields)):  # a sorted array's runs begin where a word differs from the one before
        starts = F.expr(f"CASE WHEN size(w{i}) = 0 THEN array() ELSE filter(sequence(0, size(w{i}) - 1), p -> p = 0 OR w{i}[p] <> w{i}[p - 1]) END")
        cut = cut.withColumns({f"n{i}": F.size(f"w{i}"), f"s{i}": starts})
    runs = [F.expr(f"transform(s{i}, (p, j) -> struct(w{i}[p] AS token, {i} AS field, coalesce(get(s{i}, j + 1), n{i}) - p AS tf, n{i} AS len))") for i in range(len(fields))]
    entries = cut.select("place", F.explode(F.concat(*runs)).alias("e")).select("e.token", F.shiftright("place", SHARD_BITS).alias("shard"), F.shiftright("place", RANGE_BITS).alias("range"), "place", "e.field", "e.tf", "e.len")
    # One exchange, which both groupings and the buckets share.
    entries = entries.repartition(n, "token", "shard")
    each = lambda c: F.array(*[F.coalesce(F.max(F.when(F.col("field") == i, F.col(c))), F.lit(0)) for i in range(len(fields))]).alias(c)
    entries = entries.groupBy("token", "shard", "range", "place").agg(each("tf"), each("len"))
    at = F.expr(f"cast(place & {(1 << RANGE_BITS) - 1} AS tinyint)")
    blocks = entries.groupBy("token", "shard", "range").agg(
        F.array_sort(F.collect_list(F.struct(at.alias("at"), "tf", "len"))).alias("entries"),
        F.count(F.lit(1)).cast("int").alias("n"),
        F.array(*[F.max(F.col("tf")[i]) for i in range(len(fields))]).alias("top"),
        F.array(*[F.coalesce(F.min(F.when(F.col("tf")[i] > 0, F.col("len")[i])), F.lit(0)) for i in range(len(fields))]).alias("low"),
    )
    _saved(blocks, f"{lexicon.name}_postings", n, ["token", "shard"], ["token", "shard", "range"], folder)

    own = lexicon.table(spark, "postings").where(F.shiftright("range", SEGMENT_BITS - RANGE_BITS) == segment)
    tokens = own.groupBy("token").agg(F.sum("n").alias("df"), F.collect_set("shard").alias("shards"))
    _saved(tokens.repartition(n, "token"), f"{lexicon.name}_tokens", n, ["token"], ["token"], folder)
    sums = cut.agg(F.lit(segment).alias("segment"), F.count(F.lit(1)).alias("documents"), F.array(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(fields))]).alias("words"), F.array(*[F.count(F.when(F.col(f"n{i}") > 0, 1)) for i in range(len(fields))]).alias("texts"))
    totals = sums.write.mode("append").format("parquet")
    (totals.option("path", f"{folder}/{lexicon.name}_totals") if folder else totals).saveAsTable(f"{lexicon.name}_totals")
    return lexicon


def build(rows: DataFrame, id_col: str, fields: dict[str, tuple[Column, float]], name: str, *, buckets: int | None = None, reset: bool = False) -> Lexicon:
    """An index of the catalogue's, of one segment."""
    lexicon = Lexicon(name, tuple((f, float(b)) for f, (_, b) in fields.items()))
    if reset:
        lexicon.drop(rows.sparkSession)
    return add(lexicon, rows, id_col, {f: c for f, (c, _) in fields.items()}, buckets=buckets)


def build_scratch(rows: DataFrame, id_col: str, fields: dict[str, tuple[Column, float]], buckets: int | None = None, name: str | None = None) -> Lexicon:
    """An index with its files in the shared scratch folder: for one request, or under a name, by which it is found again."""
    folder = shared_dir(rows.sparkSession, "lexicon")
    lexicon = Lexicon(name or "lexicon_" + folder.rpartition("-")[2], tuple((f, float(b)) for f, (_, b) in fields.items()))
    if rows.sparkSession.catalog.tableExists(f"{lexicon.name}_totals"):  # the last that is written
        return lexicon
    lexicon.drop(rows.sparkSession)
    return add(lexicon, rows, id_col, {f: c for f, (c, _) in fields.items()}, buckets=buckets, folder=folder)


# --- queries ------------------------------------------------------------------------------------------------------


def _only(table: DataFrame, tokens: list[str] | None) -> DataFrame:
    """The table's rows of these tokens: in lists as short as Parquet filters pages by."""
    if tokens is None:
        return table
    test = F.lit(False)
    for k in range(0, len(tokens), 10):
        test = test | F.col("token").isin(tokens[k : k + 10])
    return table.where(test)


def _weight(boosts: list[float], average: list[float], tf: str, length: str) -> Column:
    """The boosted sum of a document's normalised frequencies over the fields."""
    out = F.lit(0.0)
    for i, (boost, mean) in enumerate(zip(boosts, average, strict=True)):
        if mean:
            out = out + boost * (F.col(tf)[i] / (1 - B + B * F.col(length)[i] / F.lit(mean)))
    return out


def _saturated(f: Column) -> Column:
    return f / (f + K1)


class Search:
    """A set of queries against an index.  queries: keys, query."""

    def __init__(self, lexicon: Lexicon, queries: DataFrame, keys: list[str]):
        self.spark, self.keys, self.lexicon = queries.sparkSession, keys, lexicon
        totals = lexicon.table(self.spark, "totals").collect()  # a row a segment
        documents = sum(r.documents for r in totals)
        sums = [(sum(r.words[i] for r in totals), sum(r.texts[i] for r in totals)) for i in range(len(lexicon.boosts))]
        self.average, self.boosts = [a / b if b else 0.0 for a, b in sums], [b for _, b in lexicon.boosts]
        asked = queries.select(*keys, F.explode(words(F.col("query"))).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("times"))
        asked = written(asked, "asked")
        few = [r.token for r in asked.select("token").distinct().limit(LITERALS + 1).collect()]
        self.tokens = few if len(few) <= LITERALS else None
        known = _only(lexicon.table(self.spark, "tokens"), self.tokens)
        terms = asked.join(known, "token").groupBy(*keys, "token", "times").agg(F.sum("df").alias("df"), F.flatten(F.collect_list("shards")).alias("shards"))
        idf = F.log(1 + (documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.terms = written(terms.select(*keys, "token", (F.col("times") * idf).alias("weight"), F.explode("shards").alias("shard")), "terms")

    def postings(self) -> DataFrame:
        return _only(self.lexicon.table(self.spark, "postings"), self.tokens)

    def bounds(self) -> DataFrame:
        """keys, range, bound: what no document of the range scores above."""
        blocks = self.postings().select("token", "shard", "range", "top", "low")
        part = F.col("weight") * (K1 + 1) * _saturated(_weight(self.boosts, self.average, "top", "low"))
        return self.terms.join(blocks, ["token", "shard"]).groupBy(*self.keys, "range").agg(F.sum(part).alias("bound"))

    def scores(self, ranges: DataFrame) -> DataFrame:
        """keys, place, score of all documents of the queries' ranges (keys, range) that have a token of theirs."""
        wanted = ranges.groupBy(*self.keys, F.shiftright("range", SHARD_BITS - RANGE_BITS).alias("shard")).agg(F.collect_list("range").alias("ranges"))
        terms = self.terms.join(wanted, [*self.keys, "shard"])
        found = terms.join(self.postings().select("token", "shard", "range", "entries"), ["token", "shard"]).where("array_contains(ranges, range)")
        found = found.select(*self.keys, "weight", "range", F.explode("entries").alias("e")).select(*self.keys, "weight", (F.shiftleft("range", RANGE_BITS) + F.col("e.at")).alias("place"), "e.tf", "e.len")
        part = F.col("weight") * (K1 + 1) * _saturated(_weight(self.boosts, self.average, "tf", "len"))
        return found.groupBy(*self.keys, "place").agg(F.round(F.sum(part), 9).alias("score"))

    def ranges(self, k: int) -> tuple[DataFrame, DataFrame]:
        """The scores of each query's k ranges of the highest bounds, and the other ranges (keys, range) that may hold one of the k best."""
        order = Window.partitionBy(*self.keys).orderBy(F.desc("bound"), "range")
        bounds = written(self.bounds(), "bounds")
        first = written(bounds.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(*self.keys, "range"), "first-ranges")
        scored = written(self.scores(first), "first-scores")
        best = Window.partitionBy(*self.keys).orderBy(F.desc("score"), "place")
        last = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy(*self.keys).agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("n"))
        rest = bounds.join(first, [*self.keys, "range"], "left_anti").join(last, self.keys, "left")
        return scored, rest.where(F.coalesce(F.col("n"), F.lit(0)) < k).unionByName(rest.where((F.col("n") >= k) & (F.col("bound") + SLACK >= F.col("last")))).select(*self.keys, "range")

    def topk(self, k: int) -> DataFrame:
        """keys, uri, score, rank: the k best of each query, of equal scores the first URIs; scores are rounded to nine places."""
        scored, rest = self.ranges(k)
        scored = scored.unionByName(self.scores(written(rest, "other-ranges")))
        # Within a segment numbers are in the order of URIs, so its first k are all that can be among the k best.
        own = Window.partitionBy(*self.keys, F.shiftright("place", SEGMENT_BITS)).orderBy(F.desc("score"), "place")
        best = scored.withColumn("n", F.row_number().over(own)).where(F.col("n") <= k).select(*self.keys, "score", "place", F.shiftright("place", RANGE_BITS).alias("range"))
        documents = self.lexicon.table(self.spark, "documents").select("range", F.col("place").alias("p"), "uri")
        named = best.join(documents, "range").where("place = p")
        order = Window.partitionBy(*self.keys).orderBy(F.desc("score"), "uri")
        return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*self.keys, "uri", "score", "rank")


def topk(lexicon: Lexicon, queries: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """keys, uri, score, rank: the k best documents of each query by BM25 over the boosted fields.

    queries: keys, query.  A token that a query repeats counts each time.  Queries without words, or of words that no document has, give nothing.
    """
    return Search(lexicon, queries, keys).topk(k)
