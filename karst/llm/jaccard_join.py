"""Operator 5, exact Jaccard join of n-gram sets by parity sketches.

Every shingle of a document toggles one bit of a wide, sparse bit sketch (k segments of 2**32
bits).  Shingles that two documents share cancel out, so the Hamming distance of their sketches is a
lower bound of the symmetric difference of their sets.  Documents that link differ in at
most d shingles, d following from their size band; with k = d + 1 + E segments at least E + 1
segments are equal (pigeonhole).  Segments are compared by the XOR of random masks of their odd bits.
Of each document only the d + 1 richest segments are joined on: both documents order segments alike, so
the E equal segments that may be left out cannot be all.  Colliding documents are verified on
their whole sets.  No link is lost; identical sets are one item from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.llm.blocks import blocks_of, unpacked
from karst.llm.common import bounded, discard, free_name, table, tidy, written
from karst.llm.linkage import PACKED, Packer, buckets, close, mix, shard_bits, sketch_of

SHINGLE, PERCENT = 4, 85
#: Words of a block.
BLOCK_WORDS = 300_000
_GOLD, _SEG, _GRP, _CNT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_HALF = np.uint64(32)


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z as a-z."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` word hashes, one for each place where such a run begins."""
    n = len(h) - size + 1
    out = np.full(max(0, n), size, np.uint64)
    for j in range(size if n > 0 else 0):
        out = mix(out * _GOLD + h[j : j + n])
    return out


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of a document's shingles; fewer words than a shingle are one."""
    return np.unique(runs(h, min(size, len(h)))) if len(h) else np.zeros(0, np.uint64)


def sets_of(row: dict, size: int) -> Iterator[np.ndarray]:
    """The shingle sets of a block's documents."""
    h = np.frombuffer(row["words"], np.uint64)[unpacked(row["seq"], "<u4")]
    whole, at = runs(h, size), 0
    for n in row["n"]:
        yield np.unique(whole[at : at + n - size + 1]) if n >= size else shingles(h[at : at + n], size)
        at += n


def set_id(s: np.ndarray) -> int:
    """The item: a digest of the set, with the lowest bit free for the side."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) & 0xFFFFFFFFFFFFFFFE


@lru_cache(maxsize=64)
def bands(percent: int, upto: int) -> list[int]:
    """Least sizes of the bands; sets that link lie in one band or in neighbours."""
    out = [1]
    while out[-1] <= upto:
        out.append(100 * out[-1] // percent + 1)
    return out


def _grid(upto: int) -> int:
    return 1 << max(10, upto.bit_length() + 1)


def keys_of(s: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(side, keys) in the set's two band groups: as a smaller set in its own band's, as a larger one in that below."""
    n = len(s)
    low = bands(percent, _grid(n))
    band = int(np.searchsorted(low, n, side="right")) - 1
    masks = mix(s ^ _GOLD)
    for group, side in ((band, 0), (band - 1, 1)):
        if group < 0:
            continue
        top = low[group + 1] - 1
        d = (100 - percent) * (top + 100 * top // percent) // (100 + percent)
        if d < 1:
            continue  # only equal sets link, and they are one item
        extra = 1 + -(-15 * d // 100)
        k = d + 1 + extra
        segment = ((s >> _HALF) * np.uint64(k)) >> _HALF  # sorted, as s is
        at = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        count = np.diff(np.append(at, n))
        present = segment[at]
        tag = np.uint64((group + 1) * int(_GRP) & 0xFFFFFFFFFFFFFFFF)
        key = mix(np.bitwise_xor.reduceat(masks, at) ^ mix(present * _SEG + tag + count.astype(np.uint64) * _CNT))
        if len(key) > d + 1:
            key = key[np.lexsort((key, -count))[: d + 1]]
        elif k - len(key) > extra:  # so few segments have bits that only empty ones may be equal
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), present)
            key = np.concatenate([key, mix(mix(empty * _SEG + tag))])
        yield side, key


def _ids(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.select(["block", "n", "words", "seq"]).to_pylist()):
                n, ids = [], []
                for s in sets_of(row, size):
                    n.append(len(s))
                    ids.append(np.uint64(set_id(s)).astype(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(n), pa.int64()), batch.column("ids").slice(k, 1).flatten(), pa.array(n, pa.int64()), pa.array(ids, pa.int64())], names=["block", "_id", "n_shingles", "item"])

    return tidy(run)


def _keys(size: int, percent: int, bits: int, keys_of: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(bits), set()
        for batch in batches:
            for row in batch.to_pylist():
                for s in sets_of(row, size):
                    item = set_id(s) if len(s) else None
                    if item is None or item in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(item)
                    for side, keys in keys_of(s, percent):
                        packer.add(keys, item | side)
                    if packer.full():
                        yield packer.flush()
        yield packer.flush()

    return tidy(run)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                want, cols = set(row["items"]), ([], [], [], [])
                for s in sets_of(row, size):
                    item = int(np.uint64(set_id(s)).astype(np.int64)) if len(s) else None
                    if item in want:
                        want.discard(item)
                        for out, v in zip(cols, (item, len(s), sketch_of(s), s.tobytes()), strict=True):
                            out.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["item", "n", "sketch", "s"])

    return tidy(run)


def _check(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                u = len(p) + len(q)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (u - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return tidy(run)


def verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges a, b whose whole sets meet the threshold.  A hot item's edges are split by the planner."""
    x = sets.select(F.col("item").alias("ia"), F.col("s").alias("x"))
    y = sets.select(F.col("item").alias("ib"), F.col("s").alias("y"))
    pairs = edges.join(x, F.expr("a = ia")).join(y, F.expr("b = ib")).select("a", "b", "x", "y")
    return pairs.mapInArrow(_check(percent), "a long, b long")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, keys: Callable = keys_of) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links, itself included) of every row.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of distinct
    ``size``-word shingles; a text of fewer words is one shingle.  Null texts and texts without words have
    empty sets and link with nothing, not even with each other.  Repeated rows have equal sets and link.
    keys(set, percent) gives the (side, keys) under which a set is a candidate; links of colliding sets are
    all found, whatever the keys.  Null ids are ignored by the minimum; a component without other ids has a null one.  Texts are taken whole, however long, and
    columns beyond the id and the text are not looked at.  An empty table gives
    an empty result.
    """
    blocks = written(blocks_of(bounded(docs), id_col, text_col, words_of, words=BLOCK_WORDS), "jaccard-blocks", compression="none")
    own = T.StructField("_id", docs.schema[id_col].dataType)
    items = blocks.mapInArrow(_ids(size), T.StructType([T.StructField("block", T.LongType()), own, *T.StructType.fromDDL("n_shingles long, item long").fields]))
    items = written(items, "jaccard-items")
    bits, plain = shard_bits(docs), blocks.select("block", "n", "words", "seq")
    found = buckets(plain.mapInArrow(_keys(size, percent, bits, keys), PACKED), "jaccard-buckets")

    # Whole sets only of items in buckets, from one block each; a block's items are at most its documents.
    inside = found.select(F.explode(F.concat("small", "large")).alias("item")).distinct()
    chosen = items.groupBy("item").agg(F.min("block").alias("block")).join(inside, "item", "left_semi").groupBy("block").agg(F.collect_list("item").alias("items"))
    sets = written(plain.join(chosen, "block").mapInArrow(_sets(size), "item long, n long, sketch binary, s binary"), "jaccard-sets", free=True)
    discard(blocks)

    parts = close(found, lambda edges: verified(edges, sets, percent), sets.select("item", "n", "sketch"), percent, "jaccard")
    discard(found)
    discard(sets)
    full = items.where("item IS NOT NULL").join(parts, "item", "left").withColumn("component", F.coalesce("component", "item"))
    # Written, so that both sides of the last join are plain exchanges, of which the planner splits a large group's.
    least = written(full.groupBy("component").agg(F.min("_id").alias("component_id")), "jaccard-least")
    linked = full.join(least, "component").select(F.col("_id").alias(id_col), "n_shingles", "component_id")
    return linked.union(items.where("item IS NULL").select(F.col("_id").alias(id_col), "n_shingles", F.col("_id").alias("component_id")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each component: that with the smallest id, null ids last; of repeated ids the least digest of the row.

    Equal rows are one row, as they link.  Rows without words link with nothing, so all of them stay.
    """
    key, alone = free_name(docs.columns, "_key"), free_name(docs.columns, "_alone")
    cells = [F.to_json(F.struct(c.name)) if isinstance(c.dataType, (T.MapType, T.VariantType)) else F.col(c.name) for c in docs.schema]
    # Not null itself, and ordered as rows are preferred; the hash skips nulls, so these are told to it.
    keyed = docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(*cells, *(F.col(c).isNull() for c in docs.columns)).alias("digest")))
    kept = jaccard_components(keyed, id_col=key, **options).where(F.col(key) == F.col("component_id"))
    kept = kept.select(key, (F.col("n_shingles") == 0).alias(alone)).distinct()
    keyed = keyed.join(kept.hint("shuffle_hash"), key)
    keyed = keyed.withColumn(alone, F.when(F.col(alone), F.monotonically_increasing_id()))
    return keyed.dropDuplicates([key, alone]).select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
