"""What similarity operators share: packed key buckets, components of links, and their exact closure.

A candidate key is eight bytes and so is an item.  Map tasks deal their (key, item) entries into
shards and ship each shard as one packed row, so that tens of millions of entries are shuffled and
sorted as arrays, not as rows.  A bucket is a key with its items.  Items that share a bucket are
candidates; ``close`` verifies as many of them as are needed to know the components for sure, and never
lists all pairs of a bucket whose items are linked anyway.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from karst.llm.common import discard, partitions, tidy, tidy_groups, written

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
PACKED = "shard int, keys binary, items binary"
BUCKETS = "key long, small array<long>, large array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    return x ^ (x >> np.uint64(33))


def shard_bits(df: DataFrame) -> int:
    """Shards are a power of two, some to every shuffle partition."""
    return max(8, min(20, (8 * partitions(df.sparkSession)).bit_length()))


class Packer:
    """Gathers entries and gives them as packed rows.  An item's lowest bit is its side: 0 small, 1 large."""

    def __init__(self, bits: int, limit: int = 300_000):
        self.bits, self.limit, self.keys, self.items, self.n = bits, limit, [], [], 0

    def add(self, keys: np.ndarray, item: int) -> None:
        self.add_all(keys[None], np.array([item], np.uint64))

    def add_all(self, keys: np.ndarray, items: np.ndarray) -> None:
        """A line of keys for each item."""
        self.keys.append(keys.ravel())
        self.items.append(np.repeat(items, keys.shape[1]))
        self.n += keys.size

    def full(self) -> bool:
        return self.n >= self.limit

    def flush(self) -> pa.RecordBatch:
        keys, items = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (self.keys, self.items))
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        keys, items, shard = keys[order], items[order], shard[order]
        at = np.flatnonzero(np.diff(shard, prepend=-1))
        ends = [*at[1:].tolist(), len(shard)][: len(at)]
        rows = [(int(shard[a]), keys[a:b].tobytes(), items[a:b].tobytes()) for a, b in zip(at.tolist(), ends, strict=True)]
        self.keys, self.items, self.n = [], [], 0
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "keys", "items"])


def _group(table: pa.Table) -> pa.Table:
    """Buckets of one shard: keys with at least two items, one of them small."""
    keys = np.frombuffer(b"".join(x.as_py() for x in table.column("keys")), dtype=np.uint64)
    items = np.frombuffer(b"".join(x.as_py() for x in table.column("items")), dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, items = keys[order], items[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    counts = np.diff(np.append(first, len(keys)))
    out = ([], [], [])
    one = np.uint64(1)
    for a, n in zip(first[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
        own = np.unique(items[a : a + n])
        if len(own) < 2:
            continue
        side = (own & one).astype(bool)
        small, large = (own[~side]).view(np.int64), (own[side] & ~one).view(np.int64)
        if len(small) and len(small) + len(large) > 1:
            out[0].append(int(keys[a : a + 1].view(np.int64)[0]))
            out[1].append(small)
            out[2].append(large)
    ints = pa.list_(pa.int64())
    return pa.table({"key": pa.array(out[0], pa.int64()), "small": pa.array(out[1], ints), "large": pa.array(out[2], ints)})


def buckets(packed: DataFrame, name: str) -> DataFrame:
    """The buckets of packed entries, written: key, small, large (items of either side; large ones need not be compared)."""
    return written(packed.groupBy("shard").applyInArrow(tidy_groups(_group), BUCKETS), name, free=True)


def components(edges: DataFrame, name: str) -> DataFrame:
    """item, component (its smallest item), for the items of undirected edges a, b: alternating large and small stars.

    Every round is written to the shared folder; stars of any size are formed by map-side
    minima and a join whose hot side the planner splits.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
        large = both.join(least, F.expr("a = u")).where("b > a").select(F.col("m").alias("a"), F.col("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u")
        small = large.join(least, F.expr("b = u")).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        # The state is told by the job that writes it; told twice over, as after a lost executor, it only costs one more round.
        told = Observation()
        state = small.where("a <> b").distinct().observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        before, edges = edges, written(state, name)
        discard(before)
        now = (told.get["n"], told.get["h"])
        if now == seen:
            break
        seen = now
    found = edges.groupBy("b").agg(F.min("a").alias("a"))
    out = written(found.select(F.col("b").alias("item"), F.col("a").alias("component")).union(found.select("a", "a").distinct()), name)
    discard(edges)
    return out


def sketch_of(s: np.ndarray) -> bytes:
    """The parity sketch of a set of hashes: each toggles one of 2**m bits, at least four to an element; folding it in half gives the next smaller one."""
    bits = 1 << max(9, min(17, (4 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _alike(rows: list[dict]) -> np.ndarray:
    """The sketches of rows as a matrix of words, folded to the shortest's length."""
    width = min(len(r["sketch"]) for r in rows)
    out = np.zeros((len(rows), width // 8), dtype=np.uint64)
    for k, r in enumerate(rows):
        words = np.frombuffer(r["sketch"], dtype=np.uint64)
        while len(words) * 8 > width:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        out[k] = words
    return out


def _cross(percent: int, nearest: int | None):
    """Candidate pairs of a bucket's items (or of two blocks of a large bucket's) in different components.

    A pair goes when the Hamming distance of the sketches, a lower bound of the symmetric
    difference, excludes a link; of the others, each item's ``nearest`` are given, or all.
    Pairs with the item that all were compared with are known already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                own = [x for x in row["own"] if x["i"] != row["centre"]]
                if len(own) < 2:
                    continue
                i, c, n, block = (np.array([x[f] for x in own], np.int64) for f in ("i", "c", "n", "block"))
                large = np.array([x["large"] for x in own])
                words, a, b = _alike(own), [], []
                for x in np.flatnonzero(~large & (block == row["lo"])).tolist():
                    other = np.flatnonzero((c != c[x]) & (block == row["hi"]))
                    if not len(other):
                        continue
                    far = np.bitwise_count(words[other] ^ words[x]).sum(axis=1, dtype=np.int64)
                    near = far * (100 + percent) <= (100 - percent) * (n[other] + n[x])
                    other, far = other[near], far[near]
                    if nearest is not None and len(other) > nearest:
                        other = other[np.argpartition(far, nearest)[:nearest]]
                    a.append(np.full(len(other), i[x]))
                    b.append(i[other])
                if a and sum(map(len, a)):
                    x, y = np.concatenate(a), np.concatenate(b)
                    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return tidy(run)


#: Items of a bucket that one task compares with as many others.
BLOCK = 4096


def close(found: DataFrame, verify: Callable[[DataFrame], DataFrame], items: DataFrame, percent: int, name: str) -> DataFrame:
    """item, component: of all links between items that share a bucket, with the threshold 100 * common >= percent * union.

    items: item, n (the size of its set), sketch.  First each bucket's items are compared with its
    smallest small item.  A bucket whose items are then in one component can add nothing.  In the
    others, items are compared with their nearest in other components, which mostly links them;
    then whatever pairs across components their sketches don't exclude are verified.  After that no
    candidate pair is left that is neither refuted nor within a component.  Buckets of any size are
    compared in blocks, so no task holds more than two blocks.
    """
    centre = F.array_min("small")
    star = found.select(centre.alias("a"), F.explode(F.concat("small", "large")).alias("b")).where("a <> b")
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(verify(star), name + "-links", free=True)
    parts = components(links, name + "-components")

    rest = found.where("size(small) + size(large) > 2").withColumn("blocks", F.ceil((F.size("small") + F.size("large")) / BLOCK).cast("int"))
    sides = [rest.select("key", centre.alias("centre"), "blocks", F.explode(side).alias("i"), F.lit(side == "large").alias("large")) for side in ("small", "large")]
    own = sides[0].union(sides[1])
    for nearest in (3, None):
        now = own.join(parts, F.expr("i = item"), "left").select("key", "centre", "blocks", "i", "large", F.coalesce("component", "i").alias("c"))
        mixed = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        now = written(now.join(mixed, "key", "left_semi"), name + "-mixed", free=True)
        if now.isEmpty():
            discard(now)
            break
        told = now.join(items, F.expr("i = item")).withColumn("block", F.expr("pmod(xxhash64(i), blocks)").cast("int"))
        # Every ordered pair of blocks: an item is a row's x in its own block's pairs, a y in the others'.
        told = told.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = told.select("key", "centre", F.explode(F.array_distinct(F.array(F.struct(F.col("block").alias("lo"), F.col("other").alias("hi")), F.struct(F.col("other").alias("lo"), F.col("block").alias("hi"))))).alias("p"), F.struct("i", "c", "large", "n", "sketch", "block").alias("x"))
        lists = pair.groupBy("key", "centre", "p.lo", "p.hi").agg(F.collect_list("x").alias("own"))
        across = lists.mapInArrow(_cross(percent, nearest), "a long, b long").distinct()
        more = written(verify(across), name + "-links", free=True)
        discard(now)
        if not more.isEmpty():
            links = links.union(more)
            parts = components(links, name + "-components")
    return parts
