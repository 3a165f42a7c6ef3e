"""Operator 7, cross-entropy difference of two matched n-gram language models.

A background model of all documents and a target model of the good ones are alike in order, smoothing and
vocabulary.  A document's score is the mean over its words of background loss minus target loss: the
higher, the more it looks like the target.  A document is scored by what the other documents count: its own
words are taken out of both models first.

Every distinct word and bigram of the corpus is counted for itself, known by a 64-bit hash.  Blocks of documents
send each of their words and bigrams once, with its counts, to the shard of its hash; shards
answer each block with the corpus's counts of those that other blocks hold too.  A key has no more entries than
there are blocks; only totals reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.llm.blocks import WORDS, blocks_of, by_shard, packed, packed_keys, unpacked, unpacked_keys
from karst.llm.common import bounded, table, tidy, tidy_groups, written
from karst.llm.decontaminate import words_of
from karst.llm.linkage import mix, shard_bits

#: Weight of the bigram estimate against the unigram one, and the unigram's added count.
BIGRAM_WEIGHT, ADDED = 0.7, 0.5
_GOLD, _WORD, _BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_ENTRIES = "shard int, block long, keys binary, b binary, t binary"
_COUNTS = "block long, shard int, at binary, b binary, t binary, n_words long"


class Block:
    """The grams of a block: its words, then its bigrams; the begin mark is the word after the last."""

    def __init__(self, row: dict, bits: int):
        self.n = np.array(row["n"], np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.seq = unpacked(row["seq"], "<u4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.target = np.zeros(len(self.n), bool)
        self.target[row["good"] or []] = True
        self.width = len(self.words) + 1
        self.before = np.empty_like(self.seq)
        self.before[1:] = self.seq[:-1]
        self.before[(np.cumsum(self.n) - self.n)[self.n > 0]] = self.width - 1
        flag = self.target[self.doc]
        # Bigrams with a flag for the target, sorted.
        codes = np.sort(((self.before * self.width + self.seq) << 1) | flag)
        pairs = codes >> 1
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        self.pairs = pairs[first]
        b = np.diff(np.append(first, len(pairs)))
        t = np.add.reduceat(codes & 1, first) if len(first) else b
        self.b = np.concatenate([np.bincount(self.seq, minlength=len(self.words)), b])
        self.t = np.concatenate([np.bincount(self.seq[flag], minlength=len(self.words)), t])
        h = np.append(self.words, _BEGIN)
        grams = mix(mix(h[self.pairs // self.width] * _GOLD) + h[self.pairs % self.width])
        # The lowest bit tells a word from a bigram.
        self.keys = np.concatenate([mix(self.words ^ _WORD) | np.uint64(1), grams & ~np.uint64(1)])
        self.order, self.shards, self.cuts = by_shard(self.keys, bits)


def _entries(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block(row, bits)
                keys, b, t = (x[own.order] for x in (own.keys, own.b.astype("<u4"), own.t.astype("<u4")))
                cols = [own.shards, np.full(len(own.cuts), row["block"]), *([f(x[i:j]) for i, j in own.cuts] for x, f in ((keys, packed_keys), (b, packed), (t, packed)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], names=["shard", "block", "keys", "b", "t"])

    return tidy(run)


def _counts(table: pa.Table) -> pa.Table:
    """For each block the counts of those of its grams of this shard that stand in other blocks too; and, of no block, how many distinct words the shard has."""
    parts = [unpacked_keys(x) for x in table.column("keys")]
    keys = np.concatenate(parts)
    b, t = (np.concatenate([unpacked(x, "<u4") for x in table.column(c)]).astype(np.int64) for c in ("b", "t"))
    size = np.array([len(x) for x in parts])
    owner, at = np.repeat(np.arange(len(parts)), size), np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
    order = np.argsort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    count = np.diff(np.append(first, len(keys)))
    sums = [np.repeat(np.add.reduceat(x[order], first), count) for x in (b, t)]
    shared = np.repeat(count > 1, count)
    order, sums = order[shared], [x[shared] for x in sums]
    place = np.lexsort((at[order], owner[order]))
    order, sums = order[place], [x[place] for x in sums]
    cuts = np.searchsorted(owner[order], np.arange(len(parts) + 1)).tolist()
    own = [(k, i, j) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
    blocks, shard = table.column("block").to_pylist(), table.column("shard")[0].as_py()
    n_words = int((keys[np.argsort(keys)][first] & np.uint64(1)).sum())
    cols = [
        [*(blocks[k] for k, _, _ in own), None],
        [shard] * (len(own) + 1),
        *([*(packed(x[i:j]) for _, i, j in own), None] for x in (at[order].astype("<u4"), *sums)),
        [None] * len(own) + [n_words],
    ]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64()]
    return pa.table({f.split(" ")[0]: pa.array(c, k) for f, c, k in zip(_COUNTS.split(", "), cols, kinds, strict=True)})


def _scores(bits: int, totals: list[int], distinct: int):
    """totals: words and documents with words of the background, then of the target."""

    def run(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        row = blocks.select(["block", "n", "words", "seq", "good"]).to_pylist()[0]
        own = Block(row, bits)
        sides = [own.b.astype(np.int64), own.t.astype(np.int64)]
        begins = dict(zip(own.shards.tolist(), own.cuts, strict=True))
        for x in counts.to_pylist():
            at = own.order[begins[x["shard"]][0] + unpacked(x["at"], "<u4").astype(np.int64)]
            for side, c in zip(sides, ("b", "t"), strict=True):
                side[at] = unpacked(x[c], "<i8")
        # The distinct bigrams of each document, and the counts that it has of them and of their words.
        w = own.width
        codes = np.sort(own.doc * (w * w) + own.before * w + own.seq)
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        codes, c = codes[first], np.diff(np.append(first, len(codes)))
        doc, pair = codes // (w * w), codes % (w * w)
        h, x = pair // w, pair % w
        mine, mine_n = np.unique(own.doc * w + own.seq, return_counts=True)
        held = lambda word: np.where(word == w - 1, 1, mine_n[np.minimum(np.searchsorted(mine, doc * w + word), len(mine) - 1)])  # noqa: E731  each document begins once
        held_h, held_x = held(h), held(x)
        gram = len(own.words) + np.searchsorted(own.pairs, pair)
        losses = []
        for k, side in enumerate(sides):
            mask = np.ones(len(doc), np.int64) if k == 0 else own.target[doc].astype(np.int64)
            n, begins_n = totals[2 * k] - own.n[doc] * mask, totals[2 * k + 1] - mask
            unigram = (side[x] - held_x * mask + ADDED) / (n + ADDED * (distinct + 2))
            seen = np.where(h == w - 1, begins_n, side[np.minimum(h, len(own.words) - 1)] - held_h * mask)
            p = np.where(seen > 0, BIGRAM_WEIGHT * (side[gram] - c * mask) / np.maximum(seen, 1) + (1 - BIGRAM_WEIGHT) * unigram, unigram)
            losses.append(np.bincount(doc, c * -np.log(p), len(own.n)))
        some = own.n > 0
        mean = [pa.array(x / np.maximum(own.n, 1), mask=~some) for x in losses]
        ids = blocks.column("ids").combine_chunks().flatten()
        return pa.table({"_id": ids, "n_words": pa.array(own.n), "background_loss": mean[0], "target_loss": mean[1]})

    return run


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = WORDS) -> DataFrame:
    """id, n_words, background_loss, target_loss (means in nats), score (their difference) of every row.

    Target documents are those that labels calls quality 1 and toxic 0; repeated labels of an id count once
    (the best quality, the worst toxicity).  All documents, labelled or not, make the background.  A row's own
    words are not counted when it is scored, but those of a repeated row are.  Null and
    empty texts have no words and null losses; so has every row when no target document has words.
    Repeated rows count and are scored each.  An empty table gives an empty result.  Columns beyond the id and the
    text are not looked at.  The result does not depend on ``block_words``; a longer text is a block of its own.
    """
    if not 0 < block_words <= 10 * WORDS:
        raise ValueError(f"block_words must be from 1 to {10 * WORDS}, as documents and bigrams of a block are numbered in 63 bits")
    bits = shard_bits(bounded(docs))
    blocks = written(blocks_of(docs, id_col, text_col, words_of, words=block_words), "lm-blocks", compression="none")
    good = labels.groupBy(id_col).agg(F.max("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0").select(F.col(id_col).alias("_good"))
    # Labels grow with the corpus; only ids meet them.
    flags = blocks.select("block", F.posexplode("ids").alias("at", "_id")).join(good, F.expr("_id = _good")).groupBy("block").agg(F.collect_list("at").alias("good"))
    flags = written(flags, "lm-flags")
    blocks = blocks.join(flags, "block", "left")
    of_good = F.transform(F.coalesce("good", F.array().cast("array<int>")), lambda k: F.get("n", k))
    some = lambda x: F.size(F.filter(x, lambda n: n > 0))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, n: s + n)
    sizes = blocks.select(total("n").alias("b"), some("n").alias("db"), total(of_good).alias("t"), some(of_good).alias("dt"))
    totals = [x or 0 for x in sizes.agg(*(F.sum(c) for c in ("b", "db", "t", "dt"))).first()]
    entries = blocks.mapInArrow(_entries(bits), _ENTRIES)
    counts = written(entries.groupBy("shard").applyInArrow(tidy_groups(_counts), _COUNTS), "lm-counts", free=True, compression="none")
    distinct = counts.agg(F.sum("n_words")).first()[0] or 0
    out = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *T.StructType.fromDDL("n_words long, background_loss double, target_loss double").fields])
    told = counts.where("block IS NOT NULL").select("block", "shard", "at", "b", "t")
    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tidy_groups(_scores(bits, totals, distinct)), out)
    if not totals[2]:
        scored = scored.withColumn("background_loss", F.lit(None).cast("double")).withColumn("target_loss", F.lit(None).cast("double"))
    return scored.select(F.col("_id").alias(id_col), "n_words", "background_loss", "target_loss", (F.col("background_loss") - F.col("target_loss")).alias("score"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
