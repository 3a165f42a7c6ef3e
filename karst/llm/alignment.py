"""Operator 13, alignment of two tokenizers' tokens.

A text is encoded by both vocabularies.  The ends of their tokens, cumulative byte lengths, are merged; where both end, a group of
tokens on either side ends, and its last two tokens are a link.  Documents are held in blocks: a block's distinct id pairs,
and each document's links as places among them.  Every block tells its pairs with their numbers once, as plain
rows; Spark adds them up, takes the highest count of each side, and joins them back to the blocks' pairs.  No row is
broadcast, and a pair that every document has is one row a block.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.llm.blocks import packed, unpacked
from karst.llm.common import bounded, table, tidy, written
from karst.llm.tokens import byte_of, default_vocabulary, plain_encoder

#: Links and documents at which a block ends; a longer text is a block of its own.
LINKS, DOCUMENTS = 1_500_000, 1 << 16
#: Characters at which a text for the piece vocabulary may be cut, before a single space.
CUT = 200_000
_SPACE = re.compile(r"(?<=\S) (?=\S)")
COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
PAIRS = "block long, a int, b int, n long"


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of_text(text: str, size: int = CUT) -> list[str]:
    """The text in parts that encode like the whole, each to be led by the space that the vocabulary adds.

    No piece has a space behind another character, so none lies across the end of a word.
    """
    out, at = [], 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.end()
    return [*out, text[at:]]


class Aligner:
    """One process's tables of both vocabularies."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a = plain_encoder(bytes_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        of = byte_of()
        vocab = self.a.vocabulary()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = all("▁" not in p.lstrip("▁") for p in pieces)
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # What is written for a token: in a group, at its side's end, on either side.
        self.said = [b"%d%b" % (i, end) for n, ends in ((len(self.bytes_a), b",|"), (len(self.bytes_b), b",;")) for end in (ends[:1], ends[1:]) for i in range(n)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None where a side's bytes are not the text's, led by a space."""
        whole = (" " + text).encode()
        a = self.a.ids(" " + text).tolist()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole:
            return None
        b = [i for part in (pieces_of_text(text) if self.cuts else [text]) for i in self.b.encode(part)]
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """n_a, n_b, n_groups, the digest of the groups, and the linked pairs in order, as a << 32 | b."""
        ids = self.encode(text) if text else None
        if ids is None:
            return 0, 0, 0, "", np.zeros(0, np.int64)
        a, b = ids
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        # Two sorted lists merged: for each end on one side, how many on the other lie before it.
        before = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[before] == end_a)
        last_b = before[last_a]
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[last_a] = ends_b[last_b] = 1
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        order = np.empty(len(a) + len(b), np.int64)
        behind = np.concatenate([[0], last_b + 1])  # B tokens before each group
        order[np.arange(len(a)) + behind[group_a]] = a + ends_a * len(self.bytes_a)
        order[np.arange(len(b)) + last_a[group_b] + 1] = b + ends_b * len(self.bytes_b) + 2 * len(self.bytes_a)
        told = b"".join(map(self.said.__getitem__, order.tolist()))
        return len(a), len(b), len(last_a), hashlib.sha256(told[:-1]).hexdigest(), a[last_a] << 32 | b[last_b]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    key = (bytes_path, pieces_path)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _blocks(bytes_path: str, pieces_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = aligner(bytes_path, pieces_path), TaskContext.get().partitionId() << 32, 0
        ids, rows, links, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            keys = pa.concat_arrays(ids)
            pairs, places = np.unique(np.concatenate(links), return_inverse=True)
            n_a, n_b, groups, digests = zip(*rows, strict=True)
            lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in (n_a, n_b, groups, map(len, links))]
            # A document's links are only summed, so their places are kept in order, as differences.
            cuts = np.cumsum([0, *map(len, links)])
            steps = np.concatenate([np.diff(np.sort(places[x:y]), prepend=0) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
            return pa.RecordBatch.from_arrays(
                [pa.array([part + number]), pa.ListArray.from_arrays([0, len(keys)], keys), *lists, pa.array([list(digests)], pa.list_(pa.string())), pa.array([packed(pairs)], pa.binary()), pa.array([packed(steps.astype(np.uint32))], pa.binary())],
                names=["block", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pairs", "places"],
            )

        for batch in batches:
            first = 0
            for i, value in enumerate(batch.column(1)):
                *row, found = own.align(value.as_py())
                if rows and (total + len(found) > LINKS or len(rows) >= DOCUMENTS):
                    ids.append(batch.column(0).slice(first, i - first))
                    yield flush()
                    number, first, ids, rows, links, total = number + 1, i, [], [], [], 0
                rows.append(row)
                links.append(found)
                total += len(found)
            ids.append(batch.column(0).slice(first))
        if rows:
            yield flush()

    return tidy(run)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct pairs and how many of its links hold them."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs = unpacked(row["pairs"], np.int64)
            n = np.bincount(_places(row), minlength=len(pairs))
            cols = [np.full(len(pairs), row["block"]), (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["block", "a", "b", "n"])


def _places(row: dict) -> np.ndarray:
    steps, cuts = unpacked(row["places"], np.uint32).astype(np.int64), np.cumsum([0, *row["n_links"]])
    whole = np.concatenate([[0], np.cumsum(steps)])
    return whole[1:] - np.repeat(whole[cuts[:-1]], row["n_links"])


def _told(block: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links, from the counts of its pairs."""
    row = block.to_pylist()[0]
    pairs = unpacked(row["pairs"], np.int64)
    key = counts["a"].to_numpy().astype(np.int64) << 32 | counts["b"].to_numpy()
    order = np.argsort(key)
    if not np.array_equal(key[order], pairs):
        raise ValueError("the counts of a block's pairs are not whole")
    places, cuts = _places(row), np.cumsum([0, *row["n_links"]])
    out = {"n_best": counts["best"].to_numpy(zero_copy_only=False)[order], "best_a": counts["best_a"].to_numpy(zero_copy_only=False)[order], "count_sum": counts["count"].to_numpy()[order]}
    sums = {}
    for name, values in out.items():
        whole = np.concatenate([[0], np.cumsum(values.astype(np.int64)[places])])
        sums[name] = pa.array(whole[cuts[1:]] - whole[cuts[:-1]])
    cols = {"_id": block["ids"].combine_chunks().flatten(), **{c: pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}, **sums, "groups_sha256": pa.array(row["digests"], pa.string())}
    return pa.table(cols)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count and the highest count of either side's id: from rows a, b, n."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = written(counts, "alignment-counts")
    most_a = counts.groupBy("a").agg(F.max("count").alias("most_a"))
    most_b = counts.groupBy("b").agg(F.max("count").alias("most_b"))
    return counts.join(most_a, "a").join(most_b, "b").select("a", "b", "count", "most_a", "most_b")


def alignment(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bytes_path: str | None = None, pieces_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (id, n_a, n_b, n_groups, n_links, n_best, best_a, count_sum, groups_sha256) and pairs (a, b, count, most_a, most_b).

    A is a byte-level vocabulary of the tokenizers library, which gets a space and the text; B one of sentencepiece, which
    adds that space.  Strings of special tokens in texts are plain text.  A link is a token of A and one of B that end at the same byte;
    n_best counts the links whose pair has the highest count of all with its B id (ties included), best_a those with the highest of
    their A id.  Null and empty texts, and texts that a side does not give back byte by byte, have zeros and an empty digest.  Texts are taken
    whole, however long.  Every row of docs has a row, repeated rows and null ids too, and repeated rows count each; other
    columns are not looked at, whatever their names.  An empty table gives empty results.
    """
    fields = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *T.StructType.fromDDL("n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, pairs binary, places binary").fields])
    run = _blocks(bytes_path or default_vocabulary(), pieces_path or piece_vocabulary())
    blocks = written(bounded(docs).select(id_col, text_col).mapInArrow(run, fields), "alignment-blocks", compression="none")
    pairs = written(blocks.select("block", "pairs", "places", "n_links").mapInArrow(tidy(_pairs), PAIRS), "alignment-pairs")
    counts = written(pair_counts(pairs), "alignment-pair-counts")
    back = pairs.select("block", "a", "b").join(counts, ["a", "b"]).select("block", "a", "b", "count", (F.col("count") == F.col("most_b")).alias("best"), (F.col("count") == F.col("most_a")).alias("best_a"))
    own = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, best_a long, count_sum long, groups_sha256 string").fields])
    told = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lambda x, y: _told(x, y), own)
    return told.withColumnRenamed("_id", id_col), counts


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))[0]
