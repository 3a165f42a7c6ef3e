"""Documents as blocks of word indices, for operators that come back to every word.

A text is cut into words once.  A block is a row: the hashes of its distinct words, and its documents' words as
places among them, a few bits a word when compressed.  What a block tells the corpus it tells once,
however often its own documents say it, so that the most common word, bigram or passage is met by as many entries
as there are blocks, not documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from karst.llm.common import tidy

#: Words and documents at which a block ends; a longer text is a block of its own.
WORDS, DOCUMENTS = 600_000, 1 << 16
FIELDS = "n array<long>, words binary, seq binary"


class Places(dict):
    """The place of each distinct word, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


def packed(x: np.ndarray) -> bytes:
    """An array, compressed; its first eight bytes are its size."""
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(raw: bytes | pa.Scalar, kind: str) -> np.ndarray:
    raw = raw.as_py() if isinstance(raw, pa.Scalar) else raw
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], size, codec="zstd", asbytes=True) if size else b"", dtype=kind)


def _blocks(words_of: Callable, words: int, spots: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        places, ids, n, seq, more = Places(), [], [], [], []
        total = 0

        def flush() -> pa.RecordBatch:
            own = np.fromiter(map(xxhash.xxh3_64_intdigest, places), np.uint64, len(places))
            keys = pa.concat_arrays(ids)
            cols = [pa.array([part + number]), pa.ListArray.from_arrays([0, len(keys)], keys), pa.array([n], pa.list_(pa.int64())), pa.array([own.tobytes()], pa.binary())]
            cols.append(pa.array([packed(np.concatenate(seq) if seq else np.zeros(0, np.uint32))], pa.binary()))
            if spots:
                cols.append(pa.array([packed(np.concatenate(more) if more else np.zeros(0, np.uint32))], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "n", "words", "seq", "spots"][: len(cols)])

        for batch in batches:
            first = 0
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                own = words_of(text)
                if n and (total + len(own) > words or len(n) >= DOCUMENTS):
                    ids.append(batch.column(0).slice(first, i - first))
                    yield flush()
                    number, first, total = number + 1, i, 0
                    places, ids, n, seq, more = Places(), [], [], [], []
                if own:
                    seq.append(np.fromiter(map(places.__getitem__, own), np.uint32, len(own)))
                    if spots:
                        more.append(spots(text, own))
                n.append(len(own))
                total += len(own)
            ids.append(batch.column(0).slice(first))
        if n:
            yield flush()

    return tidy(run)


def blocks_of(docs: DataFrame, id_col: str, text_col: str, words_of: Callable, *, words: int = WORDS, spots: Callable | None = None) -> DataFrame:
    """block, ids, n (words of each document), words (hashes of the distinct ones), seq (places among them), and, if asked, spots: not yet written.

    spots(text, words) gives numbers (uint32) of a document that stand in spots one after the other.
    """
    own = T.StructType.fromDDL(FIELDS + (", spots binary" if spots else "")).fields
    ids = T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType))
    return docs.select(id_col, text_col).mapInArrow(_blocks(words_of, words, spots), T.StructType([T.StructField("block", T.LongType()), ids, *own]))


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte by byte, so that the bytes that nearness makes zero cost nothing."""
    return packed(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def unpacked_keys(raw: bytes | pa.Scalar) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpacked(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def by_shard(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The order of the keys, the shards that occur, and where each begins and ends in that order."""
    order = np.argsort(keys)
    shard = (keys[order] >> np.uint64(64 - bits)).astype(np.int32)
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    return order, shard[at], list(zip(at.tolist(), [*at[1:].tolist(), len(shard)], strict=False))
