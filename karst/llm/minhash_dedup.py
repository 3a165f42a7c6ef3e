"""Operator 12, near duplicates by one-permutation MinHash.

One hash of every shingle is the only permutation: its upper bits choose one of BINS bins, and the least hash
of each bin is the signature.  Empty bins are densified optimally: each bin has a random order of all bins, the
same for every document, and an empty bin takes the value of the first one in its order that is not empty.
Bands of the signature are bucket keys.  A bucket gives a star: its items are compared with its smallest item
only, so that candidate edges are as many as items.  Where a star leaves a bucket in several components,
what its members' sketches do not exclude across components is compared too (``linkage.close``), so no link
between colliding items is lost, and no pairs are listed within a component.  Links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import table
from karst.llm.jaccard_join import jaccard_components, keep_one
from karst.llm.jaccard_sql import jaccard_sql
from karst.llm.linkage import mix

SHINGLE, PERCENT = 3, 85
#: Bands and the bins of each: of pairs at the threshold one in two million shares no band.
BANDS, ROWS = 25, 5
BINS = BANDS * ROWS
_GOLD, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD)


@lru_cache(maxsize=1)
def _orders() -> np.ndarray:
    """For each bin the rank of every bin in its order: row i is a permutation."""
    at = np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS)
    return np.argsort(np.argsort(mix(mix(at + np.uint64(1)) ^ _GOLD), axis=1), axis=1)


def signature(s: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a sorted, non-empty set of hashes.

    The bin is a monotone function of the hash, so the first of each bin's run is its least.
    """
    bins = (((s >> _HALF) * np.uint64(BINS)) >> _HALF).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    full = bins[first]
    out = np.zeros(BINS, np.uint64)
    out[full] = s[first]
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        out[empty] = out[full[np.argmin(_orders()[np.ix_(empty, full)], axis=1)]]
    return out


def band_keys(s: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(side, keys): one key a band.  Sets so small that only equal ones link have none; equal sets are one item."""
    if len(s) * 100 < percent * (len(s) + 1):
        return
    rows = signature(s).reshape(BANDS, ROWS)
    key = _BAND.copy()
    for j in range(ROWS):
        key = mix(key * _GOLD + rows[:, j])
    yield 0, key


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id, kept of every row.

    component_id is the smallest id reachable by links (100 * |A and B| >= percent * |A or B| over distinct ``size``-word
    shingles, confirmed on full sets), itself included; kept is whether it is the row's own id.  A text of fewer words is
    one shingle; null texts and texts without words have empty sets, link with nothing and are kept.  Repeated rows
    link; rows that share an id are kept or not together (``keep_one`` tells them apart).  Null ids are ignored
    by the minimum; a component without other ids has a null component_id, and its rows count as kept.  Texts are taken whole,
    however long; other columns are not looked at, whatever their names.  An empty table gives an empty result.
    """
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, size=size, percent=percent, keys=band_keys)
    return found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, **options) -> DataFrame:
    """docs with one row of each component, chosen as ``keep_one`` does."""
    return keep_one(docs, size=size, percent=percent, keys=band_keys, **options)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({jaccard_sql(SHINGLE, PERCENT)})"
