"""Operator 9, repeated passages by paragraph MinHash and by winnowed word windows.

Paragraphs (lines) of enough words get MinHash signatures of their five-word shingles, cut into bands
that are tuned for high recall.  Equal paragraphs are one item from the start; different ones that
collide in a band are verified by the exact Jaccard similarity of their shingle sets.  Components of
the links are classes; of each class one paragraph is kept and all others are removed.

Passages do not depend on line breaks: of the windows of GRAM words over a whole text those are taken whose hash is
the least of GAP neighbours, so that two equal runs of at least GRAM + GAP - 1 words share one.  Windows
that occur again are extended word by word on both sides, and what overlaps or almost touches is one passage.

Texts are cut into words once, into blocks (``blocks``).  A block asks the shards of its windows' hashes once
for each window, however often it holds it: first how often the corpus has it, then, of those that it has twice, what
stands around their first places.  So the most common passage has as many entries as there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.llm.blocks import blocks_of, by_shard, packed, packed_keys, unpacked, unpacked_keys
from karst.llm.common import bounded, discard, free_name, table, tidy, tidy_groups, written
from karst.llm.jaccard_join import verified, words_of
from karst.llm.linkage import PACKED, Packer, buckets, close, mix, shard_bits, sketch_of

SHINGLE, PERCENT, MIN_WORDS = 5, 80, 25
#: Rows of a band.  At similarity 0.8, eleven bands of 3 rows miss (1 - 0.8**3)**11 = 0.04 % of pairs.
ROWS, RECALL = 3, 0.9995
#: Words of a window, windows of which one is taken, words between hits that are joined, least words of a passage.
GRAM, GAP, JOINED, PASSAGE = 13, 13, 5, 50
#: Words of a block.
WORDS = 300_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))


def tuned(percent: int, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of so many rows that pairs at the threshold collide with this probability."""
    p, bands = (percent / 100) ** rows, 1
    while 1 - (1 - p) ** bands < recall:
        bands += 1
    return bands


def spots_of(text: str, words: list[bytes]) -> np.ndarray:
    """Three numbers for each word: code points since the end of the word before, code points of the word, line ends since that word."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[raw].astype(np.int8), prepend=1, append=1))  # begins and ends alternate
    line = np.searchsorted(np.flatnonzero(raw == 10), edge[::2])
    if len(raw) != len(text):
        edge = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[edge]
    out = np.empty((len(words), 3), np.uint32)
    out[:, 0] = edge[::2] - np.append(0, edge[1:-1:2])
    out[:, 1] = edge[1::2] - edge[::2]
    out[:, 2] = np.diff(line, prepend=0)
    return out.ravel()


def chained(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` word hashes that begin at each place (those at the end run out of words and mean nothing)."""
    out, have, power, done = h, 0, h, 1
    while True:
        if size & done:
            out = mix(out * _GOLD + np.append(power[have:], power[:have])) if have else power
            have += done
        if have == size:
            return out
        power = mix(power * _GOLD + np.append(power[done:], power[:done]))
        done *= 2


def _sliding(h: np.ndarray, size: int, least: bool) -> np.ndarray:
    """The least of each place and the size - 1 after it, or the greatest of each place and the size - 1 before it."""
    take, fill = (np.minimum, _NONE) if least else (np.maximum, np.uint64(0))
    moved = lambda x, k: np.append(x[k:], np.full(min(k, len(x)), fill)) if least else np.append(np.full(min(k, len(x)), fill), x[: max(0, len(x) - k)])
    have = 1
    while 2 * have <= size:
        h, have = take(h, moved(h, have)), 2 * have
    return take(h, moved(h, size - have)) if have < size else h


class Page:
    """The words of a block: hashes, documents, and where they stand."""

    def __init__(self, row: dict):
        self.n = np.array(row["n"], np.int64)
        self.h = np.frombuffer(row["words"], np.uint64)[unpacked(row["seq"], "<u4")]
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.start = np.cumsum(self.n) - self.n
        self._spots = row["spots"]

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and lines of the words in their documents."""
        gap, length, lines = unpacked(self._spots, "<u4").astype(np.int64).reshape(-1, 3).T
        ends = self._own_sums(gap + length)
        return ends - length, ends, self._own_sums(lines)

    def _own_sums(self, x: np.ndarray) -> np.ndarray:
        before = np.append(0, np.cumsum(x))
        return before[1:] - before[self.start][self.doc]

    def paragraphs(self, min_words: int) -> tuple[np.ndarray, ...]:
        """document, line, first word, number of words and item of the lines with at least min_words words, and the starts and ends of all words."""
        start, end, line = self.places()
        first = np.flatnonzero((np.diff(self.doc, prepend=-1) != 0) | (np.diff(line, prepend=-1) != 0))
        n = np.diff(np.append(first, len(line)))
        first, n = first[n >= min_words], n[n >= min_words]
        item = [xxhash.xxh3_64_intdigest(self.h[a : a + k].tobytes()) & 0xFFFFFFFFFFFFFFFE for a, k in zip(first.tolist(), n.tolist(), strict=True)]
        return self.doc[first], line[first], first, n, np.array(item, np.uint64), start, end

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the taken windows: those that are the least of GAP neighbours, all of their own document."""
        if len(self.h) < GRAM + GAP - 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = chained(self.h, GRAM)
        inside = np.zeros(len(h), bool)
        inside[: len(h) - GRAM + 1] = self.doc[GRAM - 1 :] == self.doc[: len(h) - GRAM + 1]
        h[~inside] = _NONE
        least, reach = _sliding(h, GAP, True), GRAM + GAP - 2
        least[max(0, len(h) - reach) :] = 0
        least[: len(h) - reach][self.doc[reach:] != self.doc[: len(h) - reach]] = 0
        at = np.flatnonzero((_sliding(least, GAP, False) == h) & inside)
        return at, h[at]

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """16-bit hashes of the GAP - 1 words before windows (nearest first) and of those after; 0: no word."""
        low, steps = np.append(np.maximum(self.h & np.uint64(0xFFFF), np.uint64(1)).astype("<u2"), np.uint16(0)), np.arange(GAP - 1)
        doc = np.append(self.doc, -1)
        out = []
        for spot in (at[:, None] - 1 - steps, at[:, None] + GRAM + steps):
            spot = np.clip(spot, -1, len(self.h))
            out.append(np.where(doc[spot] == self.doc[at][:, None], low[spot], np.uint16(0)).astype("<u2"))
        return out[0], out[1]


def _locate(min_words: int):
    names = ["block", "at", "_id", "paragraph", "start", "end", "n_words", "item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.select(["block", "n", "words", "seq", "spots"]).to_pylist()):
                doc, line, first, n, item, start, end = Page(row).paragraphs(min_words)
                ids = batch.column("ids").slice(k, 1).flatten()
                cols = [np.full(len(doc), row["block"]), doc, ids.take(pa.array(doc)), line, start[first] if len(first) else first, end[first + n - 1] if len(first) else first, n, item.view(np.int64)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return tidy(run)


def _signatures(size: int, min_words: int, bands: int, rows: int, bits: int):
    rng = np.random.default_rng(20240101)
    a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    tags = mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(bits)
        for batch in batches:
            for row in batch.to_pylist():
                page = Page(row)
                _, _, first, n, item, _, _ = page.paragraphs(min_words)
                own = np.sort(np.unique(item, return_index=True)[1])
                item, first, n = item[own], first[own], n[own]
                if not len(item):
                    continue
                s = np.append((chained(page.h, size) >> np.uint64(32)).astype(np.uint32), np.uint32(0))
                cuts = np.stack([first, first + n - size + 1], axis=1).ravel()
                out = np.repeat(tags[None], len(item), axis=0)
                for r in range(rows):
                    least = np.stack([np.minimum.reduceat(s * a[k] + b[k], cuts)[::2] for k in range(r, bands * rows, rows)], axis=1)
                    out = mix(out * _GOLD + least)
                packer.add_all(out, item)
                if packer.full():
                    yield packer.flush()
        yield packer.flush()

    return tidy(run)


def _sets(size: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                page, rows = Page(row), []
                _, _, first, n, item, _, _ = page.paragraphs(min_words)
                grams = chained(page.h, size)
                item = item.view(np.int64)
                wanted, own = np.unique(item, return_index=True)
                for k in own[np.isin(wanted, row["items"])].tolist():
                    s = np.unique(grams[first[k] : first[k] + n[k] - size + 1])
                    rows.append((int(item[k]), len(s), sketch_of(s), s.tobytes()))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["item", "n", "sketch", "s"])

    return tidy(run)


_OWN = ["block", "n", "words", "seq", "spots"]


def pages_of(docs: DataFrame, id_col: str, text_col: str, block_words: int = WORDS) -> DataFrame:
    """The blocks of docs, written."""
    return written(blocks_of(bounded(docs), id_col, text_col, words_of, words=block_words, spots=spots_of), "passage-blocks", compression="none")


def _paragraphs(blocks: DataFrame, id_col: str, size: int, percent: int, min_words: int) -> DataFrame:
    if min_words < size:
        raise ValueError("a paragraph has at least the words of a shingle")
    own = T.StructField("_id", blocks.schema["ids"].dataType.elementType)
    fields = T.StructType.fromDDL("paragraph long, start long, end long, n_words long, item long").fields
    places = written(blocks.mapInArrow(_locate(min_words), T.StructType([*T.StructType.fromDDL("block long, at long").fields, own, *fields])), "paragraph-places")
    bits, bands = shard_bits(blocks), tuned(percent)
    found = buckets(blocks.select(_OWN).mapInArrow(_signatures(size, min_words, bands, ROWS, bits), PACKED), "paragraph-buckets")

    inside = found.select(F.explode("small").alias("item")).distinct()
    # A block's items are at most its paragraphs.
    chosen = places.groupBy("item").agg(F.min("block").alias("block")).join(inside, "item", "left_semi").groupBy("block").agg(F.collect_list("item").alias("items"))
    sets = written(blocks.select(_OWN).join(chosen, "block").mapInArrow(_sets(size, min_words), "item long, n long, sketch binary, s binary"), "paragraph-sets")
    parts = close(found, lambda edges: verified(edges, sets, percent), sets.select("item", "n", "sketch"), percent, "paragraph")
    discard(found)
    discard(sets)

    # Items in classes: those that occur twice, and those that link with others.
    place = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "paragraph", "block", "at")
    counts = places.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least"))
    counts = counts.join(parts, "item", "left").withColumn("class_id", F.coalesce("component", "item"))
    classes = counts.groupBy("class_id").agg(F.sum("n").alias("n_in_class"), F.min("least").alias("least")).where("n_in_class > 1")
    told = written(counts.where("n > 1 OR component IS NOT NULL").select("item", "class_id").join(classes, "class_id"), "paragraph-classes", free=True)
    out = places.join(told, "item")
    kept = (F.col("block") == F.col("least.block")) & (F.col("at") == F.col("least.at")) & (F.col("paragraph") == F.col("least.paragraph"))
    return out.select(F.col("_id").alias(id_col), "paragraph", "start", "end", "n_words", "class_id", F.col("least._id").alias(f"kept_{id_col}"), F.col("least.paragraph").alias("kept_paragraph"), "n_in_class", (~kept).alias("removed"))


def repeated_paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, min_words: int = MIN_WORDS, block_words: int = WORDS) -> DataFrame:
    """One row per paragraph that repeats: id, paragraph, start, end, n_words, class_id, kept_<id>, kept_paragraph, n_in_class, removed.

    A class is a component of paragraphs of which ones link whose sets of ``size``-word shingles have
    a Jaccard similarity of at least percent / 100, within a document or across; the paragraph with
    the smallest (id, index) is kept.  A paragraph stretches from a line's first word to its last.  Paragraphs of fewer
    than min_words words are left alone, as are null and empty texts.  Repeated rows, and other rows of one id, hold paragraphs of
    their own, of which one is kept; null ids come last.  An empty table gives an empty result.
    """
    return _paragraphs(pages_of(docs, id_col, text_col, block_words), id_col, size, percent, min_words)


_ASKED = "shard int, block long, keys binary, n binary"
_KNOWN = "block long, shard int, at binary, n binary"


def _asked(bits: int):
    """The distinct taken windows of a block, with how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = np.unique(Page(row).windows()[1], return_counts=True)
                _, shards, cuts = by_shard(keys, bits)
                cols = [shards, np.full(len(cuts), row["block"]), [packed_keys(keys[i:j]) for i, j in cuts], [packed(n[i:j].astype("<u4")) for i, j in cuts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "keys", "n"])

    return tidy(run)


def _answers(table: pa.Table, names: list[str], owner: np.ndarray, cols: list[np.ndarray]) -> pa.Table:
    """A row for each block with its part of cols; owner: the row of table, in order, that each entry is of."""
    cuts = np.searchsorted(owner, np.arange(table.num_rows + 1)).tolist()
    own = [(k, i, j) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
    blocks, shards = table.column("block").to_pylist(), table.column("shard").to_pylist()
    made = [pa.array([packed(c[i:j]) for _, i, j in own], pa.binary()) for c in cols]
    return pa.table([pa.array([blocks[k] for k, _, _ in own], pa.int64()), pa.array([shards[k] for k, _, _ in own], pa.int32()), *made], names=["block", "shard", *names])


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a shard's rows one after the other, the row of each, and its place in that row."""
    parts = [unpacked_keys(x) for x in table.column("keys")]
    size = np.array([len(x) for x in parts])
    keys = np.concatenate(parts)
    return keys, np.repeat(np.arange(len(parts)), size), np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)


def _known(table: pa.Table) -> pa.Table:
    """For each block those of its windows of a shard that the corpus has twice or more, and how often."""
    keys, owner, at = _entries(table)
    n = np.concatenate([unpacked(x, "<u4") for x in table.column("n")]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    total = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(keys))))
    order, total = order[total > 1], total[total > 1]
    place = np.argsort(order)
    order, total = order[place], total[place]
    return _answers(table, ["at", "n"], owner[order], [at[order].astype("<u4"), total])


class Hits:
    """The taken windows of a block that the corpus repeats: places, the least one of each window first, and what the shards tell of them.

    rows: shard, at (places in the block's list of that shard), and further columns, of which ``told`` gives one.
    """

    def __init__(self, page: Page, ranks: list[int], rows: list[dict], bits: int):
        at, key = page.windows()
        keys = np.unique(key)
        _, shards, cuts = by_shard(keys, bits)
        begins = dict(zip(shards.tolist(), (i for i, _ in cuts), strict=True))
        self.rows = sorted(rows, key=lambda x: begins[x["shard"]])
        spot = [unpacked(x["at"], "<u4").astype(np.int64) for x in self.rows]
        self.keys = keys[np.concatenate([np.zeros(0, np.int64), *(s + begins[x["shard"]] for s, x in zip(spot, self.rows, strict=True))])]
        self.cuts = np.cumsum([0, *map(len, spot)]).tolist()
        which = np.searchsorted(self.keys, key)
        inside = np.flatnonzero(which < len(self.keys))
        inside = inside[self.keys[which[inside]] == key[inside]]
        at, which = at[inside], which[inside]
        rank = np.array(ranks, np.int64)[page.doc[at]]
        order = np.lexsort((at, rank, which))
        self.at, self.which, self.rank = at[order], which[order], rank[order]
        self.head = np.flatnonzero(np.diff(self.which, prepend=-1))

    def told(self, name: str, kind: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(unpacked(x[name], kind) for x in self.rows)])


_TOLD = "shard int, block long, keys binary, at binary, n binary, rank binary, before binary, after binary"
_FIRST = "block long, shard int, at binary, n binary, least binary, before1 binary, after1 binary, before2 binary, after2 binary"


def _told(bits: int):
    """The repeated windows of a block with the rank and the surroundings of the least place that it has of each."""

    def run(blocks: pa.Table, known: pa.Table) -> pa.Table:
        row = blocks.select([*_OWN, "ranks"]).to_pylist()[0]
        page = Page(row)
        hits = Hits(page, row["ranks"], known.select(["shard", "at", "n"]).to_pylist(), bits)
        cuts = list(zip(hits.cuts, hits.cuts[1:], strict=False))
        least = hits.at[hits.head]
        cols = [[x[c] for x in hits.rows] for c in ("shard", "at", "n")]
        made = [[f(x[i:j]) for i, j in cuts] for x, f in ((hits.keys, packed_keys), (hits.rank[hits.head], packed), *((x, packed) for x in page.around(least)))]
        cols = [cols[0], [row["block"]] * len(cuts), made[0], *cols[1:], *made[1:]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), *[pa.binary()] * 6), strict=True)], names=[x.split(" ")[0] for x in _TOLD.split(", ")])

    return run


def _firsts(table: pa.Table) -> pa.Table:
    """For each block and window of a shard: the rank of the least place of all, and the surroundings of the first two places in other blocks (0: none)."""
    keys, owner, _ = _entries(table)
    rank = np.concatenate([unpacked(x, "<i8") for x in table.column("rank")])
    sides = [np.concatenate([unpacked(x, "<u2") for x in table.column(c)]).reshape(-1, GAP - 1) for c in ("before", "after")]
    order = np.lexsort((rank, keys))
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    count = np.diff(np.append(first, len(keys)))
    turn = np.arange(len(keys)) - np.repeat(first, count)
    begin, count = np.repeat(first, count), np.repeat(count, count)
    least, others = np.empty(len(keys), np.int64), []
    least[order] = rank[order[begin]]
    for turn_of in (np.where(turn > 0, 0, 1), np.where(turn > 1, 1, 2)):
        place = order[np.minimum(begin + turn_of, len(keys) - 1)]
        for x in sides:
            out = np.empty_like(x)
            out[order] = np.where((turn_of < count)[:, None], x[place], np.uint16(0))
            others.append(out)
    names = ["least", "before1", "after1", "before2", "after2"]
    out = _answers(table, names, owner, [least, *others])
    # Each row of the table has entries and so a row here, in the same order.
    return pa.table([out.column("block"), out.column("shard"), table.column("at"), table.column("n"), *(out.column(c) for c in names)], names=["block", "shard", "at", "n", *names])


def _along(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logical_and.accumulate((x == y) & (x != 0), axis=1).sum(axis=1)


def _labels(n: int, a: np.ndarray, b: np.ndarray, gone_a: np.ndarray, gone_b: np.ndarray) -> np.ndarray:
    """For each word of a block 1 if it goes and 0 if it stays: it goes where it equals an earlier place's, and words between hits go along with the word before."""

    def covered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(x, minlength=n + 1) - np.bincount(y, minlength=n + 1))[:n] > 0

    out = np.where(covered(gone_a, gone_b), 1, np.where(covered(a, b), 0, -1))
    return out[np.maximum.accumulate(np.where(out >= 0, np.arange(n), 0))] if n else out


def _pieces(label: np.ndarray, a: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, begin and end of the stretches of words of one label in the passages a..to."""
    size = to - a
    passage = np.repeat(np.arange(len(a)), size)
    word = np.arange(len(passage)) + np.repeat(a - (np.cumsum(size) - size), size)
    new = np.flatnonzero((np.diff(passage, prepend=-1) != 0) | (np.diff(label[word], prepend=-1) != 0))
    return passage[new], word[new], word[np.append(new[1:], len(word)) - 1] + 1 if len(new) else new


def _nearest(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """How far each surroundings goes along with any other of its group: in sorted order its neighbours go along furthest."""
    words = np.ascontiguousarray(side.astype(">u2")).view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    x, same = side[order], group[order][1:] == group[order][:-1]
    along = np.where(same, _along(x[1:], x[:-1]), 0)
    out = np.empty(len(group), np.int64)
    out[order] = np.maximum(np.append(along, 0), np.append(0, along))
    return out


_PASSAGES = "start long, end long, n_words long, class_id long, first long, n_in_class long, removed boolean"


def _found(bits: int, least: int):
    """Hits extended and joined: id and passages."""
    names = [x.split(" ")[0] for x in _PASSAGES.split(", ")]

    def run(blocks: pa.Table, firsts: pa.Table) -> pa.Table:
        row = blocks.select([*_OWN, "ranks"]).to_pylist()[0]
        page, ids = Page(row), blocks.column("ids").combine_chunks().flatten()
        hits = Hits(page, row["ranks"], firsts.to_pylist(), bits)
        k, n = len(hits.at), hits.told("n", "<i8")
        rank1 = hits.told("least", "<i8")
        around = [[hits.told(f"{side}{which}", "<u2").reshape(-1, GAP - 1) for side in ("before", "after")] for which in (1, 2)]
        head = np.zeros(k, bool)
        head[hits.head] = True
        own = page.around(hits.at)
        is_first = head & (hits.rank == rank1[hits.which])
        local = np.repeat(hits.head, np.diff(np.append(hits.head, k)))
        here = is_first[local]  # whether the least place of all is in this block
        ext, gone = [], []
        for side in (0, 1):
            mine = own[side]
            one, two = (_along(mine, x[side][hits.which]) for x in around)
            ext.append(np.maximum(np.maximum(one, two), _nearest(hits.which, mine)) if k else one)
            # Only what the least place has goes, so that by and by every word that goes is found in a place where it stays.
            gone.append(np.where(here, _along(mine, mine[local]), one)[~is_first])
        a, b, doc = hits.at - ext[0], hits.at + GRAM + ext[1], page.doc[hits.at]
        later = hits.at[~is_first]
        label = _labels(len(page.h), a, b, later - gone[0], later + GRAM + gone[1])
        order = np.lexsort((b, a, doc))
        a, b, doc, which = a[order], b[order], doc[order], hits.which[order]
        lift = doc * (len(page.h) + JOINED + 2)  # so that one running maximum serves all documents
        reach = np.maximum.accumulate(b + lift) if k else b
        new = np.ones(k, bool)
        new[1:] = a[1:] + lift[1:] > reach[:-1] + JOINED
        at = np.flatnonzero(new)
        to = reach[np.append(at[1:], k) - 1] - lift[at] if k else at
        most = np.maximum.reduceat(n[which], at) if k else at
        first = np.minimum.reduceat(rank1[which], at) if k else at
        keep = np.flatnonzero(to - a[at] >= least)
        a, to = a[at][keep], to[keep]
        passage, begin, stop = _pieces(label, a, to)
        short = (label[begin] == 1) & (stop - begin < GRAM) if len(begin) else np.zeros(0, bool)
        for i, j in zip(begin[short].tolist(), stop[short].tolist(), strict=True):
            label[i:j] = 0
        passage, begin, stop = _pieces(label, a, to)
        spot = at[keep][passage]
        start, end, _ = page.places()
        cols = [start[begin], end[stop - 1], stop - begin, hits.keys[which[spot]].view(np.int64), first[keep][passage], most[keep][passage], label[begin] == 1]
        return pa.table([ids.take(pa.array(doc[spot])), *(pa.array(c) for c in cols)], names=["_id", *names])

    return run


def _passages(blocks: DataFrame, id_col: str, least: int) -> DataFrame:
    if least < GRAM + GAP - 1:
        raise ValueError(f"runs of fewer than {GRAM + GAP - 1} words need not hold a taken window")
    bits, own = shard_bits(blocks) - 1, T.StructField("_id", blocks.schema["ids"].dataType.elementType)
    # Documents by rank: in the order of their ids, null ones last, rows of one id as they stand in the written blocks.
    ids = blocks.select("block", F.posexplode("ids").alias("pos", "_id")).orderBy(F.col("_id").asc_nulls_last(), "block", "pos")
    ids = written(ids.withColumn("rank", F.monotonically_increasing_id()), "passage-ranks", free=True)
    ranks = ids.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("r")).select("block", F.col("r.rank").alias("ranks"))
    ranked = blocks.join(ranks, "block")

    asked = blocks.select(_OWN).mapInArrow(_asked(bits), _ASKED)
    known = written(asked.groupBy("shard").applyInArrow(tidy_groups(_known), _KNOWN), "passage-known", free=True, compression="none")
    told = ranked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(tidy_groups(_told(bits)), _TOLD)
    firsts = written(told.groupBy("shard").applyInArrow(tidy_groups(_firsts), _FIRST), "passage-firsts", free=True, compression="none")
    discard(known)
    found = ranked.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(tidy_groups(_found(bits, least)), T.StructType([own, *T.StructType.fromDDL(_PASSAGES).fields]))
    found = written(found, "passages", free=True)
    discard(firsts)
    used = ids.join(found.select(F.col("first").alias("rank")).distinct(), "rank", "left_semi").select(F.col("rank").alias("first"), F.col("_id").alias(f"kept_{id_col}"))
    none = F.lit(None).cast("long")
    return found.join(used, "first", "left").select(F.col("_id").alias(id_col), none.alias("paragraph"), "start", "end", "n_words", "class_id", f"kept_{id_col}", none.alias("kept_paragraph"), "n_in_class", "removed")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = PASSAGE, block_words: int = WORDS) -> DataFrame:
    """One row per passage of at least ``least`` words that repeats, wherever lines begin and end: columns as of ``repeated_paragraphs``, paragraphs null.

    Equal runs of at least GRAM + GAP - 1 = 25 words are found, within a document or across: windows that repeat, extended as
    far as the words equal those around any place of the window in the same block of texts, or around its first places in the first
    two other blocks; runs with at most JOINED words between them are one passage.  Words that
    a window's first place (smallest id, null ids last; then the earliest) has too are removed elsewhere, the others kept; a passage of both kinds gives a
    row for each stretch, and no stretch of fewer than GRAM words is removed from between kept ones.  kept_<id> is the least of the
    ids where the passage's windows stand first.  n_in_class is the most places that a window of the passage has; class_id tells its
    first taken window.  Equal windows are known by 64-bit hashes, the words that extend them by 16-bit ones.  Null and
    empty texts have no passages; rows of one id are told apart; an empty table gives an empty result.
    """
    return _passages(pages_of(docs, id_col, text_col, block_words), id_col, least)


def _cut(names: list[str], text_col: str):
    at = names.index(text_col)

    def cut(text: str, spans: list[dict]) -> str:
        out, to = [], 0
        for s in spans:
            out.append(text[to : s["start"]])
            to = max(to, s["end"])
        return "".join([*out, text[to:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(batch.columns[: len(names)])
            spans = batch.column(len(names)).to_pylist()
            if any(spans):
                own[at] = pa.array([cut(t, s) if s else t for t, s in zip(own[at].to_pylist(), spans, strict=True)], own[at].type)
            yield pa.RecordBatch.from_arrays(own, names=names)

    return tidy(run)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the removed paragraphs and passages; line ends and other texts are unchanged, as are all other columns.

    Every row is cleaned by what was found in it: rows are written with a key of their own, so repeated ids don't mix.
    """
    key, names = free_name(docs.columns, "_key"), docs.columns
    keyed = docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")))
    keyed = written(keyed, "keyed-documents")
    blocks = pages_of(keyed, key, text_col)
    gone = _paragraphs(blocks, key, **({"size": SHINGLE, "percent": PERCENT, "min_words": MIN_WORDS} | options)).unionByName(_passages(blocks, key, PASSAGE))
    gone = gone.where("removed").groupBy(F.col(f"{key}.row").alias("_of")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    told = keyed.join(gone, F.col(f"{key}.row") == F.col("_of"), "left").select(*[keyed[c] for c in names], gone["_spans"])
    return told.mapInArrow(_cut(names, text_col), docs.schema)


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = pages_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    return _paragraphs(blocks, "doc_id", SHINGLE, PERCENT, MIN_WORDS).unionByName(_passages(blocks, "doc_id", PASSAGE))
