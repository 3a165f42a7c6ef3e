"""Operator 4, mixture-controlled packing.

Every source is a queue of tokens.  A deficit round-robin fills each window (a fixed number of
sequences) with every queue's share of the target mixture; what a share lacks to whole tokens is
its deficit and goes on to the next window.  A queue's cumulative quota after w windows is
therefore a monotone function Q(w), and the round-robin has a closed form: a token's place
follows from its place in its queue and the quotas of the other queues.  So partitions never wait
for each other: they need only how many tokens of each source precede them.

Documents are tokenised once, into a written table; a small table of tokens by (partition,
source) gives the queue offsets.  Tokens are never shuffled while that table fits a broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from karst.llm.common import bounded, shared_dir, table, tidy, written
from karst.llm.tokens import default_vocabulary, encoder

class Schedule:
    """Cumulative quotas of the queues.

    In phase k, from starts[k] windows on, the queues that are not dry share the windows by weight; a phase ends where a queue runs
    dry, and its share goes to the others.  Queues are kept in the order in which they run dry, so a phase is a
    suffix of that order with one factor: what a queue has given is its weight times a clock that all queues share.
    Storage is a few numbers a queue, however many there are.
    """

    def __init__(self, totals: list[int], shares: list[float], window_tokens: int):
        n = len(totals)
        self.totals = np.array(totals, dtype=np.int64)
        share = np.maximum(np.array(shares, dtype=float), 0).reshape(n)
        # Queues without a share come last, by their own sizes: a second round with a clock of its own.
        self.late = share <= 0
        self.weight = np.where(self.late, self.totals.astype(float), share)
        # The clock at which a queue runs dry; the clock moves faster the less weight is left.
        self.dry = np.divide(self.totals.astype(float), self.weight, out=np.zeros(n), where=self.weight > 0)
        self.rounds, at = [], 0.0
        for late in (False, True):
            own = np.flatnonzero((self.late == late) & (self.totals > 0))
            own = own[np.argsort(self.dry[own], kind="stable")]
            dry, left = self.dry[own], np.cumsum(self.weight[own][::-1])[::-1]
            # Windows that the clock takes from one queue's end to the next one's.
            spans = np.diff(dry, prepend=0.0) * left / window_tokens
            ends = at + np.cumsum(spans)
            self.rounds.append((at, np.append(at, ends), np.append(0.0, dry)))
            at = float(ends[-1]) if len(own) else at
        self.middle = self.rounds[1][0]
        self.windows = int(np.ceil(at - 1e-9))
        self._rank()

    def _rank(self) -> None:
        """The order of the queues within a window: by class of equal weight, and then by size, which is the order of running dry.

        In a class, the queues that are dry are its first ones and all others have given the same, so what its first ones
        have given is a prefix sum and a product.  Classes of one size have a vector of their own, one entry a class.
        """
        n, self._last = len(self.totals), {}
        order = np.lexsort((self.totals, self.weight, self.late))
        weight, late, total = self.weight[order], self.late[order], self.totals[order]
        starts = np.flatnonzero(np.append([True] * min(n, 1), (np.diff(weight) != 0) | (late[1:] != late[:-1])))
        sizes = np.diff(np.append(starts, n))
        mixed = total[starts] != total[starts + sizes - 1]
        order = order[np.argsort(np.repeat(~mixed, sizes), kind="stable")]
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.arange(n)
        self.by_rank, self.dry_by_rank = self.totals[order], self.dry[order]
        self.sums = np.append(0, np.cumsum(self.by_rank))
        sizes = np.append(sizes[mixed], sizes[~mixed]).astype(np.int64)
        ends, k = np.cumsum(sizes), int(mixed.sum())
        self.mixed = [(int(e - s), int(e), float(self.weight[order[e - s]]), int(self.late[order[e - s]])) for s, e in zip(sizes[:k], ends[:k], strict=True)]
        self.even, self.even_sizes = (ends - sizes)[k:], sizes[k:]
        self.even_queues = order[self.even]

    def given_before(self, rank: int, w: int) -> int:
        """Tokens that the queues of lower rank have given after w windows; its cost is that of the classes, not of the queues."""
        if w <= 0:
            return 0
        if w >= self.windows:
            return int(self.sums[rank])
        clocks, out = self.clocks(w), 0
        for start, end, weight, late in self.mixed:
            if start >= rank:
                return out
            clock, n = clocks[late], min(rank, end) - start
            each = int(np.floor(weight * clock + 1e-6))
            dry = max(np.searchsorted(self.by_rank[start:end], each, "right"), np.searchsorted(self.dry_by_rank[start:end], clock, "right"))
            dry = min(int(dry), n)
            out += int(self.sums[start + dry] - self.sums[start]) + each * (n - dry)
        k = int(np.searchsorted(self.even, rank))
        if k:
            out += int((self._given(clocks, self.even_queues[:k]) * np.minimum(self.even_sizes[:k], rank - self.even[:k])).sum())
        return out

    def clocks(self, w: float) -> tuple[float, float]:
        """Both rounds' clocks after w windows."""
        return tuple(float(np.interp(w, ends, dry)) for _, ends, dry in self.rounds)

    def _given(self, clocks: tuple[float, float], queue: int | slice | np.ndarray) -> np.ndarray:
        clock = np.where(self.late[queue], clocks[1], clocks[0])
        # A queue that has run dry has given all, whatever a product of floats says.
        given = np.floor(self.weight[queue] * clock + 1e-6).astype(np.int64)
        return np.where(clock >= self.dry[queue], self.totals[queue], np.minimum(given, self.totals[queue]))

    def quota(self, w: int) -> np.ndarray:
        """Tokens that each queue has given after w windows: whole, monotone in w, at last all."""
        if w <= 0:
            return np.zeros(len(self.totals), dtype=np.int64)
        if w >= self.windows:
            return self.totals
        return self._given(self.clocks(w), slice(None))

    def _quota_of(self, queue: int, w: int) -> int:
        if w <= 0:
            return 0
        return int(self.totals[queue]) if w >= self.windows else int(self._given(self.clocks(w), queue))

    def window_of(self, queue: int, x: int) -> int:
        """The window w with quota(w) <= x < quota(w + 1) in the queue, by bisection around where its clock puts it."""
        lo, hi = 0, self.windows
        _, ends, dry = self.rounds[int(self.late[queue])]
        near = int(np.interp(x / self.weight[queue], dry, ends)) if self.weight[queue] > 0 else 0
        if near > 1 and self._quota_of(queue, near - 1) <= x:
            lo = near - 1
        if near + 2 < hi and self._quota_of(queue, near + 2) > x:
            hi = near + 2
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if self._quota_of(queue, mid) <= x:
                lo = mid
            else:
                hi = mid
        return lo

    def places(self, queue: int, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(from, to, place of from) for the stretches of tokens start..end of the queue, one a window."""
        w, own, own_then, shift = self._last.get(queue, (0, 0, 0, 0))
        if not own <= start < own_then:
            w, own, own_then, shift = self._window(queue, self.window_of(queue, start))
        while start < end:
            to = min(end, own_then)
            if to > start:
                yield start, to, shift + start
                start = to
            if start < end:
                w, own, own_then, shift = self._window(queue, w + 1)

    def _window(self, queue: int, w: int) -> tuple[int, int, int, int]:
        """w, what the queue has given before and after it, and what its tokens' places lie beyond their numbers; kept, as the next document mostly lies there too."""
        rank, n = int(self.rank[queue]), len(self.totals)
        own, own_then = self._quota_of(queue, w), self._quota_of(queue, w + 1)
        shift = 0
        if own_then > own:
            shift = self.given_before(rank, w + 1) + self.given_before(n, w) - self.given_before(rank, w) - own
        self._last[queue] = (w, own, own_then, shift)
        return self._last[queue]


#: The mixture in which every source has the same share.
EQUAL = "equal"
#: Partitions of which one task adds up a queue's tokens.
RANGE = 4096


def _tokenise(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        so_far: dict[str | None, int] = {}
        for batch in batches:
            ids, starts, lengths = [], [], []
            for text, source in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = np.append(enc.ids(text.as_py()), enc.dtype.type(end_id))
                ids.append(x.astype(enc.dtype).tobytes())
                starts.append(so_far.get(source, 0))
                lengths.append(len(x))
                so_far[source] = starts[-1] + len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([enc.dtype.itemsize] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                names=["_id", "source", "_part", "_at", "doc_tokens", "_width", "_ids"],
            )

    return tidy(run)


_PIECE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def _pieces(schedule, sequence_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Schedule = schedule.value
        for batch in batches:
            rows, index = [], []
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i, (queue, at, n, width, source) in enumerate(zip(*(col[c].to_pylist() for c in ("_queue", "_start", "doc_tokens", "_width", "source")), strict=True)):
                ids = np.frombuffer(col["_ids"][i].as_buffer(), dtype=f"<u{width}").astype("<u4")
                for a, b, place in plan.places(queue, at, at + n):
                    while a < b:
                        take = min(b - a, sequence_tokens - place % sequence_tokens)
                        raw = ids[a - at : a - at + take].tobytes()
                        rows.append((a - at, take, zlib.crc32(raw), n, place // sequence_tokens, place % sequence_tokens, source, raw if with_ids else None))
                        index.append(i)
                        a, place = a + take, place + take
            cols = list(zip(*rows, strict=True)) or [[]] * len(_PIECE)
            yield pa.RecordBatch.from_arrays(
                [col["_id"].take(pa.array(index, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 6 + [pa.string(), pa.binary()], strict=True))],
                names=["_id", *_PIECE.names],
            )

    return tidy(run)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    mixture: dict[str, float] | str | None = None,
    sequence_tokens: int = 1024,
    window_sequences: int = 32,
    end_id: int = 0,
    vocabulary: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids (uint32, little-endian).

    mixture: target shares by source (sources that it lacks are served last, by their sizes); "equal": every source the same;
    None: the corpus's own token shares, under which all queues run dry together.  Every source has a queue of its own.  When a
    queue runs dry the others take over its share in proportion.  Only the last sequence of all is padded.  Placing a stretch
    costs as much as there are distinct shares (and distinct sizes of queues without one, or under None), however many queues.

    Null texts are empty: one piece with the end id.  A null source is a queue of its own.
    Repeated rows are packed each.  An empty table gives no pieces.  The sequences depend on how the
    input splits into partitions, but are fixed once the token table is written.  Very long texts are cut like others.
    Extra columns, whatever their names, are not looked at.
    """
    spark = bounded(docs).sparkSession
    own = T.StructField("_id", docs.schema[id_col].dataType)
    fields = [own, *T.StructType.fromDDL("source string, _part int, _at long, doc_tokens long, _width int, _ids binary").fields]
    tokens = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).cast("string").alias("source"))
    tokens = tokens.mapInArrow(_tokenise(vocabulary or default_vocabulary(), end_id), T.StructType(fields))
    path = shared_dir(spark, "packing-tokens")
    tokens.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(tokens.schema).parquet(path)

    dealt = written(tokens.groupBy("_part", "source").agg(F.sum("doc_tokens").alias("_n")), "packing-dealt")  # partitions x sources rows
    # A queue a source: the schedule holds a few numbers of each.
    queues = sorted(((r["source"], r["n"]) for r in dealt.groupBy("source").agg(F.sum("_n").alias("n")).collect()), key=lambda q: (q[0] is None, q[0] or ""))
    names, totals = [s for s, _ in queues], [n for _, n in queues]
    shares = [float(n) if mixture is None else 1.0 if mixture == EQUAL else float(mixture.get(s, 0)) for s, n in queues]
    plan = Schedule(totals, shares, sequence_tokens * window_sequences)
    numbered = spark.createDataFrame([(s, q) for q, s in enumerate(names)], "source string, _queue int")
    # Tokens of a queue in the partitions before: within ranges of partitions, and then by range, so that no task holds all of a queue's.
    dealt = dealt.withColumn("_range", F.floor(F.col("_part") / RANGE))
    whole = dealt.groupBy("_range", "source").agg(F.sum("_n").alias("_m"))
    whole = whole.select("_range", "source", F.coalesce(F.sum("_m").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_range").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("d").join(whole.alias("r"), F.expr("d._range = r._range AND d.source <=> r.source"))
    dealt = dealt.join(numbered.alias("q"), F.expr("d.source <=> q.source"))
    offsets = dealt.select(F.col("_part").alias("_p"), F.col("d.source").alias("_s"), "_queue", (F.col("_base") + F.col("_own")).alias("_before"))
    # Written, so that the planner knows its size before it plans the join, and shuffles the tokens only if it is large.
    offsets = written(offsets, "packing-offsets")
    placed = tokens.join(offsets, F.expr("_part = _p AND source <=> _s")).withColumn("_start", F.col("_before") + F.col("_at"))
    placed = placed.select("_id", "source", "_queue", "_start", "doc_tokens", "_width", "_ids")
    out = placed.mapInArrow(_pieces(spark.sparkContext.broadcast(plan), sequence_tokens, with_ids), T.StructType([own, *_PIECE.fields]))
    return out.withColumnRenamed("_id", id_col)


def sequences(pieces: DataFrame, sequence_tokens: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids (padded array): the pieces of each sequence in the order of their offsets."""

    def join(group: pa.Table) -> pa.Table:
        order = np.argsort(np.array(group.column("offset").to_pylist()))
        raw = b"".join(group.column("ids")[int(i)].as_py() for i in order)
        ids = np.frombuffer(raw, dtype="<u4").astype(np.int32)
        padded = np.concatenate([ids, np.full(sequence_tokens - len(ids), pad_id, dtype=np.int32)])
        return pa.table({"sequence_id": group.column("sequence_id").slice(0, 1), "n_tokens": pa.array([len(ids)], pa.int32()), "ids": pa.array([padded], pa.list_(pa.int32()))})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, n_tokens int, ids array<int>")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source gets the same share of each window until it runs dry."""
    return pack(table(spark, sf_dir, "documents"), mixture=EQUAL, with_ids=False).drop("ids")
