"""Operator 11, repair of the structure of conversations by dynamic programming over their turns.

Rows are sorted once over all tasks, so that a conversation is a run of rows of one or more tasks, and its narrow side (role,
faults) is cut into segments.  Segments are bucketed by length and become time-major tensors: for each turn one array step over
all segments gives the least cost from each of four states before it (nothing yet, after system, after user,
after assistant) to each state behind the segment, a (min, +) matrix a segment.  The matrices of conversations
that lie in several segments are multiplied from the end; with the costs behind each segment known, the stored backward costs
are traced forward, again one step over all segments, choosing the first of the cheapest edits in the order D, I, K, R.
A conversation that holds a third of all rows is many segments; only its digest, which is sequential by definition, is one
stream over its rows, and it holds one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.llm.common import bounded, table, tidy, written

#: Rows of a segment at most, and rows of the segments that one tensor step takes together.
SEGMENT, TENSOR_ROWS = 4096, 1 << 18
#: Costs of the edits.  Keep is free.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_NEVER = 1 << 40
#: States: nothing yet, after system, after user, after assistant.  A conversation may end in the first and in the last.
ENDS = np.array([0, _NEVER, _NEVER, 0], np.int64)
#: The state behind an inserted or reroled row, which is the only legal one: user but for assistant after user.
_FREE = np.array([2, 2, 3, 2])
#: The state behind a kept row of role s, u, a or another, from each state; -1 where the order forbids it.
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_DELETE_OP, _KEEP_OP, _REROLE_OP = 0, 1, 2
SEGMENTS = "first long, n int, codes binary, cost array<long>"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows, some damaged by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.

    Nulls are one space: in the key, in roles and in texts.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _faults(role: Column, text: Column) -> list[Column]:
    """Initial (0 s, 1 u, 2 a, 3 another), blank, truncated."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    return [F.coalesce(F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.substring(role, 1, 1)).cast("int"), F.lit(0)).alias("initial"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("truncated")]


# --- segments as tensors -----------------------------------------------------------------------------------------


def step(after: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Costs before a turn, from those behind it: arrays (conversations, states, ends) and the turn's codes."""
    initial, gone, extra = codes & 3, (codes >> 2 & 3) > 0, (codes >> 4 & 1) * TRUNCATED
    out = after + DELETE
    for q in range(4):
        to = _KEPT[q][initial]
        kept = np.where((gone | (to < 0))[:, None], _NEVER, after[np.arange(len(codes)), to] + extra[:, None])
        rerole = np.where(gone[:, None], _NEVER, after[:, _FREE[q]] + (extra + REROLE)[:, None])
        out[:, q] = np.minimum(out[:, q], np.minimum(kept, rerole))
    once = out[:, _FREE] + INSERT
    return np.minimum(np.minimum(out, once), once[:, _FREE] + INSERT)


def backward(codes: np.ndarray, lengths: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs before every turn, time first: (turns + 1, segments, states, ends).

    codes: (turns, segments), segments of fewer turns are filled up at the end; behind: (segments, states, ends).
    """
    out = np.empty((len(codes) + 1, *behind.shape), np.int64)
    out[-1] = behind
    for t in range(len(codes) - 1, -1, -1):
        out[t] = np.where((t < lengths)[:, None, None], step(out[t + 1], codes[t]), out[t + 1])
    return out


def trace(codes: np.ndarray, lengths: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edits of every turn (inserts before it * 4 + edit), time first, and the last states, from stored costs (turns + 1, segments, states)."""
    edits, row = np.zeros(codes.shape, np.uint8), np.arange(len(state))
    for t in range(len(codes)):
        live, ahead = t < lengths, costs[t + 1]
        inserts, done, edit, end = np.zeros(len(state), np.int64), ~live, np.zeros(len(state), np.int64), state.copy()
        for k in range(3):  # a cheapest way never inserts three rows between two
            delete = ~done & (ahead[row, state] + DELETE == costs[t][row, state])
            insert = ~done & ~delete & (costs[t][row, _FREE[state]] + INSERT == costs[t][row, state]) & (k < 2)
            rest = ~done & ~delete & ~insert
            to, gone, extra = _KEPT[state, codes[t] & 3], (codes[t] >> 2 & 3) > 0, (codes[t] >> 4 & 1) * TRUNCATED
            keep = rest & ~gone & (to >= 0) & (ahead[row, to] + extra == costs[t][row, state])
            edit[keep], edit[rest & ~keep] = _KEEP_OP, _REROLE_OP
            end = np.where(delete, state, np.where(keep, to, np.where(rest, _FREE[state], end)))
            done |= delete | rest
            state = np.where(insert, _FREE[state], state)
            inserts += insert
        edits[t] = np.where(live, inserts * 4 + edit, 0)
        state = np.where(live, end, state)
    return edits, state


def _by_length(lengths: list[int]) -> Iterator[np.ndarray]:
    """Segments of like lengths together, none padded to twice its length, and no more rows at once than a tensor has."""
    lengths = np.array(lengths)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        low = lengths[order[at]]
        end = at + int(np.searchsorted(lengths[order[at:]], 2 * low))
        end = min(end, at + max(1, TENSOR_ROWS // max(1, 2 * int(low))))
        yield order[at:end]
        at = end


def _tensor(codes: list[bytes], pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(codes[i]) for i in pick])
    out = np.zeros((lengths.max(), len(pick)), np.int64)
    for k, i in enumerate(pick):
        out[: lengths[k], k] = np.frombuffer(codes[i], np.uint8)
    return out, lengths


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation in sorted rows of (conv, pos, code): the run's key, first place, number, codes and cost matrix."""
    ids, first, codes, open_id, total, fresh = [], [], [], None, 0, True

    def flush() -> Iterator[pa.RecordBatch]:
        if first:
            cost = np.empty((len(first), 16), np.int64)
            unit = np.where(np.eye(4, dtype=bool), 0, _NEVER)
            for pick in _by_length(list(map(len, codes))):
                block, lengths = _tensor(codes, pick)
                now = np.broadcast_to(unit, (len(pick), 4, 4))
                for t in range(len(block) - 1, -1, -1):  # only the first turn's costs are wanted here
                    now = np.where((t < lengths)[:, None, None], step(now, block[t]), now)
                cost[pick] = np.minimum(now, _NEVER).reshape(-1, 16)
            cols = [pa.concat_arrays(ids), pa.array(first, pa.int64()), pa.array(list(map(len, codes)), pa.int32()), pa.array(list(map(bytes, codes)), pa.binary()), pa.ListArray.from_arrays(np.arange(0, 16 * len(first) + 1, 16, dtype=np.int32), pa.array(cost.ravel()))]
            yield pa.RecordBatch.from_arrays(cols, names=["conv", "first", "n", "codes", "cost"])

    for batch in batches:
        for i, (conv, pos, code) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if fresh or conv != open_id or len(codes[-1]) >= SEGMENT:
                if total >= TENSOR_ROWS:
                    yield from flush()
                    ids, first, codes, total = [], [], [], 0
                ids.append(batch.column(0).slice(i, 1))
                first.append(pos)
                codes.append(bytearray())
                open_id, fresh = conv, False
            codes[-1].append(code)
            total += 1
    yield from flush()


def _behind(groups: pa.Table) -> pa.Table:
    """Of one conversation's segments: the costs behind each, from each state to a legal end."""
    now, out = _at_end(), []
    order = np.argsort(groups["first"].to_numpy())
    cost = np.stack(groups["cost"].to_pylist()).reshape(-1, 4, 4)
    for k in order[::-1]:
        out.append((groups["first"][int(k)].as_py(), now.tolist()))
        now = np.minimum((cost[k] + now[None, :]).min(axis=1), _NEVER)
    return pa.table({"first": pa.array([x for x, _ in out], pa.int64()), "behind": pa.array([x for _, x in out], pa.list_(pa.int64()))})


def _at_end() -> np.ndarray:
    """Costs behind the last row: rows may still be inserted."""
    once = ENDS[_FREE] + INSERT
    return np.minimum(np.minimum(ENDS, once), once[_FREE] + INSERT)


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's edits and last state from each of the states that it may begin in: the first alone where it begins a conversation."""
    for batch in batches:
        codes, behind = batch.column("codes").to_pylist(), batch.column("behind").to_pylist()
        several = np.array([x is not None for x in behind])
        behind = np.array([_at_end().tolist() if x is None else x for x in behind], np.int64).reshape(-1, 4)
        edits, states = [[b""] * 4 for _ in codes], np.zeros((len(codes), 4), np.int64)
        for pick in _by_length(list(map(len, codes))) if codes else ():
            block, lengths = _tensor(codes, pick)
            costs = backward(block, lengths, behind[pick][:, :, None])[:, :, :, 0]
            for q in range(4):
                own = np.flatnonzero(several[pick] | (q == 0))
                if len(own):
                    found, state = trace(block[:, own], lengths[own], costs[:, own], np.full(len(own), q))
                    states[pick[own], q] = state
                    for k, j in enumerate(own):
                        edits[pick[j]][q] = found[: lengths[j], k].tobytes()
        cols = [batch.column("conv"), batch.column("first"), batch.column("codes"), pa.array(several), pa.array(edits, pa.list_(pa.binary())), pa.array(states.tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["conv", "first", "codes", "several", "edits", "states"])


def _starts(groups: pa.Table) -> pa.Table:
    """Of one conversation's segments: the state that each begins in."""
    state, out = 0, []
    first, states = groups["first"].to_pylist(), groups["states"].to_pylist()
    for k in np.argsort(first):
        out.append((first[k], state))
        state = states[k][state]
    return pa.table({"first": pa.array([x for x, _ in out], pa.int64()), "start": pa.array([x for _, x in out], pa.int32())})


# --- rows and their edits, merged by their order --------------------------------------------------------------------


class Rows:
    """A conversation's repaired rows, one after the other, and what a digest needs of them."""

    def __init__(self) -> None:
        self.low = self.high = self.turn = None
        self.turns, self.state, self.cost, self.faults, self.initial, self.illegal = 0, 0, 0, [0, 0, 0], None, 0

    def insert(self) -> tuple[str, str]:
        self.state = int(_FREE[self.state])
        self.cost += INSERT
        return "assistant" if self.state == 3 else "user", ""

    def row(self, turn: int | None, role: str, text: str, code: int, edit: int) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) of the rows that come of one; a deleted one has neither role nor text."""
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        fault, initial = (code >> 2 & 3) or 3 * (code >> 4 & 1), code & 3
        if fault:
            self.faults[fault - 1] += 1
        self.illegal += self.initial is not None and (self.initial, initial) not in ((0, 1), (1, 2), (2, 1))
        self.initial = initial
        for _ in range(edit >> 2):
            yield "I", *self.insert()
        if edit & 3 == _DELETE_OP:
            self.cost += DELETE
            yield "D", None, None
            return
        self.cost += TRUNCATED * (code >> 4 & 1)
        if edit & 3 == _KEEP_OP:
            self.state = int(_KEPT[self.state, initial])
            yield "K", role, text
        else:
            self.state = int(_FREE[self.state])
            self.cost += REROLE
            yield "R", "assistant" if self.state == 3 else "user", text

    def end(self) -> Iterator[tuple[str, str, str]]:
        while ENDS[self.state]:
            yield "I", *self.insert()


def _merged(begin: Callable, take: Callable, finish: Callable, columns: list[str], kinds: list):
    """Walks sorted rows (conv, pos, kind, turn, role, text, told, codes): a segment's edits and codes come before its rows.

    take(own, conv, turn, edit, role, text) for every repaired or deleted row; finish(own, rows, conv) gives an output row or None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, rows, own, edits, codes, at, size = [], None, None, None, b"", b"", 0, 0

        def close() -> None:
            for edit in rows.end():
                take(own, out, conv, None, *edit)
            finish(own, out, conv, rows)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=columns)

        for batch in batches:
            for key, turn, role, text, told, flags in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "told", "codes")), strict=True):
                if rows is None or key != conv:
                    if rows is not None:
                        close()
                    conv, rows, own = key, Rows(), begin()
                if told is not None:
                    edits, codes, at = told, flags, 0
                    continue
                for edit in rows.row(turn, role, text, codes[at], edits[at]):
                    take(own, out, conv, turn, *edit)
                at += 1
                size += len(text)
            if len(out) >= 10_000 or size >= 4 << 20:
                yield flush()
                out.clear()
                size = 0
        if rows is not None:
            close()
        yield flush()

    return tidy(run)


def _planned(conversations: DataFrame) -> DataFrame:
    """Rows and segments' edits (told), by conversation, in order, each conversation in one task's stream."""
    spark = bounded(conversations).sparkSession
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).select("*", *_faults(F.col("role"), F.col("text")), F.monotonically_increasing_id().alias("own"))
    # Total order: equal rows are told apart by their place in the input, so no key is too hot to be split.
    keys = ["conv", "turn", "role", "digest", "own"]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id()).drop("own"), "turns")
    first = placed.groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    narrow = placed.select("conv", "pos", "role", "digest", "initial", "blank", "truncated").join(first, F.expr("conv <=> c AND role = r AND digest = d"), "left")
    # Of each row the first fault counts: blank 1, duplicate 2, else the truncated bit.
    code = F.expr("int((initial + 3) % 4 + 4 * CASE WHEN blank THEN 1 WHEN pos > first THEN 2 ELSE 0 END + CASE WHEN NOT blank AND truncated AND NOT coalesce(pos > first, false) THEN 16 ELSE 0 END)")
    codes = narrow.select("conv", "pos", code.alias("code")).repartitionByRange("pos").sortWithinPartitions("pos")
    kind = T.StructField("conv", conversations.schema["conv_id"].dataType)
    segments = codes.mapInArrow(tidy(_segments), T.StructType([kind, *T.StructType.fromDDL(SEGMENTS).fields]))
    segments = written(segments, "turn-segments")
    # Conversations in one segment are done where they lie; the matrices of the others, a few numbers for up to SEGMENT rows, meet by conversation.
    parts = segments.groupBy("conv").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col("conv").alias("c"))
    many = segments.select("conv", "first", "cost").join(parts, F.expr("conv <=> c"), "left_semi")
    behind = written(many.groupBy("conv").applyInArrow(lambda t: _behind(t), "first long, behind array<long>"), "turn-costs")
    traced = segments.select("conv", "first", "codes").join(behind.withColumnRenamed("first", "f"), F.expr("first = f"), "left").select("conv", "first", "codes", "behind")
    traced = written(traced.mapInArrow(tidy(_traced), T.StructType([kind, *T.StructType.fromDDL("first long, codes binary, several boolean, edits array<binary>, states array<long>").fields])), "turn-edits")
    starts = traced.where("several").select("conv", "first", "states").groupBy("conv").applyInArrow(lambda t: _starts(t), "first long, start int")
    told = traced.join(starts.withColumnRenamed("first", "f"), F.expr("first = f"), "left").select("conv", F.col("first").alias("pos"), F.lit(0).alias("kind"), F.expr("edits[coalesce(start, 0)]").alias("told"), "codes")
    both = placed.select("conv", "pos", F.lit(1).alias("kind"), "turn", "role", "text").unionByName(told, allowMissingColumns=True)
    return both.repartition(F.col("conv")).sortWithinPartitions("conv", "pos", "kind")


def repair(conversations: DataFrame, *, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows have conv_id, turn, role and text; other columns are not looked at, whatever their names.  They are taken by turn, nulls first; rows of one turn by role, then by the text's SHA-256;
    repeated rows are rows.  A null conv_id is a conversation like others; null roles and texts are one space.  Texts are taken whole, however long.  ``ids`` (conv_id)
    names conversations that must be in the result even without rows: they have zeros, an empty audit and the digest of nothing.
    An empty table gives an empty result.  gaps holds at most 2**63 - 1.  Equal texts are known by SHA-256.
    """
    kind = T.StructField("conv_id", conversations.schema["conv_id"].dataType)
    fields = T.StructType([kind, *T.StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])

    def begin() -> tuple:
        return hashlib.sha256(), bytearray(), []

    def take(own: tuple, out: list, conv: object, turn: object, edit: str, role: str | None, text: str | None) -> None:
        digest, audit, some = own
        audit += edit.encode()
        if role is not None:
            digest.update((f"\n{role}:{text}" if some else f"{role}:{text}").encode())
            some[:] = [True]

    def finish(own: tuple, out: list, conv: object, rows: Rows) -> None:
        gaps = min(2**63 - 1, rows.high - rows.low + 1 - rows.turns) if rows.turns else 0
        out.append((conv, gaps, *rows.faults, rows.illegal, rows.cost, own[1].decode(), own[0].hexdigest()))

    names = fields.names
    kinds = [None, *[pa.int64()] * 6, pa.string(), pa.string()]
    found = _planned(conversations).mapInArrow(_merged(begin, take, finish, names, [_arrow(kind), *kinds[1:]]), fields)
    if ids is None:
        return found
    found = written(found, "repaired").withColumnRenamed("conv_id", "c")
    wanted = ids.select("conv_id").distinct()
    rest = [F.coalesce(F.col(c), F.lit("" if c == "audit" else hashlib.sha256(b"").hexdigest() if c == "repaired_sha256" else 0)).alias(c) for c in names[1:]]
    return wanted.join(found, F.expr("conv_id <=> c"), "left").select("conv_id", *rest)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, turn, edit, role, text: the repaired rows of every conversation in order; rows and ties as ``repair`` takes them.

    Inserted rows (edit I) have a null turn and an empty text; deleted rows are left out.
    """
    kind = T.StructField("conv_id", conversations.schema["conv_id"].dataType)
    fields = T.StructType([kind, *T.StructType.fromDDL("place long, turn long, edit string, role string, text string").fields])

    def take(own: list, out: list, conv: object, turn: int | None, edit: str, role: str | None, text: str | None) -> None:
        if role is not None:
            out.append((conv, own[0], None if edit == "I" else turn, edit, role, text))
            own[0] += 1

    run = _merged(lambda: [0], take, lambda *_: None, fields.names, [_arrow(kind), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])
    return _planned(conversations).mapInArrow(run, fields)


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damage(rows), ids=rows)
