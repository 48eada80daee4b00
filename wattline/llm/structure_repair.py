"""Repair of a conversation's structure: the cheapest edits that make it an optional system turn and user/assistant pairs.

Edits of a row: K keep (0), R give it the role the place asks for (3), D delete (4; the only edit of blank and duplicate
rows); I inserts an empty turn of that role (3) before it. A truncated row that stays adds 3. The roles' initials of the
result are empty or ``s?(ua)+``; of the cheapest edit strings the ASCII-least is taken.

The cost to go from a row depends on four states: nothing yet, after the system turn, after a user turn, after an
assistant turn. A first pass walks each conversation backwards and keeps the four costs only at checkpoints, one every
``isqrt`` of its rows; the second walks forwards, holds the rows up to the next checkpoint, recomputes their costs from it and
takes at each row the least letter that still reaches the best cost. Both are streams over sorted partitions: a
conversation of n rows needs the square root of n rows in memory, whatever n is, and the text is hashed as it passes.

Rows of a conversation are ordered by turn (null first), then role and text; rows without conv_id are one conversation. A
null role or text is one space. A role's initial is its first character; an empty role has none and may stay
anywhere. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

#: The costs of edits, and what a space is.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = r"\x20\x09-\x0D"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Next state by state for a new u or a turn.
_NEXT = (2, 2, 3, 2)
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (0, 1, 2, 3)}
_NEVER = (None, None, None, None)
_NAME = {2: "user", 3: "assistant"}
_LAST = (0, 2 * INSERT, INSERT, 0)
#: Conversations of up to so many rows are one block, so they need no checkpoints.
SHORT = 64
BLANK, DUPLICATE, CUT = 1, 2, 3


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after deterministic damage; dropped rows stay as rows without role and text, so that no conversation is lost."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    role, text = plain("role"), plain("text")
    d = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 0, F.lit(None)).when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return d.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("conv_id", "turn", "role", "text")


def _fault(text: Column, copy: Column) -> Column:
    return F.when(~text.rlike(f"[^{SPACES}]"), BLANK).when(copy > 1, DUPLICATE).when(~text.rlike(rf"[.!?][{SPACES}]*\z"), CUT).otherwise(0)


def coded(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text; role null: no row, only its conversation) with place p from 1, the conversation's rows n, and fault."""
    live = F.col("role").isNotNull()
    h = rows.withColumns({"h1": F.when(live, F.xxhash64("role", "text")), "h2": F.when(live, F.xxhash64(F.lit(13), "text", "role"))})
    turn = F.col("turn").asc_nulls_first()
    order = Window.partitionBy("conv_id").orderBy(live, turn, "role", "text", "copy")  # rows that are none come first
    same = Window.partitionBy("conv_id", "h1", "h2").orderBy(turn)
    count = F.count("role").over(Window.partitionBy("conv_id"))
    h = h.repartition("conv_id").withColumn("copy", F.row_number().over(same)).withColumns({"p": F.sum(live.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": count})
    return h.select("conv_id", "turn", "role", "text", "p", "n", F.when(live, _fault(F.col("text"), F.col("copy"))).alias("fault"))


def _moves(initial: str, fault: int) -> tuple[int, tuple]:
    """What a row that stays costs more, and the state after it is kept, by state; blank and duplicate rows never stay."""
    if fault in (BLANK, DUPLICATE):
        return -1, _NEVER
    return (TRUNCATED if fault == CUT else 0), _KEEP.get(initial, _NEVER)


def back(initial: str, fault: int, after: tuple) -> tuple:
    """The four costs before a row, from those after it."""
    extra, keep = _moves(initial, fault)
    cost = []
    for s in range(4):
        best = DELETE + after[s]
        if extra >= 0:
            best = min(best, REROLE + extra + after[_NEXT[s]])
            if keep[s] is not None:
                best = min(best, extra + after[keep[s]])
        cost.append(best)
    once = [min(cost[s], INSERT + cost[_NEXT[s]]) for s in range(4)]  # two insertions in one place reach every state
    return tuple(min(once[s], INSERT + once[_NEXT[s]]) for s in range(4))


def step(initial: str, fault: int, state: int, here: tuple, after: tuple) -> tuple[str, int]:
    """(least letter on a cheapest way from ``state``, state after it) at a row with costs ``here`` before and ``after`` behind it."""
    best = here[state]
    extra, keep = _moves(initial, fault)
    if DELETE + after[state] == best:
        return "D", state
    if INSERT + here[_NEXT[state]] == best:
        return "I", _NEXT[state]
    if keep[state] is not None and extra + after[keep[state]] == best:
        return "K", keep[state]
    return "R", _NEXT[state]


def block_rows(n: int) -> int:
    """Rows between checkpoints in a conversation of n rows."""
    return SHORT if n <= SHORT else isqrt(n - 1) + 1


def checkpoints(rows: DataFrame) -> DataFrame:
    """(conv_id, p, cost): the costs behind row p, at every block's last row but the conversation's last block, for conversations of more than one block."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, costs = (), _LAST
        for b in batches:
            out = []
            for conv, p, n, initial, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "p", "n", "initial", "fault")), strict=True):
                if at != (conv,):
                    at, costs = (conv,), _LAST
                if p < n and p % block_rows(n) == 0:
                    out.append((conv, p, costs))
                costs = back(initial, fault, costs)
            c = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.int64()))], ["conv_id", "p", "cost"])

    long = rows.where(F.col("n") > SHORT).where("role IS NOT NULL").select("conv_id", "p", "n", F.substring("role", 1, 1).alias("initial"), "fault")
    return long.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("p")).mapInArrow(walk, "conv_id long, p long, cost array<long>")


class _Conversation:
    """One conversation on its way forwards; holds the rows of one block."""

    def __init__(self, conv_id: int | None, sink: list | None) -> None:
        self.conv_id, self.state, self.cost, self.sink = conv_id, 0, None, sink
        self.rows: list[tuple] = []
        self.hash, self.lines = hashlib.sha256(), 0
        self.audit: list[str] = []
        self.counts = [0, 0, 0, 0]  # by fault
        self.illegal = self.turns = 0
        self.before: str | None = None
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.rows.append((role, text, fault))
        self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1
        if self.sink is not None:
            self.sink.append((self.conv_id, self.lines, role, text))

    def _insert(self, state: int) -> int:
        self.audit.append("I")
        self._put(_NAME[_NEXT[state]], "")
        return _NEXT[state]

    def walk(self, behind: tuple) -> None:
        """Edit the rows held, with the costs behind the last of them."""
        costs = [behind]
        for role, _, fault in reversed(self.rows):
            costs.append(back(role[:1], fault, costs[-1]))
        costs.reverse()
        if self.cost is None:
            self.cost = costs[0][0]
        state = self.state
        for (role, text, fault), here, after in zip(self.rows, costs, costs[1:], strict=False):
            letter, to = step(role[:1], fault, state, here, after)
            while letter == "I":
                state = self._insert(state)
                letter, to = step(role[:1], fault, state, here, after)
            self.audit.append(letter)
            if letter != "D":
                self._put(role if letter == "K" else _NAME[to], text)
            state = to
        self.state = state
        self.rows.clear()

    def result(self) -> tuple:
        self.walk(_LAST)
        if self.cost is not None:
            while _LAST[self.state]:
                self.state = self._insert(self.state)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, self.cost or 0, "".join(self.audit), self.hash.hexdigest())


_TURN = [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
_OUT = [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _stream(rows: DataFrame) -> DataFrame:
    """Each conversation's rows and the costs of its checkpoints in one order, a conversation in one partition."""
    none = lambda kind: F.lit(None).cast(kind)
    marks = checkpoints(rows).select("conv_id", "p", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("int").alias("fault"), "cost")
    stream = rows.select("conv_id", "p", "turn", "role", "text", "fault", none("array<long>").alias("cost")).unionByName(marks)
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "p", F.col("cost").isNotNull())


def _forward(batches: Iterator[pa.RecordBatch], sink: list | None) -> Iterator[list[tuple]]:
    """After each batch the results of the conversations that ended; their repaired turns go to ``sink`` as they are made."""
    now: _Conversation | None = None
    for b in batches:
        done = []
        for conv, p, turn, role, text, fault, cost in zip(*(b.column(c).to_pylist() for c in ("conv_id", "p", "turn", "role", "text", "fault", "cost")), strict=True):
            if now is None or now.conv_id != conv:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv, sink)
            if cost is not None:
                now.walk(tuple(cost))
            elif role is not None:
                now.add(turn, role, text, fault)
        yield done
    if now is not None:
        yield [now.result()]


def _batch(rows: list[tuple], columns: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [[] for _ in columns]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(c, columns, strict=True)], [n for n, _ in columns])


def _schema(columns: list[tuple]) -> str:
    return ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in columns)


def repaired(rows: DataFrame) -> DataFrame:
    """A row a conversation of ``coded`` rows: gaps, faults, illegal neighbours, cost, audit and the digest of the repaired text. rows is read twice, so it should be stored."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _forward(batches, None):
            yield _batch(done, _OUT)

    return _stream(rows).mapInArrow(walk, _schema(_OUT))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns that ``repaired`` leaves, numbered from 1."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink: list[tuple] = []
        for _ in _forward(batches, sink):
            yield _batch(sink, _TURN)
            sink.clear()

    return _stream(rows).mapInArrow(walk, _schema(_TURN))


def audited(conversations: DataFrame) -> DataFrame:
    """``repaired`` of the damaged conversations."""
    return repaired(stored(coded(damaged(conversations)), "repair-rows"))
