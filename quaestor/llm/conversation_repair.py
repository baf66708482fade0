"""Conversations put back into legal turns by the cheapest edits, found with IDA*.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Its rows
are kept (K, 0), given the role that is due (R, 1) or deleted (D, 2), and turns
without text may be inserted (I, 5); blank rows and repetitions must go, and a
truncated row that stays costs 5 more. Of the cheapest edits those with the
ASCII-least letters are taken.

The search goes depth first in ASCII order of the letters, under a bound on cost
that rises to the next cost above it until a path is accepted; what a row costs
at least is the estimate, and a table remembers for each (row, role before) the
largest budget that failed. The first accepted path is the answer. A long
conversation is searched in pieces of 64 rows: what the rows after a piece cost
for each role at its end is known from the pieces behind, so each piece has the
answer that a search of the whole would give it, and a row's share of the work
does not grow with the conversation.

Rows go by turn (nulls first), then role, then the SHA-256 of the text; equal
rows are repetitions of the first. Their texts pass the one task of their
conversation as a stream, since the result is a hash of them in order: sorted on
disk where they don't fit, and never held. The search sees a byte for each row.
A null role or text is one space, a null turn one space in the damage's key. A
null conv_id is a conversation of its own. A role whose first letter is none of
s, u and a (or that has none) fits nowhere and is replaced or deleted. An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quaestor.llm.stored import stored

#: What the edits and an unfinished text cost, and the roles.
DELETE, INSERT, RENAME, UNFINISHED = 2, 5, 1, 5
ROLES = ("user", "assistant")

_PIECE = 64
_BLANKS = " \t\n\x0b\x0c\r"

# A row's code is 4 * initial + fault.
_SYSTEM, _USER, _ASSISTANT, _OTHER = range(4)
_SOUND, _BLANK, _DUPLICATE, _TRUNCATED = range(4)

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
_STATES = range(4)
_DUE = (2, 2, 3, 2)
#: What ends a conversation from each state, and its letters.
_END_COSTS = (0, 2 * INSERT, INSERT, 0)
_END_EDITS = ("", "II", "I", "")


def _kept(initial: int, state: int) -> int:
    """The state after keeping a row, or 0 if it doesn't fit."""
    if initial == _SYSTEM:
        return 1 if state == 0 else 0
    if initial == _OTHER:
        return 0
    return _DUE[state] if _DUE[state] == initial + 1 else 0


def _moves(code: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, rows taken, next state) of each edit, in ASCII order."""
    initial, fault = divmod(code, 4)
    moves = [("D", DELETE, 1, state), ("I", INSERT, 0, _DUE[state])]
    if fault in (_SOUND, _TRUNCATED):
        more = UNFINISHED if fault == _TRUNCATED else 0
        if _kept(initial, state):
            moves.append(("K", more, 1, _kept(initial, state)))
        moves.append(("R", RENAME + more, 1, _DUE[state]))
    return moves


_MOVES = [[_moves(code, state) for state in _STATES] for code in range(16)]
#: The least that a row of each code costs, whatever stands around it.
_LEAST = [min(cost for m in states for _, cost, taken, _ in m if taken) for states in _MOVES]


def search(codes: bytes, state: int, after: tuple[int, ...]) -> tuple[int, int, str]:
    """(cost, state at the end, letters) of the cheapest edits; `after` is what each end state costs."""
    n = len(codes)
    least = [min(after)] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + _LEAST[codes[i]]
    failed: dict[tuple[int, int], int] = {}
    letters: list[str] = []
    missing = 0  # the smallest amount by which a path went over the bound

    def descend(i: int, state: int, budget: int) -> int | None:
        nonlocal missing
        known = failed.get((i, state), -1)
        need = after[state] if i == n else max(least[i], known + 1)
        if need > budget:
            missing = min(missing, need - budget)
            return None
        if i == n:
            return state
        for letter, cost, taken, following in _MOVES[codes[i]][state]:
            end = descend(i + taken, following, budget - cost)
            if end is not None:
                letters.append(letter)
                return end
        failed[i, state] = budget
        return None

    bound = least[0]
    while True:
        missing = 1 << 60
        end = descend(0, state, bound)
        if end is not None:
            return bound, end, "".join(reversed(letters))
        bound += missing


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of a whole conversation."""
    pieces = [codes[at : at + _PIECE] for at in range(0, len(codes), _PIECE)]
    after = [_END_COSTS]
    for piece in pieces[:0:-1]:
        after.append(tuple(search(piece, state, after[-1])[0] for state in _STATES))
    state, cost, letters = 0, 0, []
    for k, piece in enumerate(pieces):
        total, state, own = search(piece, state, after.pop())
        cost = cost if k else total
        letters.append(own)
    return cost, "".join(letters) + _END_EDITS[state]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, live, turn, role, text): the rows after damage; a dropped one is not live."""
    turn = F.col("turn").cast("long")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(parts[0], F.lit(":"), parts[1])) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    damaged = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" ")))
    times = F.when(kind == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id",
        (kind != 0).alias("live"),
        turn.alias("turn"),
        F.when(kind != 0, role).alias("role"),
        F.when(kind != 0, damaged).alias("text"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("_copy"),
    ).drop("_copy")


def _code() -> Column:
    """Initial and fault of a row, but for repetitions."""
    rest = F.rtrim(F.col("text"), F.lit(_BLANKS))
    initial = F.left("role", F.lit(1))
    number = F.when(initial == "s", _SYSTEM).when(initial == "u", _USER).when(initial == "a", _ASSISTANT)
    fault = F.when(rest == "", _BLANK).when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), _TRUNCATED)
    return (4 * number.otherwise(_OTHER) + fault.otherwise(_SOUND)).cast("int")


def _order() -> list[Column]:
    return [F.asc_nulls_first(c) for c in ("turn", "role", "sha")]


_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list]]:
    """(whether a conversation begins, row) of rows that are sorted by conv_id."""
    before, some = None, False
    for batch in batches:
        for i in range(len(batch)):
            row = [c[i].as_py() for c in batch.columns]
            yield not some or row[0] != before, row
            before, some = row[0], True


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, …, audit) of every conversation, from the rows after damage."""
    kind = rows.schema["conv_id"].dataType
    labels = rows.select("conv_id", "live", "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"), _code().alias("code"))
    # All further sorts stay inside the partitions of conv_id.
    dealt = labels.repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "live", "role", "sha").orderBy(F.asc_nulls_first("turn"))
    repeated = (F.row_number().over(earlier) > 1) & (F.col("code") % 4 != _BLANK)
    code = F.when(repeated, F.floor(F.col("code") / 4) * 4 + _DUPLICATE).otherwise(F.col("code")).cast("int")
    marked = dealt.withColumn("_again", repeated).withColumn("code", code)
    marked = marked.sortWithinPartitions(F.asc_nulls_first("conv_id"), "live", *_order(), "_again")
    narrow = marked.select("conv_id", "live", "turn", "code")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        codes, turns, conv = bytearray(), [None, None, 0], None
        some = False
        for begins, (own, live, turn, code) in _by_conversation(batches):
            if begins and some:
                done.append((conv, *_report(bytes(codes), turns)))
                codes, turns = bytearray(), [None, None, 0]
                if len(done) >= 1000:
                    yield _rows(done, schema)
                    done = []
            conv, some = own, True
            if live:
                codes.append(code)
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
        if some:
            done.append((conv, *_report(bytes(codes), turns)))
            yield _rows(done, schema)

    schema = pa.schema([("conv_id", to_arrow_type(kind)), *[(n, pa.int64()) for n in _NAMES[:-1]], ("audit", pa.string())])
    return narrow.mapInArrow(task, f"conv_id {kind.simpleString()}, {_REPORT}")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _report(codes: bytes, turns: list) -> tuple:
    first, last, distinct = turns
    faults = [c & 3 for c in codes]
    initials = [c >> 2 for c in codes]
    legal = {(_SYSTEM, _USER), (_USER, _ASSISTANT), (_ASSISTANT, _USER)}
    cost, letters = repair(codes)
    return (
        last - first + 1 - distinct if distinct else 0,
        *[faults.count(f) for f in (_BLANK, _DUPLICATE, _TRUNCATED)],
        sum(pair not in legal for pair in zip(initials, initials[1:])),
        cost,
        letters,
    )


class _Writer:
    """The hash of a conversation's repaired rows, which come one by one."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, 0
        self.hash, self.lines = hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.lines += 1

    def _insertions(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _DUE[self.state]
            self._line(ROLES[self.state - 2], "")

    def add(self, role: str, text: str) -> None:
        self._insertions()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "D":
            return
        if letter == "R":
            self.state = _DUE[self.state]
            role = ROLES[self.state - 2]
        else:
            self.state = 1 if role[0] == "s" else _DUE[self.state]
        self._line(role, text)

    def end(self) -> str:
        self._insertions()
        return self.hash.hexdigest()


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    rows = damage(conversations)
    kind = rows.schema["conv_id"].dataType
    report = stored(audits(rows), "audits")
    live = rows.filter("live").select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("sha"))
    # A conversation's report comes before its rows.
    stream = report.withColumn("_kind", F.lit(0)).unionByName(live.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    dealt = stream.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "_kind", *_order())
    narrow = dealt.select("conv_id", "_kind", "role", "text", *_NAMES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        writer, head = None, None
        for _, (conv, which, role, text, *own) in _by_conversation(batches):
            if which == 0:
                if writer is not None:
                    done.append((*head, writer.end()))
                writer, head = _Writer(own[-1]), (conv, *own)
                if len(done) >= 1000:
                    yield _rows(done, schema)
                    done = []
            else:
                writer.add(role, text)
        if writer is not None:
            done.append((*head, writer.end()))
            yield _rows(done, schema)

    fields = [("conv_id", to_arrow_type(kind)), *[(n, pa.int64()) for n in _NAMES[:-1]]]
    schema = pa.schema([*fields, ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return narrow.mapInArrow(task, f"conv_id {kind.simpleString()}, {_REPORT}, repaired_sha256 string")
