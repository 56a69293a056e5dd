"""Repair of conversation structure: the cheapest edits that make turns alternate.

A repaired conversation has the role initials ``(s?(ua)+)?``.  The automaton of
that pattern has four states, so all ways through a stretch of rows are told by
a 4 x 4 table of least costs.  Edits are found by divide and conquer: costs from
the start to the middle and from the middle to the end meet in four states, the
optimal crossing with the least edit string is fixed, and both halves recurse.
Only cost vectors are kept, so space is linear in the rows.

The same step works one level up.  Rows are range-sorted, and a conversation
that does not lie whole inside one partition, or is longer than ``block`` rows,
is cut into blocks.  Blocks report their tables, crossings are fixed between the
partitions of a conversation, then between the blocks of a partition, then
between rows, so no conversation, however long, is held in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tabweave.session import cut_lineage

# Costs of the edits, and the cost of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a block, and bytes of text of a block, at most (one longer row is a block of its own).
BLOCK, BLOCK_BYTES = 4096, 1 << 24

SPACES = " \t\n\r\x0b\x0c"
ENDINGS = ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or re-roled row becomes, by the state before it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Row kinds: initial of the role (anything else: x), and whether the text is cut off.
INITIALS = "suax"
FAR = 1 << 60

Unit = Sequence[tuple[int, int, int, int]]  # (state before, state after, cost, order among those from one state)


def _segments(initial: str, truncated: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """Per pair of states, the cheapest edits of one row with the inserts before it; ties go to the least string.

    No insert precedes a deletion: after it, it costs the same and sorts earlier.
    A segment holds one letter other than I, its last; so no segment is the
    beginning of another, and strings of equally many rows differ inside both.
    """
    left_in = TRUNCATED if truncated else 0
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        found = [(start, DELETE, "D")]
        state = start
        for inserts in range(3):
            before = INSERT * inserts, "I" * inserts
            found.append((NEXT[state], before[0] + REROLE + left_in, before[1] + "R"))
            kept = {"s": SYSTEM if state == START else None, "u": USER if state != USER else None, "a": ASSISTANT if state == USER else None}.get(initial)
            if kept is not None:
                found.append((kept, before[0] + left_in, before[1] + "K"))
            state = NEXT[state]
        for end, cost, text in found:
            if (start, end) not in best or (cost, text) < best[start, end]:
                best[start, end] = cost, text
    return best


SEGMENTS = [_segments(c, cut) for c in INITIALS for cut in (False, True)]
#: Inserts that end a conversation well from each state.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _unit(segments: dict[tuple[int, int], tuple[int, str]]) -> Unit:
    order = {text: i for i, text in enumerate(sorted({text for _, text in segments.values()}))}
    return [(s, t, cost, order[text]) for (s, t), (cost, text) in segments.items()]


UNITS = [_unit(s) for s in SEGMENTS]


def forward(units: Sequence[Unit], start: int) -> tuple[list[int], list[int]]:
    """Least cost of each state after all units, and its place in the order of the least edit strings."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[start] = 0
    for unit in units:
        best: list[tuple[int, int, int] | None] = [None] * 4
        for s, t, c, order in unit:
            if cost[s] < FAR:
                way = (cost[s] + c, rank[s], order)
                if best[t] is None or way < best[t]:
                    best[t] = way
        cost = [FAR if w is None else w[0] for w in best]
        for place, (_, _, t) in enumerate(sorted((w[1], w[2], t) for t, w in enumerate(best) if w is not None)):
            rank[t] = place
    return cost, rank


def backward(units: Sequence[Unit], end: int) -> list[int]:
    """Least cost from each state before the units to ``end``."""
    cost = [FAR] * 4
    cost[end] = 0
    for unit in reversed(units):
        before = [FAR] * 4
        for s, t, c, _ in unit:
            if c + cost[t] < before[s]:
                before[s] = c + cost[t]
        cost = before
    return cost


def crossings(units: Sequence[Unit], start: int = START, end: int | None = None) -> list[int]:
    """States before, between and after the units on the cheapest way with the least edit string.

    Without ``end`` the way may end in any state, with the inserts of :data:`TAIL`.
    """
    states = [start] * (len(units) + 1)
    if units:
        cost, rank = forward(units, start)
        last = end if end is not None else min(range(4), key=lambda s: (cost[s] + INSERT * len(TAIL[s]), rank[s]))
        states[-1] = last
    todo = [(0, len(units))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        mid = (low + high) // 2
        cost, rank = forward(units[low:mid], states[low])
        rest = backward(units[mid:high], states[high])
        states[mid] = min((s for s in range(4) if cost[s] < FAR), key=lambda s: (cost[s] + rest[s], rank[s]))
        todo += [(low, mid), (mid, high)]
    return states


@lru_cache(1 << 14)
def _short(kinds: bytes) -> list[int]:
    return crossings([UNITS[k] for k in kinds])


def span(units: Sequence[Unit]) -> list[int]:
    """The table of a stretch, as a flat list: ``(before, after, cost, order)`` of each way."""
    flat: list[int] = []
    for s in range(4):
        cost, rank = forward(units, s)
        for t in range(4):
            if cost[t] < FAR:
                flat += [s, t, cost[t], rank[t]]
    return flat


def unit_of(flat: Sequence[int]) -> Unit:
    return [tuple(flat[i : i + 4]) for i in range(0, len(flat), 4)]


def kind_of(role: str, text: str) -> int:
    """The kind of a row, or -1 for a blank one."""
    body = text.rstrip(SPACES)
    if not body:
        return -1
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return 2 * INITIALS.index(initial) + (body[-1] not in ENDINGS)


class Block:
    """Rows of one conversation in order; a row stands for ``n`` equal ones, of which the first may be new."""

    def __init__(self) -> None:
        self.rows: list[tuple[int | None, str, str, int, int]] = []  # turn, role, text, n, kind of the first
        self.size = 0
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn: int | None, role: str, text: str, n: int, new: bool) -> None:
        kind = kind_of(role, text)
        if kind < 0:
            self.blank += n
        elif not new:
            self.duplicate += n
            kind = -1
        else:
            self.duplicate += n - 1
            self.truncated += kind % 2
        self.rows.append((turn, role, text, n, kind))
        self.size += len(text)

    def full(self, most: int) -> bool:
        return len(self.rows) >= most or self.size >= BLOCK_BYTES

    @property
    def kinds(self) -> bytes:
        return bytes(row[4] for row in self.rows if row[4] >= 0)


def _illegal(before: str, after: str) -> bool:
    return before[:1] + after[:1] not in ("su", "ua", "au")


def edited(rows: Sequence[tuple], states: Sequence[int], last: bool) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of rows and inserts in order; deleted rows keep what they had."""
    at = 0
    for _, role, text, n, kind in rows:
        if kind >= 0:
            state = states[at]
            for edit in SEGMENTS[kind][state, states[at + 1]][1]:
                if edit == "I":
                    state = NEXT[state]
                    yield "I", NAMES[state], ""
                else:
                    yield edit, NAMES[NEXT[state]] if edit == "R" else role, text
            at += 1
            n -= 1
        for _ in range(n):
            yield "D", role, text
    if last:
        state = states[-1]
        for _ in TAIL[state]:
            state = NEXT[state]
            yield "I", NAMES[state], ""


def _cost(rows: Sequence[tuple], states: Sequence[int], last: bool) -> int:
    """Cost of the edits without listing repeated deletions one by one."""
    total = INSERT * len(TAIL[states[-1]]) if last else 0
    at = 0
    for *_, n, kind in rows:
        if kind >= 0:
            total += SEGMENTS[kind][states[at], states[at + 1]][0]
            at += 1
            n -= 1
        total += DELETE * n
    return total


# --------------------------------------------------------------------------
# On Spark
# --------------------------------------------------------------------------

_ROW = "STRUCT<turn: BIGINT, role: STRING, text: STRING, n: BIGINT, kind: INT>"


def _ordered(df: DataFrame, conv: str, turn: str, role: str, text: str, live: Column, copies: Column) -> DataFrame:
    """Equal rows as one with a count, marked where role and text are new, sorted into ranges.

    Only sizes, hashes and keys are compared, so a text is shuffled twice.  Both
    sides of the join have one row per key.
    """
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("ck"),
        F.col(conv).alias("conv"),
        live.alias("live"),
        (live & F.col(turn).isNotNull()).alias("timed"),
        F.when(live, F.coalesce(F.col(turn).cast("bigint"), F.lit(0))).otherwise(F.lit(0)).alias("turn"),
        F.when(live, F.coalesce(F.col(role).cast("string"), F.lit(" "))).otherwise("").alias("role"),
        F.when(live, F.coalesce(F.col(text).cast("string"), F.lit(" "))).otherwise("").alias("text"),
        F.when(live, copies).otherwise(F.lit(1)).cast("bigint").alias("n"),
    ).withColumn("h", F.sha2("text", 256))
    by = ["ck", "live", "timed", "turn", "role", "h"]
    folded = rows.groupBy(*by).agg(F.first("conv").alias("conv"), F.first("text").alias("text"), F.sum("n").alias("n"))
    new = rows.where("live").groupBy("ck", "live", "role", "h").agg(F.min(F.struct("timed", "turn")).alias("at"))
    new = new.select("ck", "live", "at.timed", "at.turn", "role", "h", F.lit(True).alias("new"))
    marked = folded.join(new, by, "left").drop("h")
    order = ["ck", "timed", "turn", "role"]
    # Long texts stay out of the sampled range bounds; inside a range whole texts decide.
    return marked.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")


_BLOCK = (
    f"ck STRING, conv {{conv}}, part INT, seq INT, whole BOOLEAN, rows ARRAY<{_ROW}>, "
    "blank BIGINT, duplicate BIGINT, truncated BIGINT, span ARRAY<BIGINT>"
)
_FIELDS = ("turn", "role", "text", "n", "kind")


def _cut(rows: Iterator[tuple], most: int) -> Iterator[tuple[str, object, int, bool, Block]]:
    """``(key, conv, seq, whole, block)`` of a partition's sorted rows.

    Whole is a conversation in one block that others surround, so that no
    neighbouring partition can hold a part of it.
    """
    key = first = conv = None
    seq, block = 0, Block()
    for ck, name, live, timed, turn, role, text, n, new in rows:
        if key is None:
            first = key = ck
            conv = name
        elif ck != key:
            yield key, conv, seq, seq == 0 and key != first, block
            key, conv, seq, block = ck, name, 0, Block()
        elif block.full(most):
            yield key, conv, seq, False, block
            seq, block = seq + 1, Block()
        if live:
            block.add(turn if timed else None, role, text, n, bool(new))
    if key is not None:
        yield key, conv, seq, False, block


def _blocks(ordered: DataFrame, most: int) -> DataFrame:
    """One row per block, with its table unless it is a whole conversation; cut from its history."""
    schema = _BLOCK.format(conv=ordered.schema["conv"].dataType.simpleString())
    names = ("ck", "conv", "live", "timed", "turn", "role", "text", "n", "new")
    arrow = pa_schema(schema, ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in names), strict=True))
        out, size = [], 0
        for key, conv, seq, whole, block in _cut(rows, most):
            packed = [dict(zip(_FIELDS, row, strict=True)) for row in block.rows]
            table = None if whole else span([UNITS[k] for k in block.kinds])
            out.append((key, conv, part, seq, whole, packed, block.blank, block.duplicate, block.truncated, table))
            size += block.size + 100 * len(packed)
            if size >= BLOCK_BYTES:
                yield batch_of(out, arrow)
                out, size = [], 0
        if out:
            yield batch_of(out, arrow)

    return cut_lineage(ordered.select(*names).mapInArrow(run, schema))


def pa_schema(ddl: str, df: DataFrame) -> pa.Schema:
    """The Arrow schema of a DDL text."""
    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)


def _states(blocks: DataFrame) -> DataFrame:
    """``(ck, part, seq, start, end, last)`` of the blocks that are no whole conversation.

    First between the partitions of a conversation, as many as there are
    partitions at most; then between the blocks of a partition.
    """
    parts = blocks.where("NOT whole").select("ck", "part", "seq", "span")

    def whole_run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("seq")
        units = [unit_of(x) for x in rows["span"].to_pylist()]
        return pa.table([rows["ck"][:1], rows["part"][:1], pa.array([span(units)], pa.list_(pa.int64()))], ["ck", "part", "span"])

    def between_parts(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part")
        at = crossings([unit_of(x) for x in rows["span"].to_pylist()])
        last = [False] * (len(at) - 2) + [True]
        return pa.table([rows["ck"], rows["part"], pa.array(at[:-1], pa.int32()), pa.array(at[1:], pa.int32()), pa.array(last)], ["ck", "part", "start", "end", "last"])

    def between_blocks(table: pa.Table) -> pa.Table:
        rows = table.sort_by("seq")
        at = crossings([unit_of(x) for x in rows["span"].to_pylist()], rows["start"][0].as_py(), rows["end"][0].as_py())
        last = [False] * (len(at) - 2) + [rows["last"][0].as_py()]
        return pa.table([rows["ck"], rows["part"], rows["seq"], pa.array(at[:-1], pa.int32()), pa.array(at[1:], pa.int32()), pa.array(last)], ["ck", "part", "seq", "start", "end", "last"])

    runs = parts.groupBy("ck", "part").applyInArrow(whole_run, "ck STRING, part INT, span ARRAY<BIGINT>")
    ends = runs.groupBy("ck").applyInArrow(between_parts, "ck STRING, part INT, start INT, end INT, last BOOLEAN")
    states = parts.join(ends, ["ck", "part"]).groupBy("ck", "part")
    return states.applyInArrow(between_blocks, "ck STRING, part INT, seq INT, start INT, end INT, last BOOLEAN")


def _solved(df: DataFrame, conv: str, turn: str, role: str, text: str, live: Column | None, copies: Column | None, most: int) -> DataFrame:
    """Blocks with the states before and after them; null for whole conversations."""
    live = F.lit(True) if live is None else live
    blocks = _blocks(_ordered(df, conv, turn, role, text, live, F.lit(1) if copies is None else copies), most)
    cut = blocks.where("NOT whole").join(_states(blocks), ["ck", "part", "seq"])
    none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"), ("last", "boolean"))]
    return blocks.where("whole").select("*", *none).unionByName(cut)


def _way(row: dict) -> tuple[list[tuple], list[int], bool]:
    """Rows of a block, the states between them, and whether the conversation ends with it."""
    rows = [tuple(r[c] for c in _FIELDS) for r in row["rows"]]
    kinds = bytes(r[4] for r in rows if r[4] >= 0)
    if row["whole"] and len(kinds) <= 32:
        return rows, _short(kinds), True
    states = crossings([UNITS[k] for k in kinds], *((START, None) if row["whole"] else (row["start"], row["end"])))
    return rows, states, row["whole"] or row["last"]


_PIECE = (
    "ck STRING, conv {conv}, part INT, seq INT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, "
    "cost BIGINT, turns BIGINT, low BIGINT, high BIGINT, first_role STRING, last_role STRING, audit STRING, "
    "lines BIGINT, body BINARY, sha STRING"
)


def _piece(row: dict) -> tuple:
    """What a block adds to the report of its conversation."""
    rows, states, last = _way(row)
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(n - 1 for *_, n, _ in rows) + sum(_illegal(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False))
    audit, lines = [], []
    for edit, role, text in edited(rows, states, last):
        audit.append(edit)
        if edit != "D":
            lines.append(f"{role}:{text}")
    body = "\n".join(lines).encode("utf-8", "surrogatepass")
    sha = hashlib.sha256(body).hexdigest() if row["whole"] else None
    ends = (rows[0][1][:1], rows[-1][1][:1]) if rows else (None, None)
    return (
        row["ck"], row["conv"], row["part"], row["seq"], row["blank"], row["duplicate"], row["truncated"], illegal,
        _cost(rows, states, last), len(set(turns)), min(turns, default=None), max(turns, default=None), *ends,
        "".join(audit), len(lines), None if row["whole"] else body, sha,
    )


_REPORT = (
    "{key} {conv}, gaps BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, cost BIGINT, "
    "audit STRING, repaired_sha256 STRING"
)


class _Report:
    """The report of one conversation, added up over its blocks in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.sums, self.turns, self.lines = conv, [0] * 5, 0, 0
        self.low = self.high = self.role = self.sha = None
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def add(self, p: dict) -> None:
        self.sums = [a + p[c] for a, c in zip(self.sums, ("blank", "duplicate", "truncated", "illegal", "cost"), strict=True)]
        if p["first_role"] is not None:
            if self.role is not None:
                self.sums[3] += _illegal(self.role, p["first_role"])
            self.role = p["last_role"]
        if p["turns"]:
            self.turns += p["turns"] - (self.high is not None and self.high == p["low"])
            self.low = p["low"] if self.low is None else self.low
            self.high = p["high"]
        self.audit.append(p["audit"])
        self.sha = p["sha"] or self.sha
        if p["lines"] and p["body"] is not None:
            self.hash.update((b"\n" if self.lines else b"") + p["body"])
            self.lines += p["lines"]

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.sums, "".join(self.audit), self.sha or self.hash.hexdigest()


def repair_conversations(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    live: Column | None = None,
    copies: Column | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` per conversation.

    The audit holds the initials of the cheapest edits in order: Keep, Rerole,
    Delete, Insert; of equally cheap ones the least string.  ``live`` says which
    rows take part (a conversation without any still has a report), ``copies``
    how often a row counts; ``block`` is the number of rows that a task solves at
    once and changes no result.

    * Rows are taken by turn, null first; ties by role, then by text, in the
      order of their UTF-8 bytes.
    * A null role or text counts as one space; rows with a null key are one
      conversation.  Repeated rows are duplicates of the first.
    * A role whose first letter is not s, u or a (any case counts as another
      letter) cannot be kept.
    * Texts are used whole, whatever their length.  An empty table gives no
      rows.  Other columns are not read, whatever their names.
    * The audit and the hash of a conversation are made in one task, block by
      block: a hash is sequential.  Everything before is cut into blocks.
    """
    solved = _solved(df, conv, turn, role, text, live, copies, block)
    kind = solved.schema["conv"].dataType.simpleString()
    pieces, reports = _PIECE.format(conv=kind), _REPORT.format(key="conv", conv=kind)
    piece_arrow, report_arrow = pa_schema(pieces, df), pa_schema(reports, df)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_of([_piece(row) for row in batch.to_pylist()], piece_arrow)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, report = None, None
        for batch in batches:
            done = []
            for p in batch.to_pylist():
                if report is None or p["ck"] != key:
                    done += [report.row()] if report is not None else []
                    key, report = p["ck"], _Report(p["conv"])
                report.add(p)
            if done:
                yield batch_of(done, report_arrow)
        if report is not None:
            yield batch_of([report.row()], report_arrow)

    found = solved.mapInArrow(rebuild, pieces)
    return found.repartition("ck").sortWithinPartitions("ck", "part", "seq").mapInArrow(merge, reports).withColumnRenamed("conv", conv)


def repaired_rows(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """``(conv, part, seq, at, edit, role, text)``: the edited rows, to be read by ``part``, ``seq`` and ``at``.

    Deleted rows are listed with edit D.  Rules are those of :func:`repair_conversations`.
    """
    solved = _solved(df, conv, turn, role, text, None, None, block)
    schema = f"conv {solved.schema['conv'].dataType.simpleString()}, part INT, seq INT, at BIGINT, edit STRING, role STRING, text STRING"
    arrow = pa_schema(schema, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = [(row["conv"], row["part"], row["seq"], i, *e) for i, e in enumerate(edited(*_way(row)))]
                for start in range(0, len(out), BLOCK):
                    yield batch_of(out[start : start + BLOCK], arrow)

    return solved.mapInArrow(run, schema).withColumnRenamed("conv", conv)
