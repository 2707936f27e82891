"""Conversation structure repair with a survivor-coalescence Viterbi decoder.

A conversation's rows, in order, are edited so that the initials of the roles
read ``(s?(ua)+)?``: Keep, Rerole to user or assistant, Delete (required for a
blank row and for a repeat of an earlier role and text), Insert an empty user or
assistant row; truncated rows that stay cost extra.  The cheapest edits win, and of
equally cheap ones those whose letters are ASCII-least.

Decoder.  Four states (nothing yet, after s, u, a); each keeps one survivor, a node
of a backpointer tree with reference counts.  A node whose last reference goes
is freed with its chain; from the root on, edits are emitted as long as one single
child is left, that is once all survivors share them.  Inserts are booked before the row that
follows, so two survivors never are prefixes of each other: their order by the
whole unresolved suffix is fixed where they part, and the decoder carries
that order from row to row in place of comparing the suffixes again.  A state is given
up only when another one reaches its every continuation strictly cheaper.  Memory is the
unresolved suffix and its rows.

Spread.  Equal (conversation, turn, role, text) rows are counted first, so
copies never meet in one task.  Rows are range-partitioned and sorted by
conversation and order, so a long conversation is cut over tasks.  A
conversation that begins and ends inside a task, within ``Bounds.whole``, is decoded there.
Of all others (two per task, and the long ones) the task passes the rows on
with a small table: cost and order of the survivors for each state that the
piece may be entered in.  These tables, not the rows, go to the driver
(at most two per task and one per ``Bounds.whole``), which picks every piece's entry and
exit; the pieces are then decoded side by side.  One conversation's audit text and
SHA-256 are by definition sequential: its repaired text reaches one task, in blocks
of ``Bounds.block``, of which it holds one at a time.

Null role and text count as one space; a null conv_id is a conversation of its own; null
turns come first.  Rows of one turn are ordered by role, then text.  Roles of another
initial than s, u, a (also empty ones) can only be reroled or deleted.
Repeated rows are duplicates, blank ones blank.  An empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from venturelens.session import written

#: Rows between two looks for settled edits.
LOOK = 32
CLEAN, TRUNCATED, DUPLICATE, BLANK = range(4)
#: States: nothing yet, after s, after u, after a; and where an initial leads.
START, S, U, A = range(4)
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
FILL = {START: "u", S: "u", U: "a", A: "u"}
ROLES = {"u": "user", "a": "assistant"}
_SPACE = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def lead(self) -> dict[tuple[int, int], int]:
        """(t, s): bound on what the rest costs more from state t than from state s."""
        i, d = self.insert, self.delete
        return {(A, START): d, (A, S): 0, (A, U): i, (START, A): 0, (START, S): 0, (START, U): i,
                (S, START): max(2 * i, d), (S, A): 2 * i, (S, U): i, (U, START): i + d, (U, A): i, (U, S): i}


@dataclass(frozen=True)
class Bounds:
    """Bytes of a conversation up to which a task keeps it whole, and of one block of repaired text."""

    whole: int = 8 << 20
    block: int = 1 << 20


def _inserts(state: int, costs: Costs) -> list[tuple[int, int, str]]:
    """(state, cost, letters) after no, one and two inserts."""
    out = [(state, 0, "")]
    for n in (1, 2):
        state = NEXT[state, FILL[state]]
        out.append((state, n * costs.insert, "I" * n))
    return out


#: Survivors: (state, cost above the least) from the ASCII-least letters to the greatest.
Survivors = tuple[tuple[int, int], ...]


@lru_cache(maxsize=None)
def advance(alive: Survivors, initial: str, fault: int, costs: Costs) -> tuple[int, Survivors, tuple[tuple[int, str], ...]]:
    """One row: what the least cost rises by, the survivors, and each one's (place of its origin, letters)."""
    extra = costs.truncated if fault == TRUNCATED else 0
    found: dict[int, tuple[int, int, str]] = {}
    for place, (state, cost) in enumerate(alive):
        for at, more, letters in _inserts(state, costs):
            moves = [(at, costs.delete, "D")]
            if fault < DUPLICATE:
                if (at, initial) in NEXT:
                    moves.append((NEXT[at, initial], costs.keep + extra, "K"))
                moves.append((NEXT[at, FILL[at]], costs.rerole + extra, "R"))
            for to, price, letter in moves:
                found[to] = min(found.get(to, (1 << 62, 0, "")), (cost + more + price, place, letters + letter))
    lead, least = costs.lead(), min(c for c, _, _ in found.values())
    stay = sorted((place, letters, s, c) for s, (c, place, letters) in found.items()
                  if not any(t != s and found[t][0] + lead[t, s] < c for t in found))
    return least, tuple((s, c - least) for _, _, s, c in stay), tuple((p, x) for p, x, _, _ in stay)


def finish(alive: Survivors, costs: Costs) -> tuple[int, int, str]:
    """Place of the winner at the end, its cost above the least, and the letters of its last inserts."""
    ends = []
    for place, (state, cost) in enumerate(alive):
        ends += [(cost + more, place, letters) for at, more, letters in _inserts(state, costs) if at in (START, A)]
    cost, place, letters = min(ends)
    return place, cost, letters


class Decoder:
    """Survivors of one conversation or piece; ``emit(letters, row)`` gets its edits in order."""

    def __init__(self, emit, costs: Costs, entry: int = START):
        self.emit, self.costs, self.cost, self.rows = emit, costs, 0, 0
        self.alive: Survivors = ((entry, 0),)
        # node: parent, letters, row, references
        self.root = [None, "", None, 1]
        self.nodes = [self.root]

    def row(self, initial: str, fault: int, row) -> None:
        rise, self.alive, origins = advance(self.alive, initial if initial in "sua" else "", fault, self.costs)
        self.cost += rise
        old, self.nodes = self.nodes, []
        for place, letters in origins:
            old[place][3] += 1
            self.nodes.append([old[place], letters, row, 1])
        for node in old:
            self._release(node)
        self.rows += 1
        if self.rows % LOOK == 0:
            self._settle(self.nodes[0])

    def _release(self, node: list) -> None:
        while node is not None:
            node[3] -= 1
            if node[3]:
                return
            node = node[0]

    def _settle(self, node: list) -> None:
        """Emit, from the root on, what all survivors share."""
        path = []
        while node is not self.root:
            path.append(node)
            node = node[0]
        while path and self.root[3] == 1:
            self.root = path.pop()
            self.root[0] = None
            self.emit(self.root[1], self.root[2])

    def end(self, state: int | None = None) -> None:
        """Take the survivor of ``state``, or the winner at the end of the conversation."""
        if state is None:
            place, more, letters = finish(self.alive, self.costs)
        else:
            place, letters = [s for s, _ in self.alive].index(state), ""
            more = self.alive[place][1]
        self.cost += more
        for other, node in enumerate(self.nodes):
            if other != place:
                self._release(node)
        self._settle(self.nodes[place])
        if letters:
            self.emit(letters, None)


class Counts:
    """Faults and gaps of a run of rows in order."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def row(self, turn: int | None, initial: str, fault: int) -> None:
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        self._pair(initial)
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def _pair(self, initial: str) -> None:
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1

    def join(self, other: Counts) -> None:
        """Add the run of rows that follows."""
        self.blank, self.duplicate = self.blank + other.blank, self.duplicate + other.duplicate
        self.truncated, self.illegal = self.truncated + other.truncated, self.illegal + other.illegal
        if other.first is not None:
            self._pair(other.first)
            self.last = other.last
        if other.low is not None:
            self.turns += other.turns - (other.low == self.high)
            self.low, self.high = other.low if self.low is None else self.low, other.high

    def values(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


class Audit:
    """Collects the letters and the digest of the repaired text, or its blocks."""

    def __init__(self, block_bytes: int = 0):
        self.letters, self.state, self.block_bytes = [], START, block_bytes
        self.digest, self.empty = (None if block_bytes else hashlib.sha256()), True
        self.block, self.size, self.blocks = [], 0, []

    def __call__(self, letters: str, row) -> None:
        self.letters.append(letters)
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                to, line = row[0][:1], f"{row[0]}:{row[1]}"
            else:
                to = FILL[self.state]
                line = f"{ROLES[to]}:{row[1] if letter == 'R' else ''}"
            self.state = NEXT[self.state, to]
            self._line(line.encode())

    def _line(self, line: bytes) -> None:
        if self.digest is not None:
            self.digest.update(line if self.empty else b"\n" + line)
        else:
            self.block.append(line)
            self.size += len(line) + 1
            if self.size >= self.block_bytes:
                self.flush()
        self.empty = False

    def flush(self) -> None:
        if self.block or self.letters:
            self.blocks.append(("".join(self.letters), b"\n".join(self.block) if self.block else None))
            self.letters, self.block, self.size = [], [], 0


class Messages(Audit):
    """Collects the repaired rows themselves, with the edit that each comes from (deleted ones too)."""

    def __init__(self, start: int = START):
        super().__init__()
        self.state, self.rows = start, []

    def __call__(self, letters: str, row) -> None:
        for letter in letters:
            if letter == "D":
                self.rows.append(("D", row[0], row[1]))
                continue
            to = row[0][:1] if letter == "K" else FILL[self.state]
            self.state = NEXT[self.state, to]
            self.rows.append((letter, row[0] if letter == "K" else ROLES[to], "" if letter == "I" else row[1]))


def copies_of(role: str, text: str, n: int, fault: int) -> Iterator[tuple[str, int, tuple[str, str]]]:
    """The n equal rows of one counted row: (initial, fault, row)."""
    row, initial = (role, text), role[:1]
    for i in range(n):
        yield initial, fault if i == 0 or fault == BLANK else DUPLICATE, row


# --- frames -----------------------------------------------------------------

def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault: distinct rows, range-partitioned and sorted.

    ``rows`` has conv_id, turn, role, text (no nulls in the last two) and copies (0: the row only names its conversation).
    """
    d = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    seen = rows.where(F.col("copies") > 0).where(F.col("text").rlike(f"[^{_SPACE}]"))
    firsts = (seen.groupBy("conv_id", d.alias("d"))
              .agg(F.max(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("lo"), F.max("turn").alias("hi"))
              .where("lo < hi or (untimed and lo is not null)"))
    # written: Spark then knows its bytes, and shuffles the texts only where the repeats are too many to broadcast
    firsts = written(firsts.select(F.col("conv_id").alias("_c"), "d", "untimed", "lo"), "repeats")
    distinct = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("untimed") | (F.col("turn") > F.col("lo"))), F.lit(False))
    fault = (F.when(~F.col("text").rlike(f"[^{_SPACE}]"), BLANK).when(later, DUPLICATE)
             .when(~F.col("text").rlike(f"[.!?][{_SPACE}]*\\z"), TRUNCATED).otherwise(CLEAN))
    return (distinct.withColumn("_d", d).join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_d") == F.col("d")), "left")
            .select("conv_id", "turn", "role", "text", "copies", fault.cast("int").alias("fault"))
            .repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
            .sortWithinPartitions("conv_id", "turn", "role", "text"))


_PIECE = "part long, seg long, counts array<string>, costs array<long>, ranks array<int>"
_RAW = "idx long, turn long, role string, text string, copies long, fault int"
_DONE = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
         "audit string, repaired_sha256 string")
_MESSAGE = "seq bigint, edit string, role string, text string"


class _Table:
    """The survivors' costs and order for every state that a piece may be entered in."""

    def __init__(self, costs: Costs):
        self.costs, self.entries = costs, [(0, ((e, 0),)) for e in range(4)]

    def row(self, initial: str, fault: int) -> None:
        initial = initial if initial in "sua" else ""
        for e, (total, alive) in enumerate(self.entries):
            rise, alive, _ = advance(alive, initial, fault, self.costs)
            self.entries[e] = total + rise, alive

    def flat(self) -> tuple[list, list]:
        cost, rank = [None] * 16, [None] * 16
        for e, (total, alive) in enumerate(self.entries):
            for r, (s, c) in enumerate(alive):
                cost[4 * e + s], rank[4 * e + s] = total + c, r
        return cost, rank


def _first_pass(costs: Costs, bounds: Bounds, kind: str, messages: bool):
    schema = _arrow(_schema(kind, messages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out = _Out(schema, messages)
        seg, conv, held, size, open_ = -1, None, [], 0, False
        table = counts = None
        idx = 0

        def pass_on():
            """The held rows go on to the second pass; the tables take them in."""
            nonlocal held, size, idx
            for turn, role, text, copies, fault in held:
                for initial, f, _ in copies_of(role, text, copies, fault):
                    table.row(initial, f)
                    counts.row(turn, initial, f)
                out.raw(conv, part, seg, idx, turn, role, text, copies, fault)
                idx += 1
            held, size = [], 0

        def close(last: bool):
            nonlocal held, size
            if seg < 0:
                return
            if open_ or last or seg == 0:
                pass_on()
                out.piece(conv, part, seg, counts, table)
            else:
                out.done(conv, *_decode(held, costs, messages))
                held, size = [], 0

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")]
            for c, *row in zip(*columns):
                if seg < 0 or c != conv:
                    close(False)
                    conv, seg, open_, idx = c, seg + 1, False, 0
                    table, counts = _Table(costs), Counts()
                held.append(row)
                size += len(row[2])
                if size > bounds.whole:
                    open_ = True
                    pass_on()
                if out.full():
                    yield out.batch()
        close(True)
        yield out.batch()
    return run


def _decode(rows: list, costs: Costs, messages: bool) -> tuple:
    counts, sink = Counts(), Messages() if messages else Audit()
    decoder = Decoder(sink, costs)
    for turn, role, text, copies, fault in rows:
        for initial, f, row in copies_of(role, text, copies, fault):
            decoder.row(initial, f, row)
            counts.row(turn, initial, f)
    decoder.end()
    return counts, decoder.cost, sink


class _Out:
    """Rows of the first pass: decoded conversations, tables of pieces, and rows passed on."""

    def __init__(self, schema: pa.Schema, messages: bool):
        self.messages, self.schema = messages, schema
        self.rows, self.size = [], 0

    def _add(self, size: int, **values) -> None:
        self.rows.append(values)
        self.size += size + 100

    def done(self, conv, counts: Counts, cost: int, sink: Audit) -> None:
        if self.messages:
            for seq, (edit, role, text) in enumerate(sink.rows):
                self._add(len(text), what="done", conv_id=conv, seq=seq, edit=edit, role=role, text=text)
        else:
            gaps, blank, duplicate, truncated, illegal = counts.values()
            self._add(len(sink.letters), what="done", conv_id=conv, gaps=gaps, blank=blank, duplicate=duplicate, truncated=truncated,
                      illegal=illegal, cost=cost, audit="".join(sink.letters), repaired_sha256=sink.digest.hexdigest())

    def piece(self, conv, part, seg, counts: Counts, table: _Table) -> None:
        cost, rank = table.flat()
        self._add(500, what="piece", conv_id=conv, part=part, seg=seg, costs=cost, ranks=rank,
                  counts=[None if (v := getattr(counts, f)) is None else str(v) for f in Counts.FIELDS])

    def raw(self, conv, part, seg, idx, turn, role, text, copies, fault) -> None:
        self._add(len(text), what="row", conv_id=conv, part=part, seg=seg, idx=idx, turn=turn, role=role, text=text,
                  copies=copies, fault=fault)

    def full(self) -> bool:
        return self.size > 4 << 20

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.size = self.rows, [], 0
        return pa.RecordBatch.from_pylist(rows, schema=self.schema)


def _arrow(fields: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(fields))


def _schema(kind: str, messages: bool) -> str:
    extra = "seq bigint, edit string" if messages else _DONE
    return f"what string, conv_id {kind}, {_PIECE}, {_RAW}, {extra}"


def plan(pieces: list, costs: Costs) -> dict[tuple[int, int], tuple]:
    """(part, seg) -> (entry, exit, final letters, first piece?, last piece?, total cost, counts of the whole conversation).

    ``pieces`` are the piece rows of all conversations, in any order.
    """
    groups: dict = {}
    for p in sorted(pieces, key=lambda p: (p["part"], p["seg"])):
        groups.setdefault(p["conv_id"], []).append(p)
    out = {}
    for run in groups.values():
        # rest[i][s]: least cost from state s at the start of piece i to the end
        rest = [[None] * 4 for _ in run] + [[2 * costs.insert, 2 * costs.insert, costs.insert, 0]]
        rest[-1][START] = 0
        for i in range(len(run) - 1, -1, -1):
            for e in range(4):
                ways = [c + rest[i + 1][s] for s, c in enumerate(run[i]["costs"][4 * e:4 * e + 4]) if c is not None]
                rest[i][e] = min(ways)
        counts = Counts()
        for p in run:
            counts.join(_counts(p["counts"]))
        state = START
        for i, p in enumerate(run):
            ways = [(c + rest[i + 1][s], p["ranks"][4 * state + s], s)
                    for s, c in enumerate(p["costs"][4 * state:4 * state + 4]) if c is not None]
            to = min(ways)[2]
            last = i == len(run) - 1
            letters = finish(((to, 0),), costs)[2] if last else ""
            out[p["part"], p["seg"]] = (state, to, letters, i, last, rest[0][START], counts.values())
            state = to
    return out


def _counts(values: list) -> Counts:
    c = Counts()
    for name, v in zip(Counts.FIELDS, values):
        setattr(c, name, v if name in ("first", "last") or v is None else int(v))
    return c


def _pieces(rows: DataFrame, plans: dict, costs: Costs, bounds: Bounds, kind: str, messages: bool) -> DataFrame:
    """Blocks (or messages) of the pieces, decoded side by side."""
    shared = rows.sparkSession.sparkContext.broadcast(plans)
    fields = f"conv_id {kind}, " + ("piece bigint, seq bigint, edit string, role string, text string" if messages else
                                    "piece bigint, block bigint, letters string, body binary, cost bigint, counts array<bigint>")

    schema = _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, key, conv, decoder, sink, sent = shared.value, None, None, None, None, 0

        def rows_of(final: bool) -> list[dict]:
            nonlocal sent
            entry, to, letters, i, last, cost, counts = plans[key]
            if final:
                decoder.end(to)
                if letters:
                    sink(letters, None)
            if messages:
                got, sink.rows = sink.rows, []
                out = [dict(conv_id=conv, piece=i, seq=sent + j, edit=e, role=r, text=t) for j, (e, r, t) in enumerate(got)]
            else:
                if final:
                    sink.flush()
                got, sink.blocks = sink.blocks, []
                if final and not sent and not got:
                    got = [("", None)]
                out = [dict(conv_id=conv, piece=i, block=sent + j, letters=a, body=b, cost=cost, counts=counts)
                       for j, (a, b) in enumerate(got)]
            sent += len(out)
            return out

        for batch in batches:
            names = ("conv_id", "part", "seg", "role", "text", "copies", "fault")
            for c, part, seg, role, text, copies, fault in zip(*(batch.column(n).to_pylist() for n in names)):
                if (part, seg) != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pylist(rows_of(True), schema=schema)
                    key, conv, sent = (part, seg), c, 0
                    entry = plans[key][0]
                    sink = Messages(entry) if messages else Audit(bounds.block)
                    sink.state = entry
                    decoder = Decoder(sink, costs, entry)
                for initial, f, row in copies_of(role, text, copies, fault):
                    decoder.row(initial, f, row)
                if (len(sink.rows) > 5000) if messages else sink.blocks:
                    yield pa.RecordBatch.from_pylist(rows_of(False), schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist(rows_of(True), schema=schema)

    # pieces of one conversation go to different tasks; a piece is at most one task's share of the rows
    return (rows.repartition("part", "seg").sortWithinPartitions("part", "seg", "idx")
            .select("conv_id", "part", "seg", "role", "text", "copies", "fault").mapInArrow(run, fields))


def _joined(blocks: DataFrame, kind: str) -> DataFrame:
    """One row per conversation from its blocks, which stream through one task in order."""
    fields = f"conv_id {kind}, {_DONE}"

    schema = _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, started = None, None, False

        def row():
            letters, digest, _, cost, (gaps, blank, duplicate, truncated, illegal) = state
            return pa.RecordBatch.from_pylist([dict(
                conv_id=conv, gaps=gaps, blank=blank, duplicate=duplicate, truncated=truncated, illegal=illegal, cost=cost,
                audit="".join(letters), repaired_sha256=digest.hexdigest())], schema=schema)

        for batch in batches:
            columns = [batch.column(n) for n in ("conv_id", "letters", "body", "cost", "counts")]
            for i in range(batch.num_rows):
                c, letters, body, cost, counts = (x[i].as_py() for x in columns)
                if not started or c != conv:
                    if started:
                        yield row()
                    conv, started, state = c, True, [[], hashlib.sha256(), True, cost, counts]
                state[0].append(letters)
                if body is not None:
                    state[1].update(body if state[2] else b"\n" + body)
                    state[2] = False
        if started:
            yield row()

    return (blocks.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "block")
            .select("conv_id", "letters", "body", "cost", "counts").mapInArrow(run, fields))


def _solved(rows: DataFrame, costs: Costs, bounds: Bounds, messages: bool) -> tuple[DataFrame, DataFrame]:
    kind = dict(rows.dtypes)["conv_id"]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copies")
    first = written(ordered(rows).mapInArrow(_first_pass(costs, bounds, kind, messages), _schema(kind, messages)), "conversations")
    plans = plan(first.where("what = 'piece'").select("conv_id", "part", "seg", "counts", "costs", "ranks").collect(), costs)
    return first.where("what = 'done'"), _pieces(first.where("what = 'row'"), plans, costs, bounds, kind, messages)


def repair(rows: DataFrame, costs: Costs = Costs(), bounds: Bounds = Bounds()) -> DataFrame:
    """Per conversation: gaps, faults, illegal pairs, cost, audit and the repaired text's SHA-256."""
    done, blocks = _solved(rows, costs, bounds, False)
    kind = dict(rows.dtypes)["conv_id"]
    names = ["conv_id", *(f.split()[0] for f in _DONE.split(", "))]
    return done.select(*names).unionByName(_joined(blocks, kind).select(*names))


def repaired_messages(rows: DataFrame, costs: Costs = Costs(), bounds: Bounds = Bounds()) -> DataFrame:
    """The repaired rows: conv_id, piece, seq (order within the piece), edit, role, text; deleted rows carry edit D."""
    done, pieces = _solved(rows, costs, bounds, True)
    return done.select("conv_id", F.lit(0).cast("bigint").alias("piece"), "seq", "edit", "role", "text").unionByName(pieces)


def plain(conversations: DataFrame) -> DataFrame:
    """Undamaged input of ``repair``: nulls in role and text are one space, every row once."""
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The fixed damage, by crc32 of ``conv_id:turn`` modulo 20; a dropped row stays with no copies."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = plain(conversations).withColumn("fate", F.crc32(key) % 20)
    gone = F.col("fate") == 0
    text = (F.when(gone | (F.col("fate") == 1), "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    role = F.when(gone, "").when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"),
                       F.when(gone, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


#: DuckDB statement for repair(damaged(conversations)).
ORACLE = """
WITH RECURSIVE crc AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(4294967295, list_reduce([4294967295] || list_transform(string_split(
                coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS fate
      FROM conversations, crc),
c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
x AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
      FROM f WHERE fate <> 0),
y AS (SELECT cid, turn, role, text, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy) AS i
      FROM x JOIN c ON x.conv_id IS NOT DISTINCT FROM c.conv_id),
z AS (SELECT *, left(role, 1) AS r,
        CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 3
             WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 2
             WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 1 ELSE 0 END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) || left(role, 1) AS pair
      FROM y),
stats AS (SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM z GROUP BY cid),
ins(st, mid, more, letters, body) AS (VALUES
    ('0', '0', 0, '', ''), ('0', 'u', 5, 'I', chr(10) || 'user:'), ('0', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    ('s', 's', 0, '', ''), ('s', 'u', 5, 'I', chr(10) || 'user:'), ('s', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    ('u', 'u', 0, '', ''), ('u', 'a', 5, 'I', chr(10) || 'assistant:'), ('u', 'u', 10, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'),
    ('a', 'a', 0, '', ''), ('a', 'u', 5, 'I', chr(10) || 'user:'), ('a', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
go(mid, sign, st) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
v AS (
    SELECT cid, CAST(0 AS BIGINT) AS i, '0' AS st, {'cost': CAST(0 AS BIGINT), 'audit': '', 'body': ''} AS best FROM c
    UNION ALL
    SELECT cid, i, st, min(best) FROM (
        SELECT v.cid, z.i, e.st, {'cost': CAST(v.best.cost + ins.more + e.price AS BIGINT), 'audit': v.best.audit || ins.letters || e.letter,
                                  'body': v.best.body || ins.body || e.line} AS best
        FROM v JOIN z ON v.cid = z.cid AND z.i = v.i + 1 JOIN ins ON ins.st = v.st,
             LATERAL (SELECT ins.mid AS st, 2 AS price, 'D' AS letter, '' AS line
                      UNION ALL SELECT go.st, 5 * z.fault, 'K', chr(10) || z.role || ':' || z.text
                                FROM go WHERE go.mid = ins.mid AND go.sign = z.r AND z.fault < 2
                      UNION ALL SELECT go.st, 1 + 5 * z.fault, 'R',
                                       chr(10) || CASE go.sign WHEN 'u' THEN 'user:' ELSE 'assistant:' END || z.text
                                FROM go WHERE go.mid = ins.mid AND go.sign <> 's' AND z.fault < 2) e)
    GROUP BY cid, i, st),
w AS (SELECT v.cid, min({'cost': CAST(v.best.cost + ins.more AS BIGINT), 'audit': v.best.audit || ins.letters, 'body': v.best.body || ins.body}) AS best
      FROM v JOIN ins ON ins.st = v.st AND ins.mid IN ('0', 'a') LEFT JOIN stats USING (cid)
      WHERE v.i = coalesce(stats.n, 0) GROUP BY v.cid)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, w.best.cost AS cost, w.best.audit AS audit,
       sha256(substr(w.best.body, 2)) AS repaired_sha256
FROM c JOIN w USING (cid) LEFT JOIN stats USING (cid)
"""
