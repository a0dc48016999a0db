"""Cheapest repair of damaged conversations, by a run-length dynamic program over role and fault symbols.

Each row of a conversation has one symbol: its role's initial (s, u, a or another) and its first fault: blank, a
repetition of an earlier row, or truncated. A repaired conversation is empty, or an optional system row and then pairs of user and
assistant. Editing is a walk through the four states of that pattern, so a row is a 4 x 4 matrix of least costs (min-plus),
a run of n equal symbols its n-th power, made of cached binary powers, and a stretch of rows a product. From the costs
to go behind a run, the choices within it are unrolled row by row, always the letter that is least in ASCII order
among the cheapest, which gives the least audit.

A conversation may hold any share of all rows. Rows are dealt by range of (conversation, turn) into chunks; matrices are
multiplied per chunk, and only the one or two conversations at the edges of a chunk need more: a scan over their matrices
gives the costs behind each chunk, a second one the state in which each chunk is entered. Repetitions are found
by the first place of each (conversation, digest of role and text), counted with partial sums and led back by place.
Repaired rows come in pieces of bounded size; a digest over a whole conversation has to read its pieces one after the other.

Null roles and texts count as one blank. Rows of a null conversation id are one conversation. Null turns come
first and count for no gap; rows of equal turn go by role, then by the digest of role and text; rows alike in all of these
have no order that could show. Very long texts are handled whole. An empty table gives empty results. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .common import Stored

#: Fixed values of the cost model.
RECAST, DROP, ADD, CUT_SHORT = 1, 2, 5, 5
FAULTS = ("none", "blank", "duplicate", "truncated")
#: States: nothing yet, after system, after user, after assistant. Only the first and the last may end it.
STATES = range(4)
_FAR = 1 << 40
#: Where a user or assistant row leads, and which of the two it must be.
_ONWARD = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
#: Cost of ending in each state with added rows.
END = (0, 2 * ADD, ADD, 0)

#: Bounds of one piece of repaired rows.
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 20

BLANK_CHARACTERS = " \t\n\x0b\x0c\r"
_PLACES = 33  # bits of a row's number within its chunk

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


# --- costs --------------------------------------------------------------------------------------


def times(one: Matrix, two: Matrix) -> Matrix:
    return tuple(tuple(min(row[k] + two[k][j] for k in STATES) for j in STATES) for row in one)


def behind(matrix: Matrix, costs: Vector) -> Vector:
    """Costs to go before some rows, from those behind them."""
    return tuple(min(row[k] + costs[k] for k in STATES) for row in matrix)


IDENTITY: Matrix = tuple(tuple(0 if i == j else _FAR for j in STATES) for i in STATES)
_ONE_ADDED: Matrix = tuple(tuple(0 if i == j else ADD if _ONWARD[i][0] == j else _FAR for j in STATES) for i in STATES)
_ADDED = times(times(_ONE_ADDED, _ONE_ADDED), _ONE_ADDED)


def options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done to one row, letters in order."""
    role, fault = symbol >> 2, symbol & 3
    found = [("D", DROP, state)]
    if fault in (1, 2):
        return found
    more = CUT_SHORT if fault == 3 else 0
    onward, wanted = _ONWARD[state]
    if role == 0 and state == 0:
        found.append(("K", more, 1))
    elif (role, wanted) in ((1, "user"), (2, "assistant")):
        found.append(("K", more, onward))
    found.append(("R", RECAST + more, onward))
    return found


@functools.cache
def power(symbol: int, exponent: int) -> Matrix:
    """The 2**exponent-th power of a symbol's matrix; rows are added before a row only."""
    if exponent:
        half = power(symbol, exponent - 1)
        return times(half, half)
    own = [[_FAR] * 4 for _ in STATES]
    for state in STATES:
        for _, cost, onward in options(symbol, state):
            own[state][onward] = min(own[state][onward], cost)
    return times(_ADDED, tuple(map(tuple, own)))


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, how often in a row)."""
    values = np.frombuffer(symbols, dtype=np.uint8)
    if not len(values):
        return []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
    return list(zip(values[starts].tolist(), np.diff(np.append(starts, len(values))).tolist()))


def before_run(symbol: int, count: int, costs: Vector) -> Vector:
    """Costs to go before a run of equal symbols."""
    exponent = 0
    while count:
        if count & 1:
            costs = behind(power(symbol, exponent), costs)
        count >>= 1
        exponent += 1
    return costs


def product(symbols: bytes) -> Matrix:
    """The matrix of a stretch of rows."""
    columns = []
    for state in STATES:
        costs = tuple(0 if k == state else _FAR for k in STATES)
        for symbol, count in reversed(runs_of(symbols)):
            costs = before_run(symbol, count, costs)
        columns.append(costs)
    return tuple(zip(*columns))


def whole_cost(symbols: bytes) -> int:
    costs: Vector = END
    for symbol, count in reversed(runs_of(symbols)):
        costs = before_run(symbol, count, costs)
    return costs[0]


def _level(costs: Vector) -> Vector:
    least = min(costs)
    return tuple(cost - least for cost in costs)


@functools.cache
def _step(symbol: int, costs: Vector) -> Vector:
    return _level(behind(power(symbol, 0), costs))


@functools.cache
def choice(symbol: int, after: Vector, state: int) -> tuple[str, int]:
    """The letters for one row, those of rows added before it first, and the state behind it."""
    before = behind(power(symbol, 0), after)
    letters = ""
    while True:
        done = {letter: onward for letter, cost, onward in options(symbol, state) if cost + after[onward] == before[state]}
        onward = _ONWARD[state][0]
        if "D" not in done and ADD + before[onward] == before[state]:
            letters, state = letters + "I", onward
            continue
        letter = min(done)
        return letters + letter, done[letter]


def unroll(symbols: bytes, after: Vector, state: int) -> tuple[list[str], int]:
    """The letters for each row and the state behind the last, given the costs to go there and the state before the first.

    Costs are first carried back from run to run, then each run is unrolled from its own end.
    """
    runs = runs_of(symbols)
    ends = []
    for symbol, count in reversed(runs):
        ends.append(after)
        after = _level(before_run(symbol, count, after))
    letters: list[str] = []
    for (symbol, count), costs in zip(runs, reversed(ends)):
        costs = _level(costs)
        inner = [costs]
        for _ in range(count - 1):
            inner.append(_step(symbol, inner[-1]))
        for costs in reversed(inner):
            done, state = choice(symbol, costs, state)
            letters.append(done)
    return letters, state


def ending(state: int) -> str:
    """Letters of the rows added behind the last."""
    return "I" * (END[state] // ADD)


@functools.lru_cache(1 << 16)
def _short_unrolled(symbols: bytes) -> tuple[list[str], str]:
    letters, state = unroll(symbols, END, 0)
    return letters, ending(state)


_ALLOWED = np.zeros((5, 5), dtype=bool)
_ALLOWED[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au


def tally(symbols: bytes) -> list[int]:
    """blank, duplicate, truncated and illegal of a stretch of rows."""
    values = np.frombuffer(symbols, dtype=np.uint8)
    faults, roles = values & 3, values >> 2
    return [int((faults == k).sum()) for k in (1, 2, 3)] + [int((~_ALLOWED[roles[:-1], roles[1:]]).sum())]


@functools.lru_cache(1 << 16)
def _short_stats(symbols: bytes) -> tuple[int, ...]:
    return (*tally(symbols), whole_cost(symbols))


def _wrapped(value: int) -> int:
    """As a signed 64-bit integer."""
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


# --- Spark --------------------------------------------------------------------------------------


def _fields(conv: T.DataType, *more: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(", ".join(more)).fields])


_STATS = ("gaps long", "blank long", "duplicate long", "truncated long", "illegal long", "cost long")
_SEGMENT = (
    "place long", "edge boolean", "symbols binary", "matrix array<long>", "low long", "high long", "turns long", *_STATS,
)
_PLAN = ("place long", "after array<long>", "state int", "whole boolean", "last boolean", *_STATS)


class _Segment:
    """The rows of one conversation in one chunk."""

    def __init__(self, conv, place: int) -> None:
        self.conv, self.place, self.first = conv, place, False
        self.symbols: list[bytes] = []
        self.low = self.high = None
        self.turns = 0

    def add(self, symbols: bytes, turns: np.ndarray) -> None:
        """More rows, and their turns in order, nulls left out."""
        self.symbols.append(symbols)
        if len(turns):
            self.turns += int((np.diff(turns) != 0).sum()) + int(self.high is None or turns[0] != self.high)
            self.low = int(turns[0]) if self.low is None else self.low
            self.high = int(turns[-1])

    def row(self, last: bool) -> dict:
        symbols = b"".join(self.symbols)
        edge = self.first or last
        own = _short_stats(symbols) if len(symbols) < 64 else (*tally(symbols), whole_cost(symbols))
        gaps = _wrapped(self.high - self.low + 1 - self.turns) if self.turns else 0
        stats = dict(zip([name.split()[0] for name in _STATS], (gaps, *own)))
        matrix = [cost for row in product(symbols) for cost in row] if edge else None
        return {
            "conv": self.conv, "place": self.place, "edge": edge, "symbols": symbols, "matrix": matrix,
            "low": self.low, "high": self.high, "turns": self.turns, **stats,
        }


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _segments(schema: pa.Schema):
    """Rows (place, conv, turn, code), in order, some led by a mark of being the first of their kind, to segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Segment | None = None
        marked, chunk, out = False, None, []
        for batch in batches:
            place = batch.column("place").to_numpy(zero_copy_only=False)
            code = batch.column("code").to_numpy(zero_copy_only=False)
            if not len(code):
                continue
            led = np.concatenate([[marked], code[:-1] < 0])
            marked = bool(code[-1] < 0)
            rows = np.flatnonzero(code >= 0)
            if not len(rows):
                continue
            place, symbol = place[rows], code[rows].copy()
            symbol[(symbol & 3 != 1) & ~led[rows]] &= ~3
            symbol[(code[rows] & 3 != 1) & ~led[rows]] |= 2
            symbols = symbol.astype(np.uint8).tobytes()
            convs = batch.column("conv").take(pa.array(rows))
            kind = convs.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            turns = batch.column("turn").take(pa.array(rows))
            has_turn = turns.is_valid().to_numpy(zero_copy_only=False)
            turns = turns.fill_null(0).to_numpy(zero_copy_only=False)
            chunks = place >> _PLACES
            cuts = np.flatnonzero((np.diff(kind) != 0) | (np.diff(chunks) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
                conv, own = convs[a].as_py(), int(chunks[a])
                if now is None or own != chunk or conv != now.conv:
                    if now is not None:
                        out.append(now.row(last=own != chunk))
                    now = _Segment(conv, int(place[a]))
                    now.first, chunk = own != chunk, own
                now.add(symbols[a:b], turns[a:b][has_turn[a:b]])
            if len(out) >= 4096:
                yield _table(out, schema)
                out = []
        if now is not None:
            out.append(now.row(last=True))
        if out:
            yield _table(out, schema)

    return run


def _by_conversation(batches: Iterator[pa.RecordBatch], use) -> Iterator[list[dict]]:
    """``use`` of the rows of each conversation at the edge of chunks; there is one row for each chunk that it meets."""
    own: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if own and row["conv"] != own[0]["conv"]:
                yield use(own)
                own = []
            own.append(row)
    if own:
        yield use(own)


def _costs_behind(schema: pa.Schema):
    def costs(rows: list[dict]) -> list[dict]:
        after: Vector = END
        found = []
        for row in reversed(rows):
            found.append({"conv": row["conv"], "place": row["place"], "symbols": row["symbols"], "after": list(after)})
            matrix = tuple(tuple(row["matrix"][4 * i : 4 * i + 4]) for i in STATES)
            after = behind(matrix, after)
        for row in found:
            row["total"] = after[0]
        return found[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_conversation(batches, costs):
            yield _table(rows, schema)

    return run


def _ways_through(schema: pa.Schema):
    """The state behind a stretch for each state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ways = [unroll(row["symbols"], tuple(row["after"]), state)[1] for state in STATES]
                yield _table([{"place": row["place"], "ways": ways}], schema)

    return run


def _states_before(schema: pa.Schema):
    """State before each stretch, and the sums of the whole conversation with its first."""

    def states(rows: list[dict]) -> list[dict]:
        found, state = [], 0
        names = [name.split()[0] for name in _STATS]
        sums = {name: sum(row[name] for row in rows) for name in names}
        sums["cost"] = rows[0]["total"]
        sums["illegal"] += sum(
            not _ALLOWED[one["symbols_last"] >> 2, two["symbols_first"] >> 2] for one, two in zip(rows, rows[1:])
        )
        timed = [row for row in rows if row["turns"]]
        turns = sum(row["turns"] for row in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
        sums["gaps"] = _wrapped(timed[-1]["high"] - timed[0]["low"] + 1 - turns) if timed else 0
        for at, row in enumerate(rows):
            found.append({
                "conv": row["conv"], "place": row["place"], "after": row["after"], "state": state,
                "whole": len(rows) == 1, "last": at == len(rows) - 1, **(sums if at == 0 else dict.fromkeys(names)),
            })
            state = row["ways"][state]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_conversation(batches, states):
            yield _table(rows, schema)

    return run


class _Piecewise:
    """Repaired rows of one stretch, given away in pieces of bounded size."""

    def __init__(self, plan: dict) -> None:
        self.conv, self.place, self.whole, self.plan = plan["conv"], plan["place"], plan["whole"], plan
        if plan["after"] is None and len(plan["symbols"]) < 64:
            self.letters, self.tail = _short_unrolled(plan["symbols"])
        else:
            after = END if plan["after"] is None else tuple(plan["after"])
            self.letters, state = unroll(plan["symbols"], after, plan["state"] or 0)
            self.tail = ending(state) if plan["last"] is not False else ""
        self.state, self.at = plan["state"] or 0, 0
        self._empty()

    def _empty(self) -> None:
        self.edits: list[str] = []
        self.lines: list[dict] = []
        self.size = 0

    def _edit(self, letter: str, role: str = "", text: str = "") -> None:
        self.edits.append(letter)
        if letter == "D":
            return
        onward, wanted = _ONWARD[self.state]
        if letter == "K" and role[:1] == "s":
            onward = 1
        self.state = onward
        self.lines.append({"role": role if letter == "K" else wanted, "text": text})
        self.size += len(text) + len(role)

    def row(self, place: int, role: str, text: str) -> list[dict]:
        for letter in self.letters[self.at]:
            self._edit(letter, *((role, text) if letter != "I" else ()))
        self.at += 1
        if self.at == len(self.letters) or (len(self.edits) < PIECE_ROWS and self.size < PIECE_CHARS):
            return []
        self.whole = False
        return self.piece(place)

    def piece(self, place: int) -> list[dict]:
        done = [{"conv": self.conv, "place": place, "whole": self.whole, "edits": "".join(self.edits), "lines": self.lines}]
        self._empty()
        return done

    def end(self, place: int) -> list[dict]:
        for letter in self.tail:
            self._edit(letter)
        return self.piece(place)


def _pieces(schema: pa.Schema):
    """Rows in order, each stretch led by its plan, to pieces of repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Piecewise | None = None
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    now = _Piecewise(row)
                    continue
                made = now.row(row["place"], row["role"], row["text"])
                size += len(row["text"])
                if now.at == len(now.letters):
                    made += now.end(row["place"])
                out += made
                if size > 4 * PIECE_CHARS:
                    yield _table(out, schema)
                    out, size = [], 0
            if out:
                yield _table(out, schema)

    return run


def _joined(schema: pa.Schema):
    """Audit and digest of conversations in several pieces, one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits, digest, fresh = None, [], None, True
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in ("conv", "edits", "lines")}
                if digest is not None and row["conv"] != conv:
                    yield _table([{"conv": conv, "audit": "".join(edits), "repaired_sha256": digest.hexdigest()}], schema)
                    digest = None
                if digest is None:
                    conv, edits, digest, fresh = row["conv"], [], hashlib.sha256(), True
                edits.append(row["edits"])
                for line in row["lines"]:
                    digest.update(("" if fresh else "\n").encode() + f"{line['role']}:{line['text']}".encode())
                    fresh = False
        if digest is not None:
            yield _table([{"conv": conv, "audit": "".join(edits), "repaired_sha256": digest.hexdigest()}], schema)

    return run


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANK_CHARACTERS))


def marked(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with a code of role and own faults (repetitions are not known yet) and a digest of role and text."""
    rows = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    bare = _bare(F.col("text"))
    fault = F.when(bare == "", 1).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")
    return rows.withColumn("code", (kind * 4 + fault).cast("int")).withColumn("digest", F.unhex(F.sha2(whole, 256)))


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Pieces of repaired rows, and the figures of each conversation that has rows.

    Pieces: conv, place (in order), whole (the only piece of its conversation), edits (letters K, R, D, I) and lines
    (roles and texts). Figures: conv, gaps, blank, duplicate, truncated, illegal and cost.
    """
    stored = Stored(rows.sparkSession, "conversation-repair")
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "tie"]
    placed = marked(rows, conv, turn, role, text).withColumn("tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored.keep(placed.withColumn("place", F.monotonically_increasing_id()).drop("tie"), "placed")
    kind = placed.schema["conv"].dataType
    chunk = F.shiftright("place", _PLACES)

    first = placed.where((F.col("code").bitwiseAND(3)) != 1).groupBy("conv", "digest").agg(F.min("place").alias("place"))
    first = first.select("place", "conv", F.lit(None).cast("long").alias("turn"), F.lit(-1).alias("code"))
    marks = placed.select("place", "conv", "turn", "code").unionByName(first)
    marks = marks.repartition(chunk).sortWithinPartitions("place", "code")
    shape = _fields(kind, *_SEGMENT)
    segments = stored.keep(marks.mapInArrow(_segments(_arrow(shape)), shape), "segments")

    edges = segments.where("edge")
    shape = _fields(kind, "place long", "symbols binary", "after array<long>", "total long")
    grouped = edges.repartition("conv").sortWithinPartitions("conv", "place")
    behind_ = stored.keep(grouped.mapInArrow(_costs_behind(_arrow(shape)), shape), "behind")
    shape = T.StructType.fromDDL("place long, ways array<int>")
    ways = behind_.select("place", "symbols", "after").mapInArrow(_ways_through(_arrow(shape)), shape)
    shape = _fields(kind, *_PLAN)
    ends = F.conv(F.hex(F.substring("symbols", 1, 1)), 16, 10).cast("int").alias("symbols_first")
    last = F.conv(F.hex(F.substring("symbols", -1, 1)), 16, 10).cast("int").alias("symbols_last")
    edges = edges.select("*", ends, last).drop("symbols", "matrix", "edge")
    edges = edges.join(behind_.select("place", "after", "total"), "place").join(ways, "place")
    edges = edges.repartition("conv").sortWithinPartitions("conv", "place")
    plan = stored.keep(edges.mapInArrow(_states_before(_arrow(shape)), shape), "plan")

    led = segments.select("place", "conv", "symbols").join(
        plan.select("place", "after", "state", "whole", "last"), "place", "left"
    )
    led = led.withColumn("whole", F.coalesce("whole", F.lit(True))).withColumn("kind", F.lit(0))
    texts = placed.select("place", "role", "text", F.lit(1).alias("kind"))
    both = led.unionByName(texts, allowMissingColumns=True).repartition(chunk).sortWithinPartitions("place", "kind")
    shape = _fields(kind, "place long", "whole boolean", "edits string", "lines array<struct<role:string,text:string>>")
    pieces = stored.keep(both.mapInArrow(_pieces(_arrow(shape)), shape), "pieces")

    names = ["conv", *(name.split()[0] for name in _STATS)]
    figures = segments.where("NOT edge").select(names).unionByName(plan.where("blank IS NOT NULL").select(names))
    stored.drop("placed", "behind")
    return pieces, figures


def digests(pieces: DataFrame) -> DataFrame:
    """Columns conv, audit and repaired_sha256 (of ``role:text`` lines). Conversations in one piece need no shuffle."""
    line = F.transform("lines", lambda line: F.concat(line["role"], F.lit(":"), line["text"]))
    whole = pieces.where("whole").select(
        "conv",
        F.col("edits").alias("audit"),
        F.sha2(F.array_join(line, "\n").cast("binary"), 256).alias("repaired_sha256"),
    )
    shape = _fields(pieces.schema["conv"].dataType, "audit string", "repaired_sha256 string")
    cut = pieces.where("NOT whole").repartition("conv").sortWithinPartitions("conv", "place")
    return whole.unionByName(cut.select("conv", "edits", "lines").mapInArrow(_joined(_arrow(shape)), shape))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows, a quarter of them damaged by the hash of their conversation and turn; nulls count as one blank.

    Of twenty hash values, 0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 doubles it, 4 makes it the user's.
    """
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)
    )
    rows = rows.select("conv_id", "turn", "role", "text", F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("fate"))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = rows.where("fate <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all conversations, damaged by the hash of each row and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pieces, figures = repair(damaged(rows))
    found = figures.join(
        digests(pieces).withColumnRenamed("conv", "own"), F.col("conv").eqNullSafe(F.col("own"))
    ).drop("own")
    known = rows.select("conv_id").distinct()
    found = known.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    none = {name.split()[0]: F.lit(0) for name in _STATS}
    none |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return found.select("conv_id", *(F.coalesce(F.col(name), other).alias(name) for name, other in none.items()))
