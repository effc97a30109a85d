"""Conversation structure repair by divide and conquer (operator 11).

Roles have to follow ``(system? (user assistant)+)?``. While a conversation is edited row by row
it is in one of four states: nothing yet, after the system, after a user, after an assistant. A
row is a step between states, a table of the cheapest edits from each state to each other one.
A forward vector holds, per state, the least cost so far and the rank of its edits in ASCII
order; a backward vector holds the least cost to the end. They meet in the middle of a
conversation: of the states with the least sum the one whose edits come first is the crossing,
and both halves are solved in the same way. Rows are never kept with a table of all costs, so
memory is linear. Two lists of edits up to the same row are never equal for two states, nor one
the beginning of the other, so ranks of beginnings decide every tie.

On Spark the rows are dealt by ranges of conversation and turn, so that a hot conversation is
split over tasks, and cut into pieces of at most ``PIECE`` rows. A conversation that lies
within one task and one piece is solved there. Pieces of other ones are steps as well, tables of
four by four; those of a conversation are few and are solved by the same function, then each
piece for itself between the states found.

Defined cases: null roles and texts are one space; a null ``conv_id`` is a conversation; rows
come by turn, nulls first, rows of one turn by role, then text; repeated rows are kept apart and
count as duplicates. Empty texts are blank. Only the four columns named below are read, other
columns of any name do not matter. No rows give no pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.llm.common import small_batches
from lorekeep.session import apart, cut_lineage

# Fixed values of the contract: costs of the edits, and of keeping a truncated row.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
ROLES = {"u": "user", "a": "assistant"}

# Rows and characters of a piece, at most, but for the row that reaches the bound.
PIECE = 4096
PIECE_CHARS = 8 << 20

# States are numbers: nothing yet, after s, after u, after a. Initial to next state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INFINITE = 1 << 62
FAULTS = ("", "blank", "duplicate", "truncated")

Step = Sequence[tuple[int, int, int, object]]


def _inserted(state: int) -> list[tuple[int, str]]:
    """States that inserted rows lead to, and the inserts; the start itself without any."""
    found, letters = {state: ""}, "I"
    while (follow := [t for c, t in NEXT[state].items() if c in ROLES and t not in found]):
        state = follow[0]
        found[state] = letters
        letters += "I"
    return list(found.items())


# Least cost from a state to the end, and the inserts that it takes.
CLOSING = {s: min(((len(w) * COSTS["I"], w) for t, w in _inserted(s) if t in (0, 3)), default=(INFINITE, "")) for s in range(4)}


@lru_cache(None)
def row_step(initial: str, fault: int) -> tuple[dict[tuple[int, int], str], Step]:
    """The cheapest edits of one row between two states, the first of them in ASCII order, and
    the same as a step: from, to, cost, place among the edits from the same state."""
    kept = TRUNCATED if FAULTS[fault] == "truncated" else 0
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for s in range(4):
        for m, before in _inserted(s):
            options = [(m, "D", COSTS["D"])]
            if FAULTS[fault] not in ("blank", "duplicate"):
                options += [(t, "R", COSTS["R"] + kept) for c, t in NEXT[m].items() if c in ROLES]
                options += [(t, "K", COSTS["K"] + kept) for c, t in NEXT[m].items() if c == initial]
            for t, letter, cost in options:
                edits = (len(before) * COSTS["I"] + cost, before + letter)
                best[s, t] = min(best.get((s, t), edits), edits)
    return {k: v[1] for k, v in best.items()}, tuple((s, t, *v) for (s, t), v in best.items())


Vector = list[tuple[int, int] | None]


def start_at(state: int) -> Vector:
    return [(0, 0) if s == state else None for s in range(4)]


def forward(vector: Vector, step: Step) -> Vector:
    """Cost and rank per state after one more step; None where a state is out of reach."""
    best: list[tuple | None] = [None] * 4
    for s, t, cost, place in step:
        if vector[s] is not None:
            key = (vector[s][0] + cost, vector[s][1], place)
            if best[t] is None or key < best[t]:
                best[t] = key
    order = sorted((b[1], b[2], t) for t, b in enumerate(best) if b is not None)
    out: Vector = [None] * 4
    for rank, (_, _, t) in enumerate(order):
        out[t] = (best[t][0], rank)
    return out


def backward(costs: list[int], step: Step) -> list[int]:
    """Least cost to the end per state before the step, from those after it."""
    out = [INFINITE] * 4
    for s, t, cost, _ in step:
        out[s] = min(out[s], cost + costs[t])
    return out


def _best(vector: Vector, after: Sequence[int]) -> int:
    """The state of least cost in all; of several the one whose edits come first."""
    return min((v[0] + after[s], v[1], s) for s, v in enumerate(vector) if v is not None)[2]


def crossings(steps: Sequence[Step], start: int, end: int | None = None) -> list[int]:
    """The states before, between and after the ``steps`` of the best edits, from ``start`` to
    ``end`` or, where that is not given, to the best end."""
    states = [start] * (len(steps) + 1)
    if end is None:
        vector = start_at(start)
        for step in steps:
            vector = forward(vector, step)
        end = _best(vector, [CLOSING[s][0] for s in range(4)])
    states[-1] = end
    todo = [(0, len(steps))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        vector, costs = start_at(states[low]), [0 if s == states[high] else INFINITE for s in range(4)]
        for step in steps[low:middle]:
            vector = forward(vector, step)
        for k in range(high - 1, middle - 1, -1):
            costs = backward(costs, steps[k])
        states[middle] = _best(vector, costs)
        todo += [(low, middle), (middle, high)]
    return states


def joined(steps: Sequence[Step]) -> Step:
    """Several steps as one: the cost between any two states, and the rank among the edits from
    the same state."""
    out = []
    for s in range(4):
        vector = start_at(s)
        for step in steps:
            vector = forward(vector, step)
        out += [(s, t, *v) for t, v in enumerate(vector) if v is not None]
    return tuple(out)


def fault_of(text: str, seen: bool) -> int:
    """The first fault of a row, a place in ``FAULTS``."""
    said = text.rstrip(SPACE)
    if not said:
        return 1
    return 2 if seen else 3 if said[-1] not in STOPS else 0


@lru_cache(1 << 14)
def _short(kinds: tuple[tuple[str, int], ...], start: int, end: int | None) -> tuple[tuple[str, ...], int]:
    return _solve(kinds, start, end)


def _solve(kinds: Sequence[tuple[str, int]], start: int, end: int | None) -> tuple[tuple[str, ...], int]:
    tables = [row_step(*kind) for kind in kinds]
    states = crossings([step for _, step in tables], start, end)
    return tuple(letters[pair] for (letters, _), pair in zip(tables, zip(states, states[1:]))), states[-1]


def edits_of(kinds: Sequence[tuple[str, int]], start: int = 0, end: int | None = None) -> tuple[tuple[str, ...], int]:
    """The edits up to and with each row, and the state after the last one."""
    return _short(tuple(kinds), start, end) if len(kinds) <= 64 else _solve(kinds, start, end)


PIECES = "part int, no int, whole boolean, turns array<long>, roles array<string>, texts array<string>"
SOLVED = (
    "part int, no int, whole boolean, blank long, duplicate long, truncated long, illegal long, cost long, "
    "edits array<struct<edit: string, turn: long, role: string, text: string, fault: string>>"
)


def _with_id(rows: DataFrame, rest: str) -> T.StructType:
    return T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(rest).fields])


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def _pieces(rows: DataFrame) -> DataFrame:
    """Sorted rows as pieces. ``whole``: the piece is a conversation; so it is where the
    conversation is neither the first nor the last one of its task, and not cut."""
    schema = _with_id(rows, PIECES)
    form = _arrow(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, chars = TaskContext.get().partitionId(), 0, 0
        now, first, cuts, held, ready = None, True, 0, ([], [], []), []
        ready_chars = 0

        def close(whole: bool) -> None:
            nonlocal no, chars, held, ready_chars
            ready.append((now[0], part, no, whole, *held))
            ready_chars += chars
            no, chars, held = no + 1, 0, ([], [], [])

        def out() -> pa.RecordBatch:
            nonlocal ready, ready_chars
            columns = [pa.array(c, f.type) for c, f in zip(zip(*ready), form)]
            ready, ready_chars = [], 0
            return pa.RecordBatch.from_arrays(columns, schema=form)

        for batch in batches:
            for key, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != key:
                    if now is not None:
                        close(not first and not cuts)
                        first = False
                    now, cuts = (key,), 0
                elif len(held[0]) >= PIECE or chars >= PIECE_CHARS:
                    close(False)
                    cuts += 1
                if ready_chars >= PIECE_CHARS or len(ready) >= 2000:
                    yield out()
                for column, value in zip(held, (turn, role, text)):
                    column.append(value)
                chars += len(text)
        if now is not None:
            close(False)
        if ready:
            yield out()

    return rows.mapInArrow(cut, schema)


def _kinds(roles: list[str], texts: list[str], again: set[int] | None) -> list[tuple[str, int]]:
    """Initial and fault of the rows of a piece; ``again``: rows seen earlier, where known."""
    kinds, seen = [], set()
    for k, row in enumerate(zip(roles, texts)):
        repeated = row in seen if again is None else k in again
        seen.add(row)
        kinds.append((row[0][:1], fault_of(row[1], repeated)))
    return kinds


def _repaired(edits: tuple[str, ...], state: int, turns: list, roles: list, texts: list, kinds: list) -> list[tuple]:
    """The edits with what they leave: edit, turn, role, text, fault."""
    out = []
    for letters, turn, role, text, (initial, fault) in zip(edits, turns, roles, texts, kinds):
        for letter in letters:
            if letter == "D":
                out.append(("D", turn, role, text, FAULTS[fault]))
                continue
            to = initial if letter == "K" else next(c for c in NEXT[state] if c in ROLES)
            state = NEXT[state][to]
            row = (None, ROLES[to], "", "") if letter == "I" else (turn, role if letter == "K" else ROLES[to], text, FAULTS[fault])
            out.append((letter, *row))
    return out


def _solved(pieces: DataFrame) -> DataFrame:
    """Pieces with their edits. Beside the columns of a piece: ``again`` (rows seen earlier in
    the conversation, null: not beyond the piece), ``start`` and ``end`` (states, null: those
    of a whole conversation), ``last``, and ``before``, the initial before the piece."""
    schema = _with_id(pieces, SOLVED)
    form = _arrow(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, flat, ends = [], [], [0]
            for piece in zip(*(c.to_pylist() for c in batch.columns)):
                key, part, no, whole, turns, roles, texts, again, start, end, last, before = piece
                kinds = _kinds(roles, texts, None if again is None else set(again))
                start = 0 if start is None else start
                edits, state = edits_of(kinds, start, end)
                found = _repaired(edits, start, turns, roles, texts, kinds)
                cost = sum(COSTS[e[0]] + (e[0] in "KR" and e[4] == "truncated") * TRUNCATED for e in found)
                if whole or last:
                    for _ in CLOSING[state][1]:
                        to = next(c for c in NEXT[state] if c in ROLES)
                        found.append(("I", None, ROLES[to], "", ""))
                        state = NEXT[state][to]
                        cost += COSTS["I"]
                counts = [sum(f == k for _, f in kinds) for k in (1, 2, 3)]
                initials = [i for i, _ in kinds] if before is None else [before, *(i for i, _ in kinds)]
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                rows.append((key, part, no, whole, *counts, illegal, cost))
                flat += found
                ends.append(len(flat))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), form)] if rows else [pa.array([], f.type) for f in list(form)[:-1]]
            fields = list(form.field("edits").type.value_type)
            values = [pa.array(c, f.type) for c, f in zip(zip(*flat), fields)] if flat else [pa.array([], f.type) for f in fields]
            edits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, fields=fields))
            yield pa.RecordBatch.from_arrays([*columns, edits], schema=form)

    return pieces.mapInArrow(solve, schema)


def _states(pieces: DataFrame) -> DataFrame:
    """``part, no, start, end, last, before`` of the pieces of conversations that have several:
    their steps are joined, and the conversations solved piece by piece."""
    narrow = T.StructType([pieces.schema["conv_id"], *T.StructType.fromDDL("part int, no int, step array<long>, initials array<string>").fields])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, part, no, roles, texts, again in zip(*(c.to_pylist() for c in batch.columns)):
                kinds = _kinds(roles, texts, set(again or ()))
                step = joined([row_step(*kind)[1] for kind in kinds])
                rows.append((key, part, no, [x for entry in step for x in entry], [kinds[0][0], kinds[-1][0]]))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow(narrow))], schema=_arrow(narrow))

    found = "part int, no int, start int, end int, last boolean, before string"
    form = _arrow(T.StructType.fromDDL(found))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            steps = [[tuple(h[2][k : k + 4]) for k in range(0, len(h[2]), 4)] for h in held]
            states = crossings(steps, 0)
            before = [None, *(h[3][1] for h in held[:-1])]
            rows = [(h[0], h[1], states[k], states[k + 1], k == len(held) - 1, before[k]) for k, h in enumerate(held)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form)

        for batch in batches:
            for key, *piece in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and now[0] != key:
                    yield out()
                    held = []
                now = (key,)
                held.append(piece)
        if held:
            yield out()

    steps = pieces.select("conv_id", "part", "no", "roles", "texts", "again").mapInArrow(summarise, narrow)
    dealt = steps.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return dealt.mapInArrow(resolve, found)


def repair(rows: DataFrame) -> DataFrame:
    """Pieces of repaired conversations from ``conv_id, turn, role, text``: ``conv_id``, the
    place of the piece (``part, no``), ``whole`` where it is all of the conversation, counts
    of its faults and illegal neighbours, ``cost``, and ``edits`` in order: edit (K, R, D or
    I), turn, role, text and fault. What is not deleted is the repaired conversation."""
    small_batches(rows.sparkSession)
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *text)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    pieces = cut_lineage(_pieces(rows.repartitionByRange(*order).sortWithinPartitions(*order)))
    pieces_open = pieces.filter("not whole")
    # Rows seen earlier in another piece: by a digest, the first of each stays.
    said = F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row")
    each = pieces_open.select("conv_id", "part", "no", said).select(
        "part", "no", "at",
        F.md5(F.to_json(F.struct(F.col("conv_id").cast("string").alias("c"), "row")).cast("binary")).alias("digest"),
    )
    place = F.struct("part", "no", "at")
    first = each.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = each.join(apart(first), "digest").filter(place != F.col("first")).groupBy("part", "no").agg(F.collect_list("at").alias("again"))
    known = cut_lineage(pieces_open.join(again, ["part", "no"], "left").withColumn("again", F.coalesce("again", F.array().cast("array<int>"))))
    given = ["conv_id", "part", "no", "whole", "turns", "roles", "texts", "again", "start", "end", "last", "before"]
    unknown = {"again": "array<int>", "start": "int", "end": "int", "last": "boolean", "before": "string"}
    closed = pieces.filter("whole").withColumns({c: F.lit(None).cast(t) for c, t in unknown.items()})
    return _solved(closed.select(*given).unionByName(known.join(_states(known), ["part", "no"]).select(*given)))


def damage(rows: DataFrame) -> DataFrame:
    """The contract's faults: by crc32 of ``conv_id:turn`` modulo 20, rows go, lose their text
    or their stops, come twice, or get the role of a user."""
    said = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    code = F.crc32(said.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.filter(code != 0).select(
        "conv_id",
        "turn",
        F.when(code == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def digests(rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` the contract's columns about the repair of ``damaged``. The
    hash of a text is one stream: pieces of a cut conversation pass one task in their order,
    one at a time."""
    solved = cut_lineage(repair(damaged))
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    audit = F.array_join(F.col("edits.edit"), "").alias("audit")
    said = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    rest = [*sums, audit, F.array_join(said, "\n").alias("said"), (F.size(said) > 0).alias("some")]
    whole = solved.filter("whole").select("conv_id", *rest).select("conv_id", *sums, "audit", F.sha2("said", 256).alias("repaired_sha256"))
    form = _arrow(whole.schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, letters, digest, begun = None, [0] * len(sums), [], hashlib.sha256(), False

        def out() -> pa.RecordBatch:
            row = (now[0], *total, "".join(letters), digest.hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, form)], schema=form)

        for batch in batches:
            for key, *counts, edits, text, some in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != key:
                    if now is not None:
                        yield out()
                    now, total, letters, digest, begun = (key,), [0] * len(sums), [], hashlib.sha256(), False
                total = [a + b for a, b in zip(total, counts)]
                letters.append(edits)
                if some:
                    digest.update((("\n" if begun else "") + text).encode())
                    begun = True
        if now is not None:
            yield out()

    cut = solved.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    found = whole.unionByName(cut.select("conv_id", *rest).mapInArrow(stream, whole.schema))
    kept = damaged.select("conv_id", "turn").distinct().groupBy("conv_id")
    turns = kept.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    every = rows.select("conv_id").distinct()
    for side in (turns, found):
        side = side.withColumnRenamed("conv_id", "__id")
        every = every.join(side, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    return every.select(
        "conv_id",
        *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("gaps", *sums)),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
