"""Repairing the structure of damaged conversations.

Each row gets its first fault: blank text, a repetition of an earlier role and
text, or an end without punctuation.  The cheapest edits that bring the roles
into the grammar ``(s?(ua)+)?`` (initials of system, user, assistant) are found
by dynamic programming over turn and grammar state: backwards the cost to go of
each state before each row, then a greedy walk forwards that takes the ASCII
least among the edits whose cost is tight.  Keep costs 0, Rerole (to the role
that the grammar expects) 2, Delete 3, Insert (that role, empty) 2, and 1 more
for a kept or reroled row without end; blank and repeated rows must go.

As Spark jobs: the program needs one letter a row, so rows are first reduced to
(conversation, turn, role, digest of the text) with their number; equal rows
meet in partial sums.  These are sorted in ranges of (conversation, turn, role,
digest): a hot conversation lies in many ranges, and each range boundary cuts at
most one conversation.  Of the at most 2 x partitions pieces of conversations
that are cut, tasks compute the costs between all states at both ends; chaining
these few numbers gives the state and the cost to go at every cut, and then all
pieces are walked on their own.  Texts are moved once, sorted within their
conversation, and stream past the edits; only the hash of one conversation,
which SHA-256 defines as a sequence, reads that conversation in one task, a row
at a time.

Defined results.  A null role or text is one space, so a null text is blank.
Null conversation ids are one conversation.  Rows are taken by turn, nulls
first; rows of one turn by role and then by the SHA-256 of the text, so equal
rows follow each other and all but the first are repetitions.  A role whose
initial is not s, u or a can be deleted or reroled only.  Empty tables give no
rows.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, total_parts

# White space, the ends of a sentence, the pairs of adjacent role initials that are legal.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = ("su", "ua", "au")
# The costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; where an expected role leads, and where a kept one does.
EXPECTED = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
ROLE_INTO = {2: "user", 3: "assistant"}
NEVER = 1 << 60


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with deterministic faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4
    makes it the user's; the others stay.  Nulls of role, text and within the
    hashed key are one space.
    """
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    given = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("_fault")).filter("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _given(rows: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    """The rows under the names used here, with the digest and the faults of the text."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    return rows.select("*", F.unhex(F.sha2("text", 256)).alias("digest"), (F.length(ended) == 0).alias("blank"), (~F.substring(ended, -1, 1).isin(*ENDS)).alias("truncated"))


def _reduced(given: DataFrame) -> DataFrame:
    """Distinct rows with their number ``n``; ``first`` if no earlier turn has the role and text."""
    rows = given.groupBy("conv", "turn", "role", "digest", "blank", "truncated").agg(F.count(F.lit(1)).alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min(turn)["turn"].alias("turn"))
    a, b = rows.alias("a"), firsts.select(*[F.col(c).alias(f"_{c}") for c in ("conv", "role", "digest", "turn")], F.lit(True).alias("first"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"_{c}")) for c in ("conv", "role", "digest", "turn")]
    return a.join(b, same[0] & same[1] & same[2] & same[3], "left").select("a.*", F.coalesce("first", F.lit(False)).alias("first"))


def _pieces(reduced: DataFrame) -> DataFrame:
    """A row for each conversation and range: its rows as letters, and what adjoins the next piece.

    The letters are s, u, a and o (another role), upper-case if truncated, and x
    for a row that must go.
    """
    keys = ["conv", "turn", "role", "digest"]
    kind = reduced.schema["conv"].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), ("part", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()),
                        ("letters", pa.string()), ("illegal", pa.int64()), ("left", pa.string()), ("right", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at: dict | None = None

        def out(pieces: list[dict]) -> pa.RecordBatch:
            for p in pieces:
                p["letters"] = "".join(p["letters"])
            return pa.RecordBatch.from_pylist(pieces, schema=schema)

        for batch in batches:
            done = []
            for conv, turn, role, digest, n, blank, truncated, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or at["conv"] != conv:
                    if at is not None:
                        done.append(at)
                    at = {"conv": conv, "part": part, "turn": turn, "role": role, "digest": digest, "letters": [], "illegal": 0, "left": role[:1], "right": None}
                letter = "x" if blank or not first else role[:1] if role[:1] in ("s", "u", "a") else "o"
                at["letters"].append((letter.upper() if truncated and letter != "x" else letter) + "x" * (n - 1))
                at["illegal"] += n - 1 + (at["right"] is not None and at["right"] + role[:1] not in LEGAL)
                at["right"] = role[:1]
            yield out(done)
        if at is not None:
            yield out([at])

    ranged = reduced.repartitionByRange(total_parts(reduced), *keys).sortWithinPartitions(*keys)
    return ranged.select(*keys, "n", "blank", "truncated", "first").mapInArrow(
        run, f"conv {kind.simpleString()}, part int, turn long, role string, digest binary, letters string, illegal long, left string, right string")


def _closed(c: Sequence[int]) -> tuple[int, int, int, int]:
    """Costs to go when roles may be inserted first."""
    two, three = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + two), min(c[1], INSERT + two), two, three


#: Costs to go after the last row: nothing, or an answered user, may stand there.
END = _closed((0, NEVER, NEVER, 0))


def costs_to_go(letters: str, end: Sequence[int] = END) -> list[array]:
    """Of each state the cost to go before every row and after the last, backwards."""
    out = [array("q", [c]) for c in end]
    c = tuple(end)
    for letter in reversed(letters):
        c = tuple(x + DELETE for x in c) if letter == "x" else _before(letter, c)
        c = _closed(c)
        for column, x in zip(out, c, strict=True):
            column.append(x)
    for column in out:
        column.reverse()
    return out


def _before(letter: str, c: Sequence[int]) -> tuple[int, ...]:
    extra = TRUNCATED if letter.isupper() else 0
    kept = KEPT[letter.lower()]
    return tuple(min(c[q] + DELETE, c[EXPECTED[q]] + REROLE + extra, NEVER if kept[q] is None else c[kept[q]] + extra) for q in range(4))


def walk(letters: str, state: int = 0, end: Sequence[int] = END, last: bool = True) -> tuple[str, int]:
    """The ASCII-least cheapest edits from ``state``, and the state after them.

    ``end`` are the costs to go after these rows; unless they are the ``last``
    what is inserted there belongs to the next piece.
    """
    costs, edits, i = costs_to_go(letters, end), [], 0
    while i < len(letters) or (last and state in (1, 2)):
        now = costs[state][i]
        letter = letters[i] if i < len(letters) else None
        extra = TRUNCATED if letter and letter.isupper() else 0
        kept = KEPT[letter.lower()][state] if letter and letter != "x" else None
        if letter and costs[state][i + 1] + DELETE == now:
            edit, step = "D", 1
        elif costs[EXPECTED[state]][i] + INSERT == now:
            edit, step, state = "I", 0, EXPECTED[state]
        elif kept is not None and costs[kept][i + 1] + extra == now:
            edit, step, state = "K", 1, kept
        else:
            edit, step, state = "R", 1, EXPECTED[state]
        edits.append(edit)
        i += step
    return "".join(edits), state


def _of_cut(pieces: DataFrame, wanted: set[tuple], make) -> dict[tuple, list[int]]:
    """``make`` of the letters of each wanted (conv, part); there are at most two a partition."""
    kind = pieces.schema["conv"].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), ("part", pa.int32()), ("made", pa.list_(pa.int64()))])
    parts = sorted({p for _, p in wanted})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _batch([(c, p, make((c, p), x)) for c, p, x in rows if (c, p) in wanted], schema)

    found = pieces.filter(F.col("part").isin(parts)).select("conv", "part", "letters").mapInArrow(run, f"conv {kind.simpleString()}, part int, made array<long>")
    return {(r[0], r[1]): r[2] for r in found.collect()}


def _entries(pieces: DataFrame) -> dict[tuple, tuple[int, tuple, bool]]:
    """Of each piece of a conversation that is cut: state before, costs to go after, and whether it is the last."""
    cut = [(r[0], sorted(r[1])) for r in pieces.groupBy("conv").agg(F.collect_list("part").alias("parts")).filter(F.size("parts") > 1).collect()]
    if not cut:
        return {}
    wanted = {(conv, p) for conv, parts in cut for p in parts}

    def between(_: tuple, letters: str) -> list[int]:
        ends = [_closed([0 if k == q else NEVER for k in range(4)]) for q in range(4)]
        columns = [[int(c[0]) for c in costs_to_go(letters, e)] for e in ends]
        return [columns[k][q] for q in range(4) for k in range(4)]

    made = _of_cut(pieces, wanted, between)
    after: dict[tuple, tuple] = {}
    for conv, parts in cut:
        c = END
        for p in reversed(parts):
            after[conv, p] = c
            m = made[conv, p]
            c = tuple(min(m[4 * q + k] + c[k] for k in range(4)) for q in range(4))
    last = {(conv, parts[-1]) for conv, parts in cut}
    exits = _of_cut(pieces, wanted, lambda key, letters: [walk(letters, q, after[key], key in last)[1] for q in range(4)])
    found = {}
    for conv, parts in cut:
        state = 0
        for p in parts:
            found[conv, p] = (state, after[conv, p], (conv, p) in last)
            state = exits[conv, p][state]
    return found


def _cost(letters: str, edits: str) -> int:
    total, rows = 0, iter(letters)
    for e in edits:
        if e == "I":
            total += INSERT
        else:
            letter = next(rows)
            total += DELETE if e == "D" else (REROLE if e == "R" else 0) + (TRUNCATED if letter.isupper() else 0)
    return total


def _edits(pieces: DataFrame) -> DataFrame:
    """The pieces with their ``edits`` and ``cost``."""
    sent = pieces.sparkSession.sparkContext.broadcast(_entries(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(2).to_pylist()
            edits = [walk(x, *sent.value.get((c, p), (0, END, True)))[0] for c, p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, pa.string()), pa.array([_cost(x, e) for x, e in zip(letters, edits, strict=True)], pa.int64())],
                                             names=[*batch.schema.names, "edits", "cost"])

    given = pieces.select("conv", "part", "letters", "turn", "role", "digest", "illegal", "left", "right")
    return given.mapInArrow(run, given.select("*", F.lit("").alias("edits"), F.lit(0).cast("long").alias("cost")).schema)


def plan(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows as they are taken, the distinct rows with their faults, and the pieces with their edits."""
    given = _given(rows, conv_col, turn_col)
    reduced = durable(_reduced(given))
    return given, reduced, durable(_edits(durable(_pieces(reduced))))


def faults(reduced: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit: a row for each conversation that has rows."""
    n, fresh = F.col("n"), ~F.col("blank")
    turns = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    counted = reduced.groupBy("conv").agg(
        F.coalesce(turns, F.lit(0)).alias("gaps"), F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(fresh, F.when(F.col("first"), n - 1).otherwise(n)).otherwise(0)).alias("duplicate"),
        F.sum((fresh & F.col("first") & F.col("truncated")).cast("long")).alias("truncated"))
    sides = F.array_sort(F.collect_list(F.struct("part", "left", "right", "edits")))  # at most one a partition
    summed = edits.groupBy("conv").agg(F.sum("illegal").alias("inside"), F.sum("cost").alias("cost"), sides.alias("sides"))
    pairs = F.transform(F.slice("sides", 2, F.greatest(F.size("sides") - 1, F.lit(0))), lambda s, i: F.concat(F.get("sides", i)["right"], s["left"]))
    crossing = F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL)))
    summed = summed.select("conv", (F.col("inside") + crossing).alias("illegal"), "cost", F.array_join(F.transform("sides", lambda s: s["edits"]), "").alias("audit"))
    return _merged(counted, summed)


def _merged(*tables: DataFrame) -> DataFrame:
    """Tables of one row a conversation side by side; null is a conversation."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    return whole.groupBy("conv").agg(*[F.max(c).alias(c) for c in whole.columns if c != "conv"])


def _streamed(given: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows and, before the first row of each piece, its edits; whole conversations, in order."""
    text = F.when(~F.col("blank"), F.col("text"))  # blank rows go
    rows = given.select("conv", "turn", "role", "digest", F.lit(1).alias("kind"), text.alias("text"))
    plans = edits.select("conv", "turn", "role", "digest", F.lit(0).alias("kind"), F.col("edits").alias("text"))
    return rows.unionByName(plans).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "kind").select("conv", "kind", "role", "text")


class _Editor:
    """Applies the edits of one conversation to its rows."""

    def __init__(self) -> None:
        self.edits, self.at, self.state = "", 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            self.state = EXPECTED[self.state]
            yield ROLE_INTO[self.state], ""

    def take(self, kind: int, role: str, text: str | None) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        if kind == 0:
            self.edits, self.at = text, 0
            return
        edit = self.edits[self.at]
        self.at += 1
        if edit == "R":
            self.state = EXPECTED[self.state]
            yield ROLE_INTO[self.state], text
        elif edit == "K":
            self.state = KEPT[role[0]][self.state]
            yield role, text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, list[tuple[str, str]]]]:
    """(conv, ended, turns) for every step of the sorted rows; a conversation's turns come in several lists."""
    editor, at, begun = _Editor(), None, False
    for batch in batches:
        for conv, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv != at:
                if begun:
                    yield at, True, list(editor.inserted())
                editor, at, begun = _Editor(), conv, True
            turns = list(editor.take(kind, role, text))
            if turns:
                yield conv, False, turns
    if begun:
        yield at, True, list(editor.inserted())


def repaired(given: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, place, role, text): the turns of the repaired conversations, places from 0."""
    kind = given.schema["conv"].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, place = [], 0, 0
        for conv, ended, turns in _conversations(batches):
            for role, text in turns:
                held.append((conv, place, role, text))
                place, size = place + 1, size + len(text)
            place = 0 if ended else place
            if len(held) >= 5000 or size > 1 << 22:
                yield _batch(held, schema)
                held, size = [], 0
        yield _batch(held, schema)

    return _streamed(given, edits).mapInArrow(run, f"conv {kind.simpleString()}, place long, role string, text string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def hashes(given: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): of ``role:text`` of the repaired turns, joined by newlines."""
    kind = given.schema["conv"].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, between = [], hashlib.sha256(), ""
        for conv, ended, turns in _conversations(batches):
            for role, text in turns:
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
            if ended:
                held.append((conv, digest.hexdigest()))
                digest, between = hashlib.sha256(), ""
                if len(held) == 5000:
                    yield _batch(held, schema)
                    held = []
        yield _batch(held, schema)

    return _streamed(given, edits).mapInArrow(run, f"conv {kind.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(``conv_col``, place, role, text): ``rows`` with their structure repaired."""
    given, _, edits = plan(rows, conv_col, turn_col)
    return repaired(given, edits).withColumnRenamed("conv", conv_col)


def report(rows: DataFrame, known: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Faults, cost, edits and hash of every conversation of ``rows``, and of those that only ``known`` has."""
    given, reduced, edits = plan(rows, conv_col, turn_col)
    whole = _merged(known.select(F.col(conv_col).alias("conv")).distinct(), faults(reduced, edits), hashes(given, edits))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(F.col("conv").alias(conv_col), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
