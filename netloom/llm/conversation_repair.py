"""Conversations repaired by the cheapest edits: iterative-deepening A*.

A conversation is its rows by turn (nulls first; ties by role and text).  A row's first
fault counts: blank (no word), duplicate (role and text seen earlier), truncated (its last
character that isn't white space is not ``. ! ?``).  Edits, one a row, and insertions:

    D  delete, 2; the only edit of blank and duplicate rows
    I  insert an empty user or assistant row anywhere, 5
    K  keep, 0
    R  give the role user or assistant, 1

Truncated rows that stay cost 5 more.  The roles' initials must end as ``(s?(ua)+)?``,
which fixes the role that R and I give.  The answer is the cheapest edits' string, the
ASCII-least of equal cost.

``search`` goes depth first in ASCII order under a cost bound, which rises to the least
cost that passed it.  Its table holds, for each position and role state that failed, the
least cost known to be needed from there, so no state fails twice at one bound; the first
path that is accepted is the answer.

Conversations of up to ``STRETCH`` rows are searched whole, each in a task's stream of
sorted rows.  Longer ones are dealt by range into stretches: each stretch gives the least
cost between any two of the four role states (min-plus), the costs that follow a stretch
come from the end, each stretch is searched for every state that it can begin in, and one
pass from the start picks among these.  Equal rows travel as one row with a count.  Only
that last pass, which also hashes the repaired text in order, is one task's stream for a
conversation; it holds one stretch.

Defined results: a null role or text is one space; a null conversation id is one
conversation; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from netloom.llm.common import written

#: Rows and bytes of text of a conversation that is searched whole; rows of a stretch.
STRETCH, STRETCH_BYTES = 512, 16 << 20

DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: States: nothing yet, after system, after user, after assistant.
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_GIVEN = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
_END = (0.0, math.inf, math.inf, 0.0)
_LEGAL = {"su", "ua", "au"}

_WORD = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")

#: A row of the search: its initial, whether it must go, what it costs besides its edit.
Code = tuple[str, bool, int]


def code_of(role: str, text: str, seen: bool) -> tuple[Code, str]:
    """The row's code and its first fault ('' if it has none)."""
    if not _WORD.search(text):
        return (role[:1], True, 0), "blank"
    if seen:
        return (role[:1], True, 0), "duplicate"
    if not _LAST.search(text):
        return (role[:1], False, TRUNCATED), "truncated"
    return (role[:1], False, 0), ""


def edits(row: Code | None, q: int) -> list[tuple[str, int, int, int]]:
    """Edit, cost, rows used up and next state, in ASCII order."""
    given = _GIVEN[q][0]
    if row is None:
        return [("I", INSERT, 0, given)]
    initial, must_go, more = row
    out = [("D", DELETE, 1, q), ("I", INSERT, 0, given)]
    if not must_go:
        if initial in _KEEP[q]:
            out.append(("K", KEEP + more, 1, _KEEP[q][initial]))
        out.append(("R", REROLE + more, 1, given))
    return out


def search(rows: list[Code], start: int = 0, after: Iterable[float] = _END, last: bool = True) -> tuple[float, str, int] | None:
    """Cost with what follows, edits and end state of the ASCII-least cheapest path
    from state ``start``; ``after`` is the cost of what follows from each state.  Rows
    can be inserted behind the last row only if it is the conversation's ``last``."""
    after, n = [*after], len(rows)
    floor = [min(after)] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, must_go, more = rows[i]
        floor[i] = floor[i + 1] + (DELETE if must_go else min(DELETE, more + (KEEP if initial in ("s", "u", "a") else REROLE)))
    needed: dict[tuple[int, int], float] = {}
    bound = floor[0]
    while bound < math.inf:
        # frame: position, state, cost so far, edits left to try, least cost beyond the bound
        stack = [[0, start, 0, None, math.inf]]
        path: list[str] = []
        while stack:
            frame = stack[-1]
            i, q, cost, left, _ = frame
            if left is None:
                if i == n:
                    if cost + after[q] <= bound:
                        return cost + after[q], "".join(path), q
                    frame[4] = cost + after[q]
                left = frame[3] = iter(edits(rows[i] if i < n else None, q) if i < n or last else ())
            for edit, price, used, to in left:
                at, g = (i + used, to), cost + price
                least = g + needed.get(at, floor[at[0]])
                if least > bound:
                    frame[4] = min(frame[4], least)
                    continue
                path.append(edit)
                stack.append([*at, g, None, math.inf])
                break
            else:
                stack.pop()
                needed[i, q] = frame[4] - cost
                if stack:
                    path.pop()
                    stack[-1][4] = min(stack[-1][4], frame[4])
                else:
                    bound = frame[4]
    return None


def least_costs(rows: list[Code], last: bool) -> list[list[float]]:
    """Least cost of a stretch between any two states."""
    out = []
    for start in range(4):
        now = [math.inf] * 4
        now[start] = 0.0
        for row in [*rows, None] if last else rows:
            for q in (0, 1, 2, 3, 2, 3):  # insertions: an even number more changes nothing
                to = _GIVEN[q][0]
                now[to] = min(now[to], now[q] + INSERT)
            if row is not None:
                new = [math.inf] * 4
                for q in range(4):
                    for _, price, used, to in edits(row, q):
                        if used:
                            new[to] = min(new[to], now[q] + price)
                now = new
        out.append(now)
    return out


class Report:
    """Counts of a conversation's rows and its repaired text, row by row."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.lines = conv, 0, 0, 0
        self.n = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before, self.audit, self.hash = 0, None, [], hashlib.sha256()
        self.turns, self.low, self.high, self.turn = 0, None, None, None

    def row(self, turn: int | None, role: str, fault: str, copies: int) -> None:
        if turn is not None and turn != self.turn:
            self.turns, self.low, self.high, self.turn = self.turns + 1, turn if self.low is None else self.low, turn, turn
        if fault:
            self.n[fault] += 1
        self.n["blank" if fault == "blank" else "duplicate"] += copies - 1
        if self.before is not None and self.before + role[:1] not in _LEGAL:
            self.illegal += 1
        self.before, self.illegal = role[:1], self.illegal + copies - 1

    def line(self, role: str, text: str) -> tuple:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "replace"))
        self.lines += 1
        return self.conv, self.lines, role, text

    def repaired(self, path: str, rows: Iterable[tuple[str, str, int]]) -> Iterator[tuple]:
        """The repaired rows of a stretch, whose edits are ``path``."""
        rows = iter(rows)
        for edit in path:
            self.audit.append(edit)
            role, text, copies = (_GIVEN[self.state][1], "", 1) if edit == "I" else next(rows)
            if edit == "K":
                self.state = _KEEP[self.state][role[:1]]
                yield self.line(role, text)
            elif edit in "IR":
                self.state, role = _GIVEN[self.state]
                yield self.line(role, text)
            if copies > 1:
                self.audit.append("D" * (copies - 1))
                self.cost += DELETE * (copies - 1)

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.n["blank"], self.n["duplicate"], self.n["truncated"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        columns = [(name, batch.column(name)) for name in batch.schema.names]
        for i in range(batch.num_rows):
            yield {name: c[i].as_py() for name, c in columns}


def _batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], most: int = 1024) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while held := [*itertools.islice(rows, most)]:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(types)], names)


def _written_out(reports: Iterator[tuple[Report, Iterator[tuple]]], turns: bool) -> Iterator[tuple]:
    """Repaired rows, or one summary a conversation."""
    for report, lines in reports:
        if turns:
            yield from lines
        else:
            for _ in lines:
                pass
            yield report.summary()


def _small(names: list[str], types: list[pa.DataType], turns: bool):
    def repaired(conv, rows: Iterator[dict]) -> tuple[Report, Iterator[tuple]]:
        report, seen, codes, held = Report(conv), set(), [], []
        for r in rows:
            what = (r["role"], r["text"])
            code, fault = code_of(*what, what in seen)
            seen.add(what)
            report.row(r["turn"], r["role"], fault, 1)
            codes.append(code)
            held.append((*what, 1))
        cost, path, _ = search(codes)
        report.cost = int(cost)
        return report, report.repaired(path, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_conv = itertools.groupby(_rows(batches), key=lambda r: r["conv"])
        yield from _batches(_written_out((repaired(c, rows) for c, rows in by_conv), turns), names, types)

    return run


_LINED = "conv {conv}, piece int, stretch int, seq int, turn long, role string, text string, copies long, fault string, initial string, must_go boolean, more int"


def _number(names: list[str], types: list[pa.DataType], stretch: int):
    """Names the stretches of a sorted partition and codes its rows."""

    def lined(rows: Iterator[dict]) -> Iterator[tuple]:
        piece, number, seq, conv = TaskContext.get().partitionId(), 0, 0, object()
        for r in rows:
            if r["conv"] != conv or seq == stretch:
                conv, number, seq = r["conv"], number + 1, 0
            seq += 1
            code, fault = code_of(r["role"], r["text"], not r["first"])
            yield conv, piece, number, seq, r["turn"], r["role"], r["text"], r["n"], fault, *code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(lined(_rows(batches)), names, types, 256)

    return run


def _codes(row: dict) -> list[Code]:
    return [(c["initial"], c["must_go"], c["more"]) for c in row["codes"]]


def _costs(names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ((r["conv"], r["piece"], r["stretch"], [x for row in least_costs(_codes(r), r["last"]) for x in row]) for r in _rows(batches))
        yield from _batches(out, names, types)

    return run


def _after(names: list[str], types: list[pa.DataType]):
    """Each stretch, from a conversation's last to its first, with the costs behind it."""

    def followed(rows: Iterator[dict]) -> Iterator[tuple]:
        for conv, stretches in itertools.groupby(rows, key=lambda r: r["conv"]):
            after = [*_END]
            for r in stretches:
                yield conv, r["piece"], r["stretch"], after
                m = r["costs"]
                after = [min(m[4 * q + to] + after[to] for to in range(4)) for q in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(followed(_rows(batches)), names, types)

    return run


def _searched(names: list[str], types: list[pa.DataType]):
    """Every state that a stretch can begin in, with its cheapest edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for r in _rows(batches):
                found = [search(_codes(r), q, r["after"], r["last"]) for q in range(4)]
                yield r["conv"], r["piece"], r["stretch"], [f and f[1] for f in found], [f[0] if f else None for f in found]

        yield from _batches(out(), names, types, 256)

    return run


def _chosen(names: list[str], types: list[pa.DataType], turns: bool):
    """The last pass: a stretch's edits (``seq`` 0) come before its rows."""

    def lines(report: Report, rows: Iterator[dict]) -> Iterator[tuple]:
        begun = False
        for _, stretch in itertools.groupby(rows, key=lambda r: (r["piece"], r["stretch"])):
            head, *rest = stretch
            if not begun:
                begun, report.cost = True, report.cost + int(head["costs"][0])
            for r in rest:
                report.row(r["turn"], r["role"], r["fault"], r["copies"])
            yield from report.repaired(head["paths"][report.state], [(r["role"], r["text"], r["copies"]) for r in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reports():
            for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r["conv"]):
                report = Report(conv)
                yield report, lines(report, rows)

        yield from _batches(_written_out(reports(), turns), names, types, 256)

    return run


def _large(rows: DataFrame, out: tuple, turns: bool, stretch: int) -> DataFrame:
    """Conversations of any length, dealt by stretches."""

    def mapped(df: DataFrame, make, schema: str, *more) -> DataFrame:
        arrow = to_arrow_schema(StructType.fromDDL(schema))
        return df.mapInArrow(make(arrow.names, arrow.types, *more), schema)

    conv = rows.schema["conv"].dataType.simpleString()
    equal = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    placed = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = equal.groupBy("conv", "role", "text").agg(F.min(placed).alias("place"))
    first = first.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("text").alias("_text"), F.col("place.turn").alias("_turn"), F.lit(True).alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv", "turn", "role", "text")]
    flagged = equal.join(first, same, "left").select(*equal.columns, F.coalesce("first", F.lit(False)).alias("first"))
    by = ["conv", "turn", "role"]
    # long texts are no part of the sampled range bounds
    dealt = flagged.withColumn("begin", F.substring("text", 1, 64)).repartitionByRange(*by, "begin").sortWithinPartitions(*by, "begin", "text")
    lined = written(mapped(dealt, _number, _LINED.format(conv=conv), stretch))

    at = ["conv", "piece", "stretch"]
    whole = lined.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("seq", "initial", "must_go", "more"))).alias("codes"))
    ends = lined.groupBy("conv").agg(F.max(F.struct("piece", "stretch")).alias("end"))
    is_last = (F.col("end.piece") == F.col("piece")) & (F.col("end.stretch") == F.col("stretch"))
    stretches = written(whole.join(ends.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).select(*at, "codes", is_last.alias("last")))
    costs = mapped(stretches, _costs, f"conv {conv}, piece int, stretch int, costs array<double>")
    backward = costs.repartition("conv").sortWithinPartitions("conv", F.desc("piece"), F.desc("stretch"))
    after = written(mapped(backward, _after, f"conv {conv}, piece int, stretch int, after array<double>"))
    both = stretches.join(after.withColumnRenamed("conv", "_conv"), ["piece", "stretch"]).where(F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    spread = both.repartition(*at)
    found = written(mapped(spread, _searched, f"conv {conv}, piece int, stretch int, paths array<string>, costs array<double>"))
    heads = found.withColumn("seq", F.lit(0))
    inside = lined.select(*at, "seq", "turn", "role", "text", "copies", "fault")
    stream = heads.unionByName(inside, allowMissingColumns=True).repartition("conv").sortWithinPartitions(*at, "seq")
    return stream.mapInArrow(_chosen(*out[1:], turns), out[0])


def _repair(rows: DataFrame, turns: bool, conv_col: str, turn_col: str, role_col: str, text_col: str, stretch: int) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    kind = rows.schema["conv"].dataType
    if turns:
        names, types = [conv_col, "position", "role", "text"], ["long", "string", "string"]
    else:
        names, types = [conv_col, *_LONGS, "audit", "repaired_sha256"], ["long"] * len(_LONGS) + ["string"] * 2
    arrow = {"long": pa.int64(), "string": pa.string()}
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, [kind.simpleString(), *types], strict=True))
    out = (schema, names, [to_arrow_type(kind), *(arrow[t] for t in types)])

    large = F.col("m") > stretch
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    giants = written(sizes.where(large | (F.col("bytes") > STRETCH_BYTES)).select(F.col("conv").alias("giant")))
    if giants.isEmpty():
        small = rows
    else:
        is_giant = F.col("conv").eqNullSafe(F.col("giant"))
        small = rows.join(giants, is_giant, "left_anti")
    done = small.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(_small(*out[1:], turns), schema)
    if not giants.isEmpty():
        done = done.unionByName(_large(rows.join(giants, is_giant, "left_semi"), out, turns, stretch))
    return done


def repair_report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """One row a conversation: ``conv_col``, gaps (turns missing between its first and
    last), blank, duplicate, truncated, illegal (neighbours whose initials are not su,
    ua or au), cost, audit (the edits) and repaired_sha256 (of the repaired lines
    ``role:text``)."""
    return _repair(rows, False, conv_col, turn_col, role_col, text_col, stretch)


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """The repaired conversations: ``conv_col``, position from 1, role and text."""
    return _repair(rows, True, conv_col, turn_col, role_col, text_col, stretch)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``rows`` with faults by crc32(``conv:turn``) % 20: 0 drops a row, 1 empties its
    text, 2 removes its ``. ! ?``, 3 repeats it, 4 makes it the user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name(conv_col), F.lit(":"), name(turn_col)).cast("binary")) % 20
    marked = rows.withColumn("_kind", kind).where("_kind <> 0")
    text, role = F.coalesce(text_col, F.lit(" ")), F.coalesce(role_col, F.lit(" "))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return (
        marked.withColumn(text_col, F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
        .withColumn(role_col, F.when(F.col("_kind") == 4, "user").otherwise(role))
        .withColumn("_copy", copies)
        .select(*rows.columns)
    )
