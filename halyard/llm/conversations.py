"""Conversation repair: weighted CYK over spans of turns.

The repaired role initials must be of ``(s?(ua)+)?``. A cell of the chart belongs to a
span of rows and holds, for each nonterminal, the cheapest (cost, audit) that turns the
span into it; of equal costs the ASCII-least audit. The audit is the edits' initials:
Keep, Rerole, Delete, Insert. Nonterminals name what a span has become: nothing, or an
alternating run with its first and last initial. The grammar is in Chomsky normal form
(``RULES``: two nonterminals give one), a row's cell is closed under insertions on both
sides, and cells are combined bottom-up by span length: 1, 2, 4, ... rows. Every
nonterminal can be cut between any two rows, so one cut a span finds what all cuts do
(tests compare them). Two audits of one span and cost never begin one another, as the
letters fix the cost, so the least of the parts is the least of the whole.

Only features of rows (order, initial, faults) are parsed, not texts. They are range-sorted
by conversation and turn, so a long conversation spans many tasks; each task gives one
cell a conversation, and those few are combined in a second step. Texts meet the audit in
``repaired_rows``, a stream in order that holds one row at a time. Of a conversation it
holds the audit only, which is part of the result.

Nulls: a null role or text is one space; a null turn comes first; rows with a null id are
one conversation. Rows of one turn are in order of role, then of the SHA-256 of role and
text; equal rows are interchangeable. A row whose role is empty cannot be kept. Blank
rows have no character beyond white space. A conversation may have any length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import Workspace

#: Costs of the edits; an undeleted truncated row adds one (fixed values).
RECAST, DROP, ADD, CUT = 2, 3, 2, 1
#: Initials that may stand side by side, and results that are whole (fixed values).
LEGAL = ("su", "ua", "au")
WHOLE = ("", "ua", "sa")
#: What a span has become: nothing, or its first and last initial.
KINDS = ("", "uu", "ua", "au", "aa", "ss", "su", "sa")
RULES = [(x, y, x or y if not (x and y) else x[0] + y[1]) for x in KINDS for y in KINDS if not x or not y or x[1] + y[0] in LEGAL]
Cell = dict[str, tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans, by the binary rules."""
    out: Cell = {}
    for x, y, z in RULES:
        if x in left and y in right:
            (a, s), (b, t) = left[x], right[y]
            if z not in out or a + b <= out[z][0]:
                found = (a + b, s + t)
                if z not in out or found < out[z]:
                    out[z] = found
    return out


def _least(a: Cell, b: Cell) -> Cell:
    return {k: min(c[k] for c in (a, b) if k in c) for k in {**a, **b}}


def closed(cell: Cell) -> Cell:
    """The cell with all insertions before and after its span."""
    added: Cell = {"uu": (ADD, "I"), "aa": (ADD, "I")}
    while True:
        more = _least(_least(cell, combine(added, cell)), combine(cell, added))
        if more == cell:
            return cell
        cell = more


def row_cell(initial: str, must_go: bool, truncated: bool) -> Cell:
    """One row: delete it, or keep it or give it a role."""
    cell: Cell = {"": (DROP, "D")}
    if not must_go:
        cut = CUT * truncated
        cell |= {"uu": (RECAST + cut, "R"), "aa": (RECAST + cut, "R")}
        if initial in ("s", "u", "a"):
            cell[initial * 2] = (cut, "K")
    return closed(cell)


class Chart:
    """The cells of the rows so far: spans of falling powers of two, each combined of
    two of half its length."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, rank: int = 0) -> None:
        while self.spans and self.spans[-1][0] == rank:
            cell, rank = combine(self.spans.pop()[1], cell), rank + 1
        self.spans.append((rank, cell))

    def cell(self) -> Cell | None:
        out = None
        for _, cell in reversed(self.spans):
            out = cell if out is None else combine(cell, out)
        return out


def best(cell: Cell | None) -> tuple[int, str]:
    """Cost and audit of a whole conversation; nothing has to be done to no rows."""
    return (0, "") if cell is None else min(cell[k] for k in WHOLE if k in cell)


# --- from rows to features -------------------------------------------------------


def _plain(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))


def _digest() -> Column:
    return F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)


def _features(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, blank, truncated, copies): equal rows once."""
    bare = F.expr("trim(TRAILING ' \t\n\x0b\x0c\r' FROM text)")
    what = rows.select("conv_id", "turn", "role", _digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    return what.groupBy(*what.columns).agg(F.count(F.lit(1)).alias("copies"))


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _batch(rows: list[dict], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _peek(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    """The type of the ids, and all batches."""
    first = next(batches, None)
    if first is None:
        return None, iter(())

    def both() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    return first.schema.field("conv_id").type, both()


INT, TEXT = pa.int64(), pa.string()
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FAULTS = COUNTS[1:5]
PIECE = [("low", INT), ("high", INT), ("turns", INT), *((n, INT) for n in FAULTS), ("first", TEXT), ("last", TEXT), ("kinds", pa.list_(TEXT)), ("costs", pa.list_(INT)), ("audits", pa.list_(TEXT))]
REPORT = [*((n, INT) for n in COUNTS), ("audit", TEXT)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to a piece for each conversation of the task: its counts, its ends
    and its chart's cell."""
    kind, batches = _peek(batches)
    fields = [("conv_id", kind), ("part", pa.int32()), *PIECE]
    cells: dict[tuple, Cell] = {}
    now, out = None, []

    def piece() -> dict:
        cell = now.pop("chart").cell()
        return {**now, "kinds": list(cell), "costs": [c for c, _ in cell.values()], "audits": [a for _, a in cell.values()]}

    for part, conv, turn, initial, blank, truncated, earlier, copies in _rows(batches, ("part", "conv_id", "turn", "initial", "blank", "truncated", "earlier", "copies")):
        if now is None or conv != now["conv_id"]:
            if now:
                out.append(piece())
                if len(out) >= 2000:
                    yield _batch(out, fields)
                    out = []
            now = {"conv_id": conv, "part": part, "low": None, "high": None, "turns": 0, **dict.fromkeys(FAULTS, 0), "first": initial, "last": None, "chart": Chart()}
        if turn is not None and turn != now["high"]:
            now["low"], now["high"], now["turns"] = turn if now["low"] is None else now["low"], turn, now["turns"] + 1
        for k in range(copies):
            again = earlier or k > 0
            must_go, cut = blank or again, truncated and not blank and not again
            for name, value in zip(FAULTS, (blank, again and not blank, cut, now["last"] is not None and now["last"] + initial not in LEGAL)):
                now[name] += value
            now["last"] = initial
            what = (initial, must_go, cut)
            if what not in cells:
                cells[what] = row_cell(*what)
            now["chart"].add(cells[what])
    if now:
        out.append(piece())
        yield _batch(out, fields)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one report for each conversation."""
    kind, batches = _peek(batches)
    fields = [("conv_id", kind), *REPORT]
    now, out = None, []

    def report() -> dict:
        cost, audit = best(now["chart"].cell())
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        return {"conv_id": now["conv_id"], "gaps": gaps, **{n: now[n] for n in FAULTS}, "cost": cost, "audit": audit}

    for p in (dict(zip(("conv_id", *(n for n, _ in PIECE)), row)) for row in _rows(batches, ("conv_id", *(n for n, _ in PIECE)))):
        if now is None or p["conv_id"] != now["conv_id"]:
            if now:
                out.append(report())
                if len(out) >= 2000:
                    yield _batch(out, fields)
                    out = []
            now = {"conv_id": p["conv_id"], "low": None, "high": None, "turns": 0, **dict.fromkeys(FAULTS, 0), "last": None, "chart": Chart()}
        if p["high"] is not None:
            now["turns"] += p["turns"] - (p["low"] == now["high"])  # a turn may lie in two pieces
            now["low"], now["high"] = p["low"] if now["low"] is None else now["low"], p["high"]
        for name in FAULTS:
            now[name] += p[name]
        now["illegal"] += now["last"] is not None and now["last"] + p["first"] not in LEGAL
        now["last"] = p["last"]
        now["chart"].add({k: (c, a) for k, c, a in zip(p["kinds"], p["costs"], p["audits"])})
    if now:
        out.append(report())
        yield _batch(out, fields)


def parse_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every
    conversation that has rows."""
    own = Workspace(rows.sparkSession, "conversations")
    kind = rows.schema[conv_id].dataType.simpleString()
    plain = _plain(rows, conv_id, turn, role, text).withColumn("turn", F.col("turn").cast("long"))
    features = own.table(_features(plain), "features")
    # Where a text was seen first matters only if it is seen at more than one place.
    told = F.count(F.lit(1)).alias("places"), F.min(F.struct(F.col("turn").isNotNull().alias("late"), "turn")).alias("first")
    repeated = features.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(*told).where("places > 1").select("c", "d", "first.turn")
    repeated = repeated.withColumnRenamed("turn", "first_turn").withColumn("again", F.lit(True))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    earlier = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    marked = features.join(repeated, same, "left").select("conv_id", "turn", "role", "digest", "initial", "blank", "truncated", "copies", earlier.alias("earlier"))
    marked = own.table(marked, "marked")
    order = ["conv_id", "turn", "role", "digest"]  # nulls first
    placed = marked.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    fields = "low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, kinds array<string>, costs array<bigint>, audits array<string>"
    pieces = own.table(placed.mapInArrow(_pieces, f"conv_id {kind}, part int, {fields}"), "pieces")
    merged = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return merged.mapInArrow(_joined, f"conv_id {kind}, {', '.join(c + ' bigint' for c in COUNTS)}, audit string")


def repaired_rows(rows: DataFrame, report: DataFrame, every: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows, conversation by conversation in order: conv_id, place (from 0),
    role, text, edit, and ``report`` in a row of its own before them (place -1; without
    a report for ids of ``every`` that have no rows). One shuffle moves the texts."""
    kind = rows.schema[conv_id].dataType.simpleString()
    plain = _plain(rows, conv_id, turn, role, text)
    nothing = F.lit(None).cast("string")
    told = F.to_json(F.struct(*COUNTS))
    heads = report.select("conv_id", F.lit(0).alias("sort"), F.lit(None).cast(plain.schema["turn"].dataType).alias("turn"), nothing.alias("role"), nothing.alias("digest"), told.alias("report"), F.col("audit").alias("text"))
    body = plain.select("conv_id", F.lit(1).alias("sort"), "turn", "role", _digest().alias("digest"), nothing.alias("report"), "text")
    stream = heads.unionByName(body)
    if every is not None:
        empty = every.select(F.col(conv_id).alias("conv_id")).distinct()
        stream = stream.unionByName(empty.select("conv_id", F.lit(-1).alias("sort"), F.lit(None).cast(plain.schema["turn"].dataType).alias("turn"), nothing.alias("role"), nothing.alias("digest"), nothing.alias("report"), nothing.alias("text")))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "sort", "turn", "role", "digest").select("conv_id", "sort", "role", "text", "report")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, batches = _peek(batches)
        fields = [("conv_id", kind), ("place", INT), ("role", TEXT), ("text", TEXT), ("edit", TEXT), ("report", TEXT)]
        fresh, conv, audit, end, at, place, last = True, None, "", 0, 0, 0, ""
        out: list[dict] = []

        def put(name: str | None, body: str, edit: str | None, told: str | None = None) -> None:
            nonlocal place, last
            out.append({"conv_id": conv, "place": place, "role": name, "text": body, "edit": edit, "report": told})
            place, last = place + 1, name[0] if name else ""

        def insert() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                put("assistant" if last == "u" else "user", "", "I")

        for owner, sort, name, body, told in _rows(batches, ("conv_id", "sort", "role", "text", "report")):
            if sort < 1:
                if not fresh and owner == conv:
                    out.pop()  # the head without a report
                fresh, conv, audit, at, place = False, owner, body or "", 0, -1
                end = len(audit.rstrip("I"))
                put(None, audit, None, told)
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit != "D":
                put(("assistant" if last == "u" else "user") if edit == "R" else name, body, edit)
            if at == end:
                insert()
            if len(out) > 1000:
                yield _batch(out[:-1], fields)  # a head may still be replaced
                out = out[-1:]
        if out:
            yield _batch(out, fields)

    return stream.mapInArrow(mend, f"conv_id {kind}, place bigint, role string, text string, edit string, report string")


def repair_digests(repaired: DataFrame) -> DataFrame:
    """``repaired_rows`` as they come: (conv_id, the counts, audit, repaired_sha256)."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, batches = _peek(batches)
        fields = [("conv_id", kind), *REPORT, ("repaired_sha256", TEXT)]
        now, state, out = None, hashlib.sha256(), []
        for conv, place, role, text, told in _rows(batches, ("conv_id", "place", "role", "text", "report")):
            if place < 0:
                if now:
                    out.append({**now, "repaired_sha256": state.hexdigest()})
                    if len(out) >= 2000:
                        yield _batch(out, fields)
                        out = []
                now = {"conv_id": conv, **dict.fromkeys(COUNTS, 0), **(json.loads(told) if told else {}), "audit": text}
                state = hashlib.sha256()
            else:
                state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if now:
            out.append({**now, "repaired_sha256": state.hexdigest()})
            yield _batch(out, fields)

    return repaired.mapInArrow(fold, f"conv_id {kind}, {', '.join(c + ' bigint' for c in COUNTS)}, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults by the hash of id and turn: of every 20 hashes one
    drops the row, one empties its text, one takes its sentence ends, one repeats it, one
    makes it the user's. Nulls are one space in the hash, in roles and in texts."""
    space = F.lit(" ")
    fault = F.pmod(F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")), F.lit(20))
    kept = _plain(rows, "conv_id", "turn", "role", "text").withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return kept.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")
