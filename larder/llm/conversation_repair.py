r"""Repair of conversation structure by generalised LR parsing with edits.

A conversation is read as the initials of its rows' roles. The role grammar, an optional
system turn and then pairs of user and assistant, is compiled to LR tables. A parse
keeps all stacks at once in a graph: a node is a state on a node below, equal stacks are
one node, and all stacks share their lower parts. A row is kept (cost 0), given another
role (2) or deleted (3); an empty turn may be inserted anywhere (2). Blank and duplicate
rows must go, a truncated row that stays adds 1. Stack tops that meet are merged by the
least (cost, audit), where the audit is the string of edits' initials. Two edit strings
for the same rows with equal cost and stack never start with each other (the longer one
would hold more inserts, so cost more), hence the least prefix stays the least.

Conversations of any length are parsed in parts:

1. Rows become keys: place (turn, nulls first, then role and a digest of the text), two
   hashes of role and text, the role's initial and the faults. Equal rows of a turn are
   counted, the first row of equal role and text is found by grouping. No text so far.
2. The keys are put in order by range of (conversation, place). Each task cuts them into
   chunks of bounded length and parses a chunk from every stack that the grammar can
   reach (from the empty one where a conversation starts): a small matrix of (cost,
   audit) from stack to stack.
3. The matrices of a conversation are composed in order by streaming over its chunks;
   the choice is traced back, one audit string per chunk.
4. The chunks' rows and edits are joined to the texts by the rows' hashes. Repaired rows
   come out numbered by chunk and place, spread over all tasks.

Digests stream over ordered rows and hold no conversation.

Nulls and ties: null roles and texts are one space before anything else, so are null
ids and turns in the damage rule. A null conversation is a conversation of its own.
Rows of equal turn are ordered by role, then by digest of the text; repeated rows are
duplicates. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import batches_of, prepare, rows_of, shuffle_tasks
from larder.session import materialise

#: Productions of the role grammar; the first symbol is the goal. Lower-case letters are roles' initials.
GRAMMAR = (("C", ""), ("C", "B"), ("C", "sB"), ("B", "P"), ("B", "BP"), ("P", "ua"))
#: Roles that an edit may give or insert.
GIVEN = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
CHUNK_ROWS = 1024
_SPACE = " \t\n\x0b\x0c\r"
_END = "$"


class RoleTables:
    """LR tables of a grammar: shifts, gotos, and reductions by look-ahead (follow sets)."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = (("", grammar[0][0]), *grammar)
        self.heads = {head for head, _ in self.rules}
        self.terminals = sorted({s for _, body in grammar for s in body if s not in self.heads})
        follow = self._follow()
        states = [self._closure({(0, 0)})]
        self.shift: list[dict[str, int]] = []
        for items in states:  # grows while it is read
            moves: dict[str, set] = {}
            for rule, dot in items:
                body = self.rules[rule][1]
                if dot < len(body):
                    moves.setdefault(body[dot], set()).add((rule, dot + 1))
            row = {}
            for symbol, kernel in sorted(moves.items()):
                target = self._closure(kernel)
                if target not in states:
                    states.append(target)
                row[symbol] = states.index(target)
            self.shift.append(row)
        self.reduce: list[dict[str, list[tuple[str, int]]]] = []
        self.accepting = {i for i, items in enumerate(states) if (0, 1) in items}
        for items in states:
            found: dict[str, list[tuple[str, int]]] = {}
            for rule, dot in sorted(items):
                head, body = self.rules[rule]
                if rule and dot == len(body):
                    for ahead in follow[head]:
                        found.setdefault(ahead, []).append((head, len(body)))
            self.reduce.append(found)

    def _closure(self, items: set) -> frozenset:
        items, left = set(items), list(items)
        while left:
            rule, dot = left.pop()
            body = self.rules[rule][1]
            for number, (head, _) in enumerate(self.rules):
                if dot < len(body) and head == body[dot] and (number, 0) not in items:
                    items.add((number, 0))
                    left.append((number, 0))
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        empty: set[str] = set()
        first = {head: set() for head in self.heads}
        follow = {head: set() for head in self.heads}
        follow[""].add(_END)
        before = None
        while before != (before := (len(empty), *(len(s) for s in (*first.values(), *follow.values())))):
            for head, body in self.rules:
                if all(s in empty for s in body):
                    empty.add(head)
                for s in body:
                    first[head] |= first.get(s, {s})
                    if s not in empty:
                        break
                behind = set(follow[head])
                for s in reversed(body):
                    if s in self.heads:
                        follow[s] |= behind
                    behind = first.get(s, {s}) | (behind if s in empty else set())
        return follow


class StackGraph:
    """Stacks of a parse as nodes (state, node below); node 0 is the empty stack."""

    def __init__(self, tables: RoleTables | None = None):
        self.tables = tables or RoleTables()
        self.state, self.below = [0], [-1]
        self._node: dict[tuple[int, int], int] = {}
        self._after: dict[tuple[int, str], tuple[int, ...]] = {}
        self._accepts: dict[int, bool] = {}

    def push(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self._node:
            self._node[key] = len(self.state)
            self.state.append(state)
            self.below.append(below)
        return self._node[key]

    def _reduced(self, top: int, ahead: str) -> list[int]:
        """All stacks that reductions under this look-ahead lead to, itself first."""
        found = [top]
        for node in found:  # grows while it is read
            for head, length in self.tables.reduce[self.state[node]].get(ahead, ()):
                under = node
                for _ in range(length):
                    under = self.below[under]
                target = self.tables.shift[self.state[under]].get(head)
                if target is not None and (made := self.push(target, under)) not in found:
                    found.append(made)
        return found

    def after(self, top: int, symbol: str) -> tuple[int, ...]:
        """Stacks after shifting a symbol, none if the grammar has no such turn here."""
        key = (top, symbol)
        if key not in self._after:
            stacks = []
            for node in self._reduced(top, symbol):
                target = self.tables.shift[self.state[node]].get(symbol)
                if target is not None:
                    stacks.append(self.push(target, node))
            # what is complete whatever follows is reduced at once, so that equal stacks meet
            self._after[key] = tuple(sorted({self._settled(s) for s in stacks}))
        return self._after[key]

    def _settled(self, top: int) -> int:
        table = self.tables
        while True:
            state = self.state[top]
            reductions = {r for found in table.reduce[state].values() for r in found}
            if len(reductions) != 1 or table.shift[state]:
                return top
            ((head, length),) = reductions
            under = top
            for _ in range(length):
                under = self.below[under]
            target = table.shift[self.state[under]].get(head)
            if target is None:
                return top
            top = self.push(target, under)

    def accepts(self, top: int) -> bool:
        if top not in self._accepts:
            self._accepts[top] = any(self.state[n] in self.tables.accepting for n in self._reduced(top, _END))
        return self._accepts[top]

    def entries(self) -> list[int]:
        """All stacks between two turns; the role grammar has few."""
        found = [0]
        for node in found:  # grows while it is read
            for symbol in self.tables.terminals:
                found.extend(n for n in self.after(node, symbol) if n not in found)
            if len(found) > 64:
                raise ValueError("the grammar has stacks of any height: it can't be parsed in parts")
        return found


Tops = dict[int, tuple[int, str]]


def _offer(tops: Tops, node: int, weight: tuple[int, str]) -> bool:
    held = tops.get(node)
    if held is None or weight < held:
        tops[node] = weight
        return True
    return False


def with_inserts(graph: StackGraph, tops: Tops) -> Tops:
    """The tops, and those that inserted turns lead to."""
    left = list(tops)
    while left:
        node = left.pop()
        cost, audit = tops[node]
        for symbol in GIVEN:
            for target in graph.after(node, symbol):
                if _offer(tops, target, (cost + INSERT, audit + "I")):
                    left.append(target)
    return tops


def step(graph: StackGraph, tops: Tops, initial: str, must_go: bool, truncated: bool, copies: int = 1) -> Tops:
    """Tops after one row and ``copies - 1`` duplicates of it."""
    behind = DELETE * (copies - 1), "D" * (copies - 1)
    new: Tops = {}
    for node, (cost, audit) in tops.items():
        _offer(new, node, (cost + DELETE + behind[0], audit + "D" + behind[1]))
        if must_go:
            continue
        stays = cost + truncated * TRUNCATED + behind[0]
        for target in graph.after(node, initial):
            _offer(new, target, (stays + KEEP, audit + "K" + behind[1]))
        for symbol in GIVEN:
            for target in graph.after(node, symbol):
                _offer(new, target, (stays + REROLE, audit + "R" + behind[1]))
    return with_inserts(graph, new)


def replay(graph: StackGraph, entry: int, audit: str, initials: list[str]) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, row or None, initial of the turn that results or None) of an audit from a stack."""
    top, row = entry, 0
    for edit in audit:
        at = None if edit == "I" else row
        row += edit != "I"
        if edit == "D":
            yield edit, at, None
            continue
        symbol = initials[at] if edit == "K" else next(s for s in GIVEN if graph.after(top, s))
        (top,) = graph.after(top, symbol)
        yield edit, at, symbol


# rows and their keys


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after a damage that depends on crc32 of conversation and turn."""
    kind = F.crc32(F.concat(_text(F.col("conv_id")), F.lit(":"), _text(F.col("turn"))).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        rows.filter("_kind <> 0")
        .select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
        .drop("_copy")
    )


def row_keys(rows: DataFrame) -> DataFrame:
    """One row per distinct (conversation, turn, role, text): hashes, initial, faults, number of equal rows, whether the first."""
    solid = F.rtrim("text", F.lit(_SPACE))
    keyed = rows.select(
        "conv_id",
        "turn",
        "role",
        *_hashes(),
        F.substring("role", 1, 1).alias("initial"),
        (solid == "").alias("blank"),
        (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("unfinished"),
    )
    counted = keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n"))
    # null turns come first: a struct of (has a turn, turn) is least for them
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    again = counted.groupBy("conv_id", "h1", "h2").agg(F.min(place).alias("opens"), F.count("*").alias("turns")).filter("turns > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "opens")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    first = F.col("opens").isNull() | F.col("turn").eqNullSafe(F.col("opens.turn"))
    return counted.join(again, same, "left").select(*counted.columns, first.alias("first"))


def _hashes() -> list[Column]:
    """Two independent 64-bit hashes of role and text."""
    return [F.xxhash64("role", F.lit("\n"), "text").alias("h1"), F.xxhash64(F.lit("turn"), "text", F.lit("\n"), "role").alias("h2")]


def _row_key() -> list[Column]:
    """Two 64-bit hashes that tell a conversation's rows apart."""
    place = [F.col("conv_id").isNull(), F.col("conv_id"), F.col("turn").isNull(), F.col("turn")]
    return [F.xxhash64(*place, "h1").alias("r1"), F.xxhash64("h2", *place).alias("r2")]


# parsing in parts

_ROW = pa.struct(
    [("r1", pa.int64()), ("r2", pa.int64()), ("role", pa.string()), ("initial", pa.string()), ("blank", pa.bool_()), ("unfinished", pa.bool_())]
    + [("first", pa.bool_()), ("n", pa.int64())]
)
_ROW_DDL = "struct<r1: bigint, r2: bigint, role: string, initial: string, blank: boolean, unfinished: boolean, first: boolean, n: bigint>"
_CELL = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_CHUNK = pa.schema(
    [("conv_id", pa.int64()), ("chunk", pa.int64()), ("rows", pa.list_(_ROW)), ("illegal", pa.int64()), ("opens", pa.string()), ("ends", pa.string())]
    + [("cells", pa.list_(_CELL))]
)
_CHUNK_DDL = (
    f"conv_id long, chunk long, rows array<{_ROW_DDL}>, illegal long, opens string, ends string, "
    "cells array<struct<entry: int, exit: int, cost: bigint, audit: string>>"
)
_LEGAL = {"su", "ua", "au"}


def _chunks(rows: Iterator[tuple], partition: int, limit: int) -> Iterator[tuple]:
    """Chunks of ordered rows (conv_id, then the fields of a chunk's row), each parsed from every stack it may start with."""
    graph = StackGraph()
    entries = graph.entries()
    number, size, conv, certain = partition << 36, 0, None, False
    held: list[dict] = []

    def chunk() -> tuple:
        matrix = []
        for entry in [0] if certain else entries:
            tops = with_inserts(graph, {entry: (0, "")})
            for row in held:
                tops = step(graph, tops, row["initial"], row["blank"] or not row["first"], row["unfinished"], row["n"])
            matrix += [{"entry": entry, "exit": node, "cost": cost, "audit": audit} for node, (cost, audit) in tops.items()]
        illegal = sum(row["n"] - 1 for row in held)
        illegal += sum(a["initial"] + b["initial"] not in _LEGAL for a, b in itertools.pairwise(held))
        return conv, number, held, illegal, held[0]["initial"], held[-1]["initial"], matrix

    fields, seen = [f.name for f in _ROW], False
    for conv_id, *values in rows:
        row = dict(zip(fields, values, strict=True))
        if seen and conv_id != conv:
            if held:
                yield chunk()
                held, size, number = [], 0, number + 1
            certain = True  # only the first conversation of a task may have begun in another one
        conv, seen = conv_id, True
        left = row["n"]
        while left:
            take = min(left, limit - size)
            held.append(row | {"n": take, "first": row["first"] and left == row["n"]})
            size, left = size + take, left - take
            if size >= limit:
                yield chunk()
                held, size, number, certain = [], 0, number + 1, False
    if held:
        yield chunk()


def chunks_of(keys: DataFrame, limit: int = CHUNK_ROWS, rows_per_task: int = 1 << 20) -> DataFrame:
    """The rows in order, in chunks with their matrices; stored."""
    spark = keys.sparkSession
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "h1", "h2")]

    def parse(batches):
        yield from batches_of(_chunks(rows_of(batches), TaskContext.get().partitionId(), limit), _CHUNK, rows_per_batch=512)

    ordered = keys.repartitionByRange(shuffle_tasks(spark, keys.count(), rows_per_task), *order).sortWithinPartitions(*order)
    return materialise(
        ordered.select("conv_id", *_row_key(), "role", "initial", "blank", "unfinished", "first", "n").mapInArrow(parse, _CHUNK_DDL), "repair-chunks"
    )


class _Path:
    """The last piece of a path through a conversation's chunks, and what lies before it."""

    __slots__ = ("before", "chunk", "cost", "entry", "piece")

    def __init__(self, before: _Path | None, chunk: int, entry: int, cost: int, piece: str):
        self.before, self.chunk, self.entry, self.cost, self.piece = before, chunk, entry, cost, piece

    def better_than(self, other: _Path) -> bool:
        """Least cost, then least audit; only what lies behind the last common piece is compared."""
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, mine, others = self, other, [], []
        while a is not b:
            mine.append(a.piece)
            others.append(b.piece)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(others))


_CHOICE = pa.schema(
    [("conv_id", pa.int64()), ("chunk", pa.int64()), ("entry", pa.int32()), ("piece", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())]
    + [("audit", pa.string())]
)
_CHOICE_DDL = "conv_id long, chunk long, entry int, piece string, cost long, illegal long, audit string"


def _choices(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Per chunk its entry stack and audit, from ordered (conv_id, chunk, illegal, opens, ends, cells); a conversation's last has its sums."""
    graph = StackGraph()
    graph.entries()
    paths: dict[int, _Path | None] = {0: None}
    conv, seen, illegal, ended = None, False, 0, None

    def chosen() -> Iterator[tuple]:
        best = None
        for node, path in paths.items():
            if graph.accepts(node) and (best is None or path.better_than(best)):
                best = path
        pieces, at = [], best
        while at is not None:
            pieces.append(at)
            at = at.before
        pieces.reverse()
        for path in pieces:
            last = path is best
            audit = "".join(p.piece for p in pieces) if last else None
            yield conv, path.chunk, path.entry, path.piece, best.cost if last else None, illegal if last else None, audit

    for conv_id, chunk, inner, opens, ends, cells in rows:
        if seen and conv_id != conv:
            yield from chosen()
            paths, illegal, ended = {0: None}, 0, None
        illegal += inner + (ended is not None and ended + opens not in _LEGAL)
        conv, seen, ended = conv_id, True, ends
        new: dict[int, _Path] = {}
        for cell in cells:
            entry = cell["entry"]
            if entry not in paths:
                continue
            before = paths[entry]
            path = _Path(before, chunk, entry, cell["cost"] + (before.cost if before else 0), cell["audit"])
            if cell["exit"] not in new or path.better_than(new[cell["exit"]]):
                new[cell["exit"]] = path
        paths = new
    if seen:
        yield from chosen()


def choices(chunks: DataFrame) -> DataFrame:
    """Per chunk the stack it starts with and its edits on the cheapest way; stored."""

    def choose(batches):
        yield from batches_of(_choices(rows_of(batches)), _CHOICE)

    return materialise(
        chunks.select("conv_id", "chunk", "illegal", "opens", "ends", "cells")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "chunk")
        .mapInArrow(choose, _CHOICE_DDL),
        "repair-choices",
    )


_TURN = pa.schema(
    [("conv_id", pa.int64()), ("chunk", pa.int64()), ("at", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("r1", pa.int64()), ("r2", pa.int64())]
)


def _turns(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Turns that result, from (conv_id, chunk, entry, piece, rows)."""
    graph = StackGraph()
    graph.entries()
    for conv_id, chunk, entry, piece, held in rows:
        own = [row for row in held for _ in range(row["n"])]
        for at, (edit, place, symbol) in enumerate(replay(graph, entry, piece, [row["initial"] for row in own])):
            if symbol is None:
                continue
            row = own[place] if place is not None else {"r1": None, "r2": None}
            yield conv_id, chunk, at, edit, row["role"] if edit == "K" else GIVEN[symbol], row["r1"], row["r2"]


def repaired_turns(rows: DataFrame, chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, chunk and at (their order), edit, role, text."""

    def apply(batches):
        yield from batches_of(_turns(rows_of(batches)), _TURN)

    edits = chosen.select(F.col("conv_id"), "chunk", "entry", "piece").join(chunks.select("chunk", "rows"), "chunk")
    turns = edits.select("conv_id", "chunk", "entry", "piece", "rows").mapInArrow(
        apply, "conv_id long, chunk long, at int, edit string, role string, r1 long, r2 long"
    )
    kept = turns.filter("r1 IS NOT NULL")
    texts = rows.select("conv_id", "turn", "text", *_hashes()).select(*_row_key(), "text").groupBy("r1", "r2").agg(F.first("text").alias("text"))
    with_text = kept.join(texts.hint("merge"), ["r1", "r2"]).select("conv_id", "chunk", "at", "edit", "role", "text")
    inserted = turns.filter("r1 IS NULL").select("conv_id", "chunk", "at", "edit", "role", F.lit("").alias("text"))
    return with_text.unionByName(inserted)


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Repair rows (conv_id, turn, role, text).

    Returns the turns that result (conv_id, chunk, at, edit, role, text; in order of
    chunk and at) and per conversation gaps, blank, duplicate, truncated, illegal, cost
    and audit.
    """
    prepare(rows.sparkSession)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"))
    keys = materialise(row_keys(rows), "repair-keys")
    chunks = chunks_of(keys, chunk_rows)
    chosen = choices(chunks)
    faults = keys.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("first").cast("long"))).alias("duplicate"),
        F.sum((~F.col("blank") & F.col("first") & F.col("unfinished")).cast("long")).alias("truncated"),
    )
    sums = chosen.filter("audit IS NOT NULL").select("conv_id", "illegal", "cost", "audit")
    return repaired_turns(rows, chunks, chosen), _merged([faults, sums])


def _merged(tables: list[DataFrame]) -> DataFrame:
    """One row per conv_id, null among them, from tables with one row each."""
    whole = tables[0]
    for other in tables[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    return whole.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in whole.columns if c != "conv_id"])


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    conv, digest = None, None
    for conv_id, role, text in rows:
        if digest is not None and conv_id != conv:
            yield conv, digest.hexdigest()
            digest = None
        lead = "" if digest is None else "\n"
        digest = digest or hashlib.sha256()
        conv = conv_id
        digest.update(f"{lead}{role}:{text}".encode())
    if digest is not None:
        yield conv, digest.hexdigest()


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """Per conversation, after the damage: faults, cost, audit and a digest of the repaired turns."""
    prepare(conversations.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def digest(batches):
        yield from batches_of(_digests(rows_of(batches)), schema)

    turns, report = repair(damaged(conversations))
    digests = (
        turns.repartition("conv_id")
        .sortWithinPartitions("conv_id", "chunk", "at")
        .select("conv_id", "role", "text")
        .mapInArrow(digest, "conv_id long, repaired_sha256 string")
    )
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = _merged([report, digests, every])
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
