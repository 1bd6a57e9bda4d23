"""Repair of the turn structure of conversations by composition of weighted finite-state machines.

A conversation is an acceptor of its rows, each a symbol: the initial of its role and its fault (none, must go, truncated). The edit
transducer says what may be done with a row, or between rows, and what it costs. The grammar is an
acceptor of role initials. The three are composed lazily: only states that can be reached are made, one layer of
states for each row. The composition has no cycles, so the shortest path is found in reverse topological order, over
weights (cost, label string) that compare by cost and then by the string of edits. Extending to the left keeps
the order of such weights, which extending to the right doesn't (D before DD, but DK after DDK); so paths are grown from their ends. The
strings themselves are never built on the way: states of one layer are ranked by first label and rank of the rest.

An insertion takes no row, so inserting for ever would be a cycle; the transducer counts insertions between two rows and ends
at ``INSERTS_BETWEEN``. A third would bring the grammar back to a state it had after the first, at greater cost.

Rows meet by conversation in a sorted stream: a task holds a byte for each row of one conversation and the back pointers of its
states, never its texts. Conversations of one symbol string share their result. Repaired texts
come from a second stream over the rows, each conversation's edits ahead of it.

Defined cases: a null role or text is one space, a null id or turn likewise in what is hashed; rows of a null id are one conversation; null turns
come first and equal turns by role, then text; rows repeated in the input are duplicates; a conversation whose rows are all
dropped has no faults, no edits and an empty text; an empty table gives no rows; other columns are ignored. A
conversation of any length is streamed; its string of edits is one cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fathomline.llm.arrowmap import tidy

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INSERTS_BETWEEN = 2
#: Faults of a row.
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Conversations up to so many rows share results by their symbols, so many at a time.
SHARED_ROWS, SHARED_RESULTS = 64, 1 << 15
ROLES = {"u": "user", "a": "assistant"}


# --- machines -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Arc:
    """One edit: its label, cost, the role initial that it puts out (None: nothing), and the transducer's next state."""

    label: str
    cost: int
    out: str | None
    state: int


class Grammar:
    """Acceptor of ``(s?(ua)+)?``: nothing yet, system seen, user seen, a pair complete."""

    START, SYSTEM, USER, PAIR = range(4)
    NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
    FINAL = frozenset({START, PAIR})


@lru_cache(maxsize=None)
def row_arcs(initial: str, fault: int) -> tuple[Arc, ...]:
    """What may be done with a row; its state ends a run of insertions."""
    arcs = [Arc("D", DELETE, None, 0)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        arcs += [Arc("K", more, initial, 0), *(Arc("R", REROLE + more, role, 0) for role in ROLES)]
    return tuple(arcs)


@lru_cache(maxsize=None)
def insert_arcs(state: int) -> tuple[Arc, ...]:
    """What may be put between two rows; ``state`` counts insertions so far."""
    return tuple(Arc("I", INSERT, role, state + 1) for role in ROLES) if state < INSERTS_BETWEEN else ()


def _layer(states: set[tuple[int, int]], symbol: tuple[str, int] | None) -> tuple[dict, set[tuple[int, int]]]:
    """The arcs of the composed states at one row, with those that insertions reach, and the states at the next row."""
    arcs: dict[tuple[int, int], list] = {}
    after: set[tuple[int, int]] = set()
    open_states = sorted(states)
    while open_states:
        edit, grammar = state = open_states.pop(0)
        if state in arcs:
            continue
        own = arcs[state] = []
        for arc in insert_arcs(edit):
            if (to := Grammar.NEXT.get((grammar, arc.out))) is not None:
                own.append((arc, True, (arc.state, to)))
                open_states.append((arc.state, to))
        for arc in row_arcs(*symbol) if symbol else ():
            to = grammar if arc.out is None else Grammar.NEXT.get((grammar, arc.out))
            if to is not None:
                own.append((arc, False, (arc.state, to)))
                after.add((arc.state, to))
    return arcs, after


@lru_cache(maxsize=None)
def _layer_of(states: frozenset[tuple[int, int]], symbol: tuple[str, int] | None) -> tuple[dict, frozenset[tuple[int, int]]]:
    """Layers come back again and again; there are few sets of states and symbols."""
    arcs, after = _layer(set(states), symbol)
    return arcs, frozenset(after)


#: Weights of the states of a layer: (state, (cost, rank of the string of edits)), costs above the layer's least.
Weights = tuple[tuple[tuple[int, int], tuple[int, int]], ...]


@lru_cache(maxsize=1 << 16)
def _relax(states: frozenset[tuple[int, int]], symbol: tuple[str, int] | None, below: Weights) -> tuple[int, Weights, dict]:
    """The layer's least cost, its weights, and the arc that each state takes.

    Insertions go on in the layer, all else to the one below; the last layer (no symbol) ends in final states.
    A string is known by its first label and by what follows: a string of this layer, or its rank below. The empty one is least.
    """
    arcs, known = _layer_of(states, symbol)[0], dict(below)
    found: dict = {}
    chosen: dict = {}
    for state in sorted(arcs, key=lambda s: -s[0]):  # insertions count upwards, so this order is topological
        best = (0, ("", 0)) if symbol is None and state[1] in Grammar.FINAL else None
        step = None
        for arc, here, to in arcs[state]:
            rest = found.get(to) if here else known.get(to)
            if rest is not None:
                one = (arc.cost + rest[0], (arc.label, rest[1]))
                if best is None or one < best:
                    best, step = one, (arc, here, to)
        if best is not None:
            found[state], chosen[state] = best, step
    least = min(cost for cost, _ in found.values())
    order = {s: i for i, s in enumerate(sorted({s for _, s in found.values()}))}
    return least, tuple((state, (cost - least, order[s])) for state, (cost, s) in sorted(found.items())), chosen


def shortest(symbols: list[tuple[str, int]]) -> tuple[int, str, str]:
    """Cost, edits, and by edit the role initial put out ('-' for none), of the cheapest path, least by its edits."""
    start = (0, Grammar.START)
    layers = [frozenset({start})]
    for symbol in symbols:
        layers.append(_layer_of(layers[-1], symbol)[1])
    cost, weights, back = 0, (), []
    for states, symbol in zip(reversed(layers), [None, *reversed(symbols)]):
        least, weights, chosen = _relax(states, symbol, weights)
        cost += least
        back.append(chosen)
    cost += dict(weights)[start][0]
    edits, roles, state = [], [], start
    while (step := back[-1][state]) is not None:
        arc, here, state = step
        edits.append(arc.label)
        roles.append(arc.out or "-")
        if not here:
            back.pop()
    return cost, "".join(edits), "".join(roles)


_shared = lru_cache(maxsize=SHARED_RESULTS)(lambda symbols: shortest(list(symbols)))


def repair_of(symbols: list[tuple[str, int]]) -> tuple[int, str, str]:
    return _shared(tuple(symbols)) if len(symbols) <= SHARED_ROWS else shortest(symbols)


# --- rows ---------------------------------------------------------------------------------------------------------------

WHITE = r"\x20\x09-\x0D"
LEGAL = frozenset({"su", "ua", "au"})
#: Characters of a text that order rows of one turn and role before its digest does.
ORDERED_BY = 64


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults put in by crc32 of ``conv_id:turn`` modulo 20, for tests of repair.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    Dropped rows stay, marked as not ``present``, so that no conversation is lost.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), space(role).alias("role"), space(text).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"), copies.alias("copy")).drop("copy")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with what orders them inside a turn."""
    digest = F.when(F.col("present"), F.sha2("text", 256))
    return rows.select("conv_id", "turn", F.when(F.col("present"), F.col("role")).alias("role"), F.when(F.col("present"), F.substring("text", 1, ORDERED_BY)).alias("head"), digest.alias("digest"), "present", "text")


#: Rows of a conversation in order; nulls come first.
ORDER = ["turn", "role", "head", "digest"]

_STATS = [StructField(n, LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [StructField("audit", StringType()), StructField("roles", StringType())]


def audit(rows: DataFrame) -> DataFrame:
    """Faults and cheapest edits of each conversation of ``rows`` (conv_id, turn, role, text, present).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the edits), roles (what each edit puts out).
    """
    blank, cut = ~F.col("text").rlike(f"[^{WHITE}]"), ~F.col("text").rlike(rf"[.!?][{WHITE}]*\z")
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "digest").orderBy("turn")) > 1
    placed = _placed(rows).withColumn("own", F.when(blank, BLANK).when(cut, CUT).otherwise(FINE)).drop("text").repartition("conv_id")
    fault = F.when((F.col("own") != BLANK) & seen, DUPLICATE).otherwise(F.col("own"))
    sent = placed.withColumn("fault", fault).sortWithinPartitions("conv_id", *ORDER).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "present")
    schema = StructType([rows.schema["conv_id"], *_STATS])
    arrow = to_arrow_schema(schema)

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv, turn, initial, fault, present in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv)
                if present:
                    now.add(turn, initial, fault)
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, d)) for d in done], schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, now.result()))], schema=arrow)

    return sent.mapInArrow(tidy(run), schema)


class _Conversation:
    """What is kept of a conversation as its rows pass: one reference a row."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols = conv_id, []
        self.least = self.most = None
        self.turns = self.illegal = 0
        self.faults = [0] * 4

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.symbols and self.symbols[-1][0] + initial not in LEGAL:
            self.illegal += 1
        self.faults[fault] += 1
        self.symbols.append(_symbol(initial, fault))

    def result(self) -> list:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return [self.conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, *repair_of(self.symbols)]


@lru_cache(maxsize=1 << 12)
def _symbol(initial: str, fault: int) -> tuple[str, int]:
    """One object for equal symbols."""
    return initial, fault


def _met(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, in order, in one partition."""
    stats = F.struct(*[f.name for f in _STATS]).alias("stats")
    kind = audits.select("conv_id", F.lit(0).alias("kind"), stats)
    both = kind.unionByName(_placed(rows).filter("present").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER).select("conv_id", "stats", "turn", "role", "text")


def _edited(batches) -> Iterator[tuple]:
    """(conv_id, stats, rest): the audit of a conversation, and then, with None for stats, (edit, turn, role, text) of each edit in order."""
    conv = stats = None
    at = 0

    def inserts(turn):
        nonlocal at
        while at < len(stats["audit"]) and stats["audit"][at] == "I":
            at += 1
            yield conv, None, ("I", turn, ROLES[stats["roles"][at - 1]], "")

    for batch in batches:
        for row_conv, row_stats, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if row_stats is not None:
                if stats is not None:
                    yield from inserts(None)
                conv, stats, at = row_conv, row_stats, 0
                yield conv, stats, None
                continue
            yield from inserts(turn)
            edit, out = stats["audit"][at], stats["roles"][at]
            at += 1
            yield conv, None, (edit, turn, role if edit != "R" else ROLES[out], text)
    if stats is not None:
        yield from inserts(None)


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), turn (of an inserted row: the next row's), role, text, edit."""
    fields = [rows.schema["conv_id"], StructField("position", LongType()), rows.schema["turn"], StructField("role", StringType()), StructField("text", StringType()), StructField("edit", StringType())]
    arrow = to_arrow_schema(StructType(fields))

    def run(batches):
        out, position = [], 0
        for conv, stats, row in _edited(batches):
            if stats is not None:
                position = 0
            elif row[0] != "D":
                out.append(dict(zip(arrow.names, (conv, position, *row[1:], row[0]))))
                position += 1
                if len(out) == 1024:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _met(rows, audits).mapInArrow(tidy(run), StructType(fields))


def digest(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` with repaired_sha256: of ``role:text`` of the repaired rows, joined by newlines."""
    schema = StructType([rows.schema["conv_id"], *_STATS[:-1], StructField("repaired_sha256", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        out, now = [], None
        for conv, stats, row in _edited(batches):
            if stats is not None:
                if now is not None:
                    out.append(now[0] | {"repaired_sha256": now[1].hexdigest()})
                if len(out) == 1024:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
                now = [{"conv_id": conv, **{k: v for k, v in stats.items() if k != "roles"}}, hashlib.sha256(), b""]
            elif row[0] != "D":
                now[1].update(now[2] + f"{row[2]}:{row[3]}".encode())
                now[2] = b"\n"
        if now is not None:
            out.append(now[0] | {"repaired_sha256": now[1].hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _met(rows, audits).mapInArrow(tidy(run), schema)
