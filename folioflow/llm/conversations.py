"""Conversation repair: generalised LR parsing of role initials, with edits.

An LR table is built from the role grammar.  A graph-structured stack follows
all parses of a conversation at once: from each stack top a turn is kept (if
the table shifts its role's initial), given another role, or deleted, and
turns are inserted where the table shifts them.  Each action has a cost and a
letter; tops with an equal state are merged and the one with the smallest
(cost, letters) stays.  That is exact for grammars in which the state of a top
tells what may follow, as it does here: whatever lies below ``u``, ``a (ua)*``
follows.

Conversations are streams: rows are dealt out by conversation once, sorted
within their partition, and read in Arrow batches.  Edits on which all tops
agree are given out as they come, so what is held of a conversation is its
undecided end and its letters.  A conversation is read by one task, as the
hash of its repaired text is a chain over all of it; which turns are repeats
is decided by Spark's sort (which spills) and not in the task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

#: The role grammar: C is a conversation, T its pairs, P a pair of turns; s, u and a are initials of roles.  The first rule's head is the start.
GRAMMAR = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "P"), ("T", "TP"), ("P", "ua"))
#: Roles that a turn may be given, and that inserted turns have.
ROLES = ("user", "assistant")
DELETE, REROLE, INSERT, TRUNCATION = 4, 3, 3, 3
#: A top that costs more than this above the cheapest can't win: from any top two inserted turns reach a complete pair or an
#: open one, and one deletion makes up for a first system turn that another top could keep.
SLACK = 2 * INSERT + DELETE
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Edits held back before it is looked whether all tops agree on some.
HELD = 128
SPACE = " \t\n\x0b\x0c\r"


class Table(NamedTuple):
    """Per state: where symbols lead, the rule to reduce by (head, length), and whether the input may end."""

    shift: list[dict[str, int]]
    reduce: list[tuple[str, int] | None]
    accept: list[bool]


def lr_table(grammar: tuple[tuple[str, str], ...]) -> Table:
    """The LR(0) automaton of a grammar of one-letter symbols; rules of the start symbol end the input instead of being reduced."""
    start = grammar[0][0]

    def closure(items: Iterable[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        have, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            new = {(k, 0) for k, (head, _) in enumerate(grammar) if head == grammar[rule][1][dot : dot + 1]} - have
            have |= new
            todo += new
        return frozenset(have)

    states = [closure([(k, 0) for k, (head, _) in enumerate(grammar) if head == start])]
    shift, reduce, accept = [], [], []
    for items in states:  # grows meanwhile
        done = [grammar[rule] for rule, dot in items if dot == len(grammar[rule][1])]
        edges = {}
        for symbol in sorted({grammar[rule][1][dot] for rule, dot in items if dot < len(grammar[rule][1])}):
            to = closure([(rule, dot + 1) for rule, dot in items if grammar[rule][1][dot : dot + 1] == symbol])
            if to not in states:
                states.append(to)
            edges[symbol] = states.index(to)
        inner = [(head, len(body)) for head, body in done if head != start]
        if len(inner) > 1 or (inner and edges):
            raise ValueError("the grammar needs lookahead")
        shift.append(edges)
        reduce.append(inner[0] if inner else None)
        accept.append(len(inner) < len(done))
    return Table(shift, reduce, accept)


class Edit:
    """One action of a parse, with the one before it; number: how many actions up to here."""

    __slots__ = ("before", "letter", "number", "role", "text")

    def __init__(self, before: Edit | None, letter: str, role: str, text: str, number: int):
        self.before, self.letter, self.role, self.text, self.number = before, letter, role, text, number


class Top(NamedTuple):
    """A stack top: its state, what lies below, and the cheapest way to it (letters: of the actions not given out yet)."""

    state: int
    below: Top | None
    cost: int
    letters: str
    edit: Edit | None


class Parser:
    """The graph-structured stack of one conversation."""

    def __init__(self, table: Table):
        self.table, self.given, self.look = table, 0, HELD
        self.tops: dict[int, Top] = {0: Top(0, None, 0, "", None)}
        self._insert()

    def _edit(self, top: Top, letter: str, role: str, text: str) -> Edit:
        return Edit(top.edit, letter, role, text, (top.edit.number if top.edit else self.given) + 1)

    def _merge(self, tops: dict[int, Top], top: Top) -> bool:
        have = tops.get(top.state)
        if have is None or (top.cost, top.letters) < (have.cost, have.letters):
            tops[top.state] = top
            return True
        return False

    def _shift(self, tops: dict[int, Top], top: Top, cost: int, letter: str, role: str, text: str) -> Top | None:
        """Push a role's initial and reduce; the new top if it is the best of its state."""
        shift, reduce = self.table.shift, self.table.reduce
        state, below = shift[top.state].get(role[:1]), top
        if state is None or not role:
            return None
        while reduce[state]:
            head, length = reduce[state]
            for _ in range(length - 1):
                below = below.below
            state = shift[below.state][head]
        new = top.cost + cost, top.letters + letter
        have = tops.get(state)
        if have is not None and new >= (have.cost, have.letters):
            return None
        tops[state] = made = Top(state, below, *new, self._edit(top, letter, role, text))
        return made

    def _insert(self) -> None:
        todo = list(self.tops.values())
        while todo:
            top = todo.pop()
            for role in ROLES:
                if made := self._shift(self.tops, top, INSERT, "I", role, ""):
                    todo.append(made)

    def turn(self, role: str, text: str, fault: int) -> None:
        tops: dict[int, Top] = {}
        extra = TRUNCATION if fault == TRUNCATED else 0
        for top in self.tops.values():
            self._merge(tops, Top(top.state, top.below, top.cost + DELETE, top.letters + "D", self._edit(top, "D", role, text)))
            if fault in (NONE, TRUNCATED):
                self._shift(tops, top, extra, "K", role, text)
                for other in ROLES:
                    self._shift(tops, top, REROLE + extra, "R", other, text)
        least = min(t.cost for t in tops.values()) + SLACK
        self.tops = {s: t for s, t in tops.items() if t.cost <= least}
        self._insert()

    def agreed(self) -> list[Edit]:
        """Edits that all tops share and that weren't given out yet."""
        ends = [t.edit for t in self.tops.values()]
        if None in ends or max(e.number for e in ends) - self.given < self.look:
            return []
        while any(e is not ends[0] for e in ends):
            last = max(e.number for e in ends)
            ends = [e.before if e is not None and e.number == last else e for e in ends]
            if None in ends:
                self.look *= 2
                return []
        self.look = HELD
        out = self._back(ends[0])
        cut, self.given = ends[0].number - self.given, ends[0].number
        ends[0].before = None
        self.tops = {s: t._replace(letters=t.letters[cut:], edit=None if t.edit is ends[0] else t.edit) for s, t in self.tops.items()}
        for t in self.tops.values():  # what follows the last shared edit starts anew
            e = t.edit
            while e is not None and e.before is not None and e.before is not ends[0]:
                e = e.before
            if e is not None:
                e.before = None
        return out

    def _back(self, edit: Edit | None) -> list[Edit]:
        out = []
        while edit is not None:
            out.append(edit)
            edit = edit.before
        return out[::-1]

    def end(self) -> tuple[int, list[Edit]]:
        """Cost of the cheapest parse, and its edits that weren't given out yet."""
        best = min((t for s, t in self.tops.items() if self.table.accept[s]), key=lambda t: (t.cost, t.letters))
        return best.cost, self._back(best.edit)


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault, gone), dealt out by conversation and sorted by turn (nulls first; ties by role, then text).

    ``rows``: conv_id, turn, role, text (null role or text: one space), copy (int), gone (true: a row that is there only for
    its conversation's sake).  A turn's fault is the first that applies: blank, repeats an earlier role and text, truncated.  A turn with an empty role has no initial and is never kept.
    """
    space = F.lit(SPACE)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    seen = Window.partitionBy("conv_id", "mark", "role", "text", "gone").orderBy(*order)
    end = F.rtrim("text", space)
    rows = rows.withColumn("mark", F.xxhash64("role", "text")).repartition("conv_id").withColumn("nth", F.row_number().over(seen))
    fault = F.when(end == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    return rows.select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"), "gone").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order).drop("copy")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, what) in order: what is a row's (turn, role, text, fault), None for a row that is gone, or "end"."""
    now, begun = None, False
    for batch in batches:
        for conv, turn, role, text, fault, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun and conv != now:
                yield now, "end"
            now, begun = conv, True
            yield conv, None if gone else (turn, role, text, fault)
    if begun:
        yield now, "end"


def _start(rows: DataFrame) -> DataFrame:
    """Rows of the four columns alone, nothing gone; null role and text: one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), action (K, R or I), role, text.

    ``rows``: conv_id, turn, role, text; other columns are left out.  A null conv_id is a conversation of its own, a null turn
    comes first, null role or text is one space.  Very long texts are handled whole.  Conversations of which nothing is left
    have no rows; an empty table gives none.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    table = lr_table(GRAMMAR)

    def run(batches):
        schema, out, parser, position = None, [], Parser(table), 0

        def batch():
            nonlocal out
            cols, out = list(zip(*out, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema, strict=True)], ["conv_id", "position", "action", "role", "text"])

        def typed(stream):
            nonlocal schema
            for b in stream:
                schema = schema or [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield b

        for conv, what in _conversations(typed(batches)):
            if what == "end":
                edits = parser.end()[1]
            else:
                if what:
                    parser.turn(*what[1:])
                edits = parser.agreed()
            for e in edits:
                if e.letter != "D":
                    out.append((conv, position, e.letter, e.role, e.text))
                    position += 1
            if what == "end":
                parser, position = Parser(table), 0
            if len(out) >= 1024:
                yield batch()
        if out:
            yield batch()

    start = _start(rows).withColumns({"copy": F.lit(0), "gone": F.lit(False)})
    return marked(start).mapInArrow(run, f"conv_id {kind}, position long, action string, role string, text string")


SUMMARY = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def repair_summary(rows: DataFrame) -> DataFrame:
    """A row a conversation: gaps in its turns, faults, cost and letters of the cheapest repair, hash of the repaired text.

    ``rows`` as in ``marked``.  A conversation whose rows are all gone has zeros, no letters, and the hash of the empty string.
    An empty table gives none.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    table = lr_table(GRAMMAR)
    legal = {"su", "ua", "au"}

    def run(batches):
        ids, out, kinds = [], [], []

        def typed(stream):
            for b in stream:
                kinds[:] = kinds or [b.schema.field(0).type]
                yield b

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), *(pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), SUMMARY, strict=True))], ["conv_id", *(n for n, _ in SUMMARY)])
            ids.clear()
            out.clear()
            return made

        def new():
            return Parser(table), hashlib.sha256(), [], [0, 0, 0, 0], None, None, 0, 0, None

        parser, digest, letters, faults, first, last, distinct, illegal, initial = new()
        written = False
        for conv, what in _conversations(typed(batches)):
            if what == "end":
                cost, edits = parser.end()
            else:
                edits = []
                if what:
                    turn, role, text, fault = what
                    parser.turn(role, text, fault)
                    edits = parser.agreed()
                    faults[fault] += 1
                    if turn is not None:
                        first = turn if first is None else first
                        distinct += turn != last
                        last = turn
                    illegal += initial is not None and initial + role[:1] not in legal
                    initial = role[:1]
            for e in edits:
                letters.append(e.letter)
                if e.letter != "D":
                    digest.update(("\n" * written + e.role + ":" + e.text).encode())
                    written = True
            if what == "end":
                ids.append(conv)
                out.append((last - first + 1 - distinct if first is not None else 0, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, "".join(letters), digest.hexdigest()))
                parser, digest, letters, faults, first, last, distinct, illegal, initial = new()
                written = False
                if len(out) >= 4096:
                    yield batch()
        if out:
            yield batch()

    names = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in SUMMARY)
    return marked(rows).mapInArrow(run, f"conv_id {kind}, {names}")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20: dropped (gone), emptied, without end marks, repeated, given to the user."""
    start = _start(rows)
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    hit = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text = F.when(hit.isin(0, 1), "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return start.select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (hit == 0).alias("gone"),
        F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summary(damaged(load(spark, sf_dir, "conversations")))
