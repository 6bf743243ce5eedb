"""Conversation structure repair: weighted finite-state composition, searched as it is composed.

Three machines. The input acceptor is a conversation, row by row. The edit transducer keeps a row (cost 0), gives it a new role (1),
deletes it (2; rows that are blank or repeat an earlier row must go) or inserts an empty row (5); rows that break off and stay cost 5
more. The grammar acceptor takes the role initials `(s?(ua)+)?`. Their composition has a state for each (row, grammar state), made
only for the row at hand: arcs that read a row lead to the next layer, inserts stay in a layer and never help more than twice in
a row, so layers are relaxed in topological order. Weights are (cost, string of edit initials), compared in that order. Paths
into one state at equal cost never have strings of which one begins the other, as the longer would hold inserts that the shorter does not pay for,
so the lesser string stays the lesser one however both go on, and one best path a state is enough.

Spark shuffles the rows once by conversation, marks repeats by a window within that partitioning and sorts by turn; tasks stream the rows.
Besides the edits, which are part of the result, a task holds four weights and four running SHA-256 states whatever a
conversation's length, so conversations are never gathered. A hash over a conversation is sequential: one conversation is one task's.

Null roles and texts are one space, and so are null ids and turns in the damage's key. Rows of null conv_id are one conversation. Null turns
come first, rows of one turn in order of role and text. Roles whose initial is not s, u or a, empty ones too, fit nowhere unless they are
changed. Repeated rows are repeats. An empty table gives no row. Columns other than conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
ROLES = {"u": "user", "a": "assistant"}
#: The grammar acceptor: START (accepts), after s, after u, after a (accepts).
START, SYSTEM, USER, ASSISTANT = range(4)
ARCS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
#: Inserts in a row that can help: two reach any state of the grammar that can be reached so.
INSERTS = 2
#: Edits that a path holds in one string; older ones are a chain of such strings.
TAIL = 256

_SPACE = " \t\n\x0b\x0c\r"
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Path:
    """A best path into a state of the composition: its weight, and the digest of the rows it has written.

    Strings are compared without walking them. Paths that end in the edit of one row are never each other's beginnings, so their order,
    rank, settles that of all that follows them; where it is equal, the edits since then decide.
    """

    __slots__ = ("cost", "rank", "inserts", "edits", "before", "hash", "rows")

    def __init__(self, cost=0, rank=0, inserts=0, edits="", before=None, digest=None, rows=0):
        self.cost, self.rank, self.inserts = cost, rank, inserts
        self.edits, self.before, self.hash, self.rows = edits, before, digest or hashlib.sha256(), rows

    def weight(self) -> tuple:
        return self.cost, self.rank, self.inserts

    def then(self, edit: str, cost: int, role: str | None, text: str) -> Path:
        digest = self.hash
        if role is not None:
            digest = digest.copy()
            digest.update((("\n" if self.rows else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        inserts = self.inserts + 1 if edit == INSERT else 0
        return Path(cost, self.rank, inserts, self.edits + edit, self.before, digest, self.rows + (role is not None))

    def audit(self) -> str:
        parts, before = [self.edits], self.before
        while before:
            before, part = before
            parts.append(part)
        return "".join(reversed(parts))


class Repair:
    """The composition of one conversation with the edits and the grammar, row after row."""

    def __init__(self):
        self.paths = self._inserted({START: Path()})

    @staticmethod
    def _best(arcs: list[tuple]) -> list[tuple]:
        """The least weight into each state, in order of their strings. arcs: (state, cost, path before, edit, role, text)."""
        order = lambda arc: (arc[2].rank, INSERT * arc[2].inserts + arc[3])
        best: dict[int, tuple] = {}
        for arc in arcs:
            other = best.get(arc[0])
            if other is None or (arc[1], order(arc)) < (other[1], order(other)):
                best[arc[0]] = arc
        return sorted(best.values(), key=order)

    def _inserted(self, layer: dict[int, Path]) -> dict[int, Path]:
        """The layer with its states that inserts reach, relaxed by number of inserts."""
        best, front = dict(layer), layer
        for _ in range(INSERTS):
            arcs = [
                (to, path.cost + COST[INSERT], path, INSERT, ROLES[initial], "")
                for state, path in front.items()
                for initial, to in ARCS[state].items()
                if initial in ROLES
            ]
            better = lambda a: a[0] not in best or (a[1], a[2].rank, a[2].inserts + 1) < best[a[0]].weight()
            front = {a[0]: a[2].then(a[3], a[1], a[4], a[5]) for a in self._best(arcs) if better(a)}
            best |= front
        return best

    def read(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        arcs: list[tuple] = []
        for state, path in self.paths.items():
            arcs.append((state, path.cost + COST[DELETE], path, DELETE, None, ""))
            if not must_go:
                stay = path.cost + (TRUNCATED_COST if truncated else 0)
                for initial, to in ARCS[state].items():
                    if role[:1] == initial:
                        arcs.append((to, stay + COST[KEEP], path, KEEP, role, text))
                    if initial in ROLES:
                        arcs.append((to, stay + COST[REROLE], path, REROLE, ROLES[initial], text))
        layer = {}
        for rank, (state, cost, path, edit, new_role, new_text) in enumerate(self._best(arcs)):
            layer[state] = path.then(edit, cost, new_role, new_text)
            layer[state].rank = rank
        for path in layer.values():
            if len(path.edits) > TAIL:
                path.before, path.edits = (path.before, path.edits), ""
        self.paths = self._inserted(layer)

    def end(self) -> tuple[int, str, str]:
        """Cost, edits and digest of the best path that the grammar accepts; deleting all rows is one."""
        best = min((self.paths[s] for s in FINAL if s in self.paths), key=Path.weight)
        return best.cost, best.audit(), best.hash.hexdigest()


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.first = self.last = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def read(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        self.repair.read(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and turn; a row without a role is of a conversation's dropped rows."""
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))])
    schema = schema.append(pa.field("audit", pa.string())).append(pa.field("repaired_sha256", pa.string()))
    made: list[tuple] = []
    at = None

    def out() -> pa.RecordBatch:
        rows = [dict(zip(schema.names, r)) for r in made]
        made.clear()
        return pa.RecordBatch.from_pylist(rows, schema)

    for batch in batches:
        for conv_id, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
            if at is None or at.conv_id != conv_id:
                if at is not None:
                    made.append(at.row())
                at = _Conversation(conv_id)
            if role is not None:
                at.read(turn, role, text, fault)
        if len(made) > 5000:
            yield out()
    if at is not None:
        made.append(at.row())
    yield out()


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turn as long, role and text as string with a space for null; all other columns are left out."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def damaged(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """The rows with faults planted by a hash of their place. Dropped ones keep conv_id and nothing else, so that no conversation is lost."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(kinds))
    rows = rows_of(conversations).withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    gone = lambda column: F.when(F.col("kind") != 0, column)
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    rows = rows.select(
        "conv_id",
        gone(F.col("turn")).alias("turn"),
        gone(F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))).alias("role"),
        gone(text).alias("text"),
        copies.alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def repair(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each conversation: its faults, the cheapest edits that repair it, and the digest of what they leave.

    rows: conv_id, turn, role, text; where role is null, the row only says that there is such a conversation.
    """
    known = F.col("role").isNotNull()
    rows = rows.repartition(*([partitions] if partitions else []), "conv_id")
    same = Window.partitionBy("conv_id", "role", F.md5(F.col("text").cast("binary"))).orderBy(F.col("turn").asc_nulls_first())
    words = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(words == "", "blank").when(F.col("time") > 1, "duplicate").when(~F.substring(words, -1, 1).isin(".", "!", "?"), "truncated")
    faulty = rows.withColumn("time", F.row_number().over(same)).withColumn("fault", F.when(known, fault))
    in_order = faulty.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "time")
    return in_order.select("conv_id", "turn", "role", "text", "fault").mapInArrow(_repair, _RESULT)
