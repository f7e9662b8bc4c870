"""Repair of conversation structure: the cheapest edits that make the roles of a conversation
read ``(s?(ua)+)?`` by their initials.

A conversation's rows are taken by turn (nulls first; equal turns by role, then text). Each row
has at most one fault, the first of: blank (no character but white space), duplicate (role and
text seen earlier in the conversation), truncated (its last character that is no white space is
not a full stop, exclamation or question mark). Edits and costs: Keep 0, Rerole to user or
assistant 2, Delete 3 (the only edit of a blank or duplicate row), Insert an empty user or
assistant row 2; a truncated row that stays adds 1. Among edits of equal cost the least string
of initials (D, I, K, R) wins.

Survivor-coalescence Viterbi. Rows of a conversation stream through :class:`Repair` in order. It
keeps the best path into each state of the grammar (start, after system, user, assistant), unless
another state's path is better even after all it takes to do the same from there, as a tree of
back-pointers with reference counts. A branch that loses its last survivor is freed; as
soon as all survivors share an ancestor, everything up to it is final and leaves as edits, so
memory holds only the rows that are still undecided, not the conversation. Tied paths are ranked
by their whole undecided strings: after the same rows no path's string is a prefix of another's,
so the order of two paths also orders whatever is appended to them, and a rank carried along is
the comparison of the complete tied suffixes.

Identical rows are counted before any shuffle, so repeated rows cost one row each. One
conversation is then one sorted stream in one task: its edits and its hash are chains in which
each step needs the one before.

Defined cases: a null role or text is one space; a null turn sorts first and is no turn for the
gaps; rows of a null conversation id are one conversation; an empty role has no initial, so it
can be reroled or deleted but not kept; a conversation whose rows were all dropped has zeros and
an empty repair; an empty table gives no row; a very long text is held whole, but only while its
row is undecided; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPACES = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
LEGAL = frozenset(("su", "ua", "au"))

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a row of that initial; absent: not allowed there.
NEXT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
ENDS = (START, ASSISTANT)
#: What it costs at most to do from the first state whatever can be done from the second one: by
#: inserting the rows that lead there, or by deleting a system row that is kept there.
MIMIC = {
    (START, SYSTEM): 0, (START, ASSISTANT): 0, (START, USER): 2,
    (SYSTEM, USER): 2, (SYSTEM, START): 4, (SYSTEM, ASSISTANT): 4,
    (USER, ASSISTANT): 2, (USER, SYSTEM): 2, (USER, START): 5,
    (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 2, (ASSISTANT, START): 3,
}
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 2, 3, 2, 1
#: Rows written at a time.
BATCH = 4096

#: An edit: its initial, and role and text of the repaired row (none for Delete).
Edit = tuple[str, str | None, str | None]


class Node:
    """Edits of one row on one path; ``children`` are the living paths that go on from it, and
    ``tip`` says that a survivor ends here."""

    __slots__ = ("parent", "edits", "children", "tip")

    def __init__(self, parent: Node | None, edits: tuple[Edit, ...]):
        self.parent, self.edits = parent, edits
        self.children: list[Node] = []
        self.tip = False


def inserted(state: int) -> list[tuple[int, int, tuple[Edit, ...]]]:
    """States that inserted rows reach from a state, with cost and edits. Two rows at most: three
    come back to a state for more."""
    out: list[tuple[int, int, tuple[Edit, ...]]] = [(state, 0, ())]
    for _ in range(2):
        before, cost, edits = out[-1]
        initial = "a" if before == USER else "u"
        out.append((NEXT[before, initial], cost + INSERT, (*edits, ("I", NAMES[initial], ""))))
    return out


INSERTED = [inserted(s) for s in range(4)]


class Repair:
    """The stream of one conversation. ``row`` and ``end`` give the edits that became final."""

    def __init__(self) -> None:
        self.root = Node(None, ())
        self.root.tip = True
        #: Survivors in the order of their strings: (state, cost, node).
        self.survivors = [(START, 0, self.root)]

    def row(self, role: str, text: str, fault: str) -> list[Edit]:
        """Take the next row; ``fault`` is blank, duplicate, truncated or empty."""
        stays = STAYS_TRUNCATED if fault == "truncated" else 0
        best: dict[int, tuple] = {}
        for rank, (state, cost, node) in enumerate(self.survivors):
            for at, extra, edits in INSERTED[state]:
                so_far = cost + extra
                options = [(at, DELETE, ("D", None, None))]
                if fault not in ("blank", "duplicate"):
                    kept = NEXT.get((at, role[:1]))
                    if kept is not None:
                        options.append((kept, stays, ("K", role, text)))
                    options += [
                        (NEXT[at, i], REROLE + stays, ("R", name, text))
                        for i, name in NAMES.items()
                        if (at, i) in NEXT
                    ]
                for to, more, edit in options:
                    found = (*edits, edit)
                    key = (so_far + more, rank, "".join(e[0] for e in found))
                    if to not in best or key < best[to][0]:
                        best[to] = (key, node, found)
        hopeless = [
            to
            for to, (key, *_) in best.items()
            if any(key[0] > best[by][0][0] + MIMIC[by, to] for by in best if by != to)
        ]
        for to in hopeless:
            del best[to]
        return self._survive(best)

    def end(self) -> tuple[int, list[Edit]]:
        """Cost of the repair, and the edits that were still open."""
        best = None
        for rank, (state, cost, node) in enumerate(self.survivors):
            for at, extra, edits in INSERTED[state]:
                key = (cost + extra, rank, "".join(e[0] for e in edits))
                if at in ENDS and (best is None or key < best[0]):
                    best = (key, node, edits)
        key, node, edits = best
        out = self._survive({ASSISTANT: best})
        last = self.survivors[0][2]
        # The path that is left is a chain, so all of it was final.
        assert last is self.root
        return key[0], out

    def _survive(self, best: dict[int, tuple]) -> list[Edit]:
        old = [node for _, _, node in self.survivors]
        self.survivors = []
        for state, (key, parent, edits) in sorted(best.items(), key=lambda x: x[1][0][1:]):
            node = Node(parent, edits)
            node.tip = True
            parent.children.append(node)
            self.survivors.append((state, key[0], node))
        for node in old:
            node.tip = False
            self._free(node)
        out: list[Edit] = []
        while not self.root.tip and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            out += self.root.edits
        return out

    @staticmethod
    def _free(node: Node) -> None:
        while not node.tip and not node.children and node.parent is not None:
            node.parent.children.remove(node)
            node = node.parent


class Conversation:
    """Counts, repair and hash of one conversation, from its rows in order."""

    def __init__(self, conv: object):
        self.conv, self.repair = conv, Repair()
        self.turns, self.first, self.last = 0, None, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.audit: list[str] = []
        self.sha, self.n_rows = hashlib.sha256(), 0

    def take(self, turn: int | None, role: str, text: str, seen: bool) -> list[Edit]:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        stripped = text.rstrip(SPACES)
        if not stripped:
            fault = "blank"
        elif seen:
            fault = "duplicate"
        else:
            fault = "" if stripped.endswith(STOPS) else "truncated"
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        return self.settle(self.repair.row(role, text, fault))

    def settle(self, edits: list[Edit]) -> list[Edit]:
        for initial, role, text in edits:
            self.audit.append(initial)
            if role is not None:
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                self.sha.update(b"\n" + line if self.n_rows else line)
                self.n_rows += 1
        return edits

    def end(self) -> tuple[int, list[Edit]]:
        cost, edits = self.repair.end()
        return cost, self.settle(edits)

    @property
    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that the CRC-32 of ``conv_id:turn`` modulo 20 decides: 0 drops a row,
    1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. A
    dropped row stays with 0 ``copies`` and no content, so that its conversation is known."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role, text = part("role"), part("text")
    gone = F.col("kind") == 0
    return conversations.withColumn("kind", kind).select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(gone | (F.col("kind") == 1), "")
        .when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def ordered(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """Distinct rows with their number of copies (``copies`` names the column that holds it; each
    row is one otherwise), each conversation as one sorted run of a partition; ``seen``: role and
    text occur at an earlier turn."""
    rows = conversations.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"),
    )
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # A dropped row (no copies) is no earlier row.
    same = W.partitionBy("conv_id", "role", "text", F.col("copies") > 0)
    earlier = F.row_number().over(same.orderBy(F.col("turn").asc_nulls_first())) > 1
    return (
        counted.repartition("conv_id")
        .withColumn("seen", earlier)
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    )


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, list[Edit], int | None]]:
    """Conversations with the edits that became final, row by row; the cost comes with the last."""
    now: Conversation | None = None
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "seen"))
        for conv, turn, role, text, copies, seen in zip(*columns, strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    cost, edits = now.end()
                    yield now, edits, cost
                now = Conversation(conv)
            for copy in range(copies):
                yield now, now.take(turn, role, text, seen or copy > 0), None
    if now is not None:
        cost, edits = now.end()
        yield now, edits, cost


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [()] * len(schema)
        arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield batch()
            held.clear()
    yield batch()


def _conv_field(df: DataFrame) -> T.StructField:
    return T.StructField("conv_id", df.schema["conv_id"].dataType)


def repair_report(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text) rows: faults, cost, the edits'
    initials and the hash of the repaired ``role:text`` lines. See :func:`ordered`."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType(
        [_conv_field(conversations)]
        + [T.StructField(c, T.LongType()) for c in counts]
        + [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]
    )
    arrow = to_arrow_schema(schema)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(
            (
                (c.conv, c.gaps, *c.counts.values(), c.illegal, cost, "".join(c.audit), c.sha.hexdigest())
                for c, _, cost in _streamed(batches)
                if cost is not None
            ),
            arrow,
        )

    return ordered(conversations, copies).mapInArrow(report, schema)


def repaired(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), edit (K, R or I), role and text. Rows leave
    as soon as they are final."""
    schema = T.StructType(
        [
            _conv_field(conversations),
            T.StructField("position", T.LongType()),
            *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")],
        ]
    )
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for c, edits, _ in _streamed(batches):
            kept = [e for e in edits if e[1] is not None]
            for position, edit in enumerate(kept, c.n_rows - len(kept)):
                yield (c.conv, position, *edit)

    return ordered(conversations, copies).mapInArrow(lambda b: _batches(rows(b), arrow), schema)
