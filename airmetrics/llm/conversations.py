"""Repair of the structure of conversations: a system turn at most, then user and assistant in turn.

Rows with faults (blank, repeated, cut off) and rows in the wrong place are kept, given another
role or deleted, and missing turns are put in, at the least total cost. The lattice of edits has a
node per row border and grammar state. It is searched from both ends at once: two heaps, one of
costs from the start and one of costs to the end, expand in turn until no cheaper or equally cheap
meeting is left. Of all cheapest ways the one whose audit (the initials of its edits, in order) is
least in ASCII order is taken; it is unique, as an initial names one edge of a node.

Rows stream through the tasks in the order of their conversation. The search holds a few numbers
a row; texts go by one at a time. A conversation is one sequence, and its repair and digest are
sequential, so it is the unit of work.

Defined results: null roles and texts count as one space; a null conversation is one like any
other; rows of a null turn come first; rows of one turn are ordered by role, then by a hash of
role and text; equal rows are duplicates from the second on. A role that begins with none of ``s``,
``u`` and ``a`` (an empty one too) cannot be kept. A conversation without rows, like an empty table,
needs no edit. Only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from airmetrics.llm.common import stored

# Grammar states, and what each edit costs.
START, SYSTEM, USER, ASSISTANT = range(4)
RETITLE, DELETE, INSERT, CUT = 2, 3, 2, 1
ENDS = (START, ASSISTANT)
#: Per state, where a user or assistant turn leads, and which of the two may come.
SPOKEN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_FAR = 1 << 60
#: A task hands turns on after so many characters or rows.
OUT_CHARS, OUT_ROWS = 4 << 20, 10_000


class Lattice:
    """The edits of one conversation; a node is ``4 * row + state``.

    ``initials`` holds the first letter of each row's role; ``faults`` is ``x`` for a row that has
    to go, ``t`` for one that is cut off, ``.`` for others.
    """

    def __init__(self, initials: str, faults: str):
        self.initials, self.faults, self.rows = initials, faults, len(initials)

    def ahead(self, node: int) -> Iterator[tuple[int, int, str]]:
        """Edges out of a node: where to, at what cost, by which edit."""
        row, state = divmod(node, 4)
        yield 4 * row + SPOKEN[state], INSERT, "I"
        if row < self.rows:
            yield from self._over(row, state)

    def _over(self, row: int, state: int) -> Iterator[tuple[int, int, str]]:
        base = 4 * row + 4
        yield base + state, DELETE, "D"
        fault = self.faults[row]
        if fault != "x":
            cut = CUT if fault == "t" else 0
            yield base + SPOKEN[state], RETITLE + cut, "R"
            kept = KEPT.get(self.initials[row], {}).get(state)
            if kept is not None:
                yield base + kept, cut, "K"

    def behind(self, node: int) -> Iterator[tuple[int, int, str]]:
        """Edges into a node: where from, at what cost, by which edit."""
        row, state = divmod(node, 4)
        for before in range(4):
            if SPOKEN[before] == state:
                yield 4 * row + before, INSERT, "I"
            if row:
                for to, cost, edit in self._over(row - 1, before):
                    if to == node:
                        yield 4 * row - 4 + before, cost, edit


class _Side:
    """One of the two searches: least costs, the best neighbour towards its origin, its edit."""

    def __init__(self, nodes: int, origins: list[int], forward: bool):
        self.forward = forward
        self.cost = array("q", [_FAR]) * nodes
        self.link = array("q", [-1]) * nodes
        self.edit = bytearray(nodes)
        self.settled = bytearray(nodes)
        self.heap: list[tuple[int, int, int]] = []
        for node in origins:
            self.reach(node, 0, -1, "")

    def key(self, node: int) -> tuple[int, int]:
        """Every edge leads to a greater key, so a settled node has seen all its ties."""
        return self.cost[node], node // 4 if self.forward else -(node // 4)

    def reach(self, node: int, cost: int, link: int, edit: str) -> None:
        self.cost[node], self.link[node] = cost, link
        if edit:
            self.edit[node] = ord(edit)
        heappush(self.heap, (*self.key(node), node))

    def top(self) -> int:
        while self.heap and self.settled[self.heap[0][2]]:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else _FAR

    def path(self, node: int) -> str:
        edits = bytearray()
        while self.link[node] >= 0:
            edits.append(self.edit[node])
            node = self.link[node]
        return (edits[::-1] if self.forward else edits).decode()

    def better(self, node: int, link: int, edit: str) -> bool:
        """Whether an equally cheap way by ``link`` has the lesser audit."""
        if not self.forward:
            return ord(edit) < self.edit[node]
        # Back to where the two ways part; the edits taken there decide.
        one, two, a, b = self.link[node], link, self.edit[node], ord(edit)
        while one != two:
            first, second = self.key(one), self.key(two)
            if first >= second:
                one, a = self.link[one], self.edit[one]
            if second >= first:
                two, b = self.link[two], self.edit[two]
        return b < a


def cheapest(lattice: Lattice) -> tuple[int, str]:
    """Cost and audit of the repair."""
    nodes, last = 4 * lattice.rows + 4, 4 * lattice.rows
    ends = [last + state for state in ENDS]
    there, back = _Side(nodes, [START], True), _Side(nodes, ends, False)
    best = min((there.cost[node] for node in ends), default=_FAR)
    while there.top() < _FAR and back.top() < _FAR and there.top() + back.top() <= best:
        side, other = (there, back) if there.top() <= back.top() else (back, there)
        node = heappop(side.heap)[2]
        side.settled[node] = 1
        for to, step, edit in lattice.ahead(node) if side.forward else lattice.behind(node):
            cost = side.cost[node] + step
            if cost < side.cost[to]:
                side.reach(to, cost, node, edit)
                best = min(best, cost + other.cost[to])
            elif cost == side.cost[to] and not side.settled[to] and side.better(to, node, edit):
                side.link[to], side.edit[to] = node, ord(edit)
    # Each cheapest way leaves the settled nodes of the first search once, or ends among them.
    met = {node for _, _, node in there.heap if not there.settled[node]} | {n for n in ends if there.settled[n]}
    meetings = [n for n in met if there.cost[n] + back.cost[n] == best]
    return best, min(there.path(n) + back.path(n) for n in meetings)


class Script:
    """An audit, worked off row by row."""

    def __init__(self, audit: str = ""):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[str]:
        """Roles of the turns put in here."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, SPOKEN[self.state]
            yield NAMES[self.state]

    def row(self, role: str) -> tuple[str, str]:
        """What happens to the next row, and the role it gets."""
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEPT[role[:1]][self.state]
        elif edit == "R":
            self.state = SPOKEN[self.state]
            role = NAMES[self.state]
        return edit, role


# -- rows ----------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with known damage, by the remainder of a checksum of their key.

    0 drops the row (it stays, marked), 1 empties its text, 2 removes its full stops, 3 repeats it,
    4 makes the user speak.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = _plain(conversations).withColumn("_kind", F.crc32(key.cast("binary")) % 20)
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("gone"), F.explode(copies).alias("copy"),
    )


def _plain(conversations: DataFrame) -> DataFrame:
    space = {c: F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")}
    return conversations.select("conv_id", "turn", *space.values())


def _rows(conversations: DataFrame) -> DataFrame:
    """Rows with what orders them; ``gone`` rows only keep the name of their conversation."""
    rows = conversations if "gone" in conversations.columns else _plain(conversations)
    if "gone" not in rows.columns:
        rows = rows.withColumns({"gone": F.lit(False), "copy": F.lit(0)})
    # The length tells where the role ends.
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("digest", F.unhex(F.sha2(whole, 256)))


_ORDER = [F.asc_nulls_first, F.asc, F.asc, F.asc]


def _in_order() -> list[Column]:
    return [f(c) for f, c in zip(_ORDER, ("turn", "role", "digest", "copy"))]


def _groups(batches, names: list[str]):
    """Conversations one after the other, out of rows sorted by conversation."""
    nothing = object()
    current, held = nothing, []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ["conv_id", *names])):
            if row[0] != current and current is not nothing:
                yield current, held
                held = []
            current = row[0]
            held.append(row[1:])
    if current is not nothing:
        yield current, held


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _plan(schema: pa.Schema):
    def run(batches):
        for conv_id, rows in _groups(batches, ["gone", "turn", "initial", "fault"]):
            here = [row[1:] for row in rows if not row[0]]
            turns = [turn for turn, _, _ in here if turn is not None]
            gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
            # One letter a row, whatever a role begins with.
            initials = "".join(i if i in KEPT else "?" for _, i, _ in here)
            faults = [f for _, _, f in here]
            marks = "".join("x" if f in ("blank", "duplicate") else "t" if f else "." for f in faults)
            pairs = zip(initials, initials[1:])
            cost, audit = cheapest(Lattice(initials, marks))
            found = {
                "conv_id": conv_id, "gaps": gaps, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
                "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs), "cost": cost, "audit": audit,
            }
            yield pa.RecordBatch.from_pylist([found], schema=schema)

    return run


def plans(conversations: DataFrame) -> DataFrame:
    """Per conversation: faults, gaps between turns, and the cheapest repair with its audit."""
    rows = _rows(conversations)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = rows.select(
        "conv_id", "turn", "role", "digest", "copy", "gone", F.substring("role", 1, 1).alias("initial"),
        blank.alias("blank"), ended.alias("ended"),
    ).repartition("conv_id")
    seen = Window.partitionBy("conv_id", "digest", "gone").orderBy(*_in_order())
    again = F.row_number().over(seen) > 1
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(~F.col("ended"), "truncated")
    placed = rows.withColumn("fault", fault).sortWithinPartitions("conv_id", *_in_order())
    schema = T.StructType(
        [conversations.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())]
    )
    found = placed.select("conv_id", "gone", "turn", "initial", "fault")
    return found.mapInArrow(_plan(to_arrow_schema(schema)), schema)


def _apply(schema: pa.Schema):
    names = schema.names

    def run(batches):
        conv_id, script, position, out, size = None, Script(), 0, [], 0
        for batch in batches:
            # One text at a time: a batch may hold very long ones.
            for c, audit, role, text in zip(*(batch.column(n) for n in ("conv_id", "audit", "role", "text"))):
                # Turns put in before this row, or at the end of the conversation before.
                for name in script.inserts():
                    out.append((conv_id, position, "I", name, ""))
                    position += 1
                if audit.is_valid:
                    conv_id, script, position = c.as_py(), Script(audit.as_py()), 0
                    continue
                edit, name = script.row(role.as_py())
                if edit != "D":
                    out.append((conv_id, position, edit, name, text.as_py()))
                    position, size = position + 1, size + len(out[-1][-1])
                if size > OUT_CHARS or len(out) > OUT_ROWS:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in out], schema=schema)
                    out, size = [], 0
        out += [(conv_id, position + k, "I", name, "") for k, name in enumerate(script.inserts())]
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in out], schema=schema)

    return run


def repaired(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id, position, edit, role, text``.

    ``found`` is what :func:`plans` said of the same rows, stored. The turns of a conversation
    follow one another in one partition, in order.
    """
    empty = {"turn": "turn", "role": "string", "text": "string", "digest": "binary", "copy": "int"}
    rows = _rows(conversations).where("not gone")
    kinds = dict(rows.dtypes)
    scripts = found.select("conv_id", "audit", *[F.lit(None).cast(kinds[c]).alias(c) for c in empty], F.lit(0).alias("_part"))
    rows = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), *empty, F.lit(1).alias("_part"))
    both = scripts.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "_part", *_in_order())
    schema = T.StructType(
        [conversations.schema["conv_id"], T.StructField("position", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]
    )
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_apply(to_arrow_schema(schema)), schema)


def _digests(schema: pa.Schema):
    def run(batches):
        nothing = object()
        current, digest = nothing, None
        for batch in batches:
            for c, position, role, text in zip(*(batch.column(n) for n in ("conv_id", "position", "role", "text"))):
                if position.as_py() == 0:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"conv_id": current, "repaired_sha256": digest.hexdigest()}], schema=schema)
                    current, digest = c.as_py(), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role.as_py()}:{text.as_py()}".encode("utf-8", "surrogatepass"))
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "repaired_sha256": digest.hexdigest()}], schema=schema)

    return run


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation, ``role:text`` by lines, straight from :func:`repaired`."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    return turns.mapInArrow(_digests(to_arrow_schema(schema)), schema)


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cost and audit of every conversation, with the digest of its repaired text."""
    found = stored(plans(conversations), "plans")
    told = digests(repaired(conversations, found)).withColumnRenamed("conv_id", "_id")
    both = found.join(told, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    empty = hashlib.sha256().hexdigest()
    return both.select("conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
