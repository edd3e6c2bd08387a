"""Repair of conversation structure: the cheapest edits that make a conversation `(s?(ua)+)?`, found by a Viterbi pass.

Roles count by their first letter: an optional system message, then user and assistant by turns. A row may be kept (K, free if
its role fits), given the role user or assistant (R, 3) or deleted (D, 4); empty messages may be inserted anywhere (I, 3). Rows
with a fault: a blank text or a repeated (role, text) must be deleted, a truncated text costs 3 if it stays.

1. Spark finds the faults. The first row of each (conversation, role, text) comes from an aggregation with map-side combining,
   so a message that is repeated without end is no group of any task.
2. One narrow row a message (order, role, digest, faults; no text) goes to its conversation, sorted. A task reads them as a
   stream and keeps one survivor for each of the four states of the automaton. Survivors are leaves of a tree of back pointers
   with reference counts: a branch without a survivor is freed at once, a survivor that cannot win any more is dropped, and as soon as the root has a single child, all
   survivors share it, so its edit is final, leaves the task and is freed. Memory is that of the stretch on which survivors
   disagree, a few numbers a row, whatever the length of the conversation. Of two survivors of equal cost the one with the
   ASCII-least letters stays; the letters compared are all that follow their last common ancestor, never a prefix of them.
3. Edits and texts meet again sorted by conversation, an edit directly after its text, so that step streams as well.

A conversation is one sequence and its digest is a chain, so its rows pass through one task; they do so one batch at a time.

Defined results: null role or text counts as one space (so it is blank, or fits no role); null turns come first; rows of one
turn are ordered by role, then by digest of the text, so equal rows are adjacent and all but the first are duplicates; a null
conv_id is a conversation of its own; no rows give no edits. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import written

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NO_FAULT, BLANK, REPEATED, CUT = range(4)

# The automaton: nothing yet, after a leading system message, after a user, after an assistant.
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FINAL = (START, ASSISTANT)
#: Role that a changed or an inserted message takes in each state.
WANTED = ("user", "user", "assistant", "user")
#: Adjacent roles that are right.
LEGAL = {"su", "ua", "au"}

ORDER = ["conv_id", "turn", "old_role", "digest"]
WHITE = " \t\n\x0b\x0c\r"


class Survivors:
    """Cheapest edit sequence into each state, as a tree of back pointers with reference counts."""

    def __init__(self) -> None:
        self.parent, self.edit, self.role, self.depth = [-1], [""], [""], [0]
        #: Children and survivors of a node; sum of its children, which is the child where there is but one.
        self.refs, self.child = [1], [0]
        self.free: list[int] = []
        self.root = 0
        self.head: list[int] = [0, -1, -1, -1]
        self.cost = [0, 0, 0, 0]

    def size(self) -> int:
        return len(self.parent) - len(self.free)

    def node(self, parent: int, edit: str, role: str) -> int:
        fields = (parent, edit, role, self.depth[parent] + 1, 0, 0)
        columns = (self.parent, self.edit, self.role, self.depth, self.refs, self.child)
        if self.free:
            n = self.free.pop()
            for column, value in zip(columns, fields, strict=True):
                column[n] = value
        else:
            n = len(self.parent)
            for column, value in zip(columns, fields, strict=True):
                column.append(value)
        self.refs[parent] += 1
        self.child[parent] += n
        return n

    def release(self, n: int) -> None:
        """One reference less; nodes without any are freed up to the next that has one."""
        self.refs[n] -= 1
        while n != self.root and not self.refs[n]:
            up = self.parent[n]
            self.child[up] -= n
            self.refs[up] -= 1
            self.free.append(n)
            n = up

    def less(self, a: int, last_a: str, b: int, last_b: str) -> bool:
        """Whether the letters to a and last_a come before those to b and last_b; all letters after their last common ancestor."""
        x, y = [last_a] * bool(last_a), [last_b] * bool(last_b)
        while a != b:
            if self.depth[a] >= self.depth[b]:
                x.append(self.edit[a])
                a = self.parent[a]
            else:
                y.append(self.edit[b])
                b = self.parent[b]
        return x[::-1] < y[::-1]

    def settle(self, best: dict[int, tuple[int, int, str, str]]) -> None:
        """Make the chosen (cost, from node, edit, role) the survivors of their states; states without one keep theirs."""
        new = {s: (cost, self.node(at, edit, role)) for s, (cost, at, edit, role) in best.items()}
        for s, (cost, n) in new.items():
            old, self.head[s], self.cost[s] = self.head[s], n, cost
            self.refs[n] += 1
            if old >= 0:
                self.release(old)

    def insert(self) -> None:
        """Survivors with any number of messages inserted here. Two in a row reach every state; more come back to one at a price."""
        for _ in range(2):
            best: dict[int, tuple[int, int, str, str]] = {}
            for s in STATES:
                if self.head[s] >= 0:
                    role = WANTED[s]
                    self.offer(best, NEXT[s][role[0]], (self.cost[s] + INSERT, self.head[s], "I", role), self.head)
            if not best:
                return
            self.settle(best)

    def offer(self, best: dict, to: int, new: tuple[int, int, str, str], present: list[int] | None = None) -> None:
        if present is not None and present[to] >= 0:
            if self.cost[to] < new[0] or self.cost[to] == new[0] and not self.less(new[1], new[2], present[to], ""):
                return
        old = best.get(to)
        if old is None or new[0] < old[0] or new[0] == old[0] and self.less(new[1], new[2], old[1], old[2]):
            best[to] = new

    def prune(self) -> None:
        """Drop survivors that cannot win any more, else a sequence that deletes all messages would survive for ever.

        After insert() there is a survivor in ASSISTANT. What completes SYSTEM completes it too; so does what completes START,
        but for a system message that would have to be deleted instead of kept.
        """
        a = ASSISTANT
        s = self.head[SYSTEM]
        worse = self.cost[SYSTEM] > self.cost[a] or self.cost[SYSTEM] == self.cost[a] and s >= 0 and self.less(self.head[a], "", s, "")
        for state, drop in ((SYSTEM, worse), (START, self.cost[START] > self.cost[a] + DELETE)):
            if drop and self.head[state] >= 0:
                n, self.head[state] = self.head[state], -1
                self.release(n)

    def take(self, initial: str, fault: int) -> None:
        """The next message of the conversation."""
        self.insert()
        self.prune()
        best: dict[int, tuple[int, int, str, str]] = {}
        extra = TRUNCATED if fault == CUT else 0
        for s in STATES:
            at, cost = self.head[s], self.cost[s]
            if at < 0:
                continue
            self.offer(best, s, (cost + DELETE, at, "D", ""))
            if fault not in (BLANK, REPEATED):
                if initial in NEXT[s]:
                    self.offer(best, NEXT[s][initial], (cost + extra, at, "K", ""))
                role = WANTED[s]
                self.offer(best, NEXT[s][role[0]], (cost + REROLE + extra, at, "R", role))
        self.settle(best)

    def agreed(self) -> Iterator[tuple[str, str]]:
        """(edit, role) of every step that all survivors share by now; they are forgotten."""
        while self.refs[self.root] == 1 and self.root not in self.head:
            old, self.root = self.root, self.child[self.root]
            self.free.append(old)
            yield self.edit[self.root], self.role[self.root]

    def end(self) -> Iterator[tuple[str, str]]:
        """The remaining edits of the best survivor."""
        self.insert()
        best = None
        for s in FINAL:
            if self.head[s] >= 0 and (best is None or self.cost[s] < self.cost[best] or self.cost[s] == self.cost[best] and self.less(self.head[s], "", self.head[best], "")):
                best = s
        for s in STATES:
            if s != best and self.head[s] >= 0:
                n, self.head[s] = self.head[s], -1
                self.release(n)
        yield from self.agreed()


EDITS = "conv_id bigint, turn bigint, old_role string, digest binary, step bigint, edit string, role string, fault int, illegal int, cost int"


def plain(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with nulls of role and text as one space."""
    space = F.lit(" ")
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )


def _digest(text: Column | str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def messages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, old_role, digest, initial, fault) of every message: no texts."""
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    narrow = plain(rows).select(
        "conv_id", "turn", F.col("role").alias("old_role"), _digest("text").alias("digest"),
        (F.length(trimmed) == 0).alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    null_turn = F.max(F.col("turn").isNull())
    # Only messages that occur at several turns; those of the same turn are neighbours in the sorted stream.
    several = narrow.groupBy("conv_id", "old_role", "digest").agg(null_turn.alias("null_turn"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    several = several.where("low < high OR null_turn AND high IS NOT NULL").select(
        F.col("conv_id").alias("c"), F.col("old_role").alias("r"), F.col("digest").alias("d"), "null_turn", "low"
    )
    found = narrow.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("old_role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(F.when(F.col("null_turn"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("low")), F.lit(False))
    fault = F.when(F.col("blank"), BLANK).when(later, REPEATED).when(F.col("cut"), CUT).otherwise(NO_FAULT)
    return found.select("conv_id", "turn", "old_role", "digest", F.substring("old_role", 1, 1).alias("initial"), fault.alias("fault"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _streamed(rows: DataFrame, *order: str) -> DataFrame:
    keys = [F.col(c).asc_nulls_first() for c in order]
    return rows.repartition("conv_id").sortWithinPartitions(*keys)


def edits(rows: DataFrame) -> DataFrame:
    """One row for each edit of the repaired conversations (see EDITS); those of a conversation are numbered by step.

    role is the new role of R and I. turn, old_role and digest name the message that K, R and D take and before which (at
    the end: after which) I inserts. fault: 0 none, 1 blank, 2 repeated, 3 truncated; illegal: 1 where the message's role
    may not follow that of the message before it.
    """

    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("old_role", pa.string()), ("digest", pa.binary()), ("step", pa.int64()),
                        ("edit", pa.string()), ("role", pa.string()), ("fault", pa.int32()), ("illegal", pa.int32()), ("cost", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: tuple | None = None
        survivors, waiting, step, last, initial_before = Survivors(), deque(), 0, None, ""

        def emit(steps: Iterator[tuple[str, str]]) -> None:
            nonlocal step, last
            for edit, role in steps:
                if edit == "I":
                    key, fault, illegal, cost = waiting[0][0] if waiting else last, 0, 0, INSERT
                else:
                    key, fault, illegal = waiting.popleft()
                    last = key
                    cost = DELETE if edit == "D" else (REROLE if edit == "R" else 0) + (TRUNCATED if fault == CUT else 0)
                out.append((*now, *key, step, edit, role, fault, illegal, cost))
                step += 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*ORDER, "initial", "fault")]
            for conv_id, turn, old_role, digest, initial, fault in zip(*columns, strict=True):
                if now != (conv_id,):
                    if now is not None:
                        emit(survivors.end())
                    now, survivors, step, last, initial_before = (conv_id,), Survivors(), 0, None, ""
                    waiting.clear()
                key = (turn, old_role, digest)
                before = waiting[-1][0] if waiting else last
                if key == before and fault in (NO_FAULT, CUT):
                    fault = REPEATED
                illegal = int(before is not None and initial_before + initial not in LEGAL)
                initial_before = initial
                waiting.append((key, fault, illegal))
                survivors.take(initial, fault)
                emit(survivors.agreed())
            if out:
                yield _batch(out, schema)
                out.clear()
        if now is not None:
            emit(survivors.end())
        if out:
            yield _batch(out, schema)

    return _streamed(messages(rows), *ORDER).mapInArrow(run, EDITS)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, step, edit, role, text) of all edits, with whole texts; the repaired conversation is the rows other than D.

    found: edits(rows), preferably written. A partition holds its conversations one after the other, steps in order.
    """
    texts = plain(rows).select("conv_id", "turn", F.col("role").alias("old_role"), _digest("text").alias("digest"), F.lit(-1).cast("bigint").alias("step"),
                               F.lit("").alias("edit"), F.lit("").alias("role"), "text")
    marks = found.select(*ORDER, "step", "edit", "role", F.lit("").alias("text"))

    schema = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = ""
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "old_role", "step", "edit", "role", "text")]
            for conv_id, old_role, step, edit, role, own in zip(*columns, strict=True):
                if step < 0:
                    text = own
                else:
                    out.append((conv_id, step, edit, old_role if edit in "KD" else role, "" if edit == "I" else text))
            if out:
                yield _batch(out, schema)

    # A text has step -1, so it comes directly before the edits of its message.
    return _streamed(texts.unionByName(marks), *ORDER, "step").mapInArrow(run, "conv_id bigint, step bigint, edit string, role string, text string")


def digests(fixed: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of repaired(): all letters, and the digest of the remaining `role:text` lines, as they stream by."""

    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        letters: list[str] = []
        sha, first = hashlib.sha256(), True
        done: list[tuple] = []
        for batch in batches:
            for conv_id, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")), strict=True):
                if now != (conv_id,):
                    if now is not None:
                        done.append((*now, "".join(letters), sha.hexdigest()))
                    now, letters, sha, first = (conv_id,), [], hashlib.sha256(), True
                letters.append(edit)
                if edit != "D":
                    sha.update((("" if first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
                    first = False
            if done:
                yield _batch(done, schema)
                done.clear()
        if now is not None:
            yield _batch([(*now, "".join(letters), sha.hexdigest())], schema)

    return fixed.mapInArrow(run, "conv_id bigint, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of `conv_id:turn` (nulls: one space) modulo 20: 0 drops a row, 1 empties its text,
    2 removes `.`, `!` and `?`, 3 repeats it, 4 gives it the role user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    rows = plain(rows).withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def report(conversations: DataFrame) -> DataFrame:
    """Damage and repair of every conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    rows = damaged(conversations)
    found = written(edits(rows), "turnrepair-edits")
    fault = lambda k: F.sum((F.col("fault") == k).cast("bigint"))
    sums = found.groupBy("conv_id").agg(
        fault(BLANK).alias("blank"), fault(REPEATED).alias("duplicate"), fault(CUT).alias("truncated"),
        F.sum(F.col("illegal").cast("bigint")).alias("illegal"), F.sum(F.col("cost").cast("bigint")).alias("cost"),
    )
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    out = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    for part in (gaps, sums, digests(repaired(rows, found))):
        part = part.withColumnRenamed("conv_id", "other")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
