"""Structure repair of conversations by a suffix-shared automaton.

Role initials of a repaired conversation read ``(s?(ua)+)?``. Edits: Keep (0), Delete (3,
required for blank and duplicate rows), Rerole to user or assistant (2), Insert an empty
user or assistant row (2); a truncated row that stays adds 1. The grammar says which role
comes next, so an edit's initial alone tells what it does.

* Rows of a conversation, in order, become a *signature*: one symbol a row for its role
  initial and its fault. Only these short strings, each once, are planned.
* The signatures of all conversations form an automaton whose nodes are minimised from
  the end: a node is a suffix, and signatures with one suffix share its nodes. Sorted by
  their reversed symbols, signatures that share a suffix are neighbours, so each task walks
  a range of them with a stack and visits a node once; only the nodes on the seam of two
  ranges, at most as many as a signature has symbols, are visited twice.
* A node holds, per grammar state, the cost to go and the first edit of the best audit
  suffix. Edits open to one state have different initials, so among equal costs the
  smallest initial gives the ASCII-least audit, and a suffix's audit is read off the stack.
  The step from a node to the one before it depends on the symbol and on cost differences
  alone and is remembered.
* The audits go back to their conversations, and one pass over the rows applies them.

A conversation's rows pass in order through one task twice, as its digest is sequential;
they are sorted by Spark and streamed, so memory does not grow with a conversation but for
one symbol a row and the automaton's nodes of the longest one.

Defined cases: null role or text counts as one space, a null turn comes first, and null
conv_id is a conversation of its own; rows of one turn stand by role, then by a digest of
their text; a role of other initials is never kept; repeated rows are duplicates; a
conversation without rows has zeros, an empty audit and nothing to digest; no
conversations give no rows. Equal texts are told by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.tables import Batches, narrow, stored

#: Costs of the edits, and what a truncated row adds where it stays.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

#: White space of words, as characters to trim.
_SPACE = " \t\n\x0b\x0c\r"
#: Symbols: role initials, upper case where the row is truncated; rows that have to go.
_GONE = "-"
#: Grammar states: nothing yet, after system, after user, after assistant. What keeping a
#: row of an initial leads to, and what the next user or assistant row leads to.
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_FAR = 1 << 60

_STORY = "conv_id string, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_PLAN = "signature string, cost bigint, audit string"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


# ------------------------------------------------------------------ planning


def _relaxed(options: list[tuple[int, str]]) -> tuple[tuple[int, str], ...]:
    """The best of each state's options and of inserting first; ties by initial."""
    best = list(options)
    for _ in range(3):
        best = [min(own, (best[_NEXT[s]][0] + INSERT, "I")) for s, own in enumerate(best)]
    return tuple(best)


@lru_cache(maxsize=1 << 16)
def _before(symbol: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], str]:
    """The node before one of costs ``after``: what all its costs have in common, the rest
    of them, and the first edit of each state."""
    options = []
    for state in range(4):
        own = [(after[state] + DELETE, "D")]
        if symbol != _GONE:
            more = TRUNCATED if symbol.isupper() else 0
            to = _KEEP[symbol.lower()][state]
            if to is not None:
                own.append((after[to] + more, "K"))
            own.append((after[_NEXT[state]] + REROLE + more, "R"))
        options.append(min(own))
    best = _relaxed(options)
    least = min(cost for cost, _ in best)
    return least, tuple(cost - least for cost, _ in best), "".join(letter for _, letter in best)


#: The node of the empty suffix: it ends with nothing said or after an assistant.
_END = _relaxed([(0, ""), (_FAR, ""), (_FAR, ""), (0, "")])


class Automaton:
    """The nodes of one suffix, from its end on; moving to another signature keeps those
    that both share."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.bases = [0]
        self.costs = [tuple(cost for cost, _ in _END)]
        self.letters = ["".join(letter or "." for _, letter in _END)]
        self.visited = 0

    def plan(self, signature: str) -> tuple[int, str]:
        """Least cost and audit of a signature."""
        reverse = signature[::-1]
        shared = 0
        for a, b in zip(self.symbols, reverse, strict=False):
            if a != b:
                break
            shared += 1
        del self.symbols[shared:], self.bases[shared + 1 :], self.costs[shared + 1 :], self.letters[shared + 1 :]
        for symbol in reverse[shared:]:
            least, costs, letters = _before(symbol, self.costs[-1])
            self.symbols.append(symbol)
            self.bases.append(self.bases[-1] + least)
            self.costs.append(costs)
            self.letters.append(letters)
            self.visited += 1
        return self.bases[-1] + self.costs[-1][0], self._audit()

    def _audit(self) -> str:
        out, state, at = [], 0, len(self.symbols)
        while True:
            letter = self.letters[at][state]
            if letter == ".":
                return "".join(out)
            out.append(letter)
            if letter in "IR":
                state = _NEXT[state]
            elif letter == "K":
                state = _KEEP[self.symbols[at - 1].lower()][state]
            at -= letter != "I"


def _planned(batches: Batches) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        signatures = batch.column("signature").to_pylist()
        plans = [automaton.plan(s) for s in signatures]
        yield pa.record_batch(
            [batch.column("signature"), pa.array([c for c, _ in plans], pa.int64()), pa.array([a for _, a in plans], pa.string())],
            ["signature", "cost", "audit"],
        )


def plans(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of every distinct ``signature``."""
    ordered = F.reverse("signature")
    return signatures.select("signature").distinct().repartitionByRange(ordered).sortWithinPartitions(ordered).mapInArrow(_planned, _PLAN)


# ------------------------------------------------------------------ signatures


def judged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, d1, d2, dropped, symbol, initial`` of rows ``conv_id, turn, role, text,
    dropped``, and a row's fault: ``blank``, ``duplicate``, ``truncated`` or null.

    A conversation's rows lie in one partition. A dropped row has an empty symbol; it only
    says that its conversation is there.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACE))
    keyed = rows.select(
        F.col("conv_id"), "turn", "role", F.xxhash64("text").alias("d1"), F.xxhash64("text", F.lit(1)).alias("d2"),
        (trimmed == "").alias("bare"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"), "dropped",
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "dropped", "role", "d1", "d2").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(F.col("bare"), "blank").when(F.col("copies") > 1, "duplicate").when(F.col("cut"), "truncated")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("dropped"), "").when(F.col("fault").isin("blank", "duplicate"), _GONE).otherwise(
        F.when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    )
    return (
        keyed.withColumn("copies", F.row_number().over(same)).withColumn("fault", fault)
        .select("conv_id", "turn", "role", "d1", "d2", "dropped", "fault", symbol.alias("symbol"),
                F.when(F.col("dropped"), "").otherwise(initial).alias("initial"))
    )


class _Story:
    """What is known of one conversation while its rows pass."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.initial = None
        self.turns = 0

    def add(self, turns: list, faults: list, symbols: list, initials: list) -> None:
        """The next rows, none of them dropped."""
        self.symbols.append("".join(symbols))
        for fault in faults:
            if fault is not None:
                self.counts[fault] += 1
        for turn in turns:
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last = turn
                self.turns += 1
        before = self.initial
        for initial in initials:
            if before is not None and before + initial not in ("su", "ua", "au"):
                self.counts["illegal"] += 1
            before = initial
        self.initial = before

    def row(self) -> list:
        if self.turns:
            self.counts["gaps"] = int(self.last) - int(self.first) + 1 - self.turns
        return ["".join(self.symbols), *self.counts.values()]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where consecutive rows differ, with both ends."""
    n = len(columns[0])
    new = np.zeros(n - 1, dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n]))


def _ids(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
    """Conversation ids of a batch as text, and the bounds of their rows."""
    ids = batch.column("conv_id").to_pylist()
    return ids, _changes(np.array([i is not None for i in ids]), np.array([i or "" for i in ids], dtype=object))


def _stories(batches: Batches) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its rows in order."""
    current, story, out = None, None, []

    def done() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        types = [pa.string(), pa.string(), *[pa.int64()] * 5]
        names = ["conv_id", "signature", *_COUNTS]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        if not len(batch):
            continue
        ids, bounds = _ids(batch)
        turns, faults, symbols, initials = (batch.column(c).to_pylist() for c in ("turn", "fault", "symbol", "initial"))
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if story is None or ids[first] != current:
                if story is not None:
                    out.append([current, *story.row()])
                current, story = ids[first], _Story()
            kept = [k for k in range(first, last) if symbols[k]]
            story.add(*[[values[k] for k in kept] for values in (turns, faults, symbols, initials)])
        if len(out) >= 4096:
            yield done()
            out = []
    if story is not None:
        out.append([current, *story.row()])
    if out:
        yield done()


def stories(rows: DataFrame) -> DataFrame:
    """Per conversation its ``signature`` and counts of faults."""
    ordered = judged(rows).withColumn("conv_id", F.col("conv_id").cast("string")).sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "d1", "d2"
    )
    return ordered.select("conv_id", "turn", "fault", "symbol", "initial").mapInArrow(_stories, _STORY)


# ------------------------------------------------------------------ repair


def _clean(conversations: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return narrow(
        conversations, conv_id="conv_id", turn="turn", role=F.coalesce(F.col("role").cast("string"), space),
        text=F.coalesce(F.col("text").cast("string"), space),
    )


def _edited(batches: Batches) -> Iterator[tuple[object, str, str, str | None, int]]:
    """``(plan row, edit, role, text, place)`` of every edit, from a plan followed by its
    rows; an empty edit opens a conversation."""
    plan, audit, at, state, place = None, "", 0, 0, 0

    def inserts() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, _NEXT[state]
            yield plan, "I", _ROLE[state], "", place
            place += 1

    for batch in batches:
        columns = batch.to_pydict()
        for k, kind in enumerate(columns["kind"]):
            if kind == 0:
                yield from inserts()
                plan = {c: columns[c][k] for c in ("conv_id", *_COUNTS, "cost", "audit")}
                audit, at, state, place = plan["audit"], 0, 0, 0
                yield plan, "", "", None, 0
                continue
            yield from inserts()
            edit, role = audit[at], columns["role"][k]
            at += 1
            if edit == "K":
                state = _KEEP[role[:1]][state]
            elif edit == "R":
                state = _NEXT[state]
                role = _ROLE[state]
            yield plan, edit, role, columns["text"][k], place
            place += edit != "D"
    yield from inserts()


_REPAIRED = "conv_id string, place bigint, role string, text string, edit string"
_REPORT = f"conv_id string, {', '.join(f'{c} bigint' for c in _COUNTS)}, cost bigint, audit string, repaired_sha256 string"


def _rows(batches: Batches) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    schema = pa.schema([("conv_id", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    for plan, edit, role, text, place in _edited(batches):
        if edit not in ("", "D"):
            out.append((plan["conv_id"], place, role, text, edit))
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def _digests(batches: Batches) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"]
    types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    out: list[list] = []
    opened, digest, first = None, None, True

    def closed() -> None:
        out.append([*opened.values(), digest.hexdigest()])

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    for plan, edit, role, text, _ in _edited(batches):
        if edit == "":
            if opened is not None:
                closed()
            opened, digest, first = plan, hashlib.sha256(), True
            if len(out) >= 4096:
                yield batch()
                out = []
        elif edit != "D":
            digest.update((("" if first else "\n") + f"{role}:{text}").encode())
            first = False
    if opened is not None:
        closed()
    if out:
        yield batch()


def _with_plans(rows: DataFrame) -> DataFrame:
    """Every conversation's plan, followed by its rows, in one partition."""
    told = stored(stories(rows))
    planned = told.join(plans(told), "signature")
    heads = planned.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
        F.lit("").alias("text"), *_COUNTS, "cost", "audit",
    )
    nothing = [F.lit(None).cast("bigint").alias(c) for c in (*_COUNTS, "cost")]
    body = rows.filter("not dropped").select(
        F.col("conv_id").cast("string").alias("conv_id"), F.lit(1).alias("kind"), "turn", "role", "text", *nothing,
        F.lit(None).cast("string").alias("audit"),
    )
    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"), F.xxhash64("text", F.lit(1))
    ).select("kind", "conv_id", "role", "text", *_COUNTS, "cost", "audit")


def repaired(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` (conv_id, turn, role, text) after repair: ``conv_id,
    place, role, text, edit``, where edit is K, R or I and conv_id keeps its type."""
    rows = _clean(conversations).withColumn("dropped", F.lit(False))
    kind = conversations.schema["conv_id"].dataType
    return _with_plans(rows).mapInArrow(_rows, _REPAIRED).withColumn("conv_id", F.col("conv_id").cast(kind))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: rows damaged by the checksum of their
    ``conv_id:turn``; one in twenty each is dropped, emptied, loses its full stops, stands
    twice or turns into the user's."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))
    damage: Column = F.crc32(key.cast("binary")) % 20
    rows = _clean(conversations).withColumn("damage", damage)
    return rows.withColumn("copy", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "conv_id", "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("damage") == 0).alias("dropped"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """Repair of ``conversations`` after :func:`damaged`, a row for every conv_id: counts of
    gaps, faults and illegal neighbours, the cost, the audit and a digest of what is left."""
    kind = conversations.schema["conv_id"].dataType
    found = _with_plans(damaged(conversations)).mapInArrow(_digests, _REPORT)
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))
