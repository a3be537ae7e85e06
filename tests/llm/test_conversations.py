"""Conversation repair against a search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from samples import rows

from boxloom.llm import conversations as c

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, symbol string, audit string, kind int"
SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}


def spaced_out(value) -> str:
    return " " if value is None else str(value)


def slow_damage(table: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in table:
        own = out.setdefault(conv, [])
        role, text = spaced_out(role), spaced_out(text)
        d = zlib.crc32(f"{spaced_out(conv)}:{spaced_out(turn)}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        own.extend([(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1))
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return out


def slow_faults(own: list[tuple]) -> list:
    seen, out = set(), []
    for _, role, text in own:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def slow_plan(own: list[tuple], faults: list) -> tuple[int, str, str]:
    """Least ``(cost, audit)`` by trying every edit at every place, up to two inserts in a row."""
    best: dict = {}

    def go(i: int, state: str, inserted: int) -> tuple:
        if (i, state, inserted) in best:
            return best[i, state, inserted]
        options = []
        if i == len(own) and state in ("", "a"):
            options.append((0, "", ()))
        if i < len(own):
            _, role, text = own[i]
            cost, audit, kept = go(i + 1, state, 0)
            options.append((cost + 3, "D" + audit, kept))
            if faults[i] not in ("blank", "duplicate"):
                more = 1 if faults[i] == "truncated" else 0
                after = role[:1]
                if (state, after) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                    cost, audit, kept = go(i + 1, after, 0)
                    options.append((cost + more, "K" + audit, (f"{role}:{text}", *kept)))
                name, after = NEXT[state]
                cost, audit, kept = go(i + 1, after, 0)
                options.append((cost + 2 + more, "R" + audit, (f"{name}:{text}", *kept)))
        if inserted < 2:
            name, after = NEXT[state]
            cost, audit, kept = go(i, after, inserted + 1)
            options.append((cost + 2, "I" + audit, (f"{name}:", *kept)))
        best[i, state, inserted] = min(options, default=(10**9, "", ()))
        return best[i, state, inserted]

    return go(0, "", 0)


def slow_report(table: list[tuple]) -> list[tuple]:
    out = []
    for conv, own in slow_damage(table).items():
        faults = slow_faults(own)
        cost, audit, kept = slow_plan(own, faults)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def table_of(seed: int, conversations: int = 150) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for conv in range(conversations):
        turn = rng.choice((0, 0, 0, -2, 5))
        for k in range(rng.choice((1, 2, 3, 4, 6, 9, 30))):
            turn += rng.choice((1, 1, 1, 1, 3))
            role = rng.choice(("system", "user", "assistant", "tool", "", None)) if rng.random() < 0.15 else ("user", "assistant")[k % 2]
            text = rng.choice(("ok.", "ok.", "fine!\n ", "cut", "é。", "\t", "", None)) if rng.random() < 0.4 else f"text {rng.random()}?"
            out.append((conv, None if rng.random() < 0.02 else turn, role, text))
    return out


def as_table(spark, table: list[tuple]):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in table], CONVERSATIONS).repartition(3)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    table = table_of(seed)
    table += [(None, k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(9)] + [(7, 0, "user", "again.")] * 3
    assert rows(c.report(as_table(spark, table)), *COLUMNS) == slow_report(table)


def test_conversations_that_lose_every_row_stay(spark):
    gone = [i for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    table = [(i, 0, "user", "a.") for i in gone]
    empty = hashlib.sha256(b"").hexdigest()
    assert rows(c.report(as_table(spark, table)), *COLUMNS) == sorted([(i, *[0] * 6, "", empty) for i in gone], key=repr)


def test_automaton_on_all_short_signatures():
    """Shared nodes give what a search of each signature by itself gives."""
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    found, automaton = {}, c.Automaton()
    signatures = sorted(("".join(p) for n in range(5) for p in itertools.product("suaxUA-", repeat=n)), key=lambda s: s[::-1])
    for s in signatures:
        found[s] = automaton.plan(s)
    assert automaton.visited == len(signatures) - 1
    for s in signatures:
        own = [(k, role.get(x.lower(), "user"), "t") for k, x in enumerate(s)]
        faults = ["blank" if x == "-" else "truncated" if x.isupper() else None for x in s]
        assert found[s] == slow_plan(own, faults)[:2]


def test_repaired_rows(spark):
    table = [(1, 0, "assistant", "hello."), (1, 1, "user", "and?"), (2, 0, "system", "be kind."), (3, 5, "user", " "), (2, 3, "tool", "cut")]
    found = rows(c.repaired(as_table(spark, table)), "conv_id", "place", "role", "text", "edit")
    assert found == [
        (1, 0, "user", "", "I"), (1, 1, "assistant", "hello.", "K"), (1, 2, "user", "and?", "K"), (1, 3, "assistant", "", "I"),
        (2, 0, "system", "be kind.", "K"), (2, 1, "user", "", "I"), (2, 2, "assistant", "cut", "R"),
    ]


def test_long_conversation(spark):
    table = [(5, k, ("user", "assistant")[k % 2], f"words {k}.") for k in range(40_000)]
    (row,) = rows(c.report(as_table(spark, table)), *COLUMNS)
    assert len(row[7]) >= 38_000 and row[2] > 0 and row[6] > 0


def test_other_types_of_columns(spark):
    frame = as_table(spark, table_of(3, 20)).selectExpr("concat('c', conv_id) as conv_id", "cast(turn as int) as turn", "role", "text")
    assert c.report(frame).count() == 20 and dict(c.report(frame).dtypes)["conv_id"] == "string"


def test_nothing(spark):
    assert rows(c.report(as_table(spark, [])), *COLUMNS) == []
    assert rows(c.repaired(as_table(spark, [])), "conv_id", "place") == []
