"""Repairs against an exhaustive search over edits, and whole conversations against a plain version of the contract."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from meridia.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost long, fault string, kind int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def fault_of(row, seen):
    words = row[1].rstrip(" \t\n\x0b\x0c\r")
    return "blank" if not words else "duplicate" if row in seen else "truncated" if words[-1] not in ".!?" else ""


def cheapest(rows, insert=5):
    """All ways to edit rows (role, text, fault) into the grammar: the least (cost, audit), and its rows. Looks ahead, not back."""
    arcs = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def rest(i, state, inserts):
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        for initial, to in arcs[state].items():
            if initial in name and inserts < 4 and (r := rest(i, to, inserts + 1)):
                found.append((insert + r[0], "I" + r[1], (f"{name[initial]}:",) + r[2]))
        if i < len(rows):
            role, text, fault = rows[i]
            if r := rest(i + 1, state, 0):
                found.append((2 + r[0], "D" + r[1], r[2]))
            more = 5 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                for initial, to in arcs[state].items():
                    r = rest(i + 1, to, 0)
                    if r and role[:1] == initial:
                        found.append((more + r[0], "K" + r[1], (f"{role}:{text}",) + r[2]))
                    if r and initial in name:
                        found.append((1 + more + r[0], "R" + r[1], (f"{name[initial]}:{text}",) + r[2]))
        return min(found, default=None)

    return rest(0, 0, 0)


def expected(rows):
    out = {r[0]: [] for r in rows}
    for r in damage(rows):
        out[r[0]].append(r[1:])
    want = {}
    for conv_id, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in own:
            marked.append((role, text, fault_of((role, text), seen)))
            seen.add((role, text))
        cost, audit, lines = cheapest(tuple(marked))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        count = lambda f: sum(m[2] == f for m in marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        want[conv_id] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest)
    return want


def conversations_of(n, seed=5):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why? \t", "a.\x0b", "é", "…", "Same.", None, "x" * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ü"]
    out = []
    for k in range(n):
        length = r.randint(1, 9)
        plain = r.random() < 0.5
        for t in range(length):
            role = ("user", "assistant")[t % 2] if plain and r.random() < 0.8 else r.choice(roles)
            turn = None if r.random() < 0.05 else t + r.choice([0, 0, 0, 1])
            out.append((k, turn, role, r.choice(texts)))
    out += [(None, 1, "user", "Hi."), (None, None, None, None), (None, 1, "user", "Hi."), (5000, None, "user", "a."), (-3, -4, "system", "b.")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 3) for r in rows], SCHEMA).repartition(5)


def test_against_exhaustive_search(spark):
    rows = conversations_of(400)
    got = conversations.repair(conversations.damaged(frame(spark, rows)))
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == expected(rows)
    assert {e for v in expected(rows).values() for e in v[6]} == set("DKR") and got.count() == len({r[0] for r in rows})


@pytest.mark.parametrize(("tail", "insert"), [(4, 5), (256, 5), (4, 1), (256, 1)])
def test_paths_of_any_length(monkeypatch, tail, insert):
    """At the contract's costs deleting is always cheaper than inserting; cheaper inserts show that these work too."""
    monkeypatch.setattr(conversations, "TAIL", tail)
    monkeypatch.setitem(conversations.COST, conversations.INSERT, insert)
    r, seen = random.Random(tail), set()
    for _ in range(150):
        rows = [(r.choice(["user", "assistant", "system", "tool"]), f"{k}.", r.choice(["", "", "blank", "truncated"])) for k in range(r.randint(0, 40))]
        machine = conversations.Repair()
        for role, text, fault in rows:
            machine.read(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        cost, audit, digest = machine.end()
        want = cheapest(tuple(rows), insert)
        assert (cost, audit, digest) == (want[0], want[1], hashlib.sha256("\n".join(want[2]).encode()).hexdigest())
        seen |= set(audit)
    assert seen == set("DIKR" if insert < 5 else "DKR")


def test_audits_give_the_grammar():
    assert conversations.Repair().end() == (0, "", hashlib.sha256().hexdigest())
    machine = conversations.Repair()
    for k in range(50_000):
        machine.read(("user", "assistant")[k % 2], f"{k}.", False, False)
    cost, audit, _ = machine.end()
    assert (cost, audit) == (0, "K" * 50_000) and all(len(p.edits) <= 2 * conversations.TAIL for p in machine.paths.values())
    assert GRAMMAR.fullmatch("suaua")


def test_a_conversation_that_loses_all_rows(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = conversations.repair(conversations.damaged(frame(spark, [(lost, 0, "user", "Hi.")]))).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_empty_table(spark):
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
