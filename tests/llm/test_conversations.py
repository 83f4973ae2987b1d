import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from airmetrics.llm import conversations
from airmetrics.llm.common import read_table, ship_package
from airmetrics.llm.conversations import Lattice, cheapest
from airmetrics.llm.queries import op13_dijkstra_repair
from tests.llm.helpers import SF

EMPTY = hashlib.sha256().hexdigest()
BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def _least(roles, marks):
    """All nodes row by row, with whole audits: cost, audit and roles of the cheapest repair."""

    def put_in(states):
        for _ in range(3):
            for q, (cost, audit, out) in list(states.items()):
                name = "a" if q.endswith("u") else "u"
                new = (cost + 2, audit + "I", [*out, (name, "")])
                if name not in states or new[:2] < states[name][:2]:
                    states[name] = new
        return states

    states = put_in({"": (0, "", [])})
    for at, (letter, mark) in enumerate(zip(roles, marks)):
        after = {}

        def offer(q, value):
            if q not in after or value[:2] < after[q][:2]:
                after[q] = value

        for q, (cost, audit, out) in states.items():
            offer(q, (cost + 3, audit + "D", out))
            if mark == "x":
                continue
            extra = mark == "t"
            allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[q]
            if letter and letter in allowed:
                offer(letter, (cost + extra, audit + "K", [*out, (letter, at)]))
            name = "a" if q == "u" else "u"
            offer(name, (cost + 2 + extra, audit + "R", [*out, (name, at)]))
        states = put_in(after)
    return min((states[q] for q in ("", "a") if q in states), key=lambda x: x[:2])


def test_search_finds_the_least_of_all_cheapest_audits():
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.randint(0, 12)
        roles = "".join(rng.choice("suuaaa?") for _ in range(n))
        marks = "".join(rng.choice("...tx") for _ in range(n))
        want = _least(roles, marks)
        assert cheapest(Lattice(roles, marks)) == want[:2], (roles, marks)


def test_a_long_conversation():
    roles, marks = "ua" * 20_000 + "u" + "ua" * 10, "." * 40_021
    assert cheapest(Lattice(roles, marks))[0] == 2


def _brute(rows):
    """The contract in plain Python; rows are ``(conv_id, turn, role, text)``."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talk = talks[conv]
        space = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        talk += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, talk in talks.items():
        whole = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
        talk.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], whole(*x[1:])))
        seen, faults = set(), []
        for _, role, text in talk:
            letters = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append(
                "blank" if BLANK.match(text) else "duplicate" if (role, text) in seen
                else "truncated" if letters[-1] not in ".!?" else ""
            )
            seen.add((role, text))
        turns = [t for t, _, _ in talk if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [r[:1] for _, r, _ in talk]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        marks = ["x" if f in ("blank", "duplicate") else "t" if f else "." for f in faults]
        cost, audit, steps = _least([f if f in ("s", "u", "a") else "?" for f in first], marks)
        kept = [("", "") if at == "" else talk[at][1:] for _, at in steps]
        lines, at = [], 0
        for (name, where), (role, text) in zip(steps, kept):
            full = {"u": "user", "a": "assistant"}
            keeps = where != "" and audit.replace("I", "")[where] == "K"
            lines.append(f"{role if keeps else full[name]}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return out


def _found(frame):
    rows = frame.collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert _found(op13_dijkstra_repair(spark, SF)) == _brute(rows)


def _frame(spark, rows):
    ship_package(spark)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_hard_rows(spark):
    rng = random.Random(3)
    rows = [(None, t, rng.choice(["user", "assistant", None, "", "system"]), rng.choice(["a.", "b", None, " "])) for t in range(40)]
    rows += [(7, None, "user", "x."), (7, None, "user", "x."), (7, 3, "assistant", "y" * 3_000_000 + "."), (7, -5, "über", "é?")]
    rows += [(8, t, "user", "same.") for t in range(30)] * 2
    rows += [(c, t, rng.choice(["user", "assistant", "system", "User"]), rng.choice(["One.", "two", "Three! \n", "\x1c"]))
             for c in range(20, 60) for t in rng.sample(range(9), 6)]
    frame = _frame(spark, rows).selectExpr("*", "1 AS gaps", "'x' AS audit")
    assert _found(conversations.repair(conversations.damaged(frame))) == _brute(rows)


def test_conversations_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = _frame(spark, [(gone, 0, "user", "Hi.")])
    assert _found(conversations.repair(conversations.damaged(frame))) == {gone: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    assert conversations.repair(_frame(spark, [])).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi?"), (1, 3, "assistant", "Yes.")]
    frame = _frame(spark, rows)
    found = conversations.plans(frame)
    turns = conversations.repaired(frame, found).orderBy("position").collect()
    assert [(t.edit, t.role, t.text) for t in turns] == [
        ("K", "system", "Be kind."), ("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "Hi?"), ("K", "assistant", "Yes.")
    ]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_any_type(spark, kind):
    frame = _frame(spark, [(1, 0, "user", "Hi.")]).selectExpr(f"cast(conv_id as {kind}) conv_id", "turn", "role", "text")
    assert conversations.repair(frame).collect()[0].audit == "KI"
