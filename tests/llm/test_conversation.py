"""Operator 11 against a plain reading: all edits, row by row, with the edits as strings."""

import hashlib
import itertools
import random
import zlib

import pytest

from lorekeep.llm import conversation
from lorekeep.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def judged(rows):
    """Sorted rows with their first fault."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, out = set(), []
    for _, turn, role, text in rows:
        said = text.strip(SPACE)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def grammar(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(rest) >= 2 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def may_follow(state, initial):
    return {"": "su", "s": "u", "u": "a", "a": "u"}[state].find(initial) >= 0 and len(initial) == 1


def best(rows):
    """Least (cost, audit) and what is said, by keeping the best for every last initial."""
    now = {"": (0, "", [])}

    def put(to, state, entry):
        if state not in to or entry[:2] < to[state][:2]:
            to[state] = entry

    def inserted(states):
        while True:
            more = dict(states)
            for state, (cost, audit, said) in states.items():
                for c, role in (("u", "user"), ("a", "assistant")):
                    if may_follow(state, c):
                        put(more, c, (cost + 2, audit + "I", [*said, f"{role}:"]))
            if more == states:
                return states
            states = more

    for _, role, text, fault in rows:
        # The options before a row: each state with its own inserts, not only the best of them.
        after = {}
        for start, entry in now.items():
            for state, (cost, audit, said) in inserted({start: entry}).items():
                put(after, state, (cost + 3, audit + "D", said))
                if fault in ("blank", "duplicate"):
                    continue
                extra = fault == "truncated"
                for c, name in (("u", "user"), ("a", "assistant")):
                    if may_follow(state, c):
                        put(after, c, (cost + 2 + extra, audit + "R", [*said, f"{name}:{text}"]))
                if may_follow(state, role[:1]):
                    put(after, role[:1], (cost + extra, audit + "K", [*said, f"{role}:{text}"]))
        now = after
    ends = [e for start, entry in now.items() for s, e in inserted({start: entry}).items() if s in ("", "a")]
    return min(ends, key=lambda e: e[:2])


def by_hand(rows):
    out = []
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = judged([r for r in after if r[0] == conv])
        turns = {t for t, *_ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [sum(f == k for *_, f in mine) for k in ("blank", "duplicate", "truncated")]
        initials = [r[:1] for _, r, _, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, said = best(mine)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "User", "ürole", "usher"])
            text = rng.choice(["Yes.", "Yes", "", None, " \n", "No!", "so? ", "é.", "ends?  \t", "A\x0b", f"{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None, turn + 3]), role, text))
    rows += [(None, 1, "user", "Null."), (None, None, "assistant", "id."), (None, None, None, None), (7, None, None, None)]
    return rows + rows[5:9]


def result(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("piece", [4096, 3, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, tmp_path, monkeypatch, seed, piece):
    """Pieces of one and three rows cut nearly all conversations."""
    monkeypatch.setattr(conversation, "PIECE", piece)
    rows = odd_rows(seed)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert result(QUERIES["op11_conversation_repair"](spark, str(tmp_path))) == by_hand(rows)


def test_table(spark, small):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert result(QUERIES["op11_conversation_repair"](spark, small)) == by_hand(rows)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect() == []


def test_reading_itself():
    """The reading by hand against every list of edits, for short conversations."""
    names = {"u": "user", "a": "assistant"}
    for roles in itertools.product(["user", "assistant", "system", "x"], repeat=2):
        rows = [(k, r, f"{k}.", "") for k, r in enumerate(roles)]
        options = []
        for inserts in itertools.product([(), ("u",), ("a",), ("u", "a"), ("a", "u")], repeat=3):
            for ops in itertools.product(["D", "K", "u", "a"], repeat=2):
                audit, cost, said, initials = "", 0, [], ""
                for k in range(3):
                    for c in inserts[k]:
                        audit, cost, initials = audit + "I", cost + 2, initials + c
                        said.append(names[c] + ":")
                    if k < 2:
                        op = ops[k]
                        audit += op if op in "DK" else "R"
                        cost += {"D": 3, "K": 0}.get(op, 2)
                        if op != "D":
                            role = rows[k][1] if op == "K" else names[op]
                            initials += role[0]
                            said.append(f"{role}:{k}.")
                if grammar(initials):
                    options.append((cost, audit, said))
        assert best(rows) == min(options, key=lambda o: o[:2])


def test_long_conversation_and_other_columns(spark, monkeypatch):
    """A conversation over many tasks; pieces keep the order, other columns do not matter."""
    monkeypatch.setattr(conversation, "PIECE", 50)
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["a.", f"{k}!", f"{k}", ""])) for k in range(3000)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA + ", edits string, part int, whole boolean")
    pieces = conversation.repair(df.repartition(8)).collect()
    mine = sorted((p for p in pieces if p.conv_id == 1), key=lambda p: (p.part, p.no))
    assert len(mine) > 50
    cost, audit, said = best(judged([r for r in rows if r[0] == 1]))
    edits = [e for p in mine for e in p.edits]
    assert "".join(e.edit for e in edits) == audit and sum(p.cost for p in mine) == cost
    assert [f"{e.role}:{e.text}" for e in edits if e.edit != "D"] == said
    assert grammar("".join(e.role[0] for e in edits if e.edit != "D"))


def test_crossings_in_any_order():
    """Steps joined before solving give the same edits as rows one by one."""
    rng = random.Random(9)
    for _ in range(200):
        kinds = [(rng.choice("suaux"), rng.randrange(4)) for _ in range(rng.randrange(1, 14))]
        steps = [conversation.row_step(*k)[1] for k in kinds]
        states = conversation.crossings(steps, 0)
        cut = sorted(rng.sample(range(len(steps) + 1), min(3, len(steps))))
        parts = [steps[a:b] for a, b in itertools.pairwise([0, *cut, len(steps)]) if b > a]
        ends = list(itertools.accumulate(map(len, parts)))
        assert conversation.crossings([conversation.joined(p) for p in parts], 0)[1:] == [states[e] for e in ends]
