"""Conversation repair against a dynamic program over all states, and on odd tables."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from penstock.llm import repair
from penstock.llm.repair import audits, cheapest, damaged, op12_conversation_repair, ordered, repaired

SF = "/root/testdata/sf0.01"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
ROLES = ["user", "assistant"]


def accepted(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def best_by_force(rows):
    """Cheapest (cost, letters, roles) by breadth over what was put out; rows of (role, must go, truncated)."""

    def after(state, initial):  # the automaton, spelt out
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    def inserts(level):
        for _ in range(4):
            for state, (cost, letters) in list(level.items()):
                for role in ROLES:
                    to = after(state, role[0])
                    if to and (new := (cost + 2, letters + "I")) < level.get(to, (9**9, "")):
                        level[to] = new
        return level

    level = {"": (0, "")}
    for role, must, truncated in rows:
        level = inserts(level)
        new = {}
        for state, (cost, letters) in level.items():
            ways = [(state, 3, "D")]
            if not must:
                ways += [(after(state, role[:1]), truncated, "K")] + [(after(state, r[0]), 2 + truncated, "R") for r in ROLES]
            for to, more, letter in ways:
                if to is not None and (way := (cost + more, letters + letter)) < new.get(to, (9**9, "")):
                    new[to] = way
        level = new
    level = inserts(level)
    return min(level[s] for s in ("", "a") if s in level)


def expected(rows):
    """All result columns of one conversation, of damaged (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    counts, seen, judged = [0, 0, 0], set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults = [not words, (role, text) in seen, words[-1:] not in (".", "!", "?")]
        seen.add((role, text))
        first = faults.index(True) if any(faults) else None
        if first is not None:
            counts[first] += 1
        judged.append((role, first in (0, 1), first == 2))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters = best_by_force(judged)
    out, rest = [], iter(rows)
    for letter in letters:
        row = next(rest) if letter != "I" else None
        if letter == "K":
            out.append((row[1], row[2]))
        elif letter in "IR":
            out.append(("assistant" if out and out[-1][0].startswith("u") else "user", row[2] if row else ""))
    assert accepted("".join(r[:1] for r, _ in out))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *counts, illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest()), out


def damaged_by_force(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        held = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def collected(result):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in result.collect()}


def test_whole_table(spark):
    given = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert collected(op12_conversation_repair(spark, SF)) == {c: expected(rows)[0] for c, rows in damaged_by_force(given).items()}


def test_search_by_force():
    draw = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "agent", ""]
    for _ in range(1500):
        rows = [(draw.choice(roles[: draw.randint(1, 6)]), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randint(0, 9))]
        assert cheapest([(role[:1], must, truncated) for role, must, truncated in rows]) == best_by_force(rows), rows


@pytest.mark.parametrize("run_rows", [1, 3, repair.RUN])
def test_cut_conversations(spark, run_rows):
    """Long conversations, cut into runs within and across partitions, give what a whole search gives."""
    draw = random.Random(run_rows)
    rows = [
        (conv, turn // draw.choice([1, 1, 2]), draw.choice(["user", "assistant", "assistant", "system", "x"]), draw.choice(["Yes.", "no", "", f"{turn} !", "So?"]))
        for conv, n in ((1, 90), (2, 40), (3, 1), (None, 7))
        for turn in range(n)
    ]
    found = audits(ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), run_rows)
    for r in found.collect():
        want = expected([row[1:] for row in rows if row[0] == (r.c if r.c > 0 else None)])[0]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want[:-1]


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, other roles, clashing columns; each damage kind is met."""
    rows = [(c, t, r, x) for c in range(60) for t, r, x in [(0, "user", "Hi."), (1, "assistant", "Hello there.  "), (1, "assistant", "Hello there.  "), (2, None, "x."), (None, "user", None), (4, "", "y!")]]
    rows += [(None, None, None, None), (None, 3, "user", "word " * 50_000), (None, 4, "assistant", "é?"), (77, 2**40, "user", "z."), (77, -5, "assistant", " \n\t")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.selectExpr("*", "1 as c", "2 as audit", "'x' as digest", "'y' as kind", "0 as n").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {c: expected(some) for c, some in damaged_by_force(rows).items()}
    assert collected(op12_conversation_repair(spark, str(tmp_path))) == {c: w[0] for c, w in want.items()}
    kept = ordered(damaged(frame))
    got = {}
    for r in repaired(kept, audits(kept)).orderBy("pos").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: w[1] for c, w in want.items() if w[1]}
    frame.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert op12_conversation_repair(spark, str(tmp_path / "none")).count() == 0
