from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from songloom.llm import repair
from songloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, here int, row string, digest long"
STATES = "-sua"


def plain_best(rows):
    """Cheapest, then least edits, from the end backwards with whole strings; rows: initial, goes, cut."""
    follows = {"s": "-", "u": "-sa", "a": "u"}

    @cache
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in "-a":
            options.append((0, ""))
        if inserts < 2:
            for role in "ua":
                if state in follows[role] and (rest := best(i, role, inserts + 1)):
                    options.append((2 + rest[0], "I" + rest[1]))
        if i < len(rows):
            initial, goes, cut = rows[i]
            steps = [(3, "D", state)]
            if not goes:
                steps += [(cut, "K", initial)] if state in follows.get(initial, "") else []
                steps += [(2 + cut, "R", role) for role in "ua" if state in follows[role]]
            options += [(price + rest[0], letter + rest[1]) for price, letter, to in steps if (rest := best(i + 1, to, 0))]
        return min(options, default=None)

    return best(0, "-", 0)


def plain(turns):
    """Rows of the result, from (conv_id, turn, role, text)."""
    groups = {}
    for conv_id, turn, role, text in turns:
        groups.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        groups[conv_id] += [(turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    return [(conv_id, *plain_conversation(rows)) for conv_id, rows in groups.items()]


def plain_conversation(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = plain_best(tuple((r[1][:1], k in ("b", "d"), int(k == "t")) for r, k in zip(rows, kinds)))
    lines, left, last = [], list(rows), ""
    for letter in audit:
        needed = "assistant" if last == "u" else "user"
        _, role, text = (None, needed, "") if letter == "I" else left.pop(0)
        if letter == "D":
            continue
        role = needed if letter == "R" else role
        lines.append(f"{role}:{text}")
        last = role[0]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, digest


@pytest.mark.parametrize("segment", [1, 2, 5, 4096])
def test_edits_against_every_way(monkeypatch, segment):
    """Also with trees that start anew after every few turns."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    for n in range(400):
        alphabet = rng.choice(["sua", "uua", "aua", "u", "a", "su", "uax"])
        rows = tuple((rng.choice(alphabet), rng.random() < 0.15, int(rng.random() < 0.3)) for _ in range(n % 14))
        found = repair.Repair()
        for initial, goes, cut in rows:
            found.turn(initial, goes, bool(cut))
        assert found.best() == plain_best(rows), rows


def test_equal_hashes_are_verified(monkeypatch):
    """With a hash that tells nothing apart, letters decide."""
    monkeypatch.setattr(repair, "_MODULUS", 3)
    rng = random.Random(4)
    for n in range(200):
        rows = tuple((rng.choice("suax"), rng.random() < 0.1, int(rng.random() < 0.4)) for _ in range(n % 16))
        found = repair.Repair()
        for initial, goes, cut in rows:
            found.turn(initial, goes, bool(cut))
        assert found.best() == plain_best(rows), rows


def test_table_against_plain(spark, rows):
    rng = random.Random(1)
    texts = ["Yes.", "No", "", " \t\n", "Why?\n", None, "é日\U0001f600!", "Same. ", "x" * 5000]
    roles = ["user", "assistant", "system", "tool", None, "User"]
    turns = []
    for conv in range(60):
        for turn in range(rng.randrange(12)):
            turns.append((conv, rng.choice([turn, turn, turn * 3, None]), rng.choice(roles[: 2 + conv % 5]), rng.choice(texts)))
    turns += [(None, i, "user", "Hi.") for i in range(6)] + [(7, 1, "user", "Yes.")] * 3
    turns += [(1000, i, "user", f"{i}.") for i in range(300)]
    df = spark.createDataFrame([(*t, 0, "x", 5) for t in turns], SCHEMA).repartition(5)
    found = repair.repair(repair.damaged(df), df)
    assert rows(found) == sorted(plain(turns), key=repr)
    assert repair.repair(repair.damaged(df.limit(0)), df.limit(0)).collect() == []


def test_given_table(spark, rows):
    sf = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(QUERIES["op12_repair_conversations"](spark, sf)) == sorted(plain(turns), key=repr)
