import hashlib
import random

import pyarrow as pa
import pytest

from songloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = "</s>[INST] ok [/INST]"


def plain(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is None, t or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == chat.LEARNED)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(6)
    pieces = ["<s>", "</s>", "<\\s>", "[INST]", "[/INST]", "\\", "<<SYS>>", "<|im_end|>", "\n", "é", "日本", "\U0001f600", " word ", "<", "["]
    rows = [(c, t, rng.choice(["user", chat.LEARNED, "system"]), "".join(rng.choices(pieces, k=rng.randrange(30)))) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(-1, 0, "user", MARKS), (-1, 1, chat.LEARNED, MARKS), (None, 0, None, None), (None, None, "a\\n\nb</s>", "x")]
    rows += [(77, 1, "user", "same"), (77, 1, "user", "same"), (78, 0, chat.LEARNED, ""), (79, 0, chat.LEARNED, "long " * 60_000)]
    rows += [(80, t, "user" if t % 2 else chat.LEARNED, f"turn {t} </s>") for t in range(1500)]
    return rows


@pytest.mark.parametrize("part_bytes", [chat.PART_BYTES, 2000])
def test_read_back_equals_input(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(chat, "PART_BYTES", part_bytes)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as n_turns", "'x' as loss").repartition(5)
    formatted = chat.format_chats(df)
    got = [tuple(r)[:5] for r in chat.digests(formatted).collect()]
    assert sorted(got, key=repr) == plain(rows)
    kept = formatted.collect()
    assert (max(r.part for r in kept) > 0) == (part_bytes == 2000)
    for r in kept:
        # Marks come from the template alone: one start and one end per turn.
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == r.n_turns
        assert not any(c in r.formatted for c in chat.CONTROL if c not in (chat.START, chat.END))


def test_empty_table(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("text", ["</s>", "<\\/s>", "<\\\\/s>", "<<s>", "[[INST]]", "<\\", "<<SYS>><</SYS>>", "a\\b", "<|im_start|>"])
def test_escape_is_reversible(text):
    one = pa.array([text])
    escaped = chat.escape(one)
    assert not any(c in escaped[0].as_py() for c in chat.CONTROL)
    assert chat.unescape(escaped)[0].as_py() == text
    assert chat.unescape_role(chat.escape_role(one)[0].as_py()) == text
