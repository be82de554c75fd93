import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from songloom.llm import suffix

LENGTH = 60


def plain(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shared_passages(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdeé "
    free = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [free(k) for k in (59, 60, 61, 150, 400)]
    rows = []
    for i in range(n):
        parts = [free(rng.randrange(0, 90)) for _ in range(4)]
        text = "".join(p + (rng.choice(passages) if rng.random() < 0.7 else "") for p in parts)
        rows.append((i + 100, text))
    return [*rows, (1000, "ab" * 90), (1001, "x" * 61), (1002, "y" * 60), (1003, "z" * 59 + "z" * 59)]


def result(df, length):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[n] for n in names) for r in suffix.without_repeats(df, length=length).collect()), key=repr)


@pytest.mark.parametrize("group,chunk,block", [(4 << 20, 1 << 20, 2 << 20), (500, 700, 2000)])
def test_like_counting_every_string(documents, monkeypatch, group, chunk, block):
    """Also where groups have to be split and texts are read in parts."""
    monkeypatch.setattr(suffix, "GROUP_BYTES", group)
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    rows = shared_passages(1)
    assert result(documents(rows, extra=True), LENGTH) == plain(rows, LENGTH)


def test_odd_rows(documents, odd_rows):
    df = documents(odd_rows, extra=True)
    assert result(df, suffix.LENGTH) == plain(odd_rows, suffix.LENGTH)
    assert suffix.without_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_repeated_starts(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + (2, 3, 20, 2)[seed], 3000).astype(np.uint8)
    data[700:1000], data[2000:2300] = data[100:400], data[150:450]
    data[1500] = 255
    for length in (1, 2, 9, 40):
        seen = Counter(bytes(data[i : i + length]) for i in range(len(data) - length + 1))
        want = [i for i in range(len(data) - length + 1) if seen[bytes(data[i : i + length])] > 1]
        got = [i for i in suffix.repeated_starts(data, length).tolist() if i + length <= len(data)]
        assert got == want


def test_every_string_lies_in_one_context():
    rng = np.random.default_rng(8)
    sizes = [0, 10, 60, 61, 500, 3000]
    data = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    from songloom.llm.hashing import Stretches

    text, _, _, start, count, _ = suffix.contexts(data, offsets, Stretches(1 << 12), LENGTH)
    found = sorted((int(t), int(s) + k) for t, s, n in zip(text, start, count) for k in range(n))
    assert found == [(i, s) for i, n in enumerate(sizes) for s in range(max(n - LENGTH + 1, 0))]
