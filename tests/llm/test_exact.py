import hashlib

import numpy as np
import pytest

from songloom.llm import exact


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        group = groups[t or ""]
        keep = max((x for x in group if x is not None), default=None)
        out.append((i, keep, len(group), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr), len(groups)


def texts_with_edits():
    rng = np.random.default_rng(5)
    base = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (40, 900, 40_000)]
    rows, i = [], 0
    for text in base:
        for variant in (text, text, text[:-1], text + "x", text[: len(text) // 2] + "#" + text[len(text) // 2 + 1 :]):
            rows.append((i, variant))
            i += 1
    return rows


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_like_grouping_by_text(documents, odd_rows, digest_bytes):
    """With digests of one byte nearly all chunks clash, and contents decide."""
    rows = odd_rows + [(100 + i, t) for i, t in texts_with_edits()]
    got = exact.exact_groups(documents(rows), digest_bytes=digest_bytes).collect()
    want, groups = plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_stage_keeps_whole_rows(documents, odd_rows):
    df = documents(odd_rows, extra=True)
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t in odd_rows})
    assert exact.drop_copies(df.limit(0)).count() == 0
    assert exact.exact_groups(df.limit(0)).count() == 0


def test_chunks_follow_content(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 250, 200_000, dtype=np.uint8)
    shifted = np.concatenate([rng.integers(0, 250, 777, dtype=np.uint8), data])
    cut = lambda d: exact.chunk_ends(d, exact._hits(d), 0, len(d))
    first, second = cut(data), [e - 777 for e in cut(shifted)]
    assert first[-1] == len(data) and max(np.diff([0, *first])) <= exact.LONGEST
    assert len(set(first) & set(second)) > 0.8 * len(first)
    hits = exact._hits(data)
    monkeypatch.setattr(exact, "PART_BYTES", 999)
    assert (exact._hits(data) == hits).all()
