from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from songloom.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)] if n else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(numbers, ids):
    """Component's least id per place, by comparing all pairs."""
    parent = list(range(len(numbers)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(numbers)):
        for j in range(i):
            if (numbers[i] ^ numbers[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    groups = {}
    for i, own in enumerate(ids):
        groups.setdefault(root(i), []).append(own)
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(ids))]


def check(found, rows):
    numbers = [plain_fingerprint(t) for _, t in rows]
    expected = zip([i for i, _ in rows], [f"{n:016x}" for n in numbers], plain_components(numbers, [i for i, _ in rows]))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_texts_against_brute_force(spark, documents, odd_rows):
    rng = random.Random(5)
    words = [f"W{rng.randrange(500)}" for _ in range(300)]
    rows = list(odd_rows)
    for i in range(60):
        own = list(words)
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = "changed"
        rows.append((100 + i, " ".join(own)))
    rows += [(200 + i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(60)]
    check(simhash.simhash_groups(documents(rows, extra=True), hot_rows=5), rows)


def test_every_distance_up_to_three(spark):
    """Links of 1, 2 and 3 bits in all parts, none of four, with lists compared and with balls."""
    rng = random.Random(9)
    numbers = {0, 2**64 - 1}
    for _ in range(150):
        base = rng.getrandbits(64)
        numbers.add(base)
        for n in (1, 2, 3, 4):
            numbers.add(base ^ sum(1 << b for b in rng.sample(range(64), n)))
    centre = rng.getrandbits(64)
    # Many that agree outside one part, near and far.
    numbers |= {centre ^ rng.getrandbits(21) for _ in range(120)}
    numbers = sorted(numbers)
    classes = spark.createDataFrame([(int(np.uint64(n).astype(np.int64)),) for n in numbers], "f long")
    expected = plain_components(numbers, list(range(len(numbers))))
    for bucket in (2048, 3):
        links = [(np.int64(a).astype(np.uint64), np.int64(b).astype(np.uint64)) for a, b in simhash.links_between(classes, bucket).collect()]
        assert all(int(a ^ b).bit_count() <= 3 for a, b in links)
        place = {n: i for i, n in enumerate(numbers)}
        parent = list(range(len(numbers)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            parent[root(place[int(a)])] = root(place[int(b)])
        least = {}
        for i in range(len(numbers)):
            least.setdefault(root(i), i)
        assert [least[root(i)] for i in range(len(numbers))] == expected


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(2)
    text = "  ".join(f"w{rng.randrange(90)}" for _ in range(3000))
    whole = simhash.fingerprint_of(text.encode())
    monkeypatch.setattr(simhash, "PART_BYTES", 50)
    assert simhash.fingerprint_of(text.encode()) == whole == plain_fingerprint(text)


def test_empty_table(spark, documents):
    assert simhash.simhash_groups(documents([])).collect() == []
