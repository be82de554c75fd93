"""Exact nearest neighbours by cosine over an inverted index with block maxima.

Equal vectors are one entry with its count and labels. Entries lie in blocks of ``BLOCK``, alike
ones together; a term has the list of its entries and its greatest weight in each block. A
query's weights times those maxima bound all its cosines in a block. Its ``FIRST`` best blocks
give a first last neighbour; then every block is opened whose bound is not below that, and the
lists of the query's terms are added up there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 64
FIRST = 6
# Sums in different order may differ in the last bits; so much counts as equal.
CLOSE = 1e-9

Vector = tuple[np.ndarray, np.ndarray]  # term numbers, ascending, and weights of length 1


@dataclass
class Vectors:
    """Sparse vectors: where each starts, term numbers and weights."""

    start: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(vectors: list[Vector]) -> Vectors:
        sizes = [len(t) for t, _ in vectors]
        terms, weights = (np.concatenate([*x, np.zeros(0)]) for x in zip(([], []), *vectors))
        return Vectors(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), terms.astype(np.int64), weights)

    def __len__(self) -> int:
        return len(self.start) - 1

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))


@dataclass
class BlockMaxIndex:
    counts: np.ndarray  # documents per entry
    positives: np.ndarray  # those labelled 1
    examples: list[tuple[list[int], list[int]]]  # the first ids per entry, and their labels
    wordless: np.ndarray  # entries without terms
    maxima: np.ndarray  # (terms, blocks): greatest weights
    start: np.ndarray  # of each term's list
    entries: np.ndarray  # the lists, one after the other
    weights: np.ndarray
    entry_of: np.ndarray  # entry of each vector given to ``build``
    opened: int = 0  # for tests: pairs of query and block opened so far

    def nearest(self, queries: Vectors, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, entry and cosine of the ``k`` nearest documents and all tied with the last, by query.

        ``without`` has, per query, an entry of which one document is left out.
        """
        own = (np.full(len(queries), -1) if without is None else without).tolist()
        cuts = queries.start.tolist()
        found = [self._nearest(queries.terms[a:b], queries.weights[a:b], k, o) for a, b, o in zip(cuts, cuts[1:], own)]
        row = np.repeat(np.arange(len(found)), [len(e) for e, _ in found])
        entry, cosine = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0)), *found))
        return row, entry, cosine

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        lists = [slice(a, b) for a, b in zip(self.start[terms].tolist(), self.start[terms + 1].tolist())]
        entry = np.concatenate([*[self.entries[x] for x in lists], np.zeros(0, np.int64)])
        weight = np.concatenate([*[self.weights[x] * w for x, w in zip(lists, weights.tolist())], np.zeros(0)])
        bounds = weights @ self.maxima[terms]
        opened = np.zeros(len(bounds), bool)
        opened[np.argsort(-bounds, kind="stable")[:FIRST]] = True
        _, _, least = self._opened(opened, entry, weight, k, own, -1.0)
        opened = bounds >= least - CLOSE
        self.opened += int(opened.sum())
        at, cosine, least = self._opened(opened, entry, weight, k, own, least)
        near = cosine >= least - CLOSE
        return at[near], cosine[near]

    def _opened(self, opened: np.ndarray, entry: np.ndarray, weight: np.ndarray, k: int, own: int, least: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Entries of the opened blocks not below ``least``, their cosines, and that of the ``k``-th document; -1 if there are fewer."""
        held = np.repeat(opened, BLOCK)[: len(self.counts)]
        if not opened.all():
            some = held[entry]
            entry, weight = entry[some], weight[some]
        cosine = np.bincount(entry, weight, len(held))
        at = np.flatnonzero(held & (cosine >= least - CLOSE))
        cosine = cosine[at]
        best = np.argsort(-cosine, kind="stable")
        total = np.cumsum(self.counts[at[best]] - (at[best] == own))
        if not len(total) or total[-1] < k:
            return at, cosine, -1.0
        return at, cosine, float(cosine[best[np.searchsorted(total, k)]])


def build(vectors: list[Vector], size: int, ids: list[int], labels: list[int], evidence: int) -> BlockMaxIndex:
    """Index examples over ``size`` terms; equal vectors are one entry, with the first ``evidence`` ids."""
    groups: dict[tuple, list[int]] = {}
    for i, (terms, weights) in enumerate(vectors):
        # The heaviest terms first, so that alike entries are neighbours.
        order = np.lexsort((terms, -weights))
        groups.setdefault((tuple(terms[order].tolist()), tuple(np.round(weights[order], 9).tolist())), []).append(i)
    members = [groups[key] for key in sorted(groups)]
    entry_of = np.zeros(len(vectors), np.int64)
    for entry, group in enumerate(members):
        entry_of[group] = entry
    held = Vectors.of([vectors[g[0]] for g in members])
    entry = held.row()
    maxima = np.zeros((size, -(-len(members) // BLOCK)))
    np.maximum.at(maxima, (held.terms, entry // BLOCK), held.weights)
    order = np.lexsort((entry, held.terms))
    return BlockMaxIndex(
        counts=np.array([len(g) for g in members], np.int64),
        positives=np.array([sum(labels[i] for i in g) for g in members], np.int64),
        examples=[([ids[i] for i in g[:evidence]], [labels[i] for i in g[:evidence]]) for g in members],
        wordless=np.flatnonzero(np.diff(held.start) == 0), maxima=maxima,
        start=np.searchsorted(held.terms[order], np.arange(size + 1)), entries=entry[order], weights=held.weights[order],
        entry_of=entry_of,
    )


def by_query(row: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """First and last place of each query among ascending rows."""
    at = np.searchsorted(row, np.arange(n + 1))
    return zip(at[:-1].tolist(), at[1:].tolist())
