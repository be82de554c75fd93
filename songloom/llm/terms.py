"""Terms of texts, counted a buffer of many texts at a time.

A text is lower-cased and cut at white space; a word loses the punctuation at its ends. Its
terms are the word as a whole and its beginnings of ``BEGINNINGS`` characters, those shorter
than the word. In a buffer, words are found by their edges, and every term's 64-bit hash by one
subtraction of running sums, so a word that no one knows costs no more than one that all do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from songloom.llm.hashing import Stretches, U, buffer_of, runs

BEGINNINGS = range(3, 8)
WHOLE, BEGINNING = 3, 4  # seeds that tell "tras" from the beginning of "trash"
RUN_BYTES = 1 << 20
_SIEVE_BITS = 18

# White space; characters that are no part of a word at its ends.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATION = r"\x00-/:-@\[-^`{-\x7f\x80-\xbf -⏿　-〿"
_IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() or b == 0x5F for b in range(256)])
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ENDS = re.compile(rf"^[{_PUNCTUATION}]+|[{_PUNCTUATION}]+$")


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))


def terms_of(word: str) -> list[str]:
    """Terms of a lower-case word; a whole word has ``$`` at its end."""
    word = _ENDS.sub("", word)
    return [word + "$", *[word[:n] for n in BEGINNINGS if n < len(word)]] if word else []


def terms_in(text: str) -> set[str]:
    """All terms of a lower-case text."""
    return {term for word in set(_WORD.findall(text)) for term in terms_of(word)}


def _in_word(data: np.ndarray) -> np.ndarray:
    found = _IN_WORD[data]
    following = np.append(data[1:], 0)
    # U+0080 to U+00BF, U+2000 to U+23FF, U+3000 to U+303F.
    for first, low, high, size in ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0x8F, 3), (0xE3, 0x80, 0x80, 3)):
        at = np.flatnonzero((data == first) & (following >= low) & (following <= high))
        for i in range(size):
            found[at + i] = False
    return found


class Words:
    """Words of a buffer of lower-case texts: where they are, and hashes of their terms."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashes: Stretches) -> None:
        inside = np.empty(len(data) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(_SPACE[data], out=inside[1:-1])
        at = np.flatnonzero(inside[1:] != inside[:-1])
        # The end of a text ends its last word.
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = _different(cuts[inside[cuts] & inside[cuts + 1]])
        starts, ends = (np.sort(np.concatenate([x, cuts])) for x in (at[0::2], at[1::2]))
        held = _in_word(data)
        before = np.concatenate([[0], np.cumsum(held)])
        some = before[ends] > before[starts]
        starts, ends, place = starts[some], ends[some], np.flatnonzero(held)
        self.first, self.last = place[before[starts]], place[before[ends] - 1] + 1
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(self.first, offsets)))
        begins = (data & 0xC0) != 0x80
        characters = np.concatenate([[0], np.cumsum(begins)])
        self._place = np.append(np.flatnonzero(begins), len(data))
        self._at = characters[self.first]
        self.length = characters[self.last] - self._at
        self._hashes, self._sums = hashes, hashes.sums(data)

    def terms(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words by number, and the hash of one of their terms: whole words, then beginnings."""
        yield np.arange(len(self.first)), self._hashes.of(self._sums, self.first, self.last, WHOLE)
        for n in BEGINNINGS:
            longer = np.flatnonzero(self.length > n)
            yield longer, self._hashes.of(self._sums, self.first[longer], self._place[self._at[longer] + n], BEGINNING)


def term_hashes(terms: list[str]) -> np.ndarray:
    """Hashes of terms as ``terms_of`` writes them."""
    hashes = Stretches(1 << 10)
    out = np.zeros(len(terms), np.uint64)
    for whole, seed in ((True, WHOLE), (False, BEGINNING)):
        at = [i for i, t in enumerate(terms) if t.endswith("$") == whole]
        data, offsets = buffer_of(pa.array([terms[i].removesuffix("$") for i in at], pa.large_string()))
        if at:
            out[at] = hashes.of(hashes.sums(data[: offsets[-1]]), offsets[:-1], offsets[1:], seed)
    return out


class Lexicon:
    """Known terms, each with a number; several may share one. ``size`` stands for all other words."""

    def __init__(self, numbers: dict[str, int]) -> None:
        self.size = max(numbers.values(), default=-1) + 1
        hashes = term_hashes(list(numbers))
        order = np.argsort(hashes)
        self._hashes, self._numbers = hashes[order], np.array(list(numbers.values()), np.int64)[order]
        self._sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self._sieve[self._hashes >> U(64 - _SIEVE_BITS)] = True

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some hashes are known, and their numbers."""
        may = np.flatnonzero(self._sieve[hashes >> U(64 - _SIEVE_BITS)])
        if not len(may):
            return may, may
        place = np.minimum(np.searchsorted(self._hashes, hashes[may]), len(self._hashes) - 1)
        right = self._hashes[place] == hashes[may]
        return may[right], self._numbers[place[right]]

    def counts(self, texts: pa.Array, hashes: Stretches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of neighbouring texts: how many numbers each has, the numbers ascending, and their counts.

        A word counts once for each number of its terms, and for ``size`` if it has none.
        """
        data, offsets = buffer_of(lowered(texts))
        for first, last in runs(offsets, RUN_BYTES):
            words = Words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], hashes)
            pairs = []
            for word, found in words.terms():
                at, number = self._known(found)
                pairs.append(word[at] * (self.size + 1) + number)
            word, number = np.divmod(_different(np.concatenate(pairs)), self.size + 1)
            other = np.ones(len(words.first), bool)
            other[word] = False
            others = np.bincount(words.row[other], minlength=last - first)
            some = np.flatnonzero(others)
            cells, counts = np.unique(words.row[word] * (self.size + 1) + number, return_counts=True)
            cells = np.concatenate([cells, some * (self.size + 1) + self.size])
            order = np.argsort(cells, kind="stable")
            row, number = np.divmod(cells[order], self.size + 1)
            yield np.bincount(row, minlength=last - first), number, np.concatenate([counts, others[some]])[order]


def _different(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]]
