"""Structure repair of conversations: cheapest edits, with the edit trail as a shared tree.

Turns of a conversation, in order, must have role initials ``(s?(ua)+)?``. Edits: Keep costs 0,
Rerole to user or assistant 2, Delete 3 (the only one for blank and repeated turns), Insert of
an empty user or assistant turn 2; a truncated turn that is not deleted costs 1 more. Among
cheapest edits the one whose initials (``D I K R``) are least as a string counts.

1. Faults are found on narrow rows (turn, initial, digest of role and text); texts stay behind.
2. A conversation's narrow rows stream through four states (nothing yet; system; user;
   assistant). The best trail to each state is a node of a tree with its parent, one jump to a
   far ancestor (binary lifting in its skew form) and a rolling hash of all its letters, so
   trails share their beginnings. Of trails with equal cost the one with the lesser letter after
   their longest common beginning wins; it is found by jumping up while hashes differ. Equal
   hashes of different nodes are verified letter by letter. (Trails of equal cost over equal
   turns differ in some letter before either ends: what follows a common beginning could only
   be inserts, which cost.)
3. After ``SEGMENT`` turns the live trails, four at most, are written down as letters and the
   tree starts anew from them, with their order. So a conversation takes a few bytes a turn
   while it is open, as much as its answer.
4. Texts meet the trails in one shuffle by conversation and are hashed as they stream past.
   (The digest is a chain over the turns, so one task reads all texts of a conversation, in
   memory that holds only its edits.)

Defined cases: a null role or text is one space, so the turn is blank or must get a role; turns
are in order of turn (null first), role, digest; equal turns are repeats; a null conversation id
is one conversation; a conversation without turns has zeros and empty edits; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from songloom.llm.common import SPACES, stored

SEGMENT = 4096
REROLE = INSERT = 2
DELETE = 3
TRUNCATED = 1
# States by the role before: none, system, user, assistant.
STATES = range(4)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FINAL = (0, 3)

AUDIT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)
REPAIRED = AUDIT + ", repaired_sha256 string"

_MODULUS = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51


class Trails:
    """A tree of letters; a node is the string on the way to it."""

    def __init__(self) -> None:
        # What was written down: per segment and state, the trail it goes on from, and letters.
        self.written: list[dict[int, tuple[int, bytes]]] = []
        self.order: dict[tuple[int, int], int] = {}
        self._start({0: (0, 0)})

    def _start(self, roots: dict[int, tuple[int, int]]) -> None:
        """``roots``: hash and depth of the trails to go on from, by state."""
        self.root = {}
        self.parent, self.jump, self.depth = array("q"), array("q"), array("q")
        self.hash, self.letter, self.base = array("Q"), array("B"), array("b")
        for state, (hashed, depth) in roots.items():
            node = len(self.parent)
            self.root[state] = node
            for held, value in ((self.parent, node), (self.jump, node), (self.depth, depth), (self.hash, hashed), (self.letter, 0), (self.base, state)):
                held.append(value)

    def add(self, node: int, letter: str) -> int:
        code = ord(letter)
        far = self.jump[node]
        # Jumps of equal length twice in a row become one of both.
        even = self.depth[node] - self.depth[far] == self.depth[far] - self.depth[self.jump[far]]
        self.jump.append(self.jump[far] if even else node)
        self.parent.append(node)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + code) % _MODULUS)
        self.letter.append(code)
        self.base.append(self.base[node])
        return len(self.parent) - 1

    def _up(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            far = self.jump[node]
            node = far if self.depth[far] >= depth else self.parent[node]
        return node

    def compare(self, x: int, y: int) -> int:
        """-1 or 1 by the letters of two trails; -2 or 2 if one is the beginning of the other."""
        if self.base[x] != self.base[y]:
            return self._by_base(x, y)
        a, b = x, y
        if self.depth[a] > self.depth[b]:
            a = self._up(a, self.depth[b])
        elif self.depth[b] > self.depth[a]:
            b = self._up(b, self.depth[a])
        if a == b:
            return 0 if x == y else -2 if self.depth[x] < self.depth[y] else 2
        if self.hash[a] == self.hash[b]:
            # Different nodes with equal hashes: see whether the letters really agree.
            found = self._earliest(a, b)
            return found or (0 if self.depth[x] == self.depth[y] else -2 if self.depth[x] < self.depth[y] else 2)
        while self.hash[self.parent[a]] != self.hash[self.parent[b]]:
            if self.hash[self.jump[a]] != self.hash[self.jump[b]]:
                a, b = self.jump[a], self.jump[b]
            else:
                a, b = self.parent[a], self.parent[b]
        before = self._earliest(self.parent[a], self.parent[b])
        return before or (-1 if self.letter[a] < self.letter[b] else 1)

    def _earliest(self, a: int, b: int) -> int:
        """Order by the first letter in which two nodes of equal depth differ, 0 if none."""
        found = 0
        while a != b:
            if self.letter[a] != self.letter[b]:
                found = -1 if self.letter[a] < self.letter[b] else 1
            a, b = self.parent[a], self.parent[b]
        return found

    def _by_base(self, x: int, y: int) -> int:
        known = self.order[self.base[x], self.base[y]]
        if abs(known) == 1:
            return known
        if known == 2:
            return -self._by_base(y, x)
        # y goes on from x's beginning with inserts; x goes on with a turn, or not yet.
        first = self.depth[self.root[self.base[x]]] + 1
        if self.depth[x] < first:
            return -2
        return -1 if self.letter[self._up(x, first)] < ord("I") else 1

    def _letters(self, node: int) -> bytes:
        out = bytearray()
        while self.parent[node] != node:
            out.append(self.letter[node])
            node = self.parent[node]
        return bytes(reversed(out))

    def write_down(self, heads: dict[int, int]) -> dict[int, int]:
        """Start a new tree from the given nodes, by state."""
        order = {(p, q): self.compare(x, y) for p, x in heads.items() for q, y in heads.items() if p != q}
        self.written.append({state: (self.base[node], self._letters(node)) for state, node in heads.items()})
        self._start({state: (self.hash[node], self.depth[node]) for state, node in heads.items()})
        self.order = order
        return dict(self.root)

    def text(self, node: int) -> str:
        parts, state = [self._letters(node)], self.base[node]
        for held in reversed(self.written):
            state, letters = held[state]
            parts.append(letters)
        return b"".join(reversed(parts)).decode()


class Repair:
    """The cheapest edits of one conversation, turn after turn."""

    def __init__(self) -> None:
        self.trails = Trails()
        self.cost, self.node = {0: 0}, {0: self.trails.root[0]}
        self.turns = 0
        self._insert()

    def _offer(self, cost: dict[int, int], node: dict[int, int], state: int, price: int, last: int, letter: str) -> None:
        if price > cost.get(state, price):
            return
        new = self.trails.add(last, letter)
        if price < cost.get(state, price + 1) or self.trails.compare(new, node[state]) < 0:
            cost[state], node[state] = price, new

    def _insert(self) -> None:
        # A user turn first, an assistant turn maybe after it; more never pays.
        for letter in "ua":
            for state, after in NEXT[letter].items():
                if state in self.cost:
                    self._offer(self.cost, self.node, after, self.cost[state] + INSERT, self.node[state], "I")

    def turn(self, initial: str, deleted: bool, truncated: bool) -> None:
        """``deleted``: the turn has to go."""
        cost: dict[int, int] = {}
        node: dict[int, int] = {}
        for state, price in self.cost.items():
            last = self.node[state]
            self._offer(cost, node, state, price + DELETE, last, "D")
            if deleted:
                continue
            price += TRUNCATED * truncated
            after = NEXT.get(initial, {}).get(state)
            if after is not None:
                self._offer(cost, node, after, price, last, "K")
            for letter in "ua":
                if state in NEXT[letter]:
                    self._offer(cost, node, NEXT[letter][state], price + REROLE, last, "R")
        self.cost, self.node = cost, node
        self._insert()
        self.turns += 1
        if self.turns % SEGMENT == 0:
            self.node = self.trails.write_down(self.node)

    def best(self) -> tuple[int, str]:
        least = min(self.cost[s] for s in FINAL if s in self.cost)
        first = None
        for state in FINAL:
            if self.cost.get(state) == least and (first is None or self.trails.compare(self.node[state], first) < 0):
                first = self.node[state]
        return least, self.trails.text(first)


class _Conversation:
    def __init__(self) -> None:
        self.repair = Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.turns: list[int] = []  # first, last, how many different

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        duplicate, truncated = duplicate and not blank, truncated and not (blank or duplicate)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = turn, self.turns[2] + 1
        self.repair.turn(initial, blank or duplicate, truncated)

    def row(self) -> tuple:
        first, last, different = self.turns or (0, -1, 0)
        return (last - first + 1 - different, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.best())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names, types = zip(*(field.split() for field in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted narrow rows in; a row per conversation out."""
    open_: _Conversation | None = None
    id = None
    for batch in batches:
        done = []
        for conv_id, here, *fields in zip(*(c.to_pylist() for c in batch.columns)):
            if open_ is None or conv_id != id:
                if open_:
                    done.append((id, *open_.row()))
                open_, id = _Conversation(), conv_id
            if here:
                open_.add(*fields)
        if done:
            yield _batch(done, AUDIT)
    if open_:
        yield _batch([(id, *open_.row())], AUDIT)


class _Lines:
    """The repaired turns of a conversation, hashed as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0
        self.hash, self.some = hashlib.sha256(), False

    def _line(self, initial: str, role: str, text: str) -> None:
        self.hash.update(f"{'\n' if self.some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.some, self.state = True, NEXT[initial][self.state]

    def _needed(self) -> tuple[str, str]:
        return ("a", "assistant") if self.state == 2 else ("u", "user")

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line(*self._needed(), "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._line(role[0], role, text)
        elif edit == "R":
            self._line(*self._needed(), text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's edits, followed by its turns, in; its row out."""
    lines: _Lines | None = None
    found: tuple = ()
    for batch in batches:
        done = []
        for role, text, audit in zip(*(batch.column(c).to_pylist() for c in ("role", "text", "row"))):
            if audit is not None:
                if lines:
                    done.append((*found, lines.digest()))
                found, lines = tuple(audit.values()), _Lines(audit["audit"])
            else:
                lines.turn(role, text)
        if done:
            yield _batch(done, REPAIRED)
    if lines:
        yield _batch([(*found, lines.digest())], REPAIRED)


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in, by a hash of conversation and turn: one in four has one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), fault.alias("fault"))
    return (
        rows.where("fault <> 0")
        .withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        )
    )


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, its cheapest edits, and a digest of what they give.

    ``turns`` has ``conv_id, turn, role, text``; ``conversations``, with ``conv_id``, names those
    that get a row even without turns.
    """
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text"))
    rows = plain.withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    ended = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select(
        "conv_id", F.lit(True).alias("here"), "turn", "role", F.substring("role", 1, 1).alias("initial"), "digest",
        (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    narrow = narrow.withColumn("duplicate", F.row_number().over(seen) > 1)
    if conversations is not None:
        named = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        narrow = narrow.unionByName(named.withColumn("here", F.lit(False)), allowMissingColumns=True)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    audits = stored(
        narrow.repartition("conv_id").sortWithinPartitions(*order)
        .select("conv_id", "here", "turn", "initial", "blank", "duplicate", "truncated").mapInArrow(_audits, AUDIT)
    )
    first = audits.select("conv_id", F.struct(*audits.columns).alias("row"))
    return (
        rows.unionByName(first, allowMissingColumns=True).repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("row").isNull(), *order[1:])
        .select("role", "text", "row").mapInArrow(_digests, REPAIRED)
    )
