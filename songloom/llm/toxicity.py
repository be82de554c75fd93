"""Toxicity of documents by their nearest labelled examples.

Terms (``terms``) are words and beginnings of words. All terms of the examples that tell the
labels apart by a chi-squared of ``LEAST_CHI`` span the space, so it grows with the vocabulary;
a term and its beginnings that stand in the same examples are one. All other words count
together as one more term, so a long text with one bad word stays far from a short one with
five. Document frequencies are those of all documents. Vectors are TF-IDF,
``(1 + log n) * idf``, of length 1. The neighbours are the ``NEIGHBOURS`` nearest examples by
exact cosine, and all tied with the last. They vote by ``1 / (1 - cosine + SOFT)``; a logistic
curve, fitted to what each example's own neighbours say about it, turns votes into
probabilities.

Only the fit is on a sample: at most ``SAMPLE`` labelled rows, those first by a hash of their
id. Every whole text is read once, where it lies, and leaves its term counts, a few numbers a
document. Document frequencies are a combined sum over these. Documents with equal counts are
one vector; each different vector is scored once, in batches, and its documents get the score
by a join that spreads hot vectors. The examples' own votes, for the curve, are found in tasks.

Defined cases: a null text is empty; a text without words is nearest to examples without words,
or if there are none gets the prior; a document with several labels counts as toxic if one of
them says so; without labels of both kinds all scores are the prior; a null id is scored and not
held out; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from songloom.llm.blockmax import BlockMaxIndex, Vectors, build, by_query
from songloom.llm.common import as_rows, sized, stored, text_of
from songloom.llm.hashing import Stretches
from songloom.llm.terms import BEGINNINGS, RUN_BYTES, Lexicon, lowered, terms_in
from songloom.operators.skew import HOT_ROWS, join_unique

SAMPLE = 10_000
LEAST_CHI = 12.0
LEAST_DOCUMENTS = 3
NEIGHBOURS = 15
SOFT = 0.02
EVIDENCE = 3

COUNTS = "array<int>"
JUDGED = "struct<score:double,evidence:array<struct<doc_id:long,cosine:double,label:int>>>"


@dataclass
class Model:
    lexicon: Lexicon
    idf: np.ndarray  # by number; the last is all other words
    index: BlockMaxIndex
    prior: float
    slope: float = 0.0
    shift: float = 0.0

    def votes(self, row: np.ndarray, entry: np.ndarray, cosine: np.ndarray, own: np.ndarray, own_label: np.ndarray) -> np.ndarray:
        """Share of toxic neighbours by nearness, per query; its own document has no vote."""
        weight = 1 / (1 - np.minimum(cosine, 1.0) + SOFT)
        mine = entry == own[row]
        total = np.bincount(row, weight * (self.index.counts[entry] - mine), len(own))
        toxic = np.bincount(row, weight * (self.index.positives[entry] - mine * own_label[row]), len(own))
        return np.divide(toxic, total, out=np.full(len(own), self.prior), where=total > 0)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * votes + self.shift, -50, 50)))

    def vectors(self, numbers: pa.Array, counts: pa.Array) -> Vectors:
        """TF-IDF vectors of length 1, or without terms."""
        start = np.concatenate([[0], np.cumsum(numbers.value_lengths().to_numpy())])
        held = numbers.flatten().to_numpy()
        weights = (1 + np.log(counts.flatten().to_numpy().astype(float))) * self.idf[held]
        row = np.repeat(np.arange(len(numbers)), np.diff(start))
        return Vectors(start, held, weights / np.sqrt(np.bincount(row, weights * weights, len(numbers)))[row])

    def neighbours(self, queries: Vectors, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, entry and cosine; texts without words are near each other only."""
        row, entry, cosine = self.index.nearest(queries, NEIGHBOURS, own)
        empty = np.diff(queries.start) == 0
        if not empty.any():
            return row, entry, cosine
        some, none = ~empty[row], self.index.wordless
        at = np.repeat(np.flatnonzero(empty), len(none))
        row = np.concatenate([row[some], at])
        entry = np.concatenate([entry[some], np.tile(none, int(empty.sum()))])
        cosine = np.concatenate([cosine[some], np.ones(len(at))])
        order = np.argsort(row, kind="stable")
        return row[order], entry[order], cosine[order]

    def judge(self, numbers: pa.Array, counts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and as evidence id, cosine and label of the nearest examples."""
        queries = self.vectors(numbers, counts)
        row, entry, cosine = self.neighbours(queries)
        none = np.full(len(queries), -1)
        voted = np.bincount(row, minlength=len(queries)) > 0
        scores = np.where(voted, self.calibrated(self.votes(row, entry, cosine, none, none)), self.prior)
        # Nearest first, ties by entry.
        cosine = np.minimum(np.round(cosine, 9), 1.0)
        order = np.lexsort((entry, -cosine, row))
        entry, cosine = entry[order], cosine[order]
        evidence = []
        for first, last in by_query(row, len(queries)):
            last = min(last, first + EVIDENCE)
            seen = [
                {"doc_id": i, "cosine": c, "label": y}
                for e, c in zip(entry[first:last].tolist(), cosine[first:last].tolist()) for i, y in zip(*self.index.examples[e])
            ]
            evidence.append(seen[:EVIDENCE])
        return scores, evidence


def _curve(votes: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method; a little ridge on the slope."""
    a, b = 5.0, -2.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * votes + b, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9) * times
        g = np.array([(times * (y - p) * votes).sum() - 0.01 * a, (times * (y - p)).sum()])
        h = np.array([[(w * votes * votes).sum() + 0.01, (w * votes).sum()], [(w * votes).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents: Counter[str] = Counter()
    positive: Counter[str] = Counter()
    for batch in batches:
        for text, label in zip(lowered(batch.column(0)).to_pylist(), batch.column(1).to_pylist()):
            found = terms_in(text)
            documents.update(found)
            if label:
                positive.update(found)
        # Some hundred documents a task; their terms are summed up by Spark.
    if documents:
        names = list(documents)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([documents[t] for t in names], pa.int64()), pa.array([positive[t] for t in names], pa.int64())],
            ["term", "n", "p"],
        )


def slots(counts: dict[str, tuple[int, int]]) -> dict[str, int]:
    """A number per term; a term and the beginnings of it with equal counts share one.

    A beginning is in every document that its words are in, so with equal counts the
    documents are the same.
    """
    number: dict[str, int] = {}
    used = 0
    for term in sorted(counts):
        # The whole word "tras$" has the beginnings of "tras".
        shorter = [term[:n] for n in range(len(term) - 1, min(BEGINNINGS) - 1, -1)]
        same = next((b for b in shorter if counts.get(b) == counts[term]), None)
        if same is None:
            number[term], used = used, used + 1
        else:
            number[term] = number[same]
    return number


def _chi_squared(n: Column, p: Column, documents: int, positives: int) -> Column:
    """From 2 x 2 counts of term and label."""
    a, b = p.cast("double"), (n - p).cast("double")
    c, d = positives - a, (documents - positives) - b
    bottom = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(bottom > 0, documents * (a * d - b * c) * (a * d - b * c) / bottom).otherwise(0.0)


def _counts(lexicon: Lexicon):
    @F.arrow_udf(f"struct<numbers:{COUNTS},counts:{COUNTS}>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Stretches(RUN_BYTES)
        for texts in batches:
            sizes, numbers, counts = (np.concatenate([*x, np.zeros(0, np.int64)]).astype("int32") for x in zip(([], [], []), *lexicon.counts(texts, hashes)))
            # A vector of one term has length 1 however often the term occurs.
            counts[(np.cumsum(sizes) - 1)[sizes == 1]] = 1
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(x)) for x in (numbers, counts)], ["numbers", "counts"])

    return counted.asNondeterministic()


def counted(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, key, numbers, counts``: the term counts of every whole text, stored; ``key`` is a hash of it."""
    rows = docs.select("doc_id", text_of("text").alias("text"))
    return stored(rows.select("doc_id", F.xxhash64("text").alias("key"), _counts(lexicon)("text").alias("x")).select("doc_id", "key", "x.*"))


def document_frequencies(held: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """How many documents there are, and in how many each number below ``size`` is."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(size + 1, np.int64)
        for batch in batches:
            total += len(batch)
            found += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size + 1)
        at = np.flatnonzero(found[:size])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([total, *found[at].tolist()], pa.int64())], ["at", "n"])

    rows = held.select("numbers").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found = {row.at: row.n for row in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(size)], float)


def _own_votes(model: Model, entries: dict[tuple, int]):
    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, counts, label, times = batch.columns
            keys = zip(map(tuple, numbers.to_pylist()), map(tuple, counts.to_pylist()))
            own = np.array([entries[k] for k in keys])
            queries = model.vectors(numbers, counts)
            found = model.votes(*model.neighbours(queries, own), own, label.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(found), label, times], ["vote", "label", "times"])

    return votes


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    """Fit on rows of ``doc_id, label``; ``docs`` has ``doc_id, text``. Also returns ``counted`` of ``docs``."""
    chosen = (
        labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = stored(
        docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
        # Repeated ids must not exceed the bound either.
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)
        .repartition(16, "doc_id")
    )
    documents, positives = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (positives + 0.5) / (documents + 1)
    if positives in (0, documents):
        lexicon = Lexicon({})
        return Model(lexicon, np.ones(1), build([], 1, [], [], 0), prior, 0.0, float(np.log(prior / (1 - prior)))), counted(docs, lexicon)
    chi = _chi_squared(F.col("n"), F.col("p"), documents, positives)
    best = (
        rows.select("text", "label").mapInArrow(_term_counts, "term string, n long, p long")
        .groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        .where(F.col("n") >= LEAST_DOCUMENTS).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI)
        .collect()
    )
    lexicon = Lexicon(slots({row.term: (row.n, row.p) for row in best}))
    held = counted(docs, lexicon)
    total, frequency = document_frequencies(held, lexicon.size)
    idf = np.array([*(np.log((total + 1) / (frequency + 1)) + 1), 1.0])

    found = (
        rows.select("doc_id", "label", _counts(lexicon)("text").alias("v")).select("doc_id", "label", "v.*")
        .orderBy("doc_id", "numbers", "counts").collect()
    )
    return _fitted(rows.sparkSession, found, Model(lexicon, idf, build([], len(idf), [], [], 0), prior)), held


def _fitted(spark: SparkSession, found: list, model: Model) -> Model:
    """The model with its index of examples and its curve."""
    lists = [pa.array([r[c] for r in found], pa.list_(pa.int32())) for c in ("numbers", "counts")]
    held = model.vectors(*lists)
    cuts = zip(held.start[:-1].tolist(), held.start[1:].tolist())
    vectors = [(held.terms[a:b], held.weights[a:b]) for a, b in cuts]
    labels = [r.label for r in found]
    model.index = build(vectors, len(model.idf), [r.doc_id for r in found], labels, EVIDENCE)
    groups = Counter((tuple(r.numbers), tuple(r.counts), r.label) for r in found)
    entries = {(tuple(r.numbers), tuple(r.counts)): e for r, e in zip(found, model.index.entry_of.tolist())}
    own = spark.createDataFrame([(list(n), list(c), y, t) for (n, c, y), t in groups.items()], f"numbers {COUNTS}, counts {COUNTS}, label int, times int")
    votes = own.repartition(32).mapInArrow(_own_votes(model, entries), "vote double, label int, times int").collect()
    votes.sort()
    model.slope, model.shift = _curve(*(np.array(x, float) for x in zip(*votes)))
    return model


def _judged(model: Model):
    @F.arrow_udf(JUDGED)
    def judged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for numbers, counts in batches:
            scores, evidence = model.judge(numbers, counts)
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["score", "evidence"])

    return judged.asNondeterministic()


def judged(held: DataFrame, model: Model, threshold: float = 0.5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``doc_id, key, score, predicted, evidence`` of every row of ``counted``."""
    # Small to move and slow to score: dealt to as many tasks as there are.
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = held.select("numbers", "counts").distinct().repartition(tasks)
    scores = stored(vectors.withColumn("x", _judged(model)("numbers", "counts")).select("numbers", "counts", "x.*"))
    found = join_unique(held, scores, ["numbers", "counts"], spread="key", hot_rows=hot_rows)
    return found.select("doc_id", "key", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def _key(docs: DataFrame) -> DataFrame:
    """``row, doc_id, key, spread`` of documents."""
    text = text_of(F.col("row.text"))
    return as_rows(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64(text).alias("key"), F.xxhash64("row").alias("spread"))


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Add ``score``, ``predicted`` and ``evidence`` to every row."""
    found = stored(judged(counted(docs, model.lexicon), model, threshold))
    each = found.groupBy("doc_id", "key").agg(F.first(F.struct("score", "predicted", "evidence")).alias("x"))
    joined = join_unique(_key(docs), each, ["doc_id", "key"], "left", spread="spread", null_safe=("doc_id",))
    return joined.select("row.*", "x.*")


def drop_toxic(docs: DataFrame, model: Model, held: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns; ``held`` is ``counted`` of them."""
    found = judged(counted(docs, model.lexicon) if held is None else held, model, threshold)
    rejected = sized(stored(found.where("predicted = 1").select("doc_id", "key").distinct()))
    return join_unique(_key(docs), rejected, ["doc_id", "key"], "left_anti", spread="spread", null_safe=("doc_id",)).select("row.*")
