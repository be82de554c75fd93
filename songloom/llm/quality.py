"""Quality scores of documents: boosted trees over statistics of the whole text.

Only the fit is on a sample: at most ``SAMPLE`` labelled rows, those first by a hash of
their id; their statistics (a few numbers a row) come to the driver. Every document is then
scored where it lies, so nothing is shuffled and no key or group can be hot.

Defined cases: a null text is empty, and empty texts are scored like others; a document
with several labels counts by the lowest; without labels of both kinds all scores are the
prior; a null id is scored and not held out; repeated rows get equal scores; an empty table
gives an empty result; no column besides the text reaches a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from songloom.llm.common import text_of
from songloom.llm.trees import Forest, fit

SAMPLE = 50_000
FEATURES = (
    "words", "word_length", "word_length_spread", "distinct_words", "commonest_word", "short_words",
    "repeated_triples", "lines", "line_words", "repeated_lines", "upper", "digits", "symbols",
    "exclamation", "bars", "stops", "quotes_brackets", "spaces", "entropy", "marked_words", "capital_words",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>@^~=_\\", np.uint8)
_BRACKETS = np.frombuffer(b"\"'()[]{}", np.uint8)


def statistics(text: str) -> list[float]:
    """The statistics of one text; shares are of its words, letters or lines."""
    data = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(data, minlength=256)
    size = max(len(data), 1)
    letters = max(count[65:91].sum() + count[97:123].sum() + count[128:].sum() / 2, 1)
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    triples = max(len(words) - 2, 1)
    share = count[count > 0] / size
    return [
        np.log1p(len(words)), lengths.mean(), lengths.std(), len(seen) / n,
        max(seen.values(), default=0) / n, (lengths <= 3).mean(),
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if len(words) > 2 else 0.0,
        np.log1p(len(lines)), len(words) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        count[65:91].sum() / letters, count[48:58].sum() / size, count[_SYMBOLS].sum() / n,
        count[33] / n, count[124] / n, count[46] / n, count[_BRACKETS].sum() / n,
        (count[32] + count[9:14].sum()) / size, float(-(share * np.log2(share)).sum()),
        sum(not w[-1].isalnum() for w in words) / n, sum(w[0].isupper() for w in words) / n,
    ]


def _statistics(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t or "") for t in texts.to_pylist()]
    return np.array(rows, float).reshape(-1, len(FEATURES))


def features(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = _statistics(texts)
            at = pa.array(np.arange(len(values) + 1, dtype="int32") * len(FEATURES))
            yield pa.ListArray.from_arrays(at, pa.array(values.ravel()))

    return run(text)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on rows of ``doc_id, label``; ``docs`` has ``doc_id, text``."""
    chosen = (
        labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = (
        docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "label", features(F.col("text")).alias("x"))
        # Repeated ids must not exceed the bound either.
        .orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample)
    ).toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["label"].to_numpy(float))


def scored(text: Column, forest: Forest) -> Column:
    """Score of each text, 0 to 1."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(forest.scores(_statistics(texts)))

    return run.asNondeterministic()(text)


def in_fold(modulus: int, remainder: int, id: str = "doc_id") -> Column:
    """Whether ``crc32`` of the id as text leaves the remainder; not so for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % modulus == remainder, F.lit(False))


def quality_scores(docs: DataFrame, forest: Forest, threshold: float = 0.7) -> DataFrame:
    """Add ``score`` and ``predicted`` to every row."""
    return docs.withColumn("score", scored(text_of("text"), forest)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
