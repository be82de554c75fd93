"""Text encoders, chosen by model name: ``encode(df, text)`` adds a unit vector.

The model name is a column of the index and a condition of every search, so vectors of
different models never meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from songloom.functions.text import words
from songloom.functions.vectors import norm

# Fixed value: the model used where none is named.
DEFAULT_MODEL = "all-MiniLM-L6-v2"


class Encoder(Protocol):
    model: str

    def embedding(self, text: Column) -> Column: ...


def encode(df: DataFrame, encoder: Encoder, text: str = "document") -> DataFrame:
    """Add ``model``, ``embedding`` and ``norm``. Works row by row, nothing is shuffled."""
    vector = encoder.embedding(F.col(text))
    return (
        df.withColumn("model", F.lit(encoder.model))
        .withColumn("embedding", vector)
        .withColumn("norm", norm(F.col("embedding")))
    )


def word_bucket(word: str, dim: int) -> int:
    """The bucket of a word, from the first 32 bits of its MD5."""
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


@dataclass(frozen=True)
class HashingEncoder:
    """Counts of word buckets, scaled to length 1. Deterministic, needs no model."""

    dim: int = 64

    @property
    def model(self) -> str:
        return f"hashing-{self.dim}"

    def embedding(self, text: Column) -> Column:
        return _unit_counts(self.dim)(words(text))


def _unit_counts(dim: int):
    @F.arrow_udf("array<float>")
    def unit_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            n = len(lists)
            # Each different word of the batch is hashed once.
            held = lists.flatten().dictionary_encode()
            by_word = [word_bucket(w, dim) for w in held.dictionary.to_pylist()]
            buckets = np.array(by_word, dtype="int64")[held.indices.to_numpy()]
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cells = np.repeat(np.arange(n), lengths) * dim + buckets
            counts = np.bincount(cells, minlength=n * dim).reshape(n, dim).astype("float64")
            lengths = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit = np.divide(counts, lengths, out=np.zeros_like(counts), where=lengths > 0)
            values = pa.array(unit.astype("float32").ravel())
            offsets = pa.array(np.arange(n + 1, dtype="int32") * dim)
            yield pa.ListArray.from_arrays(offsets, values)

    return unit_counts


@dataclass(frozen=True)
class ModelEncoder:
    """A neural text model. ``load`` is called once per Python task.

    It returns a function from a list of texts to a 2-d array; without ``load`` the
    optional ``sentence_transformers`` package provides the named model.
    """

    model: str = DEFAULT_MODEL
    load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None

    def embedding(self, text: Column) -> Column:
        load = self.load or _sentence_model(self.model)

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = load()
            for texts in batches:
                rows = np.asarray(run(texts.fillna("").tolist()), dtype="float32")
                yield pd.Series(list(rows))

        # So marked, Spark never copies the call into a filter and runs the model twice.
        return vectors.asNondeterministic()(text)


def _sentence_model(name: str):
    def load():
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(name).encode

    return load


def encoder_for(model: str = DEFAULT_MODEL) -> Encoder:
    """Encoder by model name; ``hashing-<dim>`` needs no model."""
    kind, _, dim = model.partition("-")
    if kind == "hashing" and dim.isdigit():
        return HashingEncoder(int(dim))
    return ModelEncoder(model)
