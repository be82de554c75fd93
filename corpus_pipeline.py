"""From documents to packed sequences: the stages in order, each stored before the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from songloom.llm import exact, mixing, near, packing, toxicity
from songloom.llm.common import stored
from songloom.llm.queries import WEIGHTS, tokenizer_file, toxicity_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Texts reach Python in batches of so many bytes; a longer text is a batch of its own. The
#: stages share their workers, and what a batch once took, in a worker or in the buffers of the
#: JVM beside it, stays taken.
BATCH_BYTES = 4 << 20


def in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # What the stage returns is computed later, so the setting stays.
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    model, counted = toxicity_model(spark, docs, sf_dir)
    return toxicity.drop_toxic(docs, model, counted)


@in_small_batches
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays."""
    return exact.drop_copies(docs)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts, the one with the smallest id stays."""
    return near.drop_near_copies(docs)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the given weights: each document comes as often as the mix takes it."""
    return mixing.mixed(docs, WEIGHTS)


@in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the tokens of each document, and of each of its copies, lie in sequences."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Nearest neighbours, sketches and tokens are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
