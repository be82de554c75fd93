"""A stored table in buckets of its key: a save rewrites what it touches, a lookup reads one.

A row lies in the bucket ``crc32(key) mod BUCKETS``, a part of the table in the store. Saving
rows reads and replaces the buckets that they fall into, in one job, and commits all of them at
once; rows with new keys only are added as folders without reading. Every folder leaves its
counts in a small table when it is written, so totals are sums over folders, not over rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from songloom.operators.scratch import kept
from songloom.operators.upsert import upsert
from songloom.sources.tables import TableStore

BUCKETS = 64
# A bucket with more rows is written by several tasks.
TASK_ROWS = 1_000_000
COUNTED = "path string, counts map<string,bigint>"


def bucket_of(key: str) -> int:
    return zlib.crc32(key.encode()) % BUCKETS


def _bucket(key: str) -> Column:
    return (F.crc32(F.coalesce(F.col(key), F.lit(""))) % BUCKETS).cast("int")


@dataclass(frozen=True)
class BucketedTable:
    """``counts`` are aggregates of rows that add up, as SQL, by name."""

    tables: TableStore
    name: str
    schema: str
    counts: Mapping[str, str]
    key: str = "key"

    def read(self) -> DataFrame:
        return self.tables.read_parts(self.name, self.schema)

    def read_key(self, key: str) -> DataFrame:
        """The row of one key, from its bucket; the filter reaches the files."""
        held = self.tables.read(self.name, self.schema, self._part(bucket_of(key)))
        return held.where(F.col(self.key) == key)

    def save(self, rows: DataFrame, new_keys: bool = False) -> int:
        """Put rows, one per key, in place of those with the same key; returns how many buckets changed.

        With ``new_keys`` the table has none of the keys yet.
        """
        columns = self.tables.spark.createDataFrame([], self.schema).columns
        rows = kept(rows.select(*columns, _bucket(self.key).alias("_bucket")))
        per_bucket = {r._bucket: r.n for r in rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not per_bucket:
            return 0
        held = {r.part: r for r in self.tables.entries(self.name)}
        if not new_keys:
            paths = [p for b in per_bucket if (r := held.get(self._part(b))) for p in r.paths]
            if paths:
                before = self.tables.spark.read.schema(self.schema).parquet(*paths)
                rows = upsert(before.withColumn("_bucket", _bucket(self.key)), rows, [self.key])
        most = max(n + (held[self._part(b)].n if self._part(b) in held else 0) for b, n in per_bucket.items())
        salt = F.pmod(F.xxhash64(self.key), F.lit(-(-most // TASK_ROWS)))
        path = self.tables.fresh(self.name)
        placed = rows.repartition(F.col("_bucket"), salt).sortWithinPartitions("_bucket", self.key)
        placed.write.partitionBy("_bucket").parquet(path)
        counted = self._count(path)
        self.tables.commit_parts(
            self.name, {self._part(b): (folder, n) for b, (folder, n) in counted.items()}, append=new_keys
        )
        return len(counted)

    def _count(self, path: str) -> dict[int, tuple[str, int]]:
        """Count what was written to each bucket's folder, and keep the counts."""
        written = self.tables.spark.read.schema(f"{self.schema}, _bucket int").parquet(path)
        pairs = [x for name, value in self.counts.items() for x in (F.lit(name), F.expr(value).cast("bigint"))]
        rows = written.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.create_map(*pairs).alias("counts")).collect()
        folders = {r._bucket: (f"{path}/_bucket={r._bucket}", r.n) for r in rows}
        kept_ = self.tables.spark.createDataFrame([(folders[r._bucket][0], r.counts) for r in rows], COUNTED)
        kept_.coalesce(1).write.mode("append").parquet(f"{self.tables.root}/_counts/{self.name}")
        return folders

    def totals(self) -> DataFrame:
        """One row with all counts, from those of the current folders; no row of the table is read."""
        none = F.lit(0).cast("bigint")
        entries = self.tables.entries(self.name)
        paths = [(p,) for r in entries for p in r.paths]
        if not paths:
            return self.tables.spark.range(1).select(*[none.alias(c) for c in self.counts])
        current = self.tables.spark.createDataFrame(paths, "path string")
        counted = self.tables.spark.read.schema(COUNTED).parquet(f"{self.tables.root}/_counts/{self.name}")
        held = counted.join(F.broadcast(current), "path", "left_semi")
        return held.agg(*[F.coalesce(F.sum(F.col("counts")[c]), none).alias(c) for c in self.counts])

    def clear(self) -> int:
        """Empty all buckets; returns how many rows there were."""
        entries = self.tables.entries(self.name)
        self.tables.commit_parts(self.name, {r.part: (None, 0) for r in entries if r.n}, append=False)
        return sum(r.n for r in entries)

    @staticmethod
    def _part(bucket: int) -> str:
        return f"{bucket:03d}"
