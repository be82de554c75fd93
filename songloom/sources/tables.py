"""Snapshot tables on plain Parquet.

A table is a list of folders named by a manifest. Publishing writes a new folder and then
appends one manifest row, which is the commit: a reader sees the old or the new snapshot
as a whole, and no path is ever read and overwritten. A snapshot replaces the folders
before it or, where only new rows come in, adds one to them. One writer per table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

from songloom import schemas


@dataclass(frozen=True)
class TableStore:
    spark: SparkSession
    root: str

    def manifest(self) -> DataFrame:
        """All published snapshots."""
        try:
            return self.spark.read.schema(schemas.MANIFEST).parquet(f"{self.root}/_manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schemas.MANIFEST)

    def current(self) -> DataFrame:
        """The newest snapshot of every table part; one manifest row each."""
        columns = [c for c in self.manifest().columns if c not in ("name", "part")]
        newest = F.max(F.struct("snapshot", *[c for c in columns if c != "snapshot"]))
        return (
            self.manifest().groupBy("name", "part").agg(newest.alias("m"))
            .select("name", "part", "m.*")
        )

    def entry(self, name: str, part: str = "") -> Row | None:
        """Manifest row of the newest snapshot, None if never published."""
        mine = self.manifest().where((F.col("name") == name) & (F.col("part") == part))
        return mine.orderBy(F.desc("snapshot")).first()

    def read(self, name: str, schema: str | StructType, part: str = "") -> DataFrame:
        """The newest snapshot, an empty table if there is none."""
        entry = self.entry(name, part)
        if entry is None or not entry.paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*entry.paths)

    def entries(self, name: str) -> list[Row]:
        """Manifest rows of the newest snapshots of all parts of a table."""
        return self.current().where(F.col("name") == name).collect()

    def read_parts(self, name: str, schema: str) -> DataFrame:
        """The newest snapshots of all parts together."""
        paths = [path for row in self.entries(name) for path in row.paths]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def publish(self, df: DataFrame, name: str, part: str = "", append: bool = False) -> Row:
        """Write ``df`` as the next snapshot and make it the current one.

        With ``append`` the rows join those of the snapshot before; nothing of that is
        written again.
        """
        last = self.entry(name, part)
        snapshot = 1 if last is None else last.snapshot + 1
        folder = f"{self.root}/{name}" + (f"/part={part}" if part else "")
        # A folder per attempt: what a failed write leaves behind is in no one's way.
        path = f"{folder}/snapshot={snapshot:08d}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        # The count comes from the Parquet footers of what was really written.
        n = self.spark.read.schema(df.schema).parquet(path).count()
        return self._commit(name, part, [path], n, append)

    def fresh(self, name: str) -> str:
        """A folder for an attempt to write something that ``commit_parts`` will name."""
        return f"{self.root}/{name}/snapshot=parts-{uuid.uuid4().hex}"

    def commit_parts(self, name: str, parts: dict[str, tuple[str | None, int]], append: bool) -> None:
        """Make one folder each (or none), with its count, the newest snapshot of several parts at once."""
        if not parts:
            return
        last = {row.part: row for row in self.entries(name)}
        now, rows = datetime.now(timezone.utc), []
        for part, (path, n) in parts.items():
            before = last.get(part)
            paths = [] if path is None else [path]
            if append and before is not None:
                paths, n = [*before.paths, *paths], before.n + n
            rows.append((name, part, 1 if before is None else before.snapshot + 1, paths, now, n))
        commit = self.spark.createDataFrame(rows, schemas.MANIFEST)
        commit.coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")

    def attach(self, stored: Row, name: str, part: str = "") -> Row:
        """Add a published folder to another table of the same columns; nothing is copied."""
        return self._commit(name, part, stored.paths, stored.n, append=True)

    def _commit(self, name: str, part: str, paths: list[str], n: int, append: bool) -> Row:
        last = self.entry(name, part)
        snapshot = 1 if last is None else last.snapshot + 1
        if append and last is not None:
            paths, n = [*last.paths, *paths], last.n + n
        row = (name, part, snapshot, paths, datetime.now(timezone.utc), n)
        commit = self.spark.createDataFrame([row], schemas.MANIFEST)
        commit.coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")
        return self.entry(name, part)

    def vacuum(self) -> int:
        """Delete the folders that no current snapshot names; returns how many went.

        Readers of older snapshots, and a write under way, must have ended.
        """
        named = {path for row in self.current().collect() for path in row.paths}
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.root)
        files = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        # Parts that were written together lie below one folder.
        named |= {path.rpartition("/")[0] for path in named if "/snapshot=parts-" in path}
        kept = {files.makeQualified(jvm.org.apache.hadoop.fs.Path(path)).toString() for path in named}
        gone = 0
        for pattern in ("*/snapshot=*", "*/part=*/snapshot=*"):
            for found in files.globStatus(jvm.org.apache.hadoop.fs.Path(base, pattern)) or []:
                if found.getPath().toString() not in kept:
                    files.delete(found.getPath(), True)
                    gone += 1
        return gone

    def compact(self, name: str, schema: str, part: str = "") -> Row:
        """Write the folders of a table as one."""
        return self.publish(self.read(name, schema, part), name, part)

    def clear(self, name: str, schema: str, part: str = "") -> int:
        """Publish an empty snapshot; returns how many rows the table had."""
        last = self.entry(name, part)
        if last is None or last.n == 0:
            return 0
        self.publish(self.spark.createDataFrame([], schema), name, part)
        return last.n
