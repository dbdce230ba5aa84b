"""Tables that change by commits: append, replace a group, full refresh.

Parquet folders and a log, nothing else. Each commit writes its rows to a
folder of its own and then one record to the log; a version is what the log
holds up to a number, so old versions stay readable, a commit that fails midway
leaves no trace in any version, and no commit rewrites the rows that are there.
A replacing commit also writes the keys it replaces, one row each; a reader
takes a row if no later commit replaces its key. ``refresh`` starts anew, which
also compacts.

A commit can carry a batch number: a number that the log already holds is
passed over, so a restarted stream applies no batch twice. There is one writer
at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadence.session import join_path

LOG = "version int, kind string, folder string, columns string, keys array<string>, batch long"


class Table:
    """A table at ``path``, a folder that the driver and all executors share.
    ``partition_by``: columns that its files are laid out by."""

    def __init__(self, spark: SparkSession, path: str, partition_by: list[str] | None = None) -> None:
        self.spark, self.path, self.partition_by = spark, path, partition_by or []

    @classmethod
    def create(cls, first: DataFrame, path: str, partition_by: list[str] | None = None) -> Table:
        """A new table whose version 0 has the rows of ``first``."""
        table = cls(first.sparkSession, path, partition_by)
        table._commit(0, "refresh", first, [], None, None)
        return table

    def log(self) -> list:
        """The commits in order: a row each."""
        return self.spark.read.schema(LOG).json(join_path(self.path, "log", "*")).orderBy("version").collect()

    def version(self) -> int:
        return self.log()[-1]["version"]

    def append(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Adds rows; False if the log has the batch already."""
        return self._next("append", rows, [], None, batch)

    def replace(self, rows: DataFrame, keys: list[str], groups: DataFrame | None = None, batch: int | None = None) -> bool:
        """Puts ``rows`` in the place of all rows with the same ``keys``; of
        ``groups`` instead, if given, which may name keys without new rows
        (these are deleted). False if the log has the batch already."""
        return self._next("replace", rows, keys, groups, batch)

    def refresh(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Puts ``rows`` in the place of everything."""
        return self._next("refresh", rows, [], None, batch)

    def compact(self) -> None:
        """Writes the live rows as one commit."""
        self.refresh(self.read())

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one, if none is given)."""
        log = [c for c in self.log() if version is None or c["version"] <= version]
        if not log or version is not None and log[-1]["version"] < version:
            raise ValueError(f"no version {version} of {self.path}")
        last = max(i for i, c in enumerate(log) if c["kind"] == "refresh")
        rows = None
        for commit in log[last:]:
            kept = rows
            if commit["kind"] == "replace":
                gone = self.spark.read.parquet(join_path(self.path, "keys", commit["folder"]))
                same = [F.col(f"t.{k}").eqNullSafe(F.col(f"g.{k}")) for k in commit["keys"]]
                kept = rows.alias("t").join(gone.alias("g"), same, "left_anti")
            own = self._rows(commit["folder"], commit["columns"])
            rows = own if kept is None else kept.unionByName(own.select(*kept.columns))
        return rows

    def _rows(self, folder: str, columns: str) -> DataFrame:
        # a partitioned folder without rows has no file to tell its columns
        schema = StructType.fromJson(json.loads(columns))
        return self.spark.read.schema(schema).parquet(join_path(self.path, "data", folder)).select(*schema.names)

    def _next(self, kind: str, rows: DataFrame, keys: list[str], groups: DataFrame | None, batch: int | None) -> bool:
        log = self.log()
        if batch is not None and any(c["batch"] == batch for c in log):
            return False
        self._commit(log[-1]["version"] + 1, kind, rows, keys, groups, batch)
        return True

    def _commit(self, version: int, kind: str, rows: DataFrame, keys: list[str], groups: DataFrame | None, batch: int | None) -> None:
        folder, columns = uuid.uuid4().hex, rows.schema.json()
        data = join_path(self.path, "data", folder)
        writer = rows.write.partitionBy(*self.partition_by) if self.partition_by else rows.write
        writer.parquet(data)
        if kind == "replace":
            # of the rows as written, so a source that changes is read once
            named = groups if groups is not None else self._rows(folder, columns)
            named.select(*keys).distinct().write.parquet(join_path(self.path, "keys", folder))
        record = self.spark.createDataFrame([(version, kind, folder, columns, keys, batch)], LOG)
        # fails if another writer has made this version
        record.coalesce(1).write.mode("errorifexists").json(join_path(self.path, "log", f"v{version:09d}"))


def merge_stream(stream: DataFrame, table: Table, keys: list[str], order: list, checkpoint: str) -> None:
    """Drains a stream into ``table``: of each micro-batch the last row of a
    key by ``order`` (descending) takes the place of the table's row, unless
    that one comes later itself. The stream's checkpoint and the table's log
    number the batches alike, so a batch that was applied before a restart is
    passed over."""
    from cadence.operators.merge import _dedupe

    def apply(batch: DataFrame, number: int) -> None:
        if any(c["batch"] == number for c in table.log()):
            return
        fresh = batch.select(*keys).distinct()
        stored = table.read().join(fresh, keys, "left_semi")
        table.replace(_dedupe(stored.unionByName(batch.select(*stored.columns)), keys, order), keys, batch=number)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
