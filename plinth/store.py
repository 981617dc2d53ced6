"""The domain's tables in a folder: each write is a new version, which a small file puts in force.

The file of version N is ``current-N`` and names the folders that hold its rows. It
appears under its name in one step, after the rows are written, and is never changed;
the highest number counts. So a job that fails at any point leaves the old version in
force, readers never see half a table, and of two writers at once one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.schemas import COLUMNS, ddl


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, table: str) -> list[int]:
        at = self._path(f"{self.root}/{table}")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[8:]) for n in names if n.startswith("current-") and n[8:].isdigit())

    def version(self, table: str) -> int:
        """The version in force; 0 before the first write."""
        return max(self._numbers(table), default=0)

    def _folders(self, table: str, n: int) -> list[str]:
        """The folders of version n."""
        if not n:
            return []
        text = self.spark.read.text(f"{self.root}/{table}/current-{n}", wholetext=True).first().value
        return [f"{self.root}/{table}/{name}" for name in json.loads(text)]

    def read(self, table: str) -> DataFrame:
        """A table with all the columns of its schema; empty before the first write."""
        folders = self._folders(table, self.version(table))
        return self.spark.read.schema(ddl(table)).parquet(*folders) if folders else self.spark.createDataFrame([], ddl(table))

    def _rows(self, table: str, df: DataFrame) -> str:
        """Write rows to a folder of their own, which no version names yet."""
        if table not in COLUMNS:
            raise ValueError(f"unknown table {table!r}")
        want = self.spark.createDataFrame([], ddl(table)).schema
        have, name = set(df.columns), f"rows-{uuid.uuid4().hex}"
        df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]).write.parquet(f"{self.root}/{table}/{name}")
        return name

    def _put_in_force(self, table: str, n: int, names: list[str]) -> None:
        fresh, at = self._path(f"{self.root}/{table}/new-{uuid.uuid4().hex}"), self._path(f"{self.root}/{table}/current-{n}")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps(names).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(fresh, at):
            self._fs.delete(fresh, False)
            raise RuntimeError(f"another job wrote version {n} of {table}")

    def write(self, table: str, df: DataFrame) -> None:
        """Put ``df`` in force; columns that it lacks are null, others are left out."""
        n = self.version(table)
        self._put_in_force(table, n + 1, [self._rows(table, df)])

    def append(self, table: str, df: DataFrame) -> None:
        """Put the table with more rows in force; only these are written."""
        n = self.version(table)
        old = [f.rpartition("/")[2] for f in self._folders(table, n)]
        self._put_in_force(table, n + 1, [*old, self._rows(table, df)])

    def vacuum(self, table: str) -> None:
        """Remove all that the version in force doesn't name. No other job may write the table meanwhile."""
        n = self.version(table)
        keep = {f"current-{n}", *[f.rpartition("/")[2] for f in self._folders(table, n)]}
        for f in self._fs.listStatus(self._path(f"{self.root}/{table}")) if n else []:
            if f.getPath().getName() not in keep:
                self._fs.delete(f.getPath(), True)
