"""A table of an SQLite file as a read-only data source, split by ranges of row ids.

``register(spark)`` names the source ``sqlite_table``. The file must lie where all executors can open it. It is
opened read-only, so a catalog that something else writes is never locked or changed; each task sees it as it is when it
opens it. What can't be read is no error unless asked for: the catalog is foreign, and nothing is then known of it.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ROWS = 4096
AFFINITY = (("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    """The file at a path or a ``file:`` URI, read-only."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if not os.path.exists(plain):
        raise sqlite3.OperationalError(f"there is no file {plain}")
    return sqlite3.connect(f"file:{plain.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def fitting(kind: str):
    """What a column of a type takes of a value of any type, as a cell may hold any: null where it doesn't fit."""
    if kind == "binary":
        return lambda v: v if v is None or isinstance(v, bytes) else os.fsencode(str(v))
    if kind == "string":
        return lambda v: v.decode(errors="replace") if isinstance(v, bytes) else None if v is None else str(v)
    if kind in ("double", "float"):
        return lambda v: float(v) if isinstance(v, (int, float)) else None
    size = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}.get(kind)
    if size is None:
        raise ValueError(f"no column of an SQLite table can be read as {kind}")
    return lambda v: v if isinstance(v, int) and -(1 << size) <= v < 1 << size else None


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high  # both included; None: the whole table, or nothing at all if both are 0 and -1


class TableReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table = options.get("path", ""), options.get("table", "")
        self.splits, self.strict = int(options.get("partitions", 8)), options.get("strict", "false").lower() == "true"
        self.schema = schema

    def partitions(self) -> list[Range]:
        try:
            db = opened(self.path)
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                db.execute(f"SELECT 1 FROM {quoted(self.table)} LIMIT 1")
                return [Range(None, None)]  # a table without row ids
            finally:
                db.close()
        except sqlite3.Error:
            if self.strict:
                raise
            return [Range(0, -1)]
        if low is None:
            return [Range(0, -1)]
        n = max(1, min(self.splits, high - low + 1))
        cuts = [low + (high - low + 1) * i // n for i in range(n + 1)]
        return [Range(a, b - 1) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.low == 0 and partition.high == -1:
            return
        shape, takes = to_arrow_schema(self.schema), [fitting(f.dataType.simpleString()) for f in self.schema]
        columns = ", ".join(f"t.{quoted(c)}" for c in self.schema.names)  # a bare name that is no column would be a text
        where = "" if partition.low is None else " WHERE rowid BETWEEN ? AND ?"
        try:
            db = opened(self.path)
            try:
                found = db.execute(f"SELECT {columns} FROM {quoted(self.table)} AS t{where}", () if partition.low is None else (partition.low, partition.high))
                while rows := found.fetchmany(ROWS):
                    arrays = [pa.array([take(r[i]) for r in rows], f.type) for i, (f, take) in enumerate(zip(shape, takes))]
                    yield pa.RecordBatch.from_arrays(arrays, schema=shape)
            finally:
                db.close()
        except sqlite3.Error:
            if self.strict:
                raise


class SqliteTable(DataSource):
    """Options: ``path``, ``table``, ``partitions``, ``strict`` (errors are raised). Without a schema, that of the table."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        db = opened(self.options.get("path", ""))
        try:
            columns = db.execute(f"PRAGMA table_info({quoted(self.options.get('table', ''))})").fetchall()
        finally:
            db.close()
        if not columns:
            raise ValueError(f"there is no table {self.options.get('table')!r}")
        kind = lambda declared: next((k for part, k in AFFINITY if part in declared.upper()), "binary" if not declared else "double")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in columns)

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteTable)


def foreign_items(spark: SparkSession, path: str, table: str = "items", partitions: int = 8) -> DataFrame:
    """(path, item_id) of a foreign catalog's items; paths as bytes, rows without one left out. Empty where it can't be
    read: no file, no database, no such table or column."""
    register(spark)
    rows = spark.read.format("sqlite_table").schema("id long, path binary").options(path=path, table=table, partitions=partitions).load()
    return rows.where(F.octet_length("path") > 0).select("path", F.col("id").alias("item_id"))
