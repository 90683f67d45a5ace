"""SQLite files as a Spark data source: one partition per rowid range.

The file must be reachable under the same path on every executor. Register once with
``spark.dataSource.register(SqliteSource)``, then
``spark.read.format("sqlite").option("path", p).option("table", t).load()``.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = [("INT", "bigint"), ("CHAR", "string"), ("TEXT", "string"), ("CLOB", "string"),
          ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("NUM", "double")]


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _spark_type(declared: str) -> str:
    declared = (declared or "").upper()
    return next((kind for mark, kind in _KINDS if mark in declared), "string")


class RowidRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _columns(self) -> list[tuple[str, str]]:
        with _open(self.options["path"]) as con:
            rows = con.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        return [(r[1], _spark_type(r[2])) for r in rows]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, self._columns())


class SqliteReader(DataSourceReader):
    def __init__(self, options, columns):
        self.path, self.table = options["path"], options["table"]
        self.parts = int(options.get("numpartitions", options.get("numPartitions", 8)))
        self.columns = columns

    def partitions(self) -> list[RowidRange]:
        with _open(self.path) as con:
            low, high = con.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowidRange(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [RowidRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: RowidRange) -> Iterator[tuple]:
        casts = {"bigint": int, "double": float, "string": str}
        makers = [casts[t] for _, t in self.columns]
        names = ", ".join(_quoted(n) for n, _ in self.columns)
        con = _open(self.path)
        try:
            rows = con.execute(
                f"select {names} from {_quoted(self.table)} where rowid >= ? and rowid < ?",
                (partition.low, partition.high),
            )
            for row in rows:
                yield tuple(None if v is None else make(v) for v, make in zip(row, makers))
        finally:
            con.close()


def load_sqlite(spark: SparkSession, path: str, partitions: int = 8) -> dict[str, DataFrame]:
    """Every table of a SQLite file, each read in rowid ranges."""
    spark.dataSource.register(SqliteSource)
    with _open(path) as con:
        names = [r[0] for r in con.execute("select name from sqlite_master where type = 'table' order by name")]
    return {
        n: spark.read.format("sqlite").option("path", path).option("table", n).option("numPartitions", partitions).load()
        for n in names
        if not n.startswith("sqlite_")
    }
