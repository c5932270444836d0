"""Read-only SQLite tables as a Spark data source (format ``braid_sqlite``).

Options: ``path``, ``table``, ``partitions`` (by rowid range). A missing file reads as
an empty table of the given schema. The file must be readable where tasks run.

Comparisons of a column with values are part of the statement that SQLite runs, which can
use its indexes for them, and ranges are those of the rows that they let in; Spark
checks them once more. ``register`` turns this on for the session.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from braidgraph.operators.hits import hydrate

#: Values of a list that are looked up one by one, as bound variables of a statement.
MOST_VALUES = 500
_PLAIN = (str, int, float, bytes)
_KINDS = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _name(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "braid_sqlite"

    def schema(self) -> str:
        with _open(self.options["path"]) as con:
            cols = con.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        return ", ".join(f"`{c[1]}` {_KINDS.get(c[2].upper(), 'string')}" for c in cols)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 1))
        self.names = schema.fieldNames()
        self.conditions: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in self.names:
                # bytes are compared, whatever collation the column has
                column = f"{_name(f.attribute[0])} COLLATE BINARY"
                if isinstance(f, IsNull | IsNotNull):
                    self.conditions.append(f"{_name(f.attribute[0])} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
                elif isinstance(f, In) and len(f.value) <= MOST_VALUES and all(isinstance(v, _PLAIN) for v in f.value):
                    self.conditions.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                    self.values += f.value
                elif type(f) in signs and isinstance(f.value, _PLAIN):
                    self.conditions.append(f"{column} {signs[type(f)]} ?")
                    self.values.append(f.value)
            yield f

    def statement(self, columns: str, *more: str) -> str:
        where = " AND ".join([*self.conditions, *more])
        return f"SELECT {columns} FROM {_name(self.table)}" + (f" WHERE {where}" if where else "")

    def partitions(self) -> list[InputPartition]:
        if not os.path.exists(self.path):
            return []
        with _open(self.path) as con:
            lo, hi = con.execute(self.statement("min(rowid), max(rowid)"), self.values).fetchone()
        if lo is None:
            return []
        step = -(-(hi - lo + 1) // self.parts)
        return [_Range(s, min(hi, s + step - 1)) for s in range(lo, hi + 1, step)]

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # no partitions
            return
        cols = ", ".join(map(_name, self.names))
        with _open(self.path) as con:
            yield from con.execute(self.statement(cols, "rowid BETWEEN ? AND ?"), (*self.values, partition.first, partition.last))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def rows_of(spark: SparkSession, path: str, table: str, key: str, wanted: DataFrame, partitions: int = 1) -> DataFrame:
    """The rows of a table whose ``key`` is among ``wanted`` (one column): up to ``MOST_VALUES`` keys are
    looked up in the file, more of them joined with all of it."""
    register(spark)
    rows = spark.read.format(SqliteSource.name()).option("path", path).option("table", table).option("partitions", partitions).load()
    asked = wanted.toDF(key).where(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in asked.limit(MOST_VALUES + 1).collect()]
    return rows.where(F.col(key).isin(few)) if len(few) <= MOST_VALUES else rows.join(asked, key, "left_semi")


def attach_content(hits: DataFrame, stores: dict[str, str], table: str = "nodes", text: str = "docstring") -> DataFrame:
    """Hits with ``content`` from their stores' files (kg_name to path), as ``hits.hydrate`` attaches it; of each
    file only the rows that hits name are read."""
    out = None
    for name, path in sorted(stores.items()):
        own = rows_of(hits.sparkSession, path, table, "id", hits.where(F.col("kg_name") == name).select("node_id"))
        own = own.select(F.lit(name).alias("kg_name"), "id", F.col(text).alias("text"))
        out = own if out is None else out.unionByName(own)
    named = hits.sparkSession.createDataFrame([(n, None, None) for n in sorted(stores)], "kg_name string, id string, text string")
    return hydrate(hits, named if out is None else out.unionByName(named))
