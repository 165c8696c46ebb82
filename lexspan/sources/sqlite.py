"""A read-only SQLite source: spark.read.format("sqlite_table"), for databases on a path that every executor sees.

Options: path (a database, or a folder of *.db that all have the table), table, columns (comma-separated; all by default),
equals (JSON, column to value, evaluated by SQLite), pushdown (true: filters above the scan go into SQLite's query), partitions.
Rows are split by ranks of their rowid.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not,
)
from pyspark.sql.types import StructType

from lexspan.plans.runtime import ship

_TYPES = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def connect(path: str) -> sqlite3.Connection:
    """A read-only connection; the file must exist."""
    p = Path(path).resolve()
    if not p.is_file():
        raise FileNotFoundError(p)
    return sqlite3.connect(f"{p.as_uri()}?mode=ro", uri=True)


def _name(value: str) -> str:
    return '"' + value.replace('"', '""') + '"'


@dataclass
class RowRange(InputPartition):
    """Rows of one database file; without bounds the whole table."""

    file: str
    low: int | None = None
    high: int | None = None


def database_files(path: str) -> list[str]:
    """The file itself, or the *.db files of a folder: a table may be dealt to several databases."""
    p = Path(path.removeprefix("file://"))
    return sorted(map(str, p.glob("*.db"))) if p.is_dir() else [str(p)]


class SqliteReader(DataSourceReader):
    """SQLite evaluates the option `equals`; partitions have about equal numbers of the rows that pass it."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, dict(options)
        self.kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        given = json.loads(self.options.get("equals", "{}"))
        self.where = [f"{_name(c)} COLLATE BINARY = ?" for c in given]
        self.values: list = list(given.values())

    def _query(self, what: str, more: str = "") -> str:
        conditions = " AND ".join(self.where + [more] * bool(more))
        return f"SELECT {what} FROM {_name(self.options['table'])}" + f" WHERE {conditions}" * bool(conditions)

    def partitions(self) -> list[RowRange]:
        n, out = max(1, int(self.options.get("partitions", 1))), []
        files = database_files(self.options["path"])
        each = max(1, -(-n // max(1, len(files))))
        for file in files:
            with closing(connect(file)) as c:
                # Bounds by rank, not by value: ids with gaps still give equal parts.
                ranked = self._query(f"rowid AS r, ntile({each}) OVER (ORDER BY rowid) AS part")
                try:
                    out += [RowRange(file, low, high) for low, high in c.execute(f"SELECT min(r), max(r) FROM ({ranked}) GROUP BY part ORDER BY part", self.values)]
                except sqlite3.OperationalError:  # a table without row ids
                    out.append(RowRange(file))
        return out or [RowRange(file) for file in files[:1]]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        ranged = partition.low is not None
        query = self._query(", ".join(map(_name, self.names)), "rowid BETWEEN ? AND ?" if ranged else "")
        with closing(connect(partition.file)) as c:
            yield from c.execute(query + " ORDER BY rowid" * ranged, [*self.values, *([partition.low, partition.high] if ranged else [])])


class PushingReader(SqliteReader):
    """Takes over the filters on integers and texts that Spark finds above the scan."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if (found := self._condition(f)) is None:
                yield f  # Spark evaluates it
            else:
                self.where.append(found[0])
                self.values += found[1]

    def _condition(self, f: Filter) -> tuple[str, list] | None:
        if isinstance(f, Not):
            inner = self._condition(f.child)
            return inner and (f"NOT ({inner[0]})", inner[1])
        column = getattr(f, "attribute", ())
        if len(column) != 1 or column[0] not in self.kinds:
            return None
        name = _name(column[0])
        if isinstance(f, (IsNull, IsNotNull)):
            return f"{name} IS {'' if isinstance(f, IsNull) else 'NOT '}NULL", []
        values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
        kind = {"bigint": int, "string": str}.get(self.kinds[column[0]])
        if kind is None or not all(type(v) is kind for v in values):
            return None
        side = f"{name} COLLATE BINARY" if kind is str else name
        if isinstance(f, In):
            return f"{side} IN ({', '.join('?' * len(values))})", values
        return (f"{side} {_SIGNS[type(f)]} ?", values) if type(f) in _SIGNS else None


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        with closing(connect(database_files(self.options["path"])[0])) as c:
            kinds = {r[1]: (r[2] or "TEXT").upper() for r in c.execute(f"PRAGMA table_info({_name(self.options['table'])})")}
        if not kinds:
            raise ValueError(f"no table {self.options['table']}")
        if missing := [w for w in wanted if w not in kinds]:
            raise ValueError(f"columns missing: {missing}")
        return ", ".join(f"`{c}` {_TYPES.get(kinds[c], 'string')}" for c in wanted or kinds)

    def reader(self, schema: StructType) -> SqliteReader:
        return (PushingReader if self.options.get("pushdown") == "true" else SqliteReader)(schema, self.options)


def read_table(
    spark: SparkSession, path: str, table: str, columns: list[str] | None = None, partitions: int | None = None, equals: dict | None = None, pushdown: bool = False
) -> DataFrame:
    """The table as a frame; by default as many partitions as the session has cores.

    equals: column values that SQLite selects by. pushdown: filters above the scan go into SQLite too. A frame with pushdown is
    for one use: Spark keeps what a Python source was last given, so that a second query of the same frame would
    still see the first one's filters.
    """
    ship(spark)
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions or spark.sparkContext.defaultParallelism)
    if equals:
        reader = reader.option("equals", json.dumps(equals))
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        reader = reader.option("pushdown", "true")
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def read_corpus(spark: SparkSession, path: str, table: str, columns: list[str], kinds: list[str], kind: str = "natureza", partitions: int | None = None) -> DataFrame:
    """The rows of each kind, selected inside SQLite. The kind is a constant of its branch, so that a filter on it above leaves
    one branch of the plan, and the others are not read."""
    names = [c for c in columns if c != kind]
    parts = [read_table(spark, path, table, names, partitions, {kind: k}).withColumn(kind, F.lit(k)).select(*columns) for k in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def catalog(path: str) -> dict[str, list[tuple[str, str]]]:
    """Tables of a database with their columns and types."""
    with connect(path) as c:
        tables = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        return {t: [(r[1], r[2]) for r in c.execute(f"PRAGMA table_info({_name(t)})")] for t in tables}


def indexes(path: str) -> dict[str, list[tuple[str, list[str]]]]:
    """Indexes of each table with their columns."""
    with connect(path) as c:
        found = {t: [r[1] for r in c.execute(f"PRAGMA index_list({_name(t)})")] for t in catalog(path)}
        return {t: [(i, [r[2] for r in c.execute(f"PRAGMA index_info({_name(i)})")]) for i in names] for t, names in found.items()}


def integrity(path: str) -> list[str]:
    """What the database's own check finds; ['ok'] if nothing."""
    with connect(path) as c:
        return [r[0] for r in c.execute("PRAGMA integrity_check")]
