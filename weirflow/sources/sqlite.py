"""SQLite databases, through Spark's Python data source interface."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, FractionalType, IntegralType, LongType, StringType, StructField, StructType

from .jdbc import column_types

#: Column types of SQLite tables that are made from a frame.
SQLITE_TYPES: list[tuple[type[DataType], str]] = [(BooleanType, "INTEGER"), (IntegralType, "INTEGER"), (FractionalType, "REAL"), (BinaryType, "BLOB")]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Rowids(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", 1))
        if n > 1 and self.options.get("table"):
            with sqlite3.connect(self.options["database"]) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.options['table'])}").fetchone()
            if low is not None:
                cuts = [low + (high + 1 - low) * k // n for k in range(n + 1)]
                return [_Rowids(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        return [_Rowids(None, None)]

    def read(self, part: _Rowids) -> Iterator[tuple]:
        import json

        db = sqlite3.connect(self.options["database"])
        try:
            query, params = self.options.get("query"), json.loads(self.options.get("params", "[]"))
            if not query:
                query = f"SELECT * FROM {quoted(self.options['table'])}"
                if part.low is not None:
                    query, params = f"{query} WHERE rowid >= ? AND rowid < ?", [part.low, part.high]
            cursor = db.execute(query, params)
            kinds = [f.dataType for f in self.schema]
            size = int(self.options.get("batch_size", 1000))
            while rows := cursor.fetchmany(size):
                for row in rows:
                    yield tuple(_as(v, k) for v, k in zip(row, kinds, strict=True))
        finally:
            db.close()


def _as(value: object, kind: DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value.decode(errors="replace") if isinstance(value, bytes) else str(value)
    return float(value) if isinstance(kind, DoubleType) else value


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weirflow_sqlite"

    def schema(self) -> StructType:
        """Declared types where there are any; else that of the first value that isn't NULL among the first thousand."""
        import json

        with sqlite3.connect(self.options["database"]) as db:
            query, params = self.options.get("query"), json.loads(self.options.get("params", "[]"))
            cursor = db.execute(query or f"SELECT * FROM {quoted(self.options['table'])}", params)
            names = [d[0] for d in cursor.description]
            head = list(islice(cursor, 1000))
            declared = {} if query else {r[1]: r[2].upper() for r in db.execute(f"PRAGMA table_info({quoted(self.options['table'])})")}

        def kind(i: int, name: str) -> DataType:
            stated = declared.get(name, "")
            if "INT" in stated:
                return LongType()
            if any(x in stated for x in ("REAL", "FLOA", "DOUB")):
                return DoubleType()
            if "BLOB" in stated:
                return BinaryType()
            kinds = {type(r[i]) for r in head if r[i] is not None} if not stated else {str}
            if kinds <= {int, float} and kinds:
                return DoubleType() if float in kinds else LongType()
            return BinaryType() if kinds == {bytes} else StringType()

        return StructType([StructField(n, kind(i, n)) for i, n in enumerate(names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


@dataclass
class SQLiteDatabase:
    """A database file that driver and executors see. A query wins over a table; ? are its parameters."""

    database: str
    table: str = ""
    query: str = ""
    params: tuple = ()
    batch_size: int = 1000
    partitions: int = 1

    def read(self, spark: SparkSession, schema: StructType | str | None = None) -> DataFrame:
        import json

        if not self.query and not self.table:
            raise ValueError("a query or a table is needed")
        spark.dataSource.register(SQLiteSource)
        reader = spark.read.format("weirflow_sqlite").options(database=self.database, batch_size=self.batch_size, partitions=self.partitions, params=json.dumps(list(self.params)))
        reader = reader.option("query", self.query) if self.query else reader.option("table", self.table)
        return (reader.schema(schema) if schema is not None else reader).load()

    def create_table(self, schema: StructType) -> None:
        columns = ", ".join(f"{quoted(c)} {t}" for c, t in column_types(schema, SQLITE_TYPES).items())
        with sqlite3.connect(self.database) as db:
            db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.table)} ({columns})")

    def write(self, df: DataFrame, if_exists: str = "append") -> int:
        """Rows go to the one writer that a SQLite file has, a partition at a time; the number of rows. All or nothing."""
        if if_exists not in ("append", "replace", "fail"):
            raise ValueError(f"if_exists is append, replace or fail, not {if_exists!r}")
        if not self.table:
            raise ValueError("a table is needed")
        db = sqlite3.connect(self.database, isolation_level=None)
        try:
            db.execute("BEGIN IMMEDIATE")
            there = db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (self.table,)).fetchone()
            if there and if_exists == "fail":
                raise ValueError(f"there is a table {self.table!r} already")
            if there and if_exists == "replace":
                db.execute(f"DROP TABLE {quoted(self.table)}")
            columns = ", ".join(f"{quoted(c)} {t}" for c, t in column_types(df.schema, SQLITE_TYPES).items())
            db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.table)} ({columns})")
            names = ", ".join(map(quoted, df.columns))
            insert = f"INSERT INTO {quoted(self.table)} ({names}) VALUES ({', '.join('?' * len(df.columns))})"
            n, rows = 0, iter(_plain(df).toLocalIterator(prefetchPartitions=True))
            while batch := [tuple(r) for r in islice(rows, self.batch_size)]:
                db.executemany(insert, batch)
                n += len(batch)
            db.execute("COMMIT")
            return n
        except BaseException:
            if db.in_transaction:
                db.execute("ROLLBACK")
            raise
        finally:
            db.close()


def _plain(df: DataFrame) -> DataFrame:
    """Nested values as JSON, dates and decimals as text: what SQLite can hold."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, MapType

    def plain(f: StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StructType | ArrayType | MapType):
            return F.to_json(c).alias(f.name)
        native = isinstance(f.dataType, BooleanType | IntegralType | BinaryType | StringType) or f.dataType.typeName() in ("float", "double")
        return c if native else c.cast("double").alias(f.name) if isinstance(f.dataType, FractionalType) else c.cast("string").alias(f.name)

    return df.select(*(plain(f) for f in df.schema))
