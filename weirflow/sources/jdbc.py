"""Tables of databases with a JDBC driver, PostgreSQL among them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, BooleanType, DataType, FractionalType, IntegralType, StructType

from .base import Counted, mode_of


def literal(value: object) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def bind(query: str, params: tuple | list) -> str:
    """query with $1, $2 and so on, outside of quotes, replaced by values: Spark's JDBC source takes no parameters."""

    def value(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if not 1 <= int(m[1]) <= len(params):
            raise ValueError(f"no parameter ${m[1]}")
        return literal(params[int(m[1]) - 1])

    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|\$(\d+)", value, query)


#: Column types of PostgreSQL tables that are made from a frame.
POSTGRES_TYPES: list[tuple[type[DataType], str]] = [(BooleanType, "BOOLEAN"), (IntegralType, "BIGINT"), (FractionalType, "DOUBLE PRECISION"), (BinaryType, "BYTEA")]


def column_types(schema: StructType, kinds: list[tuple[type[DataType], str]], other: str = "TEXT") -> dict[str, str]:
    return {f.name: next((name for kind, name in kinds if isinstance(f.dataType, kind)), other) for f in schema}


@dataclass
class JDBCTable:
    """A query or a table. partition_column with lower, upper and partitions reads it in that many tasks."""

    url: str
    table: str = ""
    query: str = ""
    params: tuple = ()
    driver: str | None = None
    properties: dict[str, str] = field(default_factory=dict)
    fetch_size: int = 1000
    batch_size: int = 1000
    partition_column: str | None = None
    lower: int | None = None
    upper: int | None = None
    partitions: int | None = None

    def options(self) -> dict[str, str]:
        """Options of the reader."""
        if not self.query and not self.table:
            raise ValueError("a query or a table is needed")
        out = {"url": self.url, "fetchsize": str(self.fetch_size), **self.properties}
        query = bind(self.query, self.params) if self.query else ""
        if self.partition_column:
            if None in (self.lower, self.upper, self.partitions):
                raise ValueError("partition_column needs lower, upper and partitions")
            out |= {"dbtable": f"({query}) q" if query else self.table, "partitionColumn": self.partition_column, "lowerBound": str(self.lower), "upperBound": str(self.upper), "numPartitions": str(self.partitions)}
        else:
            out |= {"query": query} if query else {"dbtable": self.table}
        return out | ({"driver": self.driver} if self.driver else {})

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options()).load()

    def write_options(self, schema: StructType) -> dict[str, str]:
        if not self.table:
            raise ValueError("a table is needed")
        types = ", ".join(f"`{c}` {t}" for c, t in column_types(schema, POSTGRES_TYPES).items() if t in ("TEXT", "BIGINT", "DOUBLE PRECISION", "BOOLEAN", "BYTEA"))
        out = {"url": self.url, "dbtable": self.table, "batchsize": str(self.batch_size), **self.properties}
        # Spark parses these types itself, so those that only PostgreSQL knows are left to its dialect.
        plain = types if not re.search(r"TEXT|BYTEA|DOUBLE PRECISION", types) else ""
        return out | ({"createTableColumnTypes": plain} if plain else {}) | ({"driver": self.driver} if self.driver else {})

    def write(self, df: DataFrame, if_exists: str = "append") -> int:
        counted = Counted(df)
        counted.df.write.format("jdbc").mode(mode_of(if_exists)).options(**self.write_options(df.schema)).save()
        return counted.rows

    def create_table_sql(self, schema: StructType) -> str:
        columns = ", ".join(f'"{c}" {t}' for c, t in column_types(schema, POSTGRES_TYPES).items())
        return f'CREATE TABLE IF NOT EXISTS "{self.table}" ({columns})'


def postgres(dsn: str, **options) -> JDBCTable:
    """A PostgreSQL table or query by a DSN such as postgresql://user:password@host:5432/db."""
    parts = urlsplit(dsn)
    properties = {k: unquote(v) for k, v in (("user", parts.username), ("password", parts.password)) if v}
    url = f"jdbc:postgresql://{parts.hostname or 'localhost'}:{parts.port or 5432}{parts.path}" + (f"?{parts.query}" if parts.query else "")
    return JDBCTable(url, driver="org.postgresql.Driver", properties=properties | options.pop("properties", {}), **options)
