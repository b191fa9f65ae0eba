"""What several operators of this subpackage share, and what they take from the library."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from inspect import ismethod
from weakref import WeakMethod

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from weirflow.plans.ordering import shared_dir, written

#: Writes a frame as a table in the shared folder and reads it again: that cuts the lineage in a way that survives lost
#: executors. The table goes when the driver's JVM ends.
materialize = written

__all__ = ["Recent", "filter_rows", "id_text_crc", "kept", "map_rows", "materialize", "release", "require", "shared_dir", "table", "trim"]

#: What this worker process keeps for later tasks: of one operator at a time.
_KEPT: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, rows: Callable[[], Callable[[dict], Iterator[tuple]]], schema: str) -> DataFrame:
    """df.mapInArrow with rows()(columns of a batch as lists) giving tuples of the schema.

    rows is called once a task. Output goes out in batches of some thousand rows.
    """
    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = rows()
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = list(each(columns))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, struct)


def release() -> None:
    """Drops what a worker's earlier tasks kept, and trims.

    Workers outlive their tasks and stages; without this, an executor holds the leavings of all operators at once.
    """
    _KEPT.clear()
    trim()


def trim() -> None:
    """Gives back to the system what was freed only within the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if back:  # glibc
        back(0)


def kept(key: object, make: Callable[[], object]) -> object:
    """make(), kept for this worker's later tasks until some other operator's task begins."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def filter_rows(df: DataFrame, column: str, keep: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """Rows of df whose value in column passes; all columns go through as they are. keep is called once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        passes = keep()
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(batch.schema.names.index(column)).to_pylist()), type=pa.bool_()))
        trim()

    return df.mapInArrow(run, df.schema)


class Recent(dict):
    """A cache of a function's values over strings that keeps those of recent use, at most twice so many.

    When it is full, its entries become the older half, out of which those in use come back. Strings of over LONG letters
    aren't kept. A method's object is held weakly: it may own the cache, and both go with its last use, not only when
    Python looks for cycles.
    """

    LONG = 100

    def __init__(self, function: Callable[[str], object], most: int):
        super().__init__()
        self.function = WeakMethod(function) if ismethod(function) else function
        self.most = most
        self.older: dict = {}

    def _value(self, key: str):
        function = self.function() if isinstance(self.function, WeakMethod) else self.function
        return function(key)

    def __missing__(self, key: str):
        if len(key) > self.LONG:
            return self._value(key)
        value = self.older.get(key)
        if value is None:
            value = self._value(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def id_text_crc(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


