"""JSON documents and JSON lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .base import Counted, mode_of


def extract(df: DataFrame, record_path: str) -> DataFrame:
    """The records at a dotted path: fields by name, list items by number; a list gives a row an item."""
    value = None
    kind = df.schema
    for part in record_path.split("."):
        if isinstance(kind, ArrayType) and part.isdigit():
            value, kind = F.get(value, int(part)), kind.elementType
        elif isinstance(kind, StructType) and part in kind.names:
            value = F.col(f"`{part}`") if value is None else value.getField(part)
            kind = kind[part].dataType
        else:
            raise KeyError(f"no {part!r} on the way along {record_path!r}")
    if isinstance(kind, ArrayType):
        rows, kind = df.select(F.explode(value).alias("record")), kind.elementType
    else:
        rows = df.select(value.alias("record")).filter(F.col("record").isNotNull())
    return rows.select("record.*") if isinstance(kind, StructType) else rows.select(F.col("record").alias("value"))


@dataclass
class JSONFile:
    """A JSON file: an array, or a single object, gives rows; with lines, each line does.

    schema spares a pass over the files; it is needed for streams.
    """

    path: str
    lines: bool = False
    record_path: str | None = None
    schema: StructType | str | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.option("multiLine", not self.lines).option("mode", "FAILFAST")
        if self.schema is not None:
            reader = reader.schema(self.schema)
        df = reader.json(self.path)
        if self.schema is None and not df.columns:
            return spark.createDataFrame([], StructType([]))
        if df.columns == ["value"] and not self.record_path and self.schema is None and not isinstance(df.schema["value"].dataType, StructType):
            return df
        return extract(df, self.record_path) if self.record_path else df

    def read_stream(self, spark: SparkSession, files_per_batch: int = 1000) -> DataFrame:
        if self.schema is None:
            raise ValueError("a stream needs a schema")
        df = spark.readStream.schema(self.schema).option("multiLine", not self.lines).option("maxFilesPerTrigger", files_per_batch).json(self.path)
        return extract(df, self.record_path) if self.record_path else df

    def write(self, df: DataFrame, mode: str = "w") -> int:
        """Lines in a folder's files, NULL fields written out; the number of rows.

        As a document, an array in a file for each task's rows, which a reader takes as well; that always overwrites.
        """
        counted = Counted(df)
        if self.lines:
            counted.df.write.mode(mode_of(mode)).option("ignoreNullFields", False).json(self.path)
            return counted.rows
        record = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
        rows = counted.df.select(record.alias("record"))

        def arrays(batches):
            import pyarrow as pa

            begun = False
            for batch in batches:
                texts = batch.column(0).to_pylist()
                if texts:
                    lines = [("," if begun or i else "[") + "\n  " + t for i, t in enumerate(texts)]
                    begun = True
                    yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
            if begun:
                yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

        rows.mapInArrow(arrays, "value string").write.mode("overwrite").text(self.path)
        return counted.rows
