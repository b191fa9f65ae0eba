"""Delimited text, every cell of which is text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .base import Counted, mode_of


@dataclass
class CSVFile:
    """A file or folder of delimited text. Cells are text, empty ones too; without a header, columns are "0", "1", and so on.

    columns: names in the file's order, which spares a look at the file; they are needed for streams.
    multi_line: cells may hold line ends. That keeps a file from being split among tasks, so it has to be asked for.
    """

    path: str
    delimiter: str = ","
    encoding: str = "utf-8"
    has_header: bool = True
    columns: list[str] = field(default_factory=list)
    multi_line: bool = False
    empty_as_null: bool = False

    def _options(self) -> dict:
        return {"sep": self.delimiter, "encoding": self.encoding, "header": self.has_header, "multiLine": self.multi_line, "quote": '"', "escape": '"', "inferSchema": False}

    def _schema(self) -> StructType | None:
        return StructType([StructField(c, StringType()) for c in self.columns]) if self.columns else None

    def _text(self, df: DataFrame) -> DataFrame:
        if not self.has_header and not self.columns:
            df = df.toDF(*(c.removeprefix("_c") for c in df.columns))
        return df if self.empty_as_null else df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.options(**self._options())
        if schema := self._schema():
            reader = reader.schema(schema)
        return self._text(reader.csv(self.path))

    def read_stream(self, spark: SparkSession, files_per_batch: int = 1000) -> DataFrame:
        """New files of the folder, so many a batch."""
        schema = self._schema()
        if schema is None:
            raise ValueError("a stream needs columns")
        return self._text(spark.readStream.schema(schema).options(**self._options()).option("maxFilesPerTrigger", files_per_batch).csv(self.path))

    def write(self, df: DataFrame, mode: str = "w") -> int:
        """Files in a folder at path, each with the header; the number of rows. An empty frame writes nothing."""
        if df.isEmpty():
            return 0
        counted = Counted(df)
        text = counted.df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
        text.write.mode(mode_of(mode)).options(sep=self.delimiter, encoding=self.encoding, header=self.has_header, quote='"', escape='"', emptyValue="").csv(self.path)
        return counted.rows
