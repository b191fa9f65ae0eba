"""Parquet files, which filters and column choices are pushed down to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .base import Counted, mode_of


@dataclass
class ParquetFile:
    path: str
    partition_by: list[str] = field(default_factory=list)
    schema: StructType | str | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        return (spark.read.schema(self.schema) if self.schema is not None else spark.read).parquet(self.path)

    def read_stream(self, spark: SparkSession, files_per_batch: int = 1000) -> DataFrame:
        schema = self.schema if self.schema is not None else spark.read.parquet(self.path).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(self.path)

    def write(self, df: DataFrame, mode: str = "w") -> int:
        counted = Counted(df)
        counted.df.write.mode(mode_of(mode)).partitionBy(*self.partition_by).parquet(self.path)
        return counted.rows
