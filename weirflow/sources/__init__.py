"""Where frames come from and go to."""

from .base import Sink, Source
from .csv import CSVFile
from .jdbc import JDBCTable, postgres
from .json import JSONFile
from .kafka import KafkaSink, KafkaSource
from .parquet import ParquetFile
from .rest import RESTEndpoint
from .sqlite import SQLiteDatabase

__all__ = ["CSVFile", "JDBCTable", "JSONFile", "KafkaSink", "KafkaSource", "ParquetFile", "RESTEndpoint", "SQLiteDatabase", "Sink", "Source", "postgres"]
