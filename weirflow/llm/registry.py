"""What the driver's entry module adds: this subpackage's queries and that of the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import queries as own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return own.queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return own.oracle_sql() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
