"""Expression strings, compiled once into columns."""

from .aggregates import AGGREGATES, Aggregate, aggregate_column, parse_aggregate, parse_aggregates
from .conditions import filter_column, literal_value, parse_condition, sink_column
from .expressions import SCALARS, map_column

__all__ = [
    "AGGREGATES",
    "SCALARS",
    "Aggregate",
    "aggregate_column",
    "filter_column",
    "literal_value",
    "map_column",
    "parse_aggregate",
    "parse_aggregates",
    "parse_condition",
    "sink_column",
]
