"""Operators from frame to frame."""

from .aggregate import aggregate
from .base import Transform
from .dedup import deduplicate
from .join import join, lookup
from .project import filter_rows, map_columns
from .sets import union_all
from .top import top_n
from .window import row_window

__all__ = ["Transform", "aggregate", "deduplicate", "filter_rows", "join", "lookup", "map_columns", "row_window", "top_n", "union_all"]
