"""Row-count windows: an aggregate over the last rows of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.columns import column, is_number
from weirflow.plans.ordering import PART, ROW, in_ranges, row_numbers

FUNCTIONS = ("sum", "avg", "min", "max", "count")
#: Rows of the order that a task gets together, besides those before them that its first windows reach back to.
BLOCK = 1 << 18
_NUMBER, _BLOCK = "__weir_number", "__weir_block"


def row_window(df: DataFrame, size: int, step: int = 1, aggregation: str = "avg", column_name: str = "", order_by: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """A column {column}_window_{aggregation}: the aggregate over this row and the size - 1 before it, NULL where there are
    fewer, and at rows that the step passes over. NULL values are skipped; count counts rows.

    Without partition_by, the order of the whole frame is cut into blocks; rows that the next block's first windows need
    are copied to it, so no task sees all rows.
    """
    if size < 1 or step < 1:
        raise ValueError("size and step are at least 1")
    if aggregation not in FUNCTIONS:
        raise ValueError(f"no window function {aggregation!r}; there are {', '.join(FUNCTIONS)}")
    if aggregation != "count" and not column_name:
        raise ValueError(f"{aggregation} needs a column")
    if not order_by:
        raise ValueError("a row window needs order_by")
    name = f"{column_name}_window_{aggregation}"
    if partition_by:
        order = Window.partitionBy(*partition_by).orderBy(*order_by)
        number = F.row_number().over(order) - 1
        made = _masked(df, order, number, size, step, aggregation, column_name)
        return df.withColumn(name, made)
    ranged = in_ranges(df, order_by, "row-window")
    ranged = ranged.withColumn(_NUMBER, row_numbers(ranged)).drop(PART, ROW)
    block = max(BLOCK, 2 * size)
    home = F.floor(F.col(_NUMBER) / block).cast("long")
    reaches = F.col(_NUMBER) % block >= block - (size - 1)
    copies = ranged.withColumn(_BLOCK, F.explode(F.when(reaches, F.array(home, home + 1)).otherwise(F.array(home))))
    order = Window.partitionBy(_BLOCK).orderBy(_NUMBER)
    made = _masked(copies, order, F.col(_NUMBER), size, step, aggregation, column_name)
    out = copies.withColumn(name, made).filter(F.floor(F.col(_NUMBER) / block) == F.col(_BLOCK))
    return out.drop(_NUMBER, _BLOCK)


def _masked(df: DataFrame, order: Window, number: Column, size: int, step: int, aggregation: str, name: str) -> Column:
    frame = order.rowsBetween(-(size - 1), 0)
    if aggregation == "count":
        value = F.count(F.lit(1)).over(frame)
    else:
        field, kind = column(df, name)
        field = field if is_number(kind) or aggregation in ("min", "max") else field.cast("double")
        value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[aggregation](field).over(frame)
    return F.when((number >= size - 1) & ((number - (size - 1)) % step == 0), value)
