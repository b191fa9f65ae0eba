"""One row for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.columns import column


def deduplicate(df: DataFrame, keys: list[str], keep: str = "first", order_by: list[str] | None = None) -> DataFrame:
    """The first or last row of each key by order_by; NULL keys are equal. Without an order, any row of each key.

    Rows are reduced to one a key before the shuffle, so a key that most rows have makes no large task.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep is first or last, not {keep!r}")
    if not keys:
        raise ValueError("no keys given")
    if not order_by:
        return df.dropDuplicates(keys)
    order = F.struct(*(column(df, c)[0] for c in order_by))
    pick = F.min_by if keep == "first" else F.max_by
    row = F.struct(*(column(df, c)[0].alias(c) for c in df.columns))
    return df.groupBy(*(column(df, k)[0] for k in keys)).agg(pick(row, order).alias("__weir_row")).select("__weir_row.*")
