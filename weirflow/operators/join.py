"""Equi-joins on keys in which NULL equals NULL."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of join, and what Spark calls them.
KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full_outer"}


def join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", suffixes: tuple[str, str] = ("_left", "_right"), null_safe: bool = True) -> DataFrame:
    """Keys once, then the left side's other columns, then the right side's; columns of both get suffixes.

    Spark chooses how to join, by the sides' sizes: the null-safe comparison is a join key like any other. null_safe=False
    compares plainly: rows with a NULL key have no partner then, don't meet in one task, and Spark may filter at run time.
    """
    if how not in KINDS:
        raise ValueError(f"no join {how!r}; there are {', '.join(KINDS)}")
    keys = [on] if isinstance(on, str) else list(on)
    if not keys:
        raise ValueError("no keys given")
    for side, df in (("left", left), ("right", right)):
        if missing := [k for k in keys if k not in df.columns]:
            raise KeyError(f"no column {', '.join(missing)} on the {side} side")
    a, b = left.alias("l"), right.alias("r")

    def of(side: str, name: str):
        return F.col(f"{side}.`{name.replace('`', '``')}`")

    same = (of("l", k).eqNullSafe(of("r", k)) if null_safe else of("l", k) == of("r", k) for k in keys)
    met = a.join(b, reduce(lambda x, y: x & y, same), KINDS[how])
    both = (set(left.columns) & set(right.columns)) - set(keys)
    # Only a row without a partner can lack a side's key, and only right and outer joins keep rows without a left one.
    merged = [(of("l", k) if how in ("inner", "left") else of("r", k) if how == "right" else F.coalesce(of("l", k), of("r", k))).alias(k) for k in keys]
    rest = [of(side, c).alias(c + suffix if c in both else c) for side, df, suffix in (("l", left, suffixes[0]), ("r", right, suffixes[1])) for c in df.columns if c not in keys]
    return met.select(*merged, *rest)


def lookup(df: DataFrame, table: DataFrame, on: str | list[str], defaults: dict[str, Any]) -> DataFrame:
    """df with the columns that defaults names, from the row of table with the same key; the defaults where it has none.

    A value that is NULL in table stays NULL. Keys are unique in table, or rows of df come several times.
    """
    keys = [on] if isinstance(on, str) else list(on)
    found = table.select(*keys, *defaults, F.lit(True).alias("__weir_found"))
    met = join(df.drop(*defaults), found, keys, "left")
    return met.select(*(c for c in met.columns if c not in defaults and c != "__weir_found"), *(F.when(F.col("__weir_found"), F.col(f"`{c}`")).otherwise(F.lit(v)).alias(c) for c, v in defaults.items()))
