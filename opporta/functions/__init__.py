"""Column expressions used inside the jobs: Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so that the plan holds and evaluates it once."""
    return F.get(F.transform(F.array(value), body), 0)


def once(df: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """`keep` columns plus costly values, each computed once per row.

    The values pass through a one-row generator, which the optimizer does not see through: neither a
    later column nor a pushed-down filter repeats their expressions.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(name) for name, v in values.items()]))))
