"""The only place where frames are built: every frame is explicit and totally ordered, so that no value sees later rows."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def expanding(by: list[str], order: list[str]) -> WindowSpec:
    """All rows up to this one."""
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def before(by: list[str], order: list[str]) -> WindowSpec:
    """All rows before this one."""
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)


def trailing(by: list[str], order: list[str], n: int) -> WindowSpec:
    """This row and the n - 1 before it."""
    return ordered(by, order).rowsBetween(1 - n, 0)


def prior(by: list[str], order: list[str], n: int) -> WindowSpec:
    """The n rows before this one."""
    return ordered(by, order).rowsBetween(-n, -1)


def forward(by: list[str], order: list[str], n: int) -> WindowSpec:
    """The n rows after this one: labels only."""
    return ordered(by, order).rowsBetween(1, n)


def enough(value: Column, seen: Column, least: int) -> Column:
    """A value only if its frame has at least so many non-null inputs."""
    return F.when(seen >= least, value)


def six(value: Column) -> Column:
    return F.round(value, 6)


def islands(flag: Column, by: list[str], order: list[str]) -> Column:
    """A running number of the stretches that start where flag is true."""
    return F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(expanding(by, order))
