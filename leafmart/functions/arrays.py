"""Helpers for folds over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once; a column used inside a lambda is otherwise computed for every element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
