"""Rounding rules used across the jobs.

* ``ratio``       half away from zero on the exact quotient (SQL NUMERIC rounding)
* ``ratio_even``  half to even on the exact quotient (report rounding of the listing jobs)
* ``round_dec``   half away from zero on a double, ten decimals looked at
* ``js_round``    floor(x + 0.5) on doubles (browser dashboard rounding)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = "decimal(20,0)"


def ratio(num: Column, den: Column, digits: int, scale: int = 1) -> Column:
    """``round(scale * num / den, digits)`` for whole ``num`` and ``den``; NULL when ``den`` is 0."""
    quotient = (num.cast(_EXACT) * F.lit(scale).cast("decimal(7,0)")) / F.when(den != 0, den).cast(_EXACT)
    return F.round(quotient, digits).cast("double")


def round_dec(x: Column, digits: int) -> Column:
    """Half away from zero after ten decimals; keeps binary noise such as 2.675 * 1.1 from deciding ties."""
    return F.round(x.cast("decimal(30,10)"), digits).cast("double")


def ratio_even(num: Column, den: Column, digits: int, scale: int = 1) -> Column:
    quotient = (num.cast(_EXACT) * F.lit(scale).cast("decimal(7,0)")) / F.when(den != 0, den).cast(_EXACT)
    return F.bround(quotient, digits).cast("double")


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def js_pct(num: Column, den: Column) -> Column:
    """Rounded percentage, 0 for an empty base."""
    share = num.cast("double") / F.when(den > 0, den).cast("double") * 100
    return F.coalesce(js_round(share), F.lit(0).cast("long"))


def cents(price: Column) -> Column:
    """Price in whole cents, so that sums and ranks are exact."""
    return F.round(price * 100).cast("long")


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (also for NULL)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(flag(cond)), F.lit(0).cast("long"))
