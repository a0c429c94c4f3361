"""The three rounding rules the results depend on, and division that tolerates zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Round as SQL ``numeric`` does: decimal digits, ties away from zero."""
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")


def half_even(x: Column, digits: int) -> Column:
    """Round as array libraries do: scale, nearest even integer, scale back."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def cents(x: Column) -> Column:
    """Round one number to 2 digits by its exact binary value (scalar ``round(x, 2)``).

    ``x * 100`` can land on a tie that the exact product misses by less than one unit in
    the last place. ``slip`` is that error, recovered without loss by splitting ``x`` into
    two short halves (Dekker's product), and decides such ties; a true tie goes to the even
    cent. The steps name ``x`` some twenty times; as the element of an array it is computed once,
    and the code around a column of cents stays short enough to be compiled.
    """
    return F.transform(F.array(x), _cents).getItem(0)


def _cents(x: Column) -> Column:
    scaled = x * F.lit(100.0)
    spread = x * F.lit(134217729.0)
    high = spread - (spread - x)
    slip = (high * F.lit(100.0) - scaled) + (x - high) * F.lit(100.0)
    below = F.floor(scaled).cast("double")
    tie = scaled - below == 0.5
    return F.when(tie & (slip > 0), below + 1.0).when(tie & (slip < 0), below).otherwise(F.rint(scaled)) / 100.0


def ratio(x: Column, y: Column) -> Column:
    """``x / y`` in double; NULL where ``y`` is zero."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def exact_sum(x: Column) -> Column:
    """Sum of amounts in decimals: the same in whatever order tasks deliver the rows.

    Each amount is first rounded to six decimals.
    """
    return F.sum(x.cast("decimal(24,6)")).cast("double")


def exact_mean(x: Column) -> Column:
    return ratio(exact_sum(x), F.count(x))


def percent(x: Column, total: Column) -> Column:
    return ratio(x, total) * F.lit(100.0)
