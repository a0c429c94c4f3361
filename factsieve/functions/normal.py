"""Normal distribution tail as a column expression (no error function is built in)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# W. J. Cody, "Rational Chebyshev approximations for the error function",
# Mathematics of Computation 23 (1969). Highest power first; three ranges of |x|.
ERF_NEAR_TOP = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3]
ERF_NEAR_BOTTOM = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
ERFC_MID_TOP = [
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
]
ERFC_MID_BOTTOM = [
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
]
ERFC_FAR_TOP = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
ERFC_FAR_BOTTOM = [1.0, 2.56852019228982242e0, 1.87295284992346047e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def _poly(coefficients: list[float], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def erfc(x: Column) -> Column:
    """Complementary error function, to about 15 significant digits."""
    size = F.abs(x)
    square = x * x
    near = F.lit(1.0) - x * _poly(ERF_NEAR_TOP, square) / _poly(ERF_NEAR_BOTTOM, square)
    mid = F.exp(-square) * _poly(ERFC_MID_TOP, size) / _poly(ERFC_MID_BOTTOM, size)
    inverse = F.lit(1.0) / square
    rest = inverse * _poly(ERFC_FAR_TOP, inverse) / _poly(ERFC_FAR_BOTTOM, inverse)
    far = F.exp(-square) / size * (F.lit(1.0 / math.sqrt(math.pi)) - rest)
    tail = F.when(size <= 4.0, mid).otherwise(far)
    return F.when(size <= 0.46875, near).when(x < 0, F.lit(2.0) - tail).otherwise(tail)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution."""
    return erfc(z / F.lit(math.sqrt(2.0))) * F.lit(0.5)
