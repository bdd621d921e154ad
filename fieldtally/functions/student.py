"""Quantile of Student's t as a column expression.

With t = sqrt(v) tan(a), the probability of |T| <= t is the integral of cos(a)^(v - 1) up to that
angle, over its integral up to a right angle. The equation is solved for a few degrees of freedom
when the expression is built; between them, the logarithm of the quantile is a smooth function of
1/v, taken as a Chebyshev sum. It holds from one degree of freedom up, to ten digits.
"""

from __future__ import annotations

from functools import cache
from math import exp, lgamma, pi

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions.missing import as_column

#: Terms of the sum over 1/v from 0 to 1.
TERMS = 16


def quantile(degrees: float, central: float = 0.95) -> float:
    """t such that |T| <= t with the central probability, for one degree of freedom or more."""
    # 2v/(v + 1) keeps the angle's scale for large v: the integral is worked out in z = a sqrt(v).
    root = degrees**0.5
    whole = root * exp(0.5 * np.log(pi) + lgamma(degrees / 2) - lgamma((degrees + 1) / 2)) / 2
    nodes, weights = np.polynomial.legendre.leggauss(120)

    def density(z: np.ndarray | float):
        return np.cos(z / root) ** (degrees - 1)

    low, high = 0.0, min(root * pi / 2, 40.0)
    for _ in range(80):  # bisection
        middle = (low + high) / 2
        reached = middle / 2 * (weights * density(middle / 2 * (nodes + 1))).sum()
        low, high = (middle, high) if reached < central * whole else (low, middle)
    return float(root * np.tan((low + high) / 2 / root))


@cache
def _coefficients(terms: int = TERMS) -> tuple[float, ...]:
    at = np.cos(pi * (np.arange(terms) + 0.5) / terms)
    logs = [np.log(quantile(2 / (1 + x))) for x in at]
    return tuple(np.polynomial.chebyshev.chebfit(at, logs, terms - 1))


def t_quantile_975(degrees: Column | str) -> Column:
    """97.5% point of t with real-valued degrees of freedom; null below one degree.

    Degrees of freedom of a sum of squares are one at least; a little less is rounding.
    """
    given = as_column(degrees)
    whole = F.when(given.isNotNull(), F.greatest(given, F.lit(1.0)))
    x = 2 / whole - 1
    # As one polynomial by Horner's rule: each step uses x once.
    series = np.polynomial.chebyshev.cheb2poly(_coefficients())
    total = F.lit(float(series[-1]))
    for c in series[-2::-1]:
        total = total * x + F.lit(float(c))
    return F.exp(total)
