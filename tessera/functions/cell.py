"""Per-cell scalar formulas as Spark Columns (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _inf() -> Column:
    return F.lit(float("inf"))


def beta_cell(x: Column, mu: Column, p: float) -> Column:
    """β-divergence d_p(x | mu) of one cell, in the Tweedie-power form.

    p=0: ½(x−mu)²;  p=1: x·ln(x/mu) − x + mu;  p=2: x/mu − ln(x/mu) − 1;
    otherwise x^(2−p)/((1−p)(2−p)) − x·mu^(1−p)/(1−p) + mu^(2−p)/(2−p).
    Zeros follow the limits: 0·ln 0 = 0, so d_1(0 | mu) = mu; a zero ``mu``
    under a positive ``x`` is +∞ for p ≥ 1, and so is a zero ``x`` under a
    positive ``mu`` for p ≥ 2; d(0 | 0) is 0 for every p.
    """
    p = float(p)
    if p == 0.0:
        return F.lit(0.5) * F.pow(x - mu, F.lit(2.0))
    if p == 1.0:
        return (
            F.when(x == 0, mu)
            .when(mu <= 0, _inf())
            .otherwise(x * F.log(F.try_divide(x, mu)) - x + mu)
        )
    if p == 2.0:
        return (
            F.when((x == 0) & (mu == 0), F.lit(0.0))
            .when((x <= 0) | (mu <= 0), _inf())
            .otherwise(F.try_divide(x, mu) - F.log(F.try_divide(x, mu)) - F.lit(1.0))
        )
    a, b = 1.0 - p, 2.0 - p
    zero = F.pow(mu, F.lit(b)) / F.lit(b) if b > 0 else _inf()
    return F.when((x == 0) & (mu == 0), F.lit(0.0)).when(x == 0, zero).otherwise(
        F.pow(x, F.lit(b)) / F.lit(a * b)
        - x * F.pow(mu, F.lit(a)) / F.lit(a)
        + F.pow(mu, F.lit(b)) / F.lit(b)
    )

