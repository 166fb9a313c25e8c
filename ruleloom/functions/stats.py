"""Statistics as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_ROUNDED = 1.96
Z_EXACT = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z_ROUNDED) -> tuple[Column, Column, Column]:
    """(p, low, high) of the Wilson score interval, unclamped; null where n = 0."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p = k / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    return p, centre - half, centre + half


def wilson_clamped(k: Column, n: Column, z: float = Z_EXACT) -> tuple[Column, Column, Column]:
    """As ``wilson`` with bounds kept inside [0, 1]."""
    p, lo, hi = wilson(k, n, z)
    return p, F.greatest(lo, F.lit(0.0)), F.least(hi, F.lit(1.0))


def safe_rate(k: Column, n: Column) -> Column:
    """k / n, null where n = 0."""
    return F.try_divide(k.cast("double"), n.cast("double"))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p-value on discordant counts; 1 where b + c = 0.

    The tail is summed in log space, and ln C(n, k) is carried from one k to the
    next, so that work grows with the smaller count; no UDF is needed.
    """
    n, m = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct((-n * F.ln(F.lit(2.0))).alias("ln"), F.lit(0.0).alias("tail"))

    def step(acc: Column, k: Column) -> Column:
        ln = acc["ln"] + F.when(k == 0, 0.0).otherwise(F.ln((n - k + 1).cast("double")) - F.ln(F.greatest(k, F.lit(1)).cast("double")))
        return F.struct(ln.alias("ln"), (acc["tail"] + F.exp(ln)).alias("tail"))

    tail = F.aggregate(F.sequence(F.lit(0), m), start, step, lambda acc: acc["tail"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))
