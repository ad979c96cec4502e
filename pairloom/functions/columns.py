"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian_mi(rho: Column, limit: float = 1 - 1e-8) -> Column:
    """Mutual information in nats of two normal variables with this correlation; null where there is none."""
    r = F.least(F.lit(limit), F.greatest(F.lit(-limit), rho))
    return F.when(rho.isNotNull(), -0.5 * F.ln(1 - r * r))


def axial_wrap(d: Column) -> Column:
    """A difference of axes (period pi) as a value in [-pi/2, pi/2)."""
    return F.pmod(d + F.pi() / 2, F.pi()) - F.pi() / 2


def positive_cube(x: Column) -> Column:
    return F.pow(F.greatest(x, F.lit(0.0)), F.lit(3.0))


def hash_order(*parts) -> Column:
    """A key that orders rows at random, the same in every run and every SQL engine."""
    return F.md5(F.concat_ws(":", *parts))


def hash_number(*parts, digits: int = 8) -> Column:
    """A whole number below 16^digits from the same kind of key."""
    return F.conv(F.substring(hash_order(*parts), 1, digits), 16, 10).cast("long")


def fold(value: Column, *cases: tuple[object, object], default=None) -> Column:
    """The result of the first case that value equals, or default."""
    out = F
    for key, result in cases:
        out = out.when(value == F.lit(key), F.lit(result))
    return out.otherwise(F.lit(default))
