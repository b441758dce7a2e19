"""Number functions: null where a result does not exist, never an error or NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round(x: Column, digits: int = 0) -> Column:
    """Half away from zero, as a double."""
    return F.round(x.cast("double"), digits)


def mod(x: Column, y: Column) -> Column:
    """With the sign of x; null for y = 0."""
    return F.try_mod(x, y)


def power(x: Column, y: Column) -> Column:
    return F.power(x, y)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log(x: Column, base: Column | None = None) -> Column:
    """Natural, or to a base; null for x <= 0 and for bases <= 0 or 1."""
    if base is None:
        return ln(x)
    return F.when((base > 0) & (base != 1) & (x > 0), F.ln(x) / F.nullif(F.ln(base), F.lit(0.0)))


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def trunc(x: Column, digits: int = 0) -> Column:
    """Towards zero at a number of decimals, which may be negative; by decimals, so 2.3 stays 2.3."""
    sign, size = F.signum(x.cast("double")), F.abs(x.cast("decimal(38,10)"))
    factor = F.lit(10 ** abs(digits)).cast("decimal(18,0)")
    cut = F.floor(size * factor) / factor if digits >= 0 else F.floor(size / factor) * factor
    return sign * cut.cast("double")


def sign(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("int")


def greatest(*parts: Column) -> Column:
    """The largest that is not null."""
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def least(*parts: Column) -> Column:
    return F.least(*parts) if len(parts) > 1 else parts[0]


def random() -> Column:
    """At least 0 and below 1."""
    return F.rand()
