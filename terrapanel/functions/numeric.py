"""Small numeric building blocks shared by the column libraries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A Column from a name, a number or a Column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def finite(x) -> Column:
    """NaN and infinities become null, so no later comparison can see them as large numbers."""
    c = col(x).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def clip(x, lo, hi) -> Column:
    """x limited to [lo, hi]; null stays null (least/greatest alone would skip it)."""
    c = col(x)
    return F.when(c.isNotNull(), F.least(F.greatest(c, col(lo)), col(hi)))


def floor0(x) -> Column:
    """max(x, 0) that keeps null."""
    c = col(x)
    return F.when(c < 0.0, F.lit(0.0)).otherwise(c)


def ratio(a, b) -> Column:
    """a / b, null where b is zero."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def rounded(x, places: int = 6) -> Column:
    """Half-up rounding without a negative zero."""
    c = col(x).cast("double")
    return F.when(F.abs(c) < 0.5 * 10.0 ** -places, F.lit(0.0)).otherwise(F.round(c, places))


def all_finite(columns) -> Column:
    """True where every listed column holds a finite number."""
    return reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in columns])


def mix32(*keys, seed: int = 0) -> Column:
    """A 32-bit hash of integer keys: the first eight hex digits of an md5, which any engine repeats."""
    text = F.concat_ws("|", F.lit(str(int(seed))), *[col(k).cast("bigint").cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*keys, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the keys and the seed only."""
    return (mix32(*keys, seed=seed).cast("double") + 0.5) / 4294967296.0
