"""Small column helpers shared by operators and the query registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(c: Column, digits: int = 6) -> Column:
    """Round a double to ``digits`` decimals as ``round(x * 10^d) / 10^d``.

    The scaled product is rounded half away from zero, the way most SQL
    engines round doubles; Spark's own ``round(x, d)`` instead rounds the exact
    binary expansion, which disagrees on values such as 27.0640625.
    """
    scale = float(10 ** digits)
    return F.round(c * F.lit(scale)) / F.lit(scale)


def md5_key(*parts) -> Column:
    """Deterministic hex order key ``md5(p1:p2:...)``, equal in any SQL engine."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def md5_int(*parts) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of ``md5_key``."""
    return F.conv(F.substring(md5_key(*parts), 1, 8), 16, 10).cast("long")


def stable_round(c: Column, digits: int = 6) -> Column:
    """Round half up with ties a ten-thousandth of a unit lower, for values
    that engines sum in different orders: a mean that falls on a tie up to its
    last bit then rounds alike in all of them."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5001)).cast("double") / F.lit(scale)


def stable_round_sql(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL, for oracle queries."""
    scale = repr(float(10 ** digits))
    return f"(FLOOR(({expr}) * {scale} + 0.5001::DOUBLE) / {scale})"
