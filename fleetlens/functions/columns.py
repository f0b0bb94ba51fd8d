"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def micros(seconds: ColumnLike) -> Column:
    """Epoch seconds as a double to whole microseconds."""
    return F.round(col(seconds) * F.lit(1e6)).cast("bigint")


def seconds(us: ColumnLike) -> Column:
    return col(us) / F.lit(1e6)


def order_key(at: str, *ties: str) -> Column:
    """``(at, tie)`` packed into one decimal.

    ``max_by(value, struct(at, tie))`` would make Spark sort the input before its partial
    aggregation, since a struct cannot live in a hash-aggregation buffer. A decimal can.
    """
    if not ties:
        return F.col(at)
    (tie,) = ties
    return F.expr(
        f"cast(`{at}` as decimal(18,0)) * cast(10000000000000000000 as decimal(20,0)) + cast(`{tie}` as decimal(19,0))"
    )


def latest(value: ColumnLike, *order: str, where: Column | None = None) -> Column:
    """Value of the last row in ``order``, as an aggregate."""
    key = order_key(*order)
    if where is not None:
        key = F.when(where, key)
    return F.max_by(col(value), key)


def earliest(value: ColumnLike, *order: str, where: Column | None = None) -> Column:
    key = order_key(*order)
    if where is not None:
        key = F.when(where, key)
    return F.min_by(col(value), key)


def finite(value: ColumnLike) -> Column:
    """Whether a number is there, and neither NaN nor infinite."""
    v = col(value).cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def exponent(value: ColumnLike) -> Column:
    """The largest whole number whose power of two is at most a positive double."""
    v = col(value).cast("double")
    near = F.floor(F.log2(v)).cast("int")  # may be one off next to a power of two
    return near + F.when(F.pow(F.lit(2.0), near) > v, -1).when(F.pow(F.lit(2.0), near + 1) <= v, 1).otherwise(0)


def sortable(value: ColumnLike) -> Column:
    """A double as a whole number of the same order: exponent, then fraction. Null for null and NaN.

    Unlike a cast to a decimal it keeps every bit, and unlike a struct it can stand in a hash-aggregation buffer
    together with a tie-break. Values below the smallest normal double count as 0.
    """
    v = col(value).cast("double")
    size = F.abs(v)
    power = exponent(size)
    fraction = (size / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)
    bits = (power + 1023).cast("bigint") * F.lit(1 << 52) + fraction.cast("bigint")
    place = F.when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.2250738585072014e-308, F.lit(0).cast("bigint")).otherwise(bits)
    return F.when(F.isnan(v) | v.isNull(), None).otherwise(F.when(v < 0, -place).otherwise(place))
