"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_to(x: Column, places: int = 3) -> Column:
    """Cut down to so many decimals (towards minus infinity)."""
    p = 10.0**places
    return F.floor(x * p).cast("double") / p


def floor_all(xs: Column, places: int = 3) -> Column:
    return F.transform(xs, lambda x: floor_to(x, places))


def round_to(x: Column, places: int = 3) -> Column:
    """Round on the double's exact value; exact ties go to the even digit.

    The scaled value is itself rounded, so where it looks like a tie its exact
    error decides, by splitting both factors into halves of 26 bits.
    """
    scale = 10.0**places
    cut = 134217729.0  # 2 ** 27 + 1
    high_s = cut * scale - (cut * scale - scale)
    low_s = scale - high_s
    high_x = F.lit(cut) * x - (F.lit(cut) * x - x)
    low_x = x - high_x
    p = x * scale
    error = ((high_x * high_s - p) + high_x * low_s + low_x * high_s) + low_x * low_s
    below = F.floor(p).cast("double")
    over = p - below - 0.5
    odd = F.pmod(below, F.lit(2.0)) == 1
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & odd)))
    return F.when(F.abs(x) >= 1e15 / scale, x).otherwise((below + up.cast("int")) / scale)


def round_all(xs: Column, places: int = 3) -> Column:
    return F.transform(xs, lambda x: round_to(x, places))


def round_struct(schema, places: int = 5):
    """A function from a column of that type to the column with every float in it rounded."""
    from pyspark.sql import types as T

    if isinstance(schema, (T.DoubleType, T.FloatType)):
        return lambda c: round_to(c, places)
    if isinstance(schema, T.ArrayType):
        inner = round_struct(schema.elementType, places)
        return lambda c: F.transform(c, inner)
    if isinstance(schema, T.MapType):
        inner = round_struct(schema.valueType, places)
        return lambda c: F.transform_values(c, lambda _, v: inner(v))
    if isinstance(schema, T.StructType):
        parts = [(f.name, round_struct(f.dataType, places)) for f in schema.fields]
        return lambda c: F.when(c.isNotNull(), F.struct(*[g(c[n]).alias(n) for n, g in parts]))
    return lambda c: c


def least_known(a: Column, b: Column) -> Column:
    """The smaller of two, or the one that isn't null."""
    return F.least(a, b)


def greatest_known(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def is_nan(x: Column) -> Column:
    return F.coalesce(F.isnan(x), F.lit(False))


def same(a: Column, b: Column) -> Column:
    """Equal, where NaN equals NaN and null equals null."""
    return a.eqNullSafe(b)


def largest_or_zero(xs: Column) -> Column:
    return F.coalesce(F.array_max(xs), F.lit(0.0))


def is_sorted(xs: Column, falling: bool = False) -> Column:
    """Whether an array is in order (a null one is)."""
    ordered = F.array_sort(xs)
    return F.coalesce(xs == (F.reverse(ordered) if falling else ordered), F.lit(True))
