"""Text forms of typed values, and ranks that do not gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, types as T, functions as F

FRACTIONAL = (T.DoubleType, T.FloatType)


def scalar_text(c: Column, dtype: T.DataType) -> Column:
    """A scalar as plain text: whole numbers without a fraction, times in ISO form."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, FRACTIONAL):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        wide = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
        return F.when(whole, c.try_cast("bigint").cast("string")).when(F.abs(c) >= 1e7, wide).otherwise(c.cast("string"))
    if isinstance(dtype, T.DecimalType):
        return F.regexp_replace(c.cast("string"), r"\.0+$", "")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(dtype, T.VariantType):
        return c.cast("string")
    return c.cast("string")


def is_scalar(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))
