"""Lexical forms of scalar values and the filter that decides if a literal is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_STRING = XSD + "string"
XSD_DATE = XSD + "date"
XSD_DOUBLE = XSD + "double"
XSD_BOOLEAN = XSD + "boolean"
XSD_ANY_URI = XSD + "anyURI"

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_STRINGS = (T.StringType, T.VarcharType, T.CharType)
_TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


def double_text(value: Column) -> Column:
    """Shortest decimal text, positional for exponents -4..15, else with ``e``.

    Spark's own cast gives the same digits but turns to scientific notation
    from 1e7 on and below 1e-3; a decimal of enough places lays them out.
    """
    number = value.cast("double")
    size = F.abs(number)
    raw = number.cast("string")
    wide = F.regexp_replace(number.try_cast("decimal(38, 21)").cast("string"), r"(\.\d+?)0+$", "$1")
    scientific = F.replace(raw, F.lit(".0E"), F.lit("E"))
    scientific = F.regexp_replace(scientific, r"E(\d)", "e+$1")
    scientific = F.regexp_replace(scientific, r"E-(\d)$", "e-0$1")
    return (
        F.when((number == 0) | ((size >= 1e-3) & (size < 1e7)), raw)
        .when((size >= 1e-4) & (size < 1e16), wide)
        .when(F.isnan(number), "NaN")
        .when(size == float("inf"), F.when(number > 0, "INF").otherwise("-INF"))
        .otherwise(F.replace(scientific, F.lit("E"), F.lit("e")))
    )


def timestamp_text(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, with six fraction digits only where there are any."""
    fraction = F.date_format(value, "SSSSSS")
    return F.concat(
        F.date_format(value, "yyyy-MM-dd HH:mm:ss"),
        F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
    )


def date_text(text: Column) -> Column:
    """ISO date for ``yyyy-MM-dd`` or ``yyyyMMdd`` text; any other text unchanged."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    return F.coalesce(F.date_format(F.coalesce(iso, compact), "yyyy-MM-dd"), text)


def _plain_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(dtype, _TIMESTAMPS):
        return F.regexp_replace(timestamp_text(value), " ", "T")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return double_text(value)
    return value.cast("string")


def literal_text(value: Column, dtype: T.DataType, datatype: str) -> Column:
    """Lexical form of a column as a literal of ``datatype``."""
    is_text = isinstance(dtype, _STRINGS)
    if datatype == XSD_DATE and is_text:
        return date_text(value)
    if datatype == XSD_DATE and isinstance(dtype, _TIMESTAMPS):
        return F.date_format(value, "yyyy-MM-dd")
    if datatype == XSD_DOUBLE and is_text:
        number = F.when(value.rlike(_NUMBER), F.trim(value).try_cast("double"))
        return F.coalesce(double_text(number), value)
    return _plain_text(value, dtype)


def is_truthy(value: Column, dtype: T.DataType) -> Column:
    """Whether a value makes a literal: not null, not empty, not zero, not false.

    Text is never zero: ``'0'`` and blanks are kept.  NaN is kept.
    """
    if isinstance(dtype, _STRINGS):
        return value.isNotNull() & (value != "")
    if isinstance(dtype, T.BooleanType):
        return value.isNotNull() & value
    if isinstance(dtype, T.NumericType):
        return value.isNotNull() & (value != 0)
    if isinstance(dtype, T.BinaryType):
        return value.isNotNull() & (F.octet_length(value) > 0)
    return value.isNotNull()


def literal_or_null(value: Column, dtype: T.DataType, datatype: str) -> Column:
    """Lexical form where the literal is kept, null where it is not."""
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("string")
    return F.when(is_truthy(value, dtype), literal_text(value, dtype, datatype))
