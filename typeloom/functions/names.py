"""Names and text forms of values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def short_name(iri: Column) -> Column:
    """After the last '#', else after the last '/', else the whole text."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def lexical(col: Column, dtype: T.DataType) -> Column:
    """Text of a scalar: plain decimals without trailing zeros, ISO dates and instants, ids as they are."""
    if isinstance(dtype, T.DecimalType):
        text = col.cast("string")
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dtype, T.TimestampType):
        return F.concat(
            F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"),
            F.regexp_replace(F.date_format(col, ".SSSSSS"), r"\.?0+$", ""),
            F.lit("Z"),
        )
    return col.cast("string")
