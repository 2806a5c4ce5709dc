"""Missing-value rules shared by every operator: NULL is the only missing marker.

Sources turn NaN into NULL once, so aggregates skip missing values; the helpers below
cover the places where SQL's NULL rules differ from "skip what is missing".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import text

FLOATING = (T.DoubleType, T.FloatType)


def col(name: str) -> Column:
    """A column by its literal name; names may hold spaces, slashes or dots."""
    return F.col(text.name(name))


def numeric_names(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_names(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def boolean_names(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType) and f.name not in skip]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, in one projection."""
    return df.withColumns(
        {f.name: F.expr(f"nanvl({text.name(f.name)}, NULL)") for f in df.schema if isinstance(f.dataType, FLOATING)}
    )


def replace_infinities(df: DataFrame) -> DataFrame:
    """Plus and minus infinity become NULL in every floating column."""
    finite = "CASE WHEN abs({0}) <> double('inf') THEN {0} END"
    return df.withColumns(
        {f.name: F.expr(finite.format(text.name(f.name))) for f in df.schema if isinstance(f.dataType, FLOATING)}
    )


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double; a zero denominator gives NULL instead of an error."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def is_true(condition: Column) -> Column:
    """A comparison in which a missing operand counts as false."""
    return F.coalesce(condition, F.lit(False))


def sum_or_zero(column: Column) -> Column:
    """Group sum in which an all-missing group gives zero."""
    total = F.sum(column)
    return F.coalesce(total, F.lit(0))


def numeric_or_null(column: Column) -> Column:
    """Text to double; anything unparsable becomes NULL."""
    return F.nanvl(column.try_cast("double"), F.lit(None))


def as_text(df: DataFrame, name: str) -> str:
    """SQL text of a column's values as text; the two floating zeros give the same text."""
    zero = " + 0D" if isinstance(df.schema[name].dataType, FLOATING) else ""
    return f"CAST({text.name(name)}{zero} AS STRING)"
