"""SQL text for generated expressions. One text is parsed in one call to the JVM, where the
same expression built operator by operator needs a call per operator; for hundreds of
columns that is the difference between milliseconds and seconds on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession


def name(column: str) -> str:
    """A column by its literal name; names may hold spaces, slashes or dots."""
    return "`" + column.replace("`", "``") + "`"


def value(x: object) -> str:
    """A literal."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return f"{x}L" if abs(x) > 2**31 - 1 else str(x)
    if isinstance(x, float):
        return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"
    return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"


def rows(records: list[dict[str, str]]) -> str:
    """``inline(array(...))`` of the given records of name -> expression text."""
    structs = (
        "named_struct(" + ", ".join(f"{value(k)}, {v}" for k, v in record.items()) + ")" for record in records
    )
    return "inline(array(" + ", ".join(structs) + "))"


def frame(spark: SparkSession, records: list[dict[str, str]]) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).selectExpr(rows(records))
