"""Scans. Schemas are declared, NaN becomes NULL once, and only the asked columns are read."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.nulls import col, nan_to_null


#: A column, one of COMPARED, and a value that is neither NULL nor NaN.
Comparison = tuple[str, str, Any]
COMPARED = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq}


def _scan(df: DataFrame, columns: Sequence[str] | None, where: Sequence[Comparison]) -> DataFrame:
    """The asked columns of the rows that pass, with NaN as NULL.

    Comparisons stand below the NaN rule, which would keep those on floating columns from the scan, and again
    above it, as only there NaN is missing and passes none. A row that passes above passes below.
    """
    for name, sign, value in where:
        if sign not in COMPARED or value is None or value != value:
            raise ValueError(f"not a comparison a scan can take: {name} {sign} {value}")
    conditions = [COMPARED[sign](col(name), F.lit(value)) for name, sign, value in where]
    for condition in conditions:
        df = df.where(condition)
    df = nan_to_null(df)
    for condition in conditions:
        df = df.where(condition)
    return df.select(*[col(c) for c in columns]) if columns else df


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None, where: Sequence[Comparison] = ()
) -> DataFrame:
    """CSV with a header; only an empty field is missing, codes such as XNA are values."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    return _scan(df, columns, where)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Sequence[Comparison] = ()) -> DataFrame:
    return _scan(spark.read.parquet(path), columns, where)


def read_table_dir(
    spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None, where: Sequence[Comparison] = ()
) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return read_parquet(spark, f"{folder.rstrip('/')}/{name}.parquet", columns, where)


def read_contract(spark: SparkSession, path: str, drop: Sequence[str] = ("TARGET",)) -> T.StructType:
    """The column contract of a stored table, from its footer alone."""
    fields = [f for f in spark.read.parquet(path).schema if f.name not in set(drop)]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def read_history(spark: SparkSession, folder: str, names: Sequence[str], key: str, value: int | None = None) -> dict[str, DataFrame]:
    """History tables by name; with ``value`` only that client's rows, filtered in the scan."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{folder.rstrip('/')}/{name}")
        out[name] = df if value is None else df.where(col(key) == F.lit(value))
    return out


def read_log(
    log: DataFrame,
    since: datetime | None = None,
    status: str | None = None,
    limit: int | None = None,
    ts: str = "created_at",
) -> DataFrame:
    """Log rows, newest first, optionally from a moment on, with one outcome, or only the
    latest ``limit``. The filters reach the scan."""
    if since is not None:
        log = log.where(col(ts) >= F.lit(since))
    if status is not None:
        log = log.where(col("status") == status)
    ordered = log.orderBy(F.desc(ts), F.desc("id"))
    return ordered.limit(limit) if limit is not None else ordered


def stream_parquet(spark: SparkSession, folder: str, name: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """A stream over one table of a folder: one Parquet file, or a directory of part files."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    # A pattern, as a stream takes a lone file only from one.
    return reader.parquet(f"{folder.rstrip('/')}/{{{name}.parquet}}")


def stream_json(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """A stream of raw request bodies, one JSON object per line."""
    reader = spark.readStream
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.text(folder).withColumnRenamed("value", "body")
