"""Sinks and table evolution."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.nulls import col, is_true
from riskloom.operators.contract import contract_rows
from riskloom.schemas import LOG_DEFAULTS, LOG_SCHEMA


def write_history(tables: Mapping[str, DataFrame], folder: str, key: str, files: int | None = None) -> None:
    """One Parquet table per aggregate, sorted by client within files so that a lookup by key
    skips row groups."""
    for name, df in tables.items():
        spread_out = df.repartition(files, col(key)) if files else df
        spread_out.sortWithinPartitions(col(key)).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A catalogue table bucketed and sorted by client: joins on the client need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def save_history(tables: Mapping[str, DataFrame], folder: str, key: str, buckets: int) -> dict[str, DataFrame]:
    """Each aggregate below ``folder``, bucketed and sorted by client, and read back so: joins of these tables with rows dealt
    the same way (``rows.repartition(buckets, key)``) move and order nothing of the history. The catalogue names are new ones."""
    out = {}
    for name, df in tables.items():
        table = f"{name}_{uuid.uuid4().hex}"
        rows = df.repartition(buckets, col(key)).write.bucketBy(buckets, key).sortBy(key)
        rows.option("path", f"{folder.rstrip('/')}/{name}").saveAsTable(table)
        out[name] = df.sparkSession.table(table)
    return out


def write_contract(df: DataFrame, path: str) -> None:
    """The ordered column contract as JSON rows."""
    rows = df.sparkSession.createDataFrame(contract_rows(df), "position int, name string, type string")
    rows.coalesce(1).orderBy("position").write.mode("overwrite").json(path)


def write_text(df: DataFrame, text: str, path: str) -> None:
    """Frozen parameters (a small JSON text) on any file system Spark can reach."""
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option(
        "lineSep", "\n"
    ).text(path)


def top_importance(importance: DataFrame, n: int = 30) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def write_top_importance(importance: DataFrame, path: str, n: int = 30) -> None:
    top_importance(importance, n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def log_rows(df: DataFrame, schema: T.StructType = LOG_SCHEMA, defaults: Mapping[str, object] = LOG_DEFAULTS) -> DataFrame:
    """Rows in the log's columns: absent ones missing or defaulted, required ones enforced."""
    have = set(df.columns)
    out = []
    for f in schema:
        if f.name in have:
            value = col(f.name).cast(f.dataType)
        elif f.name == "created_at":
            value = F.current_timestamp()
        else:
            value = F.lit(None).cast(f.dataType)
        if f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]))
        if not f.nullable and f.name != "id":
            value = F.coalesce(value, F.raise_error(F.lit(f"log column {f.name} must not be missing")).cast(f.dataType))
        out.append(value.alias(f.name))
    return df.select(*out)


def append_log(df: DataFrame, folder: str, batch: int) -> None:
    """Append one batch under its own folder; writing the same batch again replaces it, so a
    restarted stream leaves no duplicates. Rows without an id get one from the batch and their own
    fields, without clock times, and equal rows from their count too, so that a replay gives the same ids."""
    own = df.withColumn("own_", F.xxhash64(F.lit(batch), *[col(c) for c in df.columns if c not in ("id", "created_at", "latency_ms")]))
    copy = F.row_number().over(Window.partitionBy("own_").orderBy("own_"))
    number = F.coalesce(F.col("id"), F.xxhash64("own_", copy))
    own.withColumn("id", number).drop("own_").withColumns({"day": F.to_date("created_at")}).write.mode("overwrite").partitionBy("day").parquet(f"{folder.rstrip('/')}/batch={batch}")


def add_columns(df: DataFrame, columns: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add columns that are absent, with their default; present ones are left as they are."""
    return df.withColumns(
        {c: F.lit(default).cast(kind) for c, (kind, default) in columns.items() if c not in df.columns}
    )


def migrate_log(df: DataFrame) -> DataFrame:
    """An older log in today's columns."""
    return add_columns(
        df, {"status": ("string", LOG_DEFAULTS["status"]), "error_type": ("string", None), "origine": ("string", "local")}
    )


def reclassify_origin(df: DataFrame, slower_than: int = 150) -> DataFrame:
    """Slow local calls can only come from production."""
    moved = is_true((F.col("latency_ms") > slower_than) & (F.col("origine") == "local"))
    return df.withColumn("origine", F.when(moved, F.lit("production")).otherwise(F.col("origine")))
