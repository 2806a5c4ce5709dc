"""Key joins that keep one row per client."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.nulls import col


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` unchanged, failing at run time if a key occurs twice.

    Only the key is aggregated, by hash; the rows themselves go to the join untouched. All share
    the key's partitioning, and no separate counting job is run.
    """
    counts = df.where(col(key).isNotNull()).groupBy(col(key)).agg(F.count(F.lit(1)).alias("n_"))
    stop = F.raise_error(F.concat(F.lit(f"join would multiply rows: {key} "), col(key).cast("string"))).cast("boolean")
    once = counts.where(F.when(F.col("n_") == 1, F.lit(True)).otherwise(stop)).select(col(key))
    return df.join(once, key).select(*[col(c) for c in df.columns])


def once_in_order(df: DataFrame, key: str) -> DataFrame:
    """As :func:`one_row_per_key`, for joins of many tables in one task: rows are counted in the order by key that the join
    needs too, so that a task holds one sort of the table instead of an aggregate and two sorts."""
    counted = df.where(col(key).isNotNull()).withColumn("n__", F.count(F.lit(1)).over(Window.partitionBy(col(key))))
    stop = F.raise_error(F.concat(F.lit(f"join would multiply rows: {key} "), col(key).cast("string"))).cast("boolean")
    return counted.where(F.when(F.col("n__") == 1, F.lit(True)).otherwise(stop)).select(*[col(c) for c in df.columns])


def left_join_one(df: DataFrame, right: DataFrame, key: str, check: bool = False, salt: int = 1) -> DataFrame:
    """Left join that never multiplies rows; ``check`` is for right sides not grouped by key."""
    left, single, on = salted(df, one_row_per_key(right, key) if check else right, key, salt)
    return left.join(single, on, "left").drop("salt_")


def left_join_all(df: DataFrame, tables: Mapping[str, DataFrame], order: Sequence[str], key: str, check: bool = False) -> DataFrame:
    """Left joins in a fixed order. All share one key, so the left side is shuffled once.
    ``check`` is for tables that were not just grouped by the key, such as stored ones."""
    for name in order:
        df = left_join_one(df, tables[name], key, check)
    return df


def salted(df: DataFrame, right: DataFrame, key: str, salt: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join with each key of ``df`` split into ``salt`` parts and ``right``
    repeated once per part: for a key that holds a large part of ``df``."""
    if salt <= 1:
        return df, right, [key]
    rest = [col(c) for c in df.columns if c != key]
    left = df.withColumn("salt_", F.pmod(F.xxhash64(*rest), F.lit(salt)).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
    return left, right.withColumn("salt_", parts), [key, "salt_"]


def heavy_keys(df: DataFrame, key: str, share: int = 1000) -> list:
    """Keys that hold at least 1/``share`` of the rows, ``share`` of them at most by counting: from a mergeable sketch of
    bounded size, one per task, in one pass over the key alone. Keys a little below the share may be listed, too."""
    tracked = 10 * share
    row = df.select(col(key).alias("k")).where("k is not null").agg(
        F.expr(f"approx_top_k(k, {share}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    return [t["item"] for t in row["top"] or [] if t["count"] * share >= row["n"]]


def heavy_apart(
    df: DataFrame,
    key: str,
    tables: Mapping[str, DataFrame],
    join: Callable[[DataFrame, Mapping[str, DataFrame], bool], DataFrame],
    heavy: Sequence | None = None,
    share: int = 1000,
) -> DataFrame:
    """``join`` twice: for the rows of heavy keys, which stay where they lie and meet a broadcast of those keys' rows, and for
    the rest, which no key dominates and which is shuffled. The third argument of ``join`` says which of the two it is.

    What is broadcast has one row per key and table, ``share`` rows at most; a table that holds a key twice is an error.
    ``heavy`` gives the keys where they are known beforehand, as for a stream.
    """
    keys = heavy_keys(df, key, share) if heavy is None else list(heavy)
    if not keys:
        return join(df, tables, False)
    listed = col(key).isin(keys)
    few = {n: F.broadcast(one_row_per_key(t.where(listed), key)) for n, t in tables.items()}
    rest = join(df.where(~F.coalesce(listed, F.lit(False))), tables, False)
    return rest.unionByName(join(df.where(listed), few, True))


def keep_keys(df: DataFrame, keys: DataFrame, key: str, salt: int = 1) -> DataFrame:
    """Semi join: rows whose key is listed. Adaptive execution splits a hot key at run time;
    ``salt`` splits it beforehand."""
    left, right, on = salted(df, keys.select(col(key)).distinct(), key, salt)
    return left.join(right, on, "left_semi").drop("salt_")


def keep_keys_chained(
    parent: DataFrame, child: DataFrame, keys: DataFrame, key: str, child_key: str
) -> tuple[DataFrame, DataFrame]:
    """Parents of the listed keys, and the children of the parents kept."""
    kept = keep_keys(parent, keys, key)
    return kept, keep_keys(child, kept, child_key)


def unmatched(df: DataFrame, right: DataFrame, key: str, salt: int = 1) -> DataFrame:
    """Rows without a partner."""
    left, keys, on = salted(df, right.select(col(key)).distinct(), key, salt)
    return left.join(keys, on, "left_anti").drop("salt_")


def restore_column(df: DataFrame, original: DataFrame, key: str, column: str, into: str | None = None) -> DataFrame:
    """Bring a column back from its source table, reading only that column and the key."""
    into = into or column
    source = original.select(col(key), col(column).alias(into))
    return df.drop(into).join(one_row_per_key(source, key), key, "left")


def lookup_history(
    df: DataFrame, history: Mapping[str, DataFrame], key: str, found: str = "history_found", heavy: Sequence | None = None
) -> DataFrame:
    """Join every history table, one row per key each, and note whether any of them knows the key.

    Heavy keys of ``df`` are found by a sketch and joined apart (see :func:`heavy_apart`); a stream cannot be asked
    beforehand and takes them from ``heavy``.
    """
    if heavy is None and df.isStreaming:
        heavy = ()

    def join(rows: DataFrame, tables: Mapping[str, DataFrame], hot: bool) -> DataFrame:
        marks = []
        for i, name in enumerate(tables):
            marks.append(f"hit_{i}")
            # A marked copy of a hinted table would lose the hint.
            marked = tables[name].withColumn(marks[-1], F.lit(True))
            rows = rows.join(F.broadcast(marked) if hot else marked, key, "left")
        any_hit = F.lit(False)
        for m in marks:
            any_hit = any_hit | F.coalesce(F.col(m), F.lit(False))
        return rows.withColumn(found, any_hit).drop(*marks)

    return heavy_apart(df, key, history, join, heavy)


def row_total(df: DataFrame, columns: Sequence[str], into: str) -> DataFrame:
    """Add co-located columns, a missing one counting as zero."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(col(c).cast("long"), F.lit(0))
    return df.withColumns({into: total})
