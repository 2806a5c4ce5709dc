"""Seeded samples and folds that do not depend on row order or partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.nulls import col
from riskloom.functions.scalars import SPREAD_RANGE, spread
from riskloom.operators.ordered import numbered


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest keys; a file order does not exist on a cluster."""
    return df.orderBy(col(key)).limit(n)


def top_rows(df: DataFrame, by: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(f"`{by}`"), *[col(t) for t in tie]).limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen uniformly and repeatably by a spread of the key; all rows if there are no more.

    Only rows below a cut, a little more than n, are ordered. Repeated keys lie together and may
    leave too few below it; then all rows are ordered.
    """
    total = df.count()
    if total <= n:
        return df
    order = F.coalesce(spread(col(key), seed), F.lit(0))
    cut = min(SPREAD_RANGE, math.ceil(SPREAD_RANGE * (n + 6 * math.sqrt(n) + 20) / total))
    near = df.where(order < cut)
    if cut < SPREAD_RANGE and near.count() < n:
        near, cut = df, SPREAD_RANGE
    return numbered(near, [], order, cut, [key]).where(F.col("position") < n).drop("position", "group_size")


def stratified_sample(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows with the label shares kept: round-half-up quota per label.

    Only rows below a cut of their label, a little more than its quota, are ordered. Labels are counted first; a label whose
    repeated keys leave too few rows below the cut is taken whole. There are as many cuts as labels, which are few.
    """
    sizes = {r["y"]: r["m"] for r in df.groupBy(col(label).alias("y")).agg(F.count(F.lit(1)).alias("m")).collect()}
    total = sum(m for y, m in sizes.items() if y is not None)
    if not total:
        return df.limit(0)
    # Rows without a label are a group that counts in no share.
    quota = {y: math.floor(n * m / total + 0.5) for y, m in sizes.items()}
    order = F.coalesce(spread(col(key), seed), F.lit(0))

    def by_label(values: dict, otherwise: int) -> Column:
        out = F.lit(otherwise).cast("bigint")
        for y, v in values.items():
            out = F.when(col(label).eqNullSafe(F.lit(y)), F.lit(v).cast("bigint")).otherwise(out)
        return out

    cuts = {y: min(SPREAD_RANGE, math.ceil(SPREAD_RANGE * (q + 6 * math.sqrt(q) + 20) / sizes[y])) for y, q in quota.items()}
    below = df.where(order < by_label(cuts, 0))
    left = {r["y"]: r["m"] for r in below.groupBy(col(label).alias("y")).agg(F.count(F.lit(1)).alias("m")).collect()}
    if short := {y: SPREAD_RANGE for y, q in quota.items() if left.get(y, 0) < min(q, sizes[y])}:
        below = df.where(order < by_label(cuts | short, 0))
    placed = numbered(below, [label], order, SPREAD_RANGE, [key])
    return placed.where(F.col("position") < by_label(quota, 0)).drop("position", "group_size")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42, into: str = "fold") -> DataFrame:
    """Fold number per row; each label is dealt evenly over the folds."""
    placed = numbered(df, [label], spread(col(key), seed), SPREAD_RANGE, [key])
    return placed.withColumn(into, (F.col("position") % F.lit(folds)).cast("int")).drop("position", "group_size")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(col(key)).distinct()
