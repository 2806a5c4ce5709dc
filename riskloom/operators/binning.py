"""Bins, histograms and densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.functions.nulls import col
from riskloom.operators.ordered import quantile_dict


def equal_width_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Edges of equal-width bins; the lowest is moved down by 0.1 % of the range so that the
    smallest value falls inside its right-closed bin."""
    r = df.agg(F.min(col(column).cast("double")).alias("lo"), F.max(col(column).cast("double")).alias("hi")).first()
    if r["lo"] is None:
        return []
    lo, hi = r["lo"], r["hi"]
    if lo == hi:
        pad = 0.001 * abs(lo) if lo != 0 else 0.001
        lo, hi = lo - pad, hi + pad
        return [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    edges = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    edges[0] -= 0.001 * (hi - lo)
    edges[-1] = hi
    return edges


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Edges of quantile bins, repeated edges dropped."""
    values = quantile_dict(df, [column], [i / bins for i in range(bins + 1)])[column]
    return sorted({v for v in values if v is not None})


def right_closed_bin(df: DataFrame, column: str, edges: Sequence[float], into: str, lowest: bool = False) -> DataFrame:
    """Add the 1-based number of the right-closed bin (e[i-1], e[i]]; outside is missing.
    ``lowest`` closes the first bin on the left as well."""
    x = f"CAST({text.name(column)} AS DOUBLE)"
    below = f"{x} {'<' if lowest else '<='} {text.value(edges[0])}"
    steps = " ".join(f"WHEN {x} <= {text.value(e)} THEN {i}" for i, e in enumerate(edges[1:], start=1))
    return df.withColumns({into: F.expr(f"CASE WHEN {x} IS NULL OR {below} THEN NULL {steps} END")})


def fixed_histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts over equal bins of a fixed range, the last bin closed, empty bins present."""
    x = col(column).cast("double")
    place = F.least(F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)) - 1
    counted = df.where((x >= low) & (x <= high)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), (F.lit(float(low)) + F.col("id") * F.lit((high - low) / bins)).alias("bin_start")
    )
    return frame.join(counted, "bin", "left").select("bin", "bin_start", F.coalesce("n", F.lit(0)).alias("n"))


def compared_density(
    reference: DataFrame, current: DataFrame, column: str, bins: int = 60, labels: Sequence[str] = ("reference", "current")
) -> DataFrame:
    """Densities of two samples over common equal bins: (bin, center, density, source)."""
    both = reference.select(col(column).cast("double").alias("x"), F.lit(labels[0]).alias("source")).unionByName(
        current.select(col(column).cast("double").alias("x"), F.lit(labels[1]).alias("source"))
    ).where("x is not null")
    # The pooled range and the two sample sizes: one row on the driver.
    head = both.agg(
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        *[F.count_if(F.col("source") == label).alias(f"n{i}") for i, label in enumerate(labels)],
    ).first()
    lo, hi = head["lo"], head["hi"]
    spark = reference.sparkSession
    if lo is None or lo == hi:
        return spark.createDataFrame([], "bin int, center double, density double, source string")
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = both.groupBy("source", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = spark.range(bins * len(labels)).select(
        (F.col("id") % bins).cast("int").alias("bin"),
        F.get(F.array(*[F.lit(x) for x in labels]), F.floor(F.col("id") / bins).cast("int")).alias("source"),
        F.get(F.array(*[F.lit(head[f"n{i}"]) for i in range(len(labels))]), F.floor(F.col("id") / bins).cast("int")).alias("total"),
    )
    return frame.join(counts, ["source", "bin"], "left").select(
        "bin",
        (F.lit(lo) + (F.col("bin") + F.lit(0.5)) * F.lit(width)).alias("center"),
        F.try_divide(F.coalesce("n", F.lit(0)), F.col("total") * F.lit(width)).alias("density"),
        "source",
    )


def bucketize(df: DataFrame, column: str, edges: Sequence[float], into: str) -> DataFrame:
    """Left-closed bins between infinite ends by binary search: 0 below the first edge."""
    inf = float("inf")
    out = Bucketizer(splits=[-inf, *edges, inf], inputCol=column, outputCol=into, handleInvalid="keep").transform(df)
    return out.withColumn(into, col(into).cast("int"))
