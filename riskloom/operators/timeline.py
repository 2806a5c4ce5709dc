"""Event-time series of the prediction log and its headline figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.nulls import col, is_true, ratio
from riskloom.functions.scalars import REFUSED
from riskloom.operators.ordered import exact_quantiles

SUCCESS = "succes"


def bucket_start(ts: str, width: str) -> Column:
    return F.window(col(ts), width).getField("start")


def fill_buckets(series: DataFrame, width: str, zero: Sequence[str] = ()) -> DataFrame:
    """Add the empty buckets between the first and the last; ``zero`` columns get 0 there.

    The frame of buckets is built from the series itself, which has one row per bucket.
    """
    ends = series.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    frame = ends.select(F.explode(F.expr(f"sequence(lo, hi, INTERVAL {width})")).alias("bucket"))
    rest = [c for c in series.columns if c != "bucket"]
    return frame.join(series, "bucket", "left").select(
        "bucket", *[F.coalesce(col(c), F.lit(0)).alias(c) if c in zero else col(c) for c in rest]
    )


def volume(df: DataFrame, ts: str, width: str) -> DataFrame:
    """Calls per bucket, empty buckets included."""
    counted = df.groupBy(bucket_start(ts, width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return fill_buckets(counted, width, ["n"])


def rate(df: DataFrame, ts: str, width: str, condition: Column, into: str) -> DataFrame:
    """Share of rows meeting the condition per bucket; empty buckets have no rate."""
    counted = df.groupBy(bucket_start(ts, width).alias("bucket")).agg(F.avg(is_true(condition).cast("int")).alias(into))
    return fill_buckets(counted, width)


def error_rate(df: DataFrame, ts: str, width: str, status: str = "status", success: str = SUCCESS) -> DataFrame:
    return rate(df, ts, width, col(status) != success, "error_rate")


def refusal_rate(df: DataFrame, ts: str, width: str, decision: str = "decision", refused: str = REFUSED) -> DataFrame:
    return rate(df, ts, width, col(decision) == refused, "refusal_rate")


def latency_quantiles(df: DataFrame, ts: str, latency: str, width: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per bucket, empty buckets included; one busy bucket is spread over
    slices of the value range."""
    rows = df.select(bucket_start(ts, width).alias("bucket"), col(latency))
    q = exact_quantiles(rows, [latency], list(probs.values()), by=["bucket"])
    return fill_buckets(q.select("bucket", *[F.col(f"q{i}").alias(n) for i, n in enumerate(probs)]), width)


def to_long(series: DataFrame, columns: Sequence[str], name: str = "measure", value: str = "ms") -> DataFrame:
    return series.unpivot(["bucket"], list(columns), name, value)


def group_share(df: DataFrame, group: str, column: str, into: str = "share") -> DataFrame:
    """Rows per (group, value) and their share of the group."""
    counts = df.where(col(column).isNotNull()).groupBy(col(group), col(column)).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(col(group)).agg(F.sum("n").alias("total_"))
    return counts.join(totals, group).withColumn(into, ratio(F.col("n"), F.col("total_"))).drop("total_")


def headline(
    df: DataFrame,
    status: str = "status",
    decision: str = "decision",
    latency: str = "latency_ms",
    known: str = "history_found",
    success: str = SUCCESS,
    refused: str = REFUSED,
) -> DataFrame:
    """One row: calls, error rate, refusal rate, median latency, share of known clients."""
    ok = is_true(col(status) == success)
    base = df.agg(
        F.count(F.lit(1)).alias("calls"),
        ratio(F.count_if(~ok), F.count(F.lit(1))).alias("error_rate"),
        ratio(F.count_if(ok & is_true(col(decision) == refused)), F.count_if(ok)).alias("refusal_rate"),
        ratio(F.count_if(ok & is_true(col(known))), F.count_if(ok & col(known).isNotNull())).alias("known_share"),
    )
    middle = exact_quantiles(df.where(col(status) == success), [latency], [0.5]).select("q0").scalar()
    return base.select("calls", "error_rate", "refusal_rate", middle.alias("median_latency"), "known_share")


def errors_by_type(df: DataFrame, status: str = "status", error: str = "error_type", success: str = SUCCESS) -> DataFrame:
    return (
        df.where((col(status) != success) & col(error).isNotNull())
        .groupBy(col(status), col(error))
        .agg(F.count(F.lit(1)).alias("calls"))
        .orderBy(F.desc("calls"), col(status), col(error))
    )


def before_after(
    df: DataFrame, ts: str, switch: Column, latency: str = "latency_ms", labels: Sequence[str] = ("avant", "apres")
) -> DataFrame:
    """Latency before and after a release: calls, minimum, median and 95th percentile."""
    rows = df.select(
        F.when(col(ts) < switch, F.lit(labels[0])).otherwise(F.lit(labels[1])).alias("version"), col(latency)
    )
    counts = rows.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.min(col(latency)).alias("min_ms"))
    q = exact_quantiles(rows, [latency], [0.5, 0.95], by=["version"])
    return (
        counts.join(q.select("version", "q0", "q1"), "version", "left")
        .select(
            "version",
            "n",
            F.round("min_ms", 0).alias("min_ms"),
            F.round("q0", 0).alias("median_ms"),
            F.round("q1", 0).alias("p95_ms"),
        )
        .orderBy(F.desc("version"))
    )
