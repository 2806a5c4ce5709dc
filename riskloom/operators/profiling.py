"""Table profiles: missing values, dominance, keys, summaries, outliers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.functions.nulls import as_text, col, is_true, numeric_names, ratio, string_names
from riskloom.operators import counted
from riskloom.operators.ordered import exact_quantiles, quantile_dict


def _long_stats(df: DataFrame, columns: Sequence[str], stats: dict[str, str]) -> DataFrame:
    """One pass over the table, then one row per column: (n_rows, column, <stat>...). Each
    statistic is SQL text with {x} for the column."""
    wide = df.agg(
        F.expr("count(1) AS n_rows"),
        *[F.expr(f"{t.format(x=text.name(c))} AS {s}_{i}") for i, c in enumerate(columns) for s, t in stats.items()],
    )
    cells = text.rows([{"column": text.value(c), **{s: f"{s}_{i}" for s in stats}} for i, c in enumerate(columns)])
    return wide.selectExpr("n_rows", cells)


def missing_table(df: DataFrame, columns: Sequence[str] | None = None, nonzero: bool = True) -> DataFrame:
    """Missing count and percentage per column, largest first."""
    columns = list(columns or df.columns)
    table = _long_stats(df, columns, {"n_present": "count({x})"})
    out = table.select(
        "column",
        (F.col("n_rows") - F.col("n_present")).alias("n_missing"),
        (F.lit(100.0) * ratio(F.col("n_rows") - F.col("n_present"), F.col("n_rows"))).alias("pct_missing"),
    )
    if nonzero:
        out = out.where("n_missing > 0")
    return out.orderBy(F.desc("pct_missing"), "column")


def high_missing(df: DataFrame, threshold: float = 0.4, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns whose missing rate exceeds the threshold."""
    rate = F.col("pct_missing") / F.lit(100.0)
    return (
        missing_table(df, columns)
        .withColumn("missing_rate", rate)
        .where(F.col("missing_rate") > threshold)
        .select("column", "missing_rate", "n_missing")
    )


def overall_missing_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean missing rate over all columns."""
    return missing_table(df, columns, nonzero=False).agg((F.avg("pct_missing") / 100.0).alias("missing_rate"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row entirely."""
    columns = list(columns or df.columns)
    groups = df.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("m"))
    return groups.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n_duplicates"),
    )


def key_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key column: distinct keys, whether unique, mean and largest rows per key."""
    out = None
    for k in keys:
        per_key = df.groupBy(col(k)).agg(F.count(F.lit(1)).alias("m"))
        part = per_key.agg(
            F.count(col(k)).alias("n_unique"),
            F.sum("m").alias("n_rows"),
            F.max(F.when(col(k).isNotNull(), F.col("m"))).alias("max_rows"),
        ).select(
            F.lit(k).alias("key"),
            "n_unique",
            (F.col("n_unique") == F.col("n_rows")).alias("is_unique"),
            ratio(F.col("n_rows"), F.col("n_unique")).alias("mean_rows"),
            "max_rows",
        )
        out = part if out is None else out.unionByName(part)
    return out


def value_frequency(df: DataFrame, column: str, top: int | None = None, normalize: bool = True) -> DataFrame:
    """Rows per value of one column, most frequent first, with the share of non-missing rows."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        total = counts.agg(F.sum("n").alias("total_")).scalar()
        counts = counts.select("value", "n", ratio(F.col("n"), total).alias("share"))
    ordered = counts.orderBy(F.desc("n"), "value")
    return ordered.limit(top) if top else ordered


def value_counts_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as text, n) over all columns in one pass."""
    cells = text.rows([{"column": text.value(c), "value": as_text(df, c)} for c in columns])
    return df.selectExpr(cells).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def dominant_value(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value per column (the smallest on ties), its share of the non-missing
    rows, and the number of distinct values."""
    columns = list(columns or df.columns)
    counts = value_counts_long(df, columns)
    number = F.when(F.col("column").isin(numeric_names(df)), F.col("value").try_cast("double"))
    top = counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), number, F.col("value"))).alias("dominant_value"),
        F.max("n").alias("dominant_n"),
        F.sum("n").alias("n_present"),
        F.count(F.lit(1)).alias("n_unique"),
    )
    return top.select(
        "column",
        "dominant_value",
        ratio(F.col("dominant_n"), F.col("n_present")).alias("dominant_share"),
        "n_unique",
    ).orderBy(F.desc("dominant_share"), "column")


def quasi_constant(df: DataFrame, threshold: float = 0.99, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns dominated by one value."""
    return dominant_value(df, columns).where(F.col("dominant_share") >= threshold)


def category_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cardinality, mode and mode share of the text columns."""
    return dominant_value(df, list(columns or string_names(df)))


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-missing values per column."""
    if approx:
        table = _long_stats(df, columns, {"n_unique": "approx_count_distinct({x})"})
        return table.select("column", "n_unique")
    return value_counts_long(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mode per column, the smallest value on ties."""
    return dominant_value(df, columns).select("column", "dominant_value", "dominant_share")


def describe(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column."""
    columns = list(columns or numeric_names(df))
    stats = {s: f"{f}(CAST({{x}} AS DOUBLE))" for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))}
    base = _long_stats(df, columns, {"n": "count({x})", **stats})
    if approx:
        q = quantile_dict(df, columns, [0.25, 0.5, 0.75], approx=True)
        quart = text.frame(
            df.sparkSession,
            [
                {"column": text.value(c), **{f"q{i}": f"CAST({text.value(v)} AS DOUBLE)" for i, v in enumerate(q[c])}}
                for c in columns
            ],
        )
    else:
        quart = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).drop("n")
    return base.join(quart, "column", "left").select(
        "column", "n", "mean", "std", "min", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max"
    )


def rate_by_group(df: DataFrame, groups: Sequence[str], label: str) -> DataFrame:
    """Mean label and number of labelled rows per group."""
    return (
        df.where(reduce(and_, [col(g).isNotNull() for g in groups], F.lit(True)))
        .groupBy(*[col(g) for g in groups])
        .agg(F.avg(col(label)).alias("rate"), F.count(col(label)).alias("n"))
    )


def crosstab_share(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Share of each column value within each row value; values are a frozen list."""
    rows = df.where(col(row).isNotNull() & col(column).isNotNull())
    counted = rows.groupBy(col(row)).agg(
        F.count(F.lit(1)).alias("all_"),
        *[F.count_if(col(column).cast("string") == F.lit(v)).alias(f"h{i}") for i, v in enumerate(values)],
    )
    return counted.select(col(row), *[ratio(F.col(f"h{i}"), F.col("all_")).alias(v) for i, v in enumerate(values)])


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column."""
    stats = {f: f"{f}(CAST({{x}} AS DOUBLE))" for f in ("min", "max")}
    return _long_stats(df, columns, stats).select("column", "min", "max")


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive."""
    return df.agg(
        F.count_if(is_true(col(label) == 0)).alias("negatives"), F.count_if(is_true(col(label) == 1)).alias("positives")
    ).select("negatives", "positives", ratio(F.col("negatives"), F.col("positives")).alias("class_ratio"))


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with the number of rows meeting each condition."""
    return df.agg(*[F.count_if(is_true(c)).alias(n) for n, c in conditions.items()])


def profile_table(df: DataFrame, keys: Sequence[str] = (), day_pattern: str = "DAYS") -> dict[str, DataFrame]:
    """All profile tables of one source, each a tidy DataFrame. Three scans: two that count the values of every column, one for
    repeated rows."""
    counts = counted.count_columns(df)
    days = [c for c in counts.numeric if day_pattern in c.upper()]
    missing = counted.missing(counts).where("n_missing > 0").orderBy(F.desc("pct_missing"), "column")
    frequent = counted.dominant(counts)
    out = {
        "missing": missing,
        "duplicates": duplicate_rows(df),
        "dominant": frequent.orderBy(F.desc("dominant_share"), "column"),
        "quasi_constant": frequent.where("dominant_share >= 0.99").orderBy(F.desc("dominant_share"), "column"),
    }
    if keys:
        out["keys"] = counted.key_columns(counts, keys)
    if string_names(df):
        out["categories"] = counted.dominant(counts, string_names(df)).orderBy(F.desc("dominant_share"), "column")
    if days:
        out["day_ranges"] = counted.ranges(counts, days)
    return out


# --- outliers ---------------------------------------------------------------------------


@dataclass(frozen=True)
class OutlierBounds:
    """Frozen limits of one column; ``mad`` of zero switches the z-score off."""

    column: str
    lower: float
    upper: float
    median: float
    mad: float


def fit_outlier_bounds(
    df: DataFrame, columns: Sequence[str] | None = None, iqr_multiplier: float = 3.0, splits: int | None = None
) -> list[OutlierBounds]:
    """Limits per column; columns with at most two values or no inter-quartile range are left
    out. The table is read twice, to count the values of every column."""
    return outlier_bounds(counted.count_columns(df, list(columns or numeric_names(df)), splits), iqr_multiplier)


def outlier_bounds(counts: counted.ColumnCounts, iqr_multiplier: float = 3.0) -> list[OutlierBounds]:
    """The limits from counts: quartiles and median, then the median of the distances to it."""
    table = counts.of(counts.numeric)
    quarters = counted.quantiles(table, {"q0": 0.25, "q1": 0.5, "q2": 0.75})
    # Values that are one double count once.
    several = table.select("column", "value").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("m")).where("m > 2")
    first = {r["column"]: r for r in quarters.join(several, "column").collect() if r["q2"] - r["q0"] != 0}
    if not first:
        return []
    mads = {r["column"]: r["mad"] for r in counted.quantiles(counted.away(counts, {c: r["q1"] for c, r in first.items()}), {"mad": 0.5}).collect()}
    out = []
    for c in counts.numeric:
        if c in first:
            r = first[c]
            spread = r["q2"] - r["q0"]
            out.append(OutlierBounds(c, r["q0"] - iqr_multiplier * spread, r["q2"] + iqr_multiplier * spread, r["q1"], mads[c]))
    return out


# Fixed value: scales the median absolute deviation to a standard deviation.
MAD_SCALE = 0.6745


def _flag_text(bounds: OutlierBounds, method: str, z: float) -> str:
    x = f"CAST({text.name(bounds.column)} AS DOUBLE)"
    iqr = f"coalesce({x} < {text.value(float(bounds.lower))} OR {x} > {text.value(float(bounds.upper))}, false)"
    mod = "false"
    if bounds.mad != 0:
        score = f"{MAD_SCALE}D * ({x} - {text.value(float(bounds.median))}) / {text.value(float(bounds.mad))}"
        mod = f"coalesce(abs({score}) > {text.value(float(z))}, false)"
    return {"iqr": iqr, "modified_z": mod, "both": f"({iqr} AND {mod})"}[method]


def outlier_flag(bounds: OutlierBounds, method: str = "both", z: float = 3.5) -> Column:
    """Row condition for one column: 'iqr', 'modified_z' or 'both'."""
    return F.expr(_flag_text(bounds, method, z))


OUTLIERS = (
    "column string, n_outliers_iqr long, n_outliers_modified_z long, n_outliers_both_methods long, "
    "pct_agreement double, min double, max double"
)


def outlier_report(df: DataFrame, bounds: Sequence[OutlierBounds], z: float = 3.5) -> DataFrame:
    """Flagged rows per column and method, agreement of the two methods, and the range."""
    if not bounds:
        return df.sparkSession.createDataFrame([], OUTLIERS)
    aggregates, records = [], []
    for i, b in enumerate(bounds):
        x = f"CAST({text.name(b.column)} AS DOUBLE)"
        for short, method in (("iqr", "iqr"), ("mod", "modified_z"), ("both", "both")):
            aggregates.append(f"count_if({_flag_text(b, method, z)}) AS {short}{i}")
        aggregates += [f"min({x}) AS min{i}", f"max({x}) AS max{i}"]
        records.append({"column": text.value(b.column), **{s: f"{s}{i}" for s in ("iqr", "mod", "both", "min", "max")}})
    return _outliers(df.agg(*[F.expr(a) for a in aggregates]).selectExpr(text.rows(records)))


def counted_outliers(counts: counted.ColumnCounts, bounds: Sequence[OutlierBounds], z: float = 3.5) -> DataFrame:
    """The same report from counts, without the table."""
    spark = counts.table.sparkSession
    if not bounds:
        return spark.createDataFrame([], OUTLIERS)
    limits = text.frame(
        spark, [{"column": text.value(b.column), **{k: f"CAST({text.value(float(getattr(b, k)))} AS DOUBLE)" for k in ("lower", "upper", "median", "mad")}} for b in bounds]
    )
    rows = counts.of([b.column for b in bounds]).join(F.broadcast(limits), "column")  # a row per column
    iqr = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    mod = (F.col("mad") != 0) & (F.abs(F.lit(MAD_SCALE) * (F.col("value") - F.col("median")) / F.nullif("mad", F.lit(0.0))) > z)
    held = {"iqr": iqr, "mod": is_true(mod), "both": iqr & is_true(mod)}
    sums = [F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(s) for s, hit in held.items()]
    return _outliers(rows.groupBy("column").agg(*sums, F.min("value").alias("min"), F.max("value").alias("max")))


def _outliers(found: DataFrame) -> DataFrame:
    return (
        found.selectExpr(
            "column",
            "iqr AS n_outliers_iqr",
            "mod AS n_outliers_modified_z",
            "both AS n_outliers_both_methods",
            "100D * both / CAST(greatest(iqr, mod, 1) AS DOUBLE) AS pct_agreement",
            "min",
            "max",
        )
        .where("n_outliers_iqr > 0 or n_outliers_modified_z > 0")
        .orderBy(F.desc("n_outliers_both_methods"), "column")
    )


def flagged_rows(df: DataFrame, bounds: OutlierBounds, method: str = "both", z: float = 3.5) -> DataFrame:
    return df.where(outlier_flag(bounds, method, z))


def outliers_per_row(
    df: DataFrame, bounds: Sequence[OutlierBounds], into: str = "n_outliers_row", z: float = 3.5
) -> DataFrame:
    """Number of columns in which both methods flag the row, with frozen bounds."""
    hits = [f"CAST({_flag_text(b, 'both', z)} AS INT)" for b in bounds]
    return df.withColumns({into: F.expr(" + ".join(["0", *hits]))})


def scan_anomalies(
    df: DataFrame,
    iqr_multiplier: float = 3.0,
    modified_z_threshold: float = 3.5,
    constant_threshold: float = 0.99,
    missing_threshold: float = 0.4,
) -> dict[str, DataFrame]:
    """The three anomaly reports of one table, which is read twice."""
    counts = counted.count_columns(df)
    high = counted.missing(counts).select("column", (F.col("pct_missing") / F.lit(100.0)).alias("missing_rate"), "n_missing")
    return {
        "outliers": counted_outliers(counts, outlier_bounds(counts, iqr_multiplier), modified_z_threshold),
        "quasi_constant": counted.dominant(counts).where(F.col("dominant_share") >= constant_threshold).orderBy(F.desc("dominant_share"), "column"),
        "high_missing": high.where(F.col("missing_rate") > missing_threshold).orderBy(F.desc("missing_rate"), "column"),
    }
