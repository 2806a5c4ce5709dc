"""Cleaning steps: sentinels, caps, flag sums, missing shares, fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.functions.nulls import col, is_true
from riskloom.operators.ordered import quantile_dict

# Fixed value: the code that stands for "no date" in day-offset columns.
DAY_SENTINEL = 365243


def sentinel_to_flag(df: DataFrame, columns: Sequence[str], sentinel: int = DAY_SENTINEL) -> DataFrame:
    """Add ``<column>_ANOM`` where the sentinel stands and blank it; absent columns are skipped."""
    present = [c for c in columns if c in df.columns]
    changes: dict[str, Column] = {}
    for c in present:
        changes[f"{c}_ANOM"] = is_true(col(c) == sentinel)
        changes[c] = F.when(is_true(col(c) != sentinel), col(c))
    return df.withColumns(changes)


def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel: int = DAY_SENTINEL) -> DataFrame:
    """Blank the sentinel without keeping a flag."""
    return df.withColumns({c: F.when(is_true(col(c) != sentinel), col(c)) for c in columns if c in df.columns})


def sum_flags(df: DataFrame, flags: Sequence[str], into: str = "TOTAL_DOCUMENTS_PROVIDED") -> DataFrame:
    """Replace 0/1 columns by their count; a missing flag counts as zero."""
    count = " + ".join(f"coalesce({text.name(c)}, 0)" for c in flags)
    return df.withColumns({into: F.expr(count)}).drop(*flags)


def cap_flag(value: Column, upper: float | None, lower: float | None) -> Column:
    flag = F.lit(False)
    if upper is not None:
        flag = flag | is_true(value > F.lit(upper))
    if lower is not None:
        flag = flag | is_true(value < F.lit(lower))
    return flag


def cap_value(value: Column, upper: float | None, lower: float | None) -> Column:
    out = value
    if upper is not None:
        out = F.when(is_true(value > F.lit(upper)), F.lit(upper)).otherwise(out)
    if lower is not None:
        out = F.when(is_true(value < F.lit(lower)), F.lit(lower)).otherwise(out)
    return out


def cap_column(
    df: DataFrame,
    column: str,
    upper: float | None = None,
    lower: float | None = None,
    flag_suffix: str = "_CAPPED_FLAG",
) -> DataFrame:
    """Clip to [lower, upper] and flag the rows that lay outside, judged on the raw value."""
    raw = col(column)
    return df.withColumns(
        {f"{column}{flag_suffix}": cap_flag(raw, upper, lower), column: cap_value(raw, upper, lower)}
    )


def missing_share(df: DataFrame, columns: Sequence[str], into: str = "pct_nan_row") -> DataFrame:
    """Share of ``columns`` that is missing in each row. The list is fixed by the caller, so
    the denominator does not depend on which columns happen to be present."""
    present = set(df.columns)
    empty = " + ".join(f"CAST({text.name(c)} IS NULL AS INT)" if c in present else "1" for c in columns)
    return df.withColumns({into: F.expr(f"({empty}) / {float(len(columns))}D")})


def fit_caps(df: DataFrame, quantiles: dict[str, float], approx: bool = False) -> dict[str, float | None]:
    """Cap per column at the given quantile, e.g. ``{"income": 0.995}``."""
    out = {}
    for q in sorted(set(quantiles.values())):
        names = [c for c, v in quantiles.items() if v == q]
        out.update({c: v[0] for c, v in quantile_dict(df, names, [q], approx=approx).items()})
    return out


def fill_median(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Fill missing values with the column's median."""
    medians = quantile_dict(df, columns, [0.5], approx=approx)
    return df.withColumns(
        {c: F.coalesce(col(c).cast("double"), F.lit(medians[c][0]).cast("double")) for c in columns}
    )
