"""A table read once into counts per column and value, from which its whole profile follows.

One pass of bounded sketches and plain aggregates gives slice edges; a second one reduces the rows to one row per column and
distinct value, which is stored. Missing values, dominance, distinct counts, extremes, exact quantiles, deviations from the
median and outliers are then sums over these counts, ordered slice by slice; the source is not read again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import text
from riskloom.functions.nulls import as_text, numeric_names, ratio
from riskloom.operators.ordered import Edges, add_slice, cumulate, fit_edges, pick_quantiles, wanted_ranks
from riskloom.session import staging_path

#: Numbers whose text follows from their value as a double; the text of others is kept beside it.
PLAIN = (T.DoubleType, T.ByteType, T.ShortType, T.IntegerType)


@dataclass(frozen=True)
class ColumnCounts:
    """``table``: column, slice, value, label, n for every distinct value that is not missing. Numbers have a value and, if their
    text does not follow from it, a label; everything else has a label."""

    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    whole: tuple[str, ...]  # whole numbers without labels
    edges: Edges
    rows: int
    table: DataFrame

    def of(self, names: Sequence[str]) -> DataFrame:
        return self.table.where(F.col("column").isin(list(names)))

    def text(self) -> str:
        """SQL text of a value as text."""
        whole = ", ".join(text.value(c) for c in self.whole) or "NULL"
        return f"coalesce(label, CASE WHEN column IN ({whole}) THEN CAST(CAST(value AS BIGINT) AS STRING) ELSE CAST(value + 0D AS STRING) END)"


def count_columns(df: DataFrame, columns: Sequence[str] | None = None, splits: int | None = None) -> ColumnCounts:
    """The counts of ``columns`` (all of them if not given): two scans of ``df``."""
    columns = list(columns or df.columns)
    numeric = [c for c in numeric_names(df) if c in columns]
    edges = fit_edges(df, numeric, splits)
    plain = {c for c in numeric if isinstance(df.schema[c].dataType, PLAIN)}
    place = {c: i for i, c in enumerate(columns)}
    narrow = df.selectExpr(
        "1 AS one",
        *[f"CAST({text.name(c)} AS DOUBLE) AS v{place[c]}" for c in numeric],
        *[f"{as_text(df, c)} AS t{place[c]}" for c in columns if c not in plain],
    )
    cut = add_slice(narrow, [f"v{place[c]}" for c in numeric], {f"v{place[c]}": edges[c] for c in numeric})
    cells = []
    for c, i in place.items():
        number, label = c in numeric, c not in plain
        cells.append(
            {
                "column": text.value(c),
                "slice": f"v{i}__slice" if number else "CAST(NULL AS INT)",
                "value": f"v{i}" if number else "CAST(NULL AS DOUBLE)",
                "label": f"t{i}" if label else "CAST(NULL AS STRING)",
            }
        )
    # A row of its own counts the rows of the table.
    cells.append({"column": "CAST(NULL AS STRING)", "slice": "CAST(NULL AS INT)", "value": "CAST(NULL AS DOUBLE)", "label": "CAST(NULL AS STRING)"})
    long = cut.selectExpr(text.rows(cells)).where("value is not null or label is not null or column is null")
    counts = long.groupBy("column", "slice", "value", "label").agg(F.count(F.lit(1)).alias("n"))
    path = staging_path(df.sparkSession, "counts")
    counts.write.parquet(path)
    stored = df.sparkSession.read.schema("column string, slice int, value double, label string, n bigint").parquet(path)
    total = stored.where("column is null").agg(F.sum("n")).first()[0] or 0
    whole = tuple(c for c in numeric if c in plain and not isinstance(df.schema[c].dataType, T.DoubleType))
    return ColumnCounts(tuple(columns), tuple(numeric), whole, edges, total, stored.where("column is not null"))


def _listed(counts: ColumnCounts, columns: Sequence[str]) -> DataFrame:
    return text.frame(counts.table.sparkSession, [{"column": text.value(c)} for c in columns])


def missing(counts: ColumnCounts, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n_missing, pct_missing of every column."""
    columns = list(columns or counts.columns)
    present = counts.of(columns).groupBy("column").agg(F.sum("n").alias("n_present"))
    gone = F.lit(counts.rows) - F.coalesce("n_present", F.lit(0))
    return _listed(counts, columns).join(present, "column", "left").select(
        "column", gone.cast("bigint").alias("n_missing"), (F.lit(100.0) * ratio(gone, F.lit(counts.rows))).alias("pct_missing")
    )


def dominant(counts: ColumnCounts, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value per column (the smallest on ties), its share of the non-missing rows, and the number of values."""
    rows = counts.of(list(columns or counts.columns)).selectExpr("column", "value", f"{counts.text()} AS shown", "n")
    # Values that differ only beyond the digits of a double are told apart by their labels and are one number here.
    top = rows.groupBy("column").agg(
        F.min_by("shown", F.struct(-F.col("n"), F.col("value"), F.col("shown"))).alias("dominant_value"),
        F.max("n").alias("dominant_n"),
        F.sum("n").alias("n_present"),
        F.count(F.lit(1)).alias("n_unique"),
    )
    return top.select("column", "dominant_value", ratio(F.col("dominant_n"), F.col("n_present")).alias("dominant_share"), "n_unique")


def key_columns(counts: ColumnCounts, keys: Sequence[str]) -> DataFrame:
    """Per key column: distinct keys, whether unique, mean and largest rows per key."""
    per = counts.of(keys).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("max_rows"))
    whole = F.lit(counts.rows)
    return _listed(counts, keys).join(per, "column", "left").select(
        F.col("column").alias("key"),
        F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"),
        (F.coalesce("n_unique", F.lit(0)) == whole).alias("is_unique"),
        ratio(whole, F.col("n_unique")).alias("mean_rows"),
        "max_rows",
    )


def ranges(counts: ColumnCounts, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column."""
    found = counts.of(columns).groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return _listed(counts, columns).join(found, "column", "left")


def quantiles(table: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """column, n and an exact interpolated quantile per name, from rows (column, slice, value, n)."""
    run = cumulate(table.groupBy("column", "slice", "value").agg(F.sum("n").alias("n")), ["column"], ["n"])
    covered = run.selectExpr("column", "value", "cum_n - n AS from_", "cum_n AS to_")
    totals = table.groupBy("column").agg(F.sum("n").alias("n"))
    # Two wanted ranks per column and quantile, so the values are never dealt by their column.
    return pick_quantiles(covered, F.broadcast(wanted_ranks(totals, ["column"], probs)), ["column"], ["column"], probs)


def away(counts: ColumnCounts, centres: Mapping[str, float]) -> DataFrame:
    """column, slice, value, n of the distances of every value to its column's centre. Slices are cut where the edges lie."""
    folded = {c: np.unique(np.abs(np.array(counts.edges[c]) - m)) for c, m in centres.items()}

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("column").to_pylist(), dtype=object)
            values, cut = batch.column("value").to_numpy(zero_copy_only=False).copy(), np.zeros(len(names), dtype=np.int32)
            for c in set(names):
                here = names == c
                values[here] = np.abs(values[here] - centres[c])
                cut[here] = np.searchsorted(folded[c], values[here], side="right")
            yield pa.RecordBatch.from_arrays([batch.column("column"), pa.array(cut), pa.array(values), batch.column("n")], names=["column", "slice", "value", "n"])

    return counts.of(list(centres)).select("column", "value", "n").mapInArrow(distances, "column string, slice int, value double, n bigint")
