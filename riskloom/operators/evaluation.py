"""Model quality from (label, score) rows, exact under ties and without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.nulls import col, is_true, ratio
from riskloom.operators.binning import bucketize
from riskloom.operators.ordered import add_slice, cumulate, fit_edges

# Cost of a missed default and of a wrongly refused client, and the grid of
# thresholds in hundredths.
COST_MISSED = 10
COST_REFUSED = 1
GRID_HUNDREDTHS = range(10, 91)


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), splits: int | None = None) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs ranked rightly, ties
    counting half. Rows become counts per distinct score, summed along ordered slices."""
    rows = df.where(col(label).isNotNull() & col(score).isNotNull()).select(
        *[col(b) for b in by], col(label).alias("y"), col(score).cast("double").alias("value")
    )
    edges = fit_edges(rows, ["value"], splits)
    counts = (
        add_slice(rows, ["value"], edges)
        .withColumnRenamed("value__slice", "slice")
        .groupBy(*by, "slice", "value")
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    )
    run = cumulate(counts, list(by), ["pos", "neg"])
    below = F.col("cum_neg") - F.col("neg")
    won = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / F.lit(2.0)))
    grouped = run.groupBy(*by).agg(
        won.alias("won"), F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg")
    )
    return grouped.select(
        *by, "n_pos", "n_neg", ratio(F.col("won"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc")
    )


def _cells(label: Column, predicted: Column) -> dict[str, Column]:
    y = is_true(label == 1)
    return {
        "tp": F.count_if(y & predicted),
        "fp": F.count_if(~y & predicted),
        "fn": F.count_if(y & ~predicted),
        "tn": F.count_if(~y & ~predicted),
    }


def confusion(df: DataFrame, label: str, score: str, threshold: float, inclusive: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """The four cells at a threshold: one row, or one per group."""
    hit = col(score) >= F.lit(threshold) if inclusive else col(score) > F.lit(threshold)
    rows = df.where(col(label).isNotNull() & col(score).isNotNull())
    return rows.groupBy(*[col(b) for b in by]).agg(*[c.alias(n) for n, c in _cells(col(label), is_true(hit)).items()])


def class_metrics(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, inclusive: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall, F1, F2 and business cost at a threshold, of all rows or per group."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision = F.coalesce(ratio(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(ratio(tp, tp + fn), F.lit(0.0))

    def f_beta(beta: float) -> Column:
        b2 = beta * beta
        return F.coalesce(ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp), F.lit(0.0))

    return confusion(df, label, score, threshold, inclusive, by).select(
        *[col(b) for b in by],
        "tp",
        "fp",
        "fn",
        "tn",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f_beta(1).alias("f1"),
        f_beta(2).alias("f2"),
        (F.lit(COST_MISSED) * F.col("fn") + F.lit(COST_REFUSED) * F.col("fp")).alias("cost"),
    )


def business_cost(
    df: DataFrame, label: str, predicted: str, cost_fn: int = COST_MISSED, cost_fp: int = COST_REFUSED
) -> DataFrame:
    """Cost of 0/1 predictions."""
    c = _cells(col(label), is_true(col(predicted) == 1))
    return df.agg((F.lit(cost_fn) * c["fn"] + F.lit(cost_fp) * c["fp"]).alias("cost"))


def threshold_sweep(
    df: DataFrame,
    label: str,
    score: str,
    hundredths: Sequence[int] = GRID_HUNDREDTHS,
    cost_fn: int = COST_MISSED,
    cost_fp: int = COST_REFUSED,
) -> DataFrame:
    """Cost at every threshold of the grid from one pass over the rows.

    Rows are counted per gap between two thresholds; the window runs over one row per gap.
    """
    grid = [h / 100 for h in hundredths]
    rows = df.where(col(label).isNotNull() & col(score).isNotNull()).select(
        col(label).alias("y"), col(score).cast("double").alias("s")
    )
    counts = bucketize(rows, "s", grid, "gap").groupBy("gap").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    steps = df.sparkSession.range(len(grid) + 1).select(F.col("id").cast("int").alias("gap"))
    filled = steps.join(counts, "gap", "left").select(
        "gap", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg")
    )
    up = Window.partitionBy(F.lit(0)).orderBy("gap").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(F.lit(0)).orderBy("gap").rowsBetween(0, Window.unboundedFollowing)
    swept = filled.select(
        "gap", F.coalesce(F.sum("pos").over(up), F.lit(0)).alias("fn"), F.sum("neg").over(down).alias("fp")
    ).where("gap > 0")
    values = F.array(*[F.lit(g) for g in grid])
    return swept.select(
        F.get(values, F.col("gap") - 1).alias("threshold"),
        "fn",
        "fp",
        (F.lit(cost_fn) * F.col("fn") + F.lit(cost_fp) * F.col("fp")).alias("cost"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Cheapest threshold, the smallest on ties."""
    return sweep.agg(F.min(F.struct("cost", "threshold")).alias("b")).select(
        F.col("b.threshold").alias("threshold"), F.col("b.cost").alias("cost")
    )


def refusal_share(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Share of rows scored above the threshold."""
    return df.agg(F.avg(is_true(col(score) > F.lit(threshold)).cast("int")).alias("refusal_rate"))


def extremes(df: DataFrame, key: str, score: str) -> DataFrame:
    """Keys with the highest and the lowest score, the smaller key on ties."""
    return df.where(col(score).isNotNull()).agg(
        F.min_by(col(key), F.struct(-col(score), col(key))).alias("highest"),
        F.min_by(col(key), F.struct(col(score), col(key))).alias("lowest"),
        F.max(col(score)).alias("highest_score"),
        F.min(col(score)).alias("lowest_score"),
    )
