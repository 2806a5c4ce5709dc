"""Drift of current rows against a fixed reference sample."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import text
from riskloom.functions.nulls import as_text, col, ratio
from riskloom.operators.cleaning import sentinel_to_null
from riskloom.operators.contract import coerce_numeric, populated_columns, union_labelled
from riskloom.operators.ordered import Edges, cumulate, fit_edges, melt_sliced, union_edges
from riskloom.operators.sampling import seeded_sample
from riskloom.operators.timeline import group_share

# The drift cut-off, the smallest usable sample and the sample size below
# which a finding is only a warning.
DRIFT_THRESHOLD = 0.1
MIN_ROWS = 2
WARN_ROWS = 500
MIN_SPREAD = 0.001


def build_reference(
    df: DataFrame, key: str, columns: Sequence[str], n: int = 10000, seed: int = 42, sentinels: Sequence[str] = ()
) -> DataFrame:
    """Seeded sample of the logged columns with sentinels blanked."""
    return sentinel_to_null(seeded_sample(df.select(*[col(c) for c in columns]), key, n, seed), sentinels)


def column_roles(reference: DataFrame, exclude: Sequence[str] = ("SK_ID_CURR",)) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns; the reference decides, the key is left out."""
    fields = [f for f in reference.schema if f.name not in set(exclude)]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in fields if f.name not in numeric]


def prepare_current(reference: DataFrame, current: DataFrame, exclude: Sequence[str] = ("SK_ID_CURR",)):
    """Typed current rows and the columns that can be compared on them."""
    numeric, categorical = column_roles(reference, exclude)
    present = set(current.columns)
    numeric = [c for c in numeric if c in present]
    categorical = [c for c in categorical if c in present]
    typed = coerce_numeric(current, numeric)
    filled = set(populated_columns(typed, [*numeric, *categorical]))
    return typed, [c for c in numeric if c in filled], [c for c in categorical if c in filled]


def wasserstein(reference: DataFrame, current: DataFrame, columns: Sequence[str], splits: int | None = None) -> DataFrame:
    """First Wasserstein distance per column in units of the reference's standard deviation.

    Both samples are reduced to counts per distinct value and summed along the ordered
    values in slices, so no column is ever ordered in one task.
    """
    # Edges of both samples: a shifted sample must not fall into one slice.
    edges = union_edges(fit_edges(reference, columns, splits), fit_edges(current, columns, splits))
    ref = melt_sliced(reference, columns, edges).withColumns({"r": F.lit(1), "c": F.lit(0)})
    cur = melt_sliced(current, columns, edges).withColumns({"r": F.lit(0), "c": F.lit(1)})
    counts = ref.unionByName(cur).groupBy("column", "slice", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    run = cumulate(counts, ["column"], ["r", "c"], next_value=True)
    gap = F.abs(ratio(F.col("cum_r"), F.col("all_r")) - ratio(F.col("cum_c"), F.col("all_c")))
    area = run.groupBy("column").agg(F.sum(gap * (F.col("next_value") - F.col("value"))).alias("area"))
    scale = reference.agg(
        *[F.expr(f"stddev_pop(CAST({text.name(c)} AS DOUBLE)) AS s{i}") for i, c in enumerate(columns)]
    ).selectExpr(text.rows([{"column": text.value(c), "std": f"s{i}"} for i, c in enumerate(columns)]))
    return area.join(scale, "column").select(
        "column",
        F.lit("wasserstein").alias("method"),
        (F.coalesce("area", F.lit(0.0)) / F.greatest(F.col("std"), F.lit(MIN_SPREAD))).alias("score"),
    )


def jensen_shannon(reference: DataFrame, current: DataFrame, columns: Sequence[str], base: float = 2.0) -> DataFrame:
    """Jensen-Shannon distance of the category shares per column."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        cells = text.rows([{"column": text.value(c), "value": as_text(df, c)} for c in columns])
        long = df.selectExpr(cells).where("value is not null")
        return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias(name))

    both = counts(reference, "r").join(counts(current, "c"), ["column", "value"], "full")
    totals = both.groupBy("column").agg(F.sum("r").alias("all_r"), F.sum("c").alias("all_c"))
    p = F.coalesce(ratio(F.col("r"), F.col("all_r")), F.lit(0.0))
    q = F.coalesce(ratio(F.col("c"), F.col("all_c")), F.lit(0.0))
    shares = both.join(totals, "column").select("column", p.alias("p"), q.alias("q"))
    m = (F.col("p") + F.col("q")) / 2

    def part(x: str):
        return F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(F.lit(0.0))

    div = F.sum(part("p") + part("q")) / F.lit(2.0) / F.ln(F.lit(float(base)))
    return shares.groupBy("column").agg(F.sqrt(F.greatest(F.lit(0.0), div)).alias("score")).select(
        "column", F.lit("jensenshannon").alias("method"), "score"
    )


def drift_detail(
    reference: DataFrame,
    current: DataFrame,
    threshold: float = DRIFT_THRESHOLD,
    exclude: Sequence[str] = ("SK_ID_CURR",),
    splits: int | None = None,
) -> DataFrame:
    """Per column: method, score, threshold and whether it drifted, worst first."""
    typed, numeric, categorical = prepare_current(reference, current, exclude)
    parts = []
    if numeric:
        parts.append(wasserstein(reference, typed, numeric, splits))
    if categorical:
        parts.append(jensen_shannon(reference, typed, categorical))
    if not parts:
        return reference.sparkSession.createDataFrame(
            [], "column string, method string, score double, threshold double, drifted boolean"
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(
        "column",
        "method",
        F.round("score", 4).alias("score"),
        F.lit(float(threshold)).alias("threshold"),
        (F.col("score") > F.lit(float(threshold))).alias("drifted"),
    ).orderBy(F.desc("score"), "column")


def drift_summary(detail: DataFrame, current: DataFrame) -> DataFrame:
    """One row: columns drifted, their share, rows compared and whether those suffice."""
    rows = current.agg(F.count(F.lit(1)).alias("n_rows")).scalar()
    found = detail.agg(
        F.count_if(F.col("drifted")).alias("columns_drifted"),
        F.count(F.lit(1)).alias("columns_compared"),
        F.coalesce(F.avg(F.col("drifted").cast("int")), F.lit(0.0)).alias("share_drifted"),
    )
    verdict = (
        F.when(F.col("n_rows") < MIN_ROWS, "no analysis").when(F.col("n_rows") < WARN_ROWS, "small sample").otherwise("sufficient")
    )
    return found.withColumn("n_rows", rows).withColumn("sample_status", verdict)


def share_by_source(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Category shares of the two samples side by side in long form."""
    both = union_labelled({"reference": reference.select(col(column)), "current": current.select(col(column))})
    return group_share(both, "source", column)


# --- a frozen reference ------------------------------------------------------------------------


@dataclass(frozen=True)
class FrozenReference:
    """What drift needs of a reference, stored once: how often each value occurs, the spread of each numeric column, and the
    edges of the slices in which values are ordered. Two such tables add up to the one of both samples."""

    path: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    edges: Edges

    def counts(self, spark: SparkSession) -> DataFrame:
        """column, slice, value, label, r."""
        return spark.read.schema("column string, slice int, value double, label string, r bigint").parquet(f"{self.path}/counts")

    def columns(self, spark: SparkSession) -> DataFrame:
        """column, kind, n, mean, m2 (sum of squares around the mean), edges."""
        return spark.read.schema("column string, kind string, n bigint, mean double, m2 double, edges array<double>").parquet(f"{self.path}/columns")


def _outer_edges(edges: Sequence[float], spread: float) -> list[float]:
    """The edges, and more of them outside at growing distances, eight for each doubling, so that a shifted sample does not fall into one slice."""
    if not edges:
        return []
    steps = [max(spread, MIN_SPREAD) * 2.0 ** (k / 8) for k in range(-16, 320)]
    return sorted({*(edges[0] - s for s in steps), *edges, *(edges[-1] + s for s in steps)})


def freeze_reference(reference: DataFrame, path: str, exclude: Sequence[str] = ("SK_ID_CURR",), splits: int | None = None) -> FrozenReference:
    """Count the reference once and store it under ``path``."""
    numeric, categorical = column_roles(reference, exclude)
    edges = fit_edges(reference, numeric, splits)
    moments = [F.expr(f"named_struct('n', count(x{i}), 'mean', avg(x{i}), 'variance', var_pop(x{i})) AS x{i}") for i in range(len(numeric))]
    narrow = reference.selectExpr("1 AS one", *[f"CAST({text.name(c)} AS DOUBLE) AS x{i}" for i, c in enumerate(numeric)])
    found = narrow.agg(F.count("one").alias("rows"), *moments).first()
    rows = []
    for i, c in enumerate(numeric):
        x = found[f"x{i}"]
        variance = x["variance"] or 0.0
        edges[c] = _outer_edges(edges[c], math.sqrt(variance))
        rows.append((c, "numeric", x["n"], x["mean"], variance * x["n"], edges[c]))
    rows += [(c, "categorical", None, None, None, None) for c in categorical]
    spark = reference.sparkSession
    frozen = FrozenReference(path.rstrip("/"), tuple(numeric), tuple(categorical), edges)
    counted_values(reference, frozen).withColumnRenamed("m", "r").write.parquet(f"{frozen.path}/counts")
    spark.createDataFrame(rows, "column string, kind string, n bigint, mean double, m2 double, edges array<double>").coalesce(1).write.parquet(f"{frozen.path}/columns")
    return frozen


def load_reference(spark: SparkSession, path: str) -> FrozenReference:
    """A stored reference; only its few columns' edges are read here."""
    bare = FrozenReference(path.rstrip("/"), (), (), {})
    rows = sorted(bare.columns(spark).collect(), key=lambda r: r["column"])
    kinds = {k: tuple(r["column"] for r in rows if r["kind"] == k) for k in ("numeric", "categorical")}
    return FrozenReference(bare.path, kinds["numeric"], kinds["categorical"], {r["column"]: list(r["edges"]) for r in rows if r["kind"] == "numeric"})


def merge_references(spark: SparkSession, a: FrozenReference, b: FrozenReference, path: str) -> FrozenReference:
    """The reference of both samples; slices are those of ``a``."""
    out = FrozenReference(path.rstrip("/"), a.numeric, a.categorical, a.edges)
    both = a.counts(spark).unionByName(b.counts(spark))
    if b.edges != a.edges:
        wide = both.where("value is not null").selectExpr("column", "r", *[f"CASE WHEN column = {text.value(c)} THEN value END AS {text.name(c)}" for c in a.numeric])
        sliced = melt_sliced(wide, list(a.numeric), a.edges, keep=["r"]).select("column", "slice", "value", F.lit(None).cast("string").alias("label"), "r")
        both = sliced.unionByName(both.where("value is null"))
    both.groupBy("column", "slice", "value", "label").agg(F.sum("r").alias("r")).write.parquet(f"{out.path}/counts")
    x, y = a.columns(spark), b.columns(spark).selectExpr("column", "n AS n_b", "mean AS mean_b", "m2 AS m2_b")
    joined = x.join(y, "column", "left")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("n_b", F.lit(0))
    shift = F.coalesce(F.col("mean_b") - F.col("mean"), F.lit(0.0))
    joined.select(
        "column",
        "kind",
        (n + m).alias("n"),
        F.coalesce(F.try_divide(n * F.coalesce("mean", F.lit(0.0)) + m * F.coalesce("mean_b", F.lit(0.0)), n + m), "mean").alias("mean"),
        (F.coalesce("m2", F.lit(0.0)) + F.coalesce("m2_b", F.lit(0.0)) + F.coalesce(F.try_divide(shift * shift * n * m, n + m), F.lit(0.0))).alias("m2"),
        "edges",
    ).write.parquet(f"{out.path}/columns")
    return out


def counted_values(df: DataFrame, frozen: FrozenReference, by: Sequence[str] = ()) -> DataFrame:
    """by..., column, slice, value, label, m: how often each value of the reference's columns occurs. Works on streams, where
    it is the state that windows keep: it spreads over all tasks and never holds rows."""
    present = set(df.columns)
    numeric = [c for c in frozen.numeric if c in present]
    categorical = [c for c in frozen.categorical if c in present]
    keys = [text.name(b) for b in by]
    parts = []
    if numeric:
        long = melt_sliced(coerce_numeric(df, numeric), numeric, frozen.edges, keep=by)
        parts.append(long.selectExpr(*keys, "column", "slice", "value", "CAST(NULL AS STRING) AS label"))
    if categorical:
        cells = text.rows([{"column": text.value(c), "label": as_text(df, c)} for c in categorical])
        long = df.selectExpr(*keys, cells).where("label is not null")
        parts.append(long.selectExpr(*keys, "column", "CAST(NULL AS INT) AS slice", "CAST(NULL AS DOUBLE) AS value", "label"))
    if not parts:
        raise ValueError("no column of the reference is there")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy(*[F.col(k) for k in keys], "column", "slice", "value", "label").agg(F.count(F.lit(1)).alias("m"))


def drift_of_counts(frozen: FrozenReference, counts: DataFrame, by: Sequence[str] = (), threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """by..., column, method, score, threshold, drifted for every group of ``counts`` (see :func:`counted_values`)."""
    spark = counts.sparkSession
    keys = [text.name(b) for b in by]
    group = [*[F.col(k) for k in keys], F.col("column")]
    groups = counts.select(*group).distinct()
    known = groups.join(frozen.counts(spark), "column").select(*group, "slice", "value", "label", "r", F.lit(0).cast("bigint").alias("c"))
    current = counts.select(*group, "slice", "value", "label", F.lit(0).cast("bigint").alias("r"), F.col("m").alias("c"))
    both = known.unionByName(current).groupBy(*group, "slice", "value", "label").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    numbers = both.where("label is null").drop("label")
    run = cumulate(numbers, [*by, "column"], ["r", "c"], next_value=True)
    gap = F.abs(ratio(F.col("cum_r"), F.col("all_r")) - ratio(F.col("cum_c"), F.col("all_c")))
    area = run.groupBy(*group).agg(F.sum(gap * (F.col("next_value") - F.col("value"))).alias("area"))
    spread = frozen.columns(spark).where("kind = 'numeric'").select("column", F.sqrt(F.try_divide("m2", "n")).alias("std"))
    w1 = area.join(spread, "column").select(*group, F.lit("wasserstein").alias("method"), (F.coalesce("area", F.lit(0.0)) / F.greatest("std", F.lit(MIN_SPREAD))).alias("score"))
    labels = both.where("label is not null")
    totals = labels.groupBy(*group).agg(F.sum("r").alias("all_r"), F.sum("c").alias("all_c"))
    # Groups may be null; the plain join on the column's name would lose those.
    match = [F.col(k).eqNullSafe(F.col(f"t{i}")) for i, k in enumerate([*keys, "column"])]
    totals = totals.select(*[g.alias(f"t{i}") for i, g in enumerate(group)], "all_r", "all_c")
    shares = labels.join(totals, match).select(*group, _share("r").alias("p"), _share("c").alias("q"))
    js = shares.groupBy(*group).agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(_divergence()) / F.lit(2.0) / F.ln(F.lit(2.0)))).alias("score"))
    scores = w1.unionByName(js.select(*group, F.lit("jensenshannon").alias("method"), "score"))
    return scores.select(*group, "method", F.round("score", 4).alias("score"), F.lit(float(threshold)).alias("threshold"), (F.round("score", 4) > F.lit(float(threshold))).alias("drifted"))


def _share(x: str):
    return F.coalesce(ratio(F.col(x), F.col(f"all_{x}")), F.lit(0.0))


def _divergence():
    m = (F.col("p") + F.col("q")) / 2
    return sum((F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(F.lit(0.0)) for x in ("p", "q")), F.lit(0.0))
