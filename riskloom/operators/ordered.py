"""Order statistics that never sort a whole column in one task.

A column is cut into slices at edges taken from a small quantile sketch. The edges are
plain numbers on the driver (at most ``splits`` per column), so the slice of a value is a
fixed function of that value: losing an executor and recomputing cannot move a row. Rows
are first reduced to one row per distinct value, each slice is ordered on its own, and
the totals of the slices before it are added from a table with one row per slice. A value
held by a third of all rows is one row here, and no task sees more than about
``1 / splits`` of the distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.functions.nulls import col
from riskloom.session import split_count

Edges = dict[str, list[float]]


def fit_edges(df: DataFrame, columns: Sequence[str], splits: int | None = None) -> Edges:
    """Slice edges per column, all columns in one pass of bounded sketches."""
    n = splits or split_count(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    if not columns or not probs:
        return {c: [] for c in columns}
    accuracy = max(100, 4 * n)  # a rank error of a quarter slice only unbalances the slices
    cuts = ", ".join(text.value(p) for p in probs)
    row = df.agg(
        *[
            F.expr(f"percentile_approx(CAST({text.name(c)} AS DOUBLE), array({cuts}), {accuracy}) AS e{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    # Infinite edges cut nothing: infinities lie in the outer slices.
    return {c: sorted({float(v) for v in (row[f"e{i}"] or []) if math.isfinite(v)}) for i, c in enumerate(columns)}


def union_edges(a: Edges, b: Edges) -> Edges:
    return {c: sorted({*a.get(c, []), *b.get(c, [])}) for c in {**a, **b}}


def add_slice(df: DataFrame, columns: Sequence[str], edges: Edges, suffix: str = "__slice") -> DataFrame:
    """Add ``<column><suffix>``: the number of the slice each value lies in."""
    cut = [c for c in columns if edges.get(c)]
    out = df
    if cut:
        inf = float("inf")
        out = Bucketizer(
            splitsArray=[[-inf, *edges[c], inf] for c in cut],
            inputCols=cut,
            outputCols=[c + suffix for c in cut],
            handleInvalid="keep",
        ).transform(df)
    number = {c: f"CAST({text.name(c + suffix)} AS INT)" if c in cut else "0" for c in columns}
    return out.withColumns({c + suffix: F.expr(n) for c, n in number.items()})


def melt_sliced(df: DataFrame, columns: Sequence[str], edges: Edges, keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep..., column, slice, value) of the non-missing values of ``columns``."""
    plain = {c: f"v{i}" for i, c in enumerate(columns)}
    kept = [text.name(k) for k in keep]
    narrow = df.selectExpr(*kept, *[f"CAST({text.name(c)} AS DOUBLE) AS {v}" for c, v in plain.items()])
    cut = add_slice(narrow, list(plain.values()), {plain[c]: edges.get(c, []) for c in columns})
    cells = text.rows([{"column": text.value(c), "slice": f"{v}__slice", "value": v} for c, v in plain.items()])
    return cut.selectExpr(*kept, cells).where("value is not null and slice is not null")


def cumulate(
    counts: DataFrame,
    by: Sequence[str],
    weights: Sequence[str],
    next_value: bool = False,
) -> DataFrame:
    """Running totals over distinct values.

    ``counts`` has one row per (by..., slice, value). Adds ``cum_<w>`` (total up to and
    including the value), ``all_<w>`` (total of the group) and, on request, ``next_value``
    (the next larger value of the group, across slices).
    """
    keys = [text.name(b) for b in by]
    # One row per slice and group: at most `splits` rows per group in each window.
    group = "PARTITION BY " + (", ".join(keys) or "0")
    before = f"OVER ({group} ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sizes = [F.expr(f"sum({w}) AS part_{w}") for w in weights]
    lead = []
    if next_value:
        sizes.append(F.expr("min(value) AS first_value"))
        lead = [f"lead(first_value) OVER ({group} ORDER BY slice) AS later_value"]
    slices = (
        counts.groupBy(*[F.col(k) for k in keys], "slice")
        .agg(*sizes)
        .selectExpr(
            *keys,
            "slice",
            *[f"coalesce(sum(part_{w}) {before}, 0) AS before_{w}" for w in weights],
            *[f"sum(part_{w}) OVER ({group}) AS all_{w}" for w in weights],
            *lead,
        )
    )
    inside = "PARTITION BY " + ", ".join([*keys, "slice"]) + " ORDER BY value"
    running = f"OVER ({inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = [f"coalesce(lead(value) OVER ({inside}), later_value) AS next_value"] if next_value else []
    return counts.join(slices, [*by, "slice"]).selectExpr(
        *keys,
        "value",
        *weights,
        *[f"sum({w}) {running} + before_{w} AS cum_{w}" for w in weights],
        *[f"all_{w}" for w in weights],
        *after,
    )


def _spots(probs: Mapping[str, float]) -> str:
    """Rows (spot, rank) for the two ranks around each wanted quantile of n values."""
    ranks = []
    for q, p in probs.items():
        at = f"((n - 1) * {text.value(float(p))})"
        ranks.append({"spot": text.value(f"{q}_lo"), "rank": f"floor({at})"})
        ranks.append({"spot": text.value(f"{q}_hi"), "rank": f"ceil({at})"})
    return text.rows(ranks)


def wanted_ranks(totals: DataFrame, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """(by..., n, spot, rank) from one row per group with its size ``n``."""
    return totals.selectExpr(*[text.name(b) for b in by], "n", _spots(probs))


def pick_quantiles(
    ranked: DataFrame, spots: DataFrame, on: Sequence[str], by: Sequence[str], probs: Mapping[str, float]
) -> DataFrame:
    """Interpolated quantiles. ``ranked`` rows cover the ranks [from_, to_) with one value;
    ``spots`` holds the few wanted ranks, so the join gives two rows per quantile."""
    keys = [text.name(b) for b in by]
    held = ranked.join(spots, list(on)).where("rank >= from_ AND rank < to_")
    ends = [f"{q}_{side}" for q in probs for side in ("lo", "hi")]
    picks = held.groupBy(*[F.col(k) for k in keys]).agg(
        F.expr("first(n) AS n"),
        *[F.expr(f"max(CASE WHEN spot = {text.value(e)} THEN value END) AS {text.name(e)}") for e in ends],
    )
    out = []
    for q, p in probs.items():
        at = f"((n - 1) * {text.value(float(p))})"
        out.append(f"`{q}_lo` + (`{q}_hi` - `{q}_lo`) * ({at} - floor({at})) AS {text.name(q)}")
    return picks.selectExpr(*keys, "n", *out)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    splits: int | None = None,
    edges: Edges | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles: one row per group and column, ``q0, q1, ...`` per prob.

    Two light passes: slice sizes first, then only the slices that hold a wanted rank are
    shuffled and ordered.
    """
    edges = edges if edges is not None else fit_edges(df, columns, splits)
    long = melt_sliced(df, columns, edges, keep=by)
    keys = [*by, "column"]
    names = [text.name(k) for k in keys]
    group = "PARTITION BY " + ", ".join(names)
    wanted = {f"q{i}": float(p) for i, p in enumerate(probs)}

    sizes = (
        long.groupBy(*[F.col(k) for k in names], "slice")
        .agg(F.expr("count(1) AS size"))
        .selectExpr(
            *names,
            "slice",
            "size",
            f"sum(size) OVER ({group} ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start",
            f"sum(size) OVER ({group}) AS n",
        )
    )
    # One row per wanted rank, found in the one slice that holds it.
    spots = sizes.selectExpr(*names, "slice", "start", "size", "n", _spots(wanted)).where(
        "rank >= start AND rank < start + size"
    )
    targets = spots.select(*[F.col(k) for k in names], "slice", "start").distinct()

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*[F.col(k) for k in names], "slice", "value").agg(F.expr("count(1) AS m"))

    if by:
        # Any number of groups: reduce to distinct values first, then keep the wanted slices.
        distinct = counted(long).join(targets, [*keys, "slice"])
    else:
        # At most two slices per column and probability, so the filter is broadcast and the
        # other slices are never shuffled.
        kept = long.join(F.broadcast(targets), [*keys, "slice"], "left_semi")
        distinct = counted(kept).join(F.broadcast(targets), [*keys, "slice"])
    inside = "PARTITION BY " + ", ".join([*names, "slice"]) + " ORDER BY value"
    running = f"sum(m) OVER ({inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ranked = distinct.selectExpr(*names, "slice", "value", "m", f"{running} + start AS to_").selectExpr(
        *names, "slice", "value", "to_ - m AS from_", "to_"
    )
    return pick_quantiles(ranked, spots.drop("start", "size"), [*keys, "slice"], keys, wanted)


def quantile_dict(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], approx: bool = False, splits: int | None = None
) -> dict[str, list[float | None]]:
    """Fitted quantiles per column as plain numbers (one row per column reaches the driver)."""
    if approx:
        wanted = ", ".join(text.value(float(p)) for p in probs)
        row = df.agg(
            *[
                F.expr(f"percentile_approx(CAST({text.name(c)} AS DOUBLE), array({wanted}), 10000) AS c{i}")
                for i, c in enumerate(columns)
            ]
        ).first()
        return {c: list(row[f"c{i}"] or [None] * len(probs)) for i, c in enumerate(columns)}
    rows = {r["column"]: r for r in exact_quantiles(df, columns, probs, splits=splits).collect()}
    return {c: [rows[c][f"q{i}"] if c in rows else None for i in range(len(probs))] for c in columns}


def ranks(df: DataFrame, columns: Sequence[str], splits: int | None = None) -> DataFrame:
    """Average rank of every distinct value: (column, value, n, all_n, rank)."""
    edges = fit_edges(df, columns, splits)
    counts = melt_sliced(df, columns, edges).groupBy("column", "slice", "value").agg(F.expr("count(1) AS n"))
    return cumulate(counts, ["column"], ["n"]).selectExpr(
        "column", "value", "n", "all_n", "cum_n - n + (n + 1) / 2.0D AS rank"
    )


def attach_by_value(
    df: DataFrame, table: DataFrame, keys: Sequence[str], size: str, total: str, value: str, share: int = 1000
) -> DataFrame:
    """Left join of a per-value table onto rows whose keys may be badly skewed.

    Values holding at least 1/share of all rows are broadcast: per total there can be at
    most ``share`` of them, whatever the data size. Every other value is too rare to
    overload a task and goes through an ordinary shuffle. Rows already served by the
    broadcast side get a random-looking salt, so their empty key does not pile up.
    """
    heavy = table.where(F.col(size) * share >= F.col(total)).select(
        *[F.col(k).alias(f"h_{k}") for k in keys], F.col(value).alias("heavy_value")
    )
    light = table.where(F.col(size) * share < F.col(total)).select(
        *[F.col(k).alias(f"l_{k}") for k in keys], F.lit(0).alias("l_salt"), F.col(value).alias("light_value")
    )
    match = [F.col(k).eqNullSafe(F.col(f"h_{k}")) for k in keys]
    first = df.join(F.broadcast(heavy), match, "left").drop(*[f"h_{k}" for k in keys])
    served = F.col("heavy_value").isNotNull()
    others = [col(c) for c in df.columns if c not in keys]
    salt = F.when(served, F.lit(1) + F.pmod(F.xxhash64(*others), F.lit(4096)).cast("int")).otherwise(F.lit(0))
    salted = first.withColumn("salt", salt)
    second = salted.join(light, [F.col(k) == F.col(f"l_{k}") for k in keys] + [F.col("salt") == F.col("l_salt")], "left")
    return second.select(
        *[col(c) for c in df.columns], F.coalesce("heavy_value", "light_value").alias(value)
    )


def numbered(
    df: DataFrame, by: Sequence[str], order: Column, upper: int, tie: Sequence[str], splits: int | None = None
) -> DataFrame:
    """Add ``position`` (from 0) and ``group_size`` within ``by``, ordered by ``order`` then ``tie``.

    ``order`` is an evenly spread whole number in [0, upper), so equal slices of its range
    are equally full and no group is ever ordered in one task. Rows with a missing group are
    a group; rows without an order (a missing key) come first.
    """
    n = splits or split_count(df.sparkSession)
    width = -(-upper // n)
    sliced = df.withColumns({"__order": F.coalesce(order, F.lit(0))}).withColumn("__slice", F.floor(F.col("__order") / F.lit(width)).cast("int"))
    sizes = sliced.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__size"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sizes = sizes.select(
        *by,
        "__slice",
        F.coalesce(
            F.sum("__size").over(group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
        F.sum("__size").over(group).alias("group_size"),
    )
    inside = Window.partitionBy(*by, "__slice").orderBy("__order", *tie)
    sizes = sizes.select(*[col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__slice").alias("__in"), "__before", "group_size")
    match = [col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]
    joined = sliced.join(sizes, [*match, F.col("__slice") == F.col("__in")])
    return (
        joined.withColumn("position", F.row_number().over(inside) - 1 + F.col("__before"))
        .drop("__order", "__slice", "__before")
        .select(*[col(c) for c in df.columns], "position", "group_size")
    )
