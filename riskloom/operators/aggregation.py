"""History tables to one row per key.

Every aggregate has map-side partial results, so a key that holds a large part of all rows
costs one partial row per task. Means are derived from the
sum and count already kept, which halves the buffers of a wide aggregate. Category lists are
frozen parameters: the output schema never depends on the rows at hand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from riskloom.functions import text
from riskloom.functions.nulls import boolean_names, col, is_true, numeric_names, string_names, sum_or_zero
from riskloom.operators.packed import can_pack, packed_aggregates

Categories = Mapping[str, Sequence[str]]

# Aggregate expressions of one generated aggregate; beyond this size it is no longer compiled to
# machine code (half the speed or less, measured). Wider ones keep packed buffers, in one pass too.
# Decimals, whose sums must stay exact, are split into passes that share one key partitioning.
MAX_BUFFERS = 60


def fit_categories(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 1000) -> dict[str, list[str]]:
    """Distinct values per text column, sorted. More than ``limit`` is an error, never a cut."""
    columns = list(columns) if columns is not None else string_names(df)
    if not columns:
        return {}
    cells = text.rows([{"c": text.value(c), "v": text.name(c)} for c in columns])
    found = df.selectExpr(cells).where("v is not null").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["c"]: r["n"] for r in found.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = {c: n for c, n in sizes.items() if n > limit}
    if wide:
        found.unpersist()
        raise ValueError(f"too many categories to turn into columns: {wide}")
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in found.collect():
        out[r["c"]].append(r["v"])
    found.unpersist()
    return {c: sorted(v) for c, v in out.items()}


def check_names(names: Sequence[str]) -> None:
    """Column names are case-insensitive in Spark; two that differ only in case would clash."""
    seen: dict[str, str] = {}
    for n in names:
        other = seen.setdefault(n.lower(), n)
        if other != n:
            raise ValueError(f"column names clash: {other!r} and {n!r}")


def aggregate_by(
    df: DataFrame,
    key: str,
    numeric: Sequence[str] = (),
    categories: Categories | None = None,
    prefix: str = "",
    count_name: str | None = None,
) -> DataFrame:
    """min / max / mean / sum per numeric column, share per category, rows per key.

    Rows without a key are left out. A missing category counts in the share's denominator;
    an all-missing sum is zero.
    """
    lead = f"{prefix}_" if prefix else ""
    shares = [(c, v) for c, values in (categories or {}).items() for v in values]
    if 4 * len(numeric) + len(shares) > MAX_BUFFERS and can_pack(df, numeric):
        return _aggregate_packed(df, key, numeric, shares, lead, count_name)
    rows = df.where(col(key).isNotNull())
    parts: list[tuple[list[str], list[str]]] = []  # (aggregates, outputs) per input column
    for i, c in enumerate(numeric):
        x, out = text.name(c), f"{lead}{c}"
        low, high = text.name(f"{out}_min"), text.name(f"{out}_max")
        parts.append(
            (
                [f"min({x}) AS {low}", f"max({x}) AS {high}", f"sum({x}) AS s{i}", f"count({x}) AS n{i}"],
                [
                    low,
                    high,
                    f"try_divide(CAST(s{i} AS DOUBLE), n{i}) AS {text.name(f'{out}_mean')}",
                    f"coalesce(s{i}, 0) AS {text.name(f'{out}_sum')}",
                ],
            )
        )
    for j, (c, v) in enumerate(shares):
        parts.append(
            (
                [f"count_if({text.name(c)} <=> {text.value(v)}) AS h{j}"],
                [f"h{j} / rows_ AS {text.name(f'{lead}{c}_{v}_mean')}"],
            )
        )

    passes: list[list[tuple[list[str], list[str]]]] = [[]]
    width = 0
    for part in parts:
        if width + len(part[0]) > MAX_BUFFERS:
            passes.append([])
            width = 0
        passes[-1].append(part)
        width += len(part[0])

    out = None
    for i, chunk in enumerate(passes):
        buffers = [F.expr(b) for p in chunk for b in p[0]]
        grouped = rows.groupBy(col(key)).agg(F.expr("count(1) AS rows_"), *buffers)
        outputs = [o for p in chunk for o in p[1]]
        if i == 0 and count_name:
            outputs.append(f"rows_ AS {text.name(count_name)}")
        piece = grouped.selectExpr(text.name(key), *outputs)
        out = piece if out is None else out.join(piece, key, "left")
    if count_name and len(passes) > 1:  # the count goes last, as in a single pass
        out = out.selectExpr(*[text.name(c) for c in out.columns if c != count_name], text.name(count_name))
    check_names(out.columns)
    return out


def _aggregate_packed(
    df: DataFrame, key: str, numeric: Sequence[str], shares: Sequence[tuple[str, str]], lead: str, count_name: str | None
) -> DataFrame:
    """The columns of :func:`aggregate_by` from packed buffers: one scan, one exchange."""
    marks = [f"{text.name(c)} <=> {text.value(v)}" for c, v in shares]
    rows, reads, hits, count = packed_aggregates(df, key, numeric, marks)
    out = [f"k AS {text.name(key)}"]
    for c in numeric:
        read, name = reads[c], f"{lead}{c}"
        out += [
            f"{read['min']} AS {text.name(f'{name}_min')}",
            f"{read['max']} AS {text.name(f'{name}_max')}",
            f"try_divide(CAST({read['sum']} AS DOUBLE), {read['count']}) AS {text.name(f'{name}_mean')}",
            f"coalesce({read['sum']}, 0) AS {text.name(f'{name}_sum')}",
        ]
    out += [f"{h} / {count} AS {text.name(f'{lead}{c}_{v}_mean')}" for h, (c, v) in zip(hits, shares)]
    out += [f"{count} AS {text.name(count_name)}"] if count_name else []
    result = rows.selectExpr(*out)
    check_names(result.columns)
    return result


def _with_missing(df: DataFrame, texts: Sequence[str], categories: Categories | None) -> Categories:
    """The given categories, and fitted ones for text columns that have none, so that no column is lost."""
    known = dict(categories or {})
    unlisted = [c for c in texts if c not in known]
    return {**known, **fit_categories(df, unlisted)} if unlisted else known


def aggregate_table(
    df: DataFrame,
    key: str,
    prefix: str,
    exclude: Sequence[str] = (),
    categories: Categories | None = None,
) -> DataFrame:
    """Generic aggregate driven by the schema: booleans as 0/1, text as shares, numbers as
    min / max / mean / sum, and ``<prefix>_COUNT``."""
    flags = boolean_names(df, [key, *exclude])
    df = df.withColumns({c: col(c).cast("int") for c in flags})
    texts = string_names(df, [key, *exclude])
    categories = _with_missing(df, texts, categories)
    return aggregate_by(
        df,
        key,
        numeric_names(df, [key, *exclude]),
        {c: categories[c] for c in texts},
        prefix,
        f"{prefix}_COUNT",
    )


def aggregate_months(
    df: DataFrame, key: str, month: str, status: str, statuses: Sequence[str]
) -> DataFrame:
    """Month rows to one row per credit: month min / max / count and status shares."""
    m, s = text.name(month), text.name(status)
    grouped = (
        df.where(col(key).isNotNull())
        .groupBy(col(key))
        .agg(
            F.expr(f"min({m}) AS {text.name(f'{month}_min')}"),
            F.expr(f"max({m}) AS {text.name(f'{month}_max')}"),
            F.expr(f"count({m}) AS {text.name(f'{month}_count')}"),
            F.expr("count(1) AS rows_"),
            *[F.expr(f"count_if({s} <=> {text.value(v)}) AS h{i}") for i, v in enumerate(statuses)],
        )
    )
    return grouped.selectExpr(
        text.name(key),
        *[text.name(f"{month}_{stat}") for stat in ("min", "max", "count")],
        *[f"h{i} / rows_ AS {text.name(f'{status}_{v}_mean')}" for i, v in enumerate(statuses)],
    )


def aggregate_credits(
    credits: DataFrame,
    months: DataFrame,
    key: str = "SK_ID_CURR",
    credit_key: str = "SK_ID_BUREAU",
    month: str = "MONTHS_BALANCE",
    status: str = "STATUS",
    categorical: Sequence[str] = ("CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE"),
    categories: Categories | None = None,
    count_name: str = "BUREAU_CREDIT_COUNT",
) -> DataFrame:
    """Two levels: months to credits, then credits (with their month summary) to clients.

    Months are reduced before the join, so the join sees one row per credit on both sides.
    """
    categories = dict(categories or {})
    if status not in categories:
        categories[status] = fit_categories(months, [status])[status]
    missing = [c for c in categorical if c not in categories]
    if missing:
        categories.update(fit_categories(credits, missing))
    summary = aggregate_months(months, credit_key, month, status, categories[status])
    enriched = credits.join(summary, credit_key, "left")
    return aggregate_by(
        enriched,
        key,
        numeric_names(enriched, [key, credit_key, *categorical]),
        {c: categories[c] for c in categorical},
        "",
        count_name,
    )


def aggregate_previous(
    df: DataFrame,
    key: str = "SK_ID_CURR",
    loan_key: str = "SK_ID_PREV",
    categories: Categories | None = None,
) -> DataFrame:
    """Earlier applications: ``_ANOM`` flags become 0/1, other booleans are not aggregated."""
    flags = [c for c in boolean_names(df) if c.endswith("_ANOM")]
    df = df.withColumns({c: col(c).cast("int") for c in flags})
    texts = string_names(df, [key, loan_key])
    categories = _with_missing(df, texts, categories)
    return aggregate_by(
        df,
        key,
        numeric_names(df, [key, loan_key]),
        {c: categories[c] for c in texts},
        "PREV",
        "PREV_APPLICATION_COUNT",
    )


def payment_terms(
    df: DataFrame,
    due: str = "AMT_INSTALMENT",
    paid: str = "AMT_PAYMENT",
    due_day: str = "DAYS_INSTALMENT",
    paid_day: str = "DAYS_ENTRY_PAYMENT",
) -> DataFrame:
    """Per instalment: under-payment, days late, late flag (a missing payment is not late)."""
    late = col(paid_day) - col(due_day)
    return df.withColumns(
        {
            "PAYMENT_DIFF": col(due) - col(paid),
            "DAYS_PAST_DUE": late,
            "LATE_PAYMENT_FLAG": is_true(late > 0).cast("int"),
        }
    )


def payment_behavior(df: DataFrame, key: str = "SK_ID_CURR", **columns: str) -> DataFrame:
    """Payment behaviour per client."""
    rows = payment_terms(df, **columns).where(col(key).isNotNull())
    return rows.groupBy(col(key)).agg(
        F.avg("PAYMENT_DIFF").alias("PAYMENT_DIFF_mean"),
        sum_or_zero(F.col("PAYMENT_DIFF")).alias("PAYMENT_DIFF_sum"),
        F.avg("DAYS_PAST_DUE").alias("DAYS_PAST_DUE_mean"),
        F.max("DAYS_PAST_DUE").alias("DAYS_PAST_DUE_max"),
        F.avg("LATE_PAYMENT_FLAG").alias("LATE_PAYMENT_RATE"),
        F.sum("LATE_PAYMENT_FLAG").alias("LATE_PAYMENT_COUNT"),
    )


def category_share(df: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """Share of each category per key."""
    return aggregate_by(df, key, (), {column: values})


def rows_per_key(df: DataFrame, key: str, into: str = "n_rows") -> DataFrame:
    return df.where(col(key).isNotNull()).groupBy(col(key)).agg(F.count(F.lit(1)).alias(into))
