"""Association between columns: correlations, Cramér's V, mutual information."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.functions.nulls import as_text, col, ratio
from riskloom.operators.cleaning import fill_median
from riskloom.operators.ordered import attach_by_value, melt_sliced, quantile_dict, ranks
from riskloom.operators.products import SUMS, pair_sums, rank_sums

# Up to this many pairs each pair is an expression of one aggregate; beyond it the cross
# products are summed as matrices.
NARROW = 10

Pairs = Sequence[tuple[str, str]]


def _centres(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Column means; moments are summed around them to keep their digits."""
    names = list(dict.fromkeys(columns))
    row = df.agg(*[F.expr(f"avg(CAST({text.name(c)} AS DOUBLE)) AS m{i}") for i, c in enumerate(names)]).first()
    return {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(names)}


def _from_sums(sums: DataFrame, *keep: str) -> DataFrame:
    """Correlation from centred sums. A variance far below the raw second moment is rounding
    of a constant column, whose correlation is NULL."""
    vx, vy = "(sxx - sx * sx / n)", "(syy - sy * sy / n)"
    real = f"n > 0 AND {vx} > sxx * 1e-12D AND {vy} > syy * 1e-12D"
    bounded = f"greatest(-1D, least(1D, (sxy - sx * sy / n) / sqrt({vx} * {vy})))"
    return sums.selectExpr(*keep, "CAST(n AS BIGINT) AS n", f"CASE WHEN {real} THEN {bounded} END AS corr")


def _narrow_pairs(df: DataFrame, pairs: Pairs) -> DataFrame:
    """A few pairs: plain sums over the rows where both are present, all pairs in one pass."""
    centres = _centres(df, [c for p in pairs for c in p])
    place = {c: f"x{i}" for i, c in enumerate(centres)}
    flat = df.selectExpr(
        *[f"CAST({text.name(c)} AS DOUBLE) - {text.value(m)} AS {place[c]}" for c, m in centres.items()]
    )
    aggregates, records = [], []
    for i, (a, b) in enumerate(pairs):
        x, y = place[a], place[b]
        terms = {"n": "1D", "sx": x, "sy": y, "sxx": f"{x} * {x}", "syy": f"{y} * {y}", "sxy": f"{x} * {y}"}
        both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
        aggregates += [f"sum(CASE WHEN {both} THEN {t} ELSE 0D END) AS {s}{i}" for s, t in terms.items()]
        records.append({"var_1": text.value(a), "var_2": text.value(b), **{s: f"{s}{i}" for s in SUMS}})
    sums = flat.agg(*[F.expr(e) for e in aggregates]).selectExpr(text.rows(records))
    return _from_sums(sums, "var_1", "var_2")


def _block_pairs(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None) -> DataFrame:
    """Many pairs: each task sums centred cross products over its rows; the partial sums are added in a
    tree. Without ``right`` all pairs of ``left``."""
    columns = [*left, *[c for c in right or [] if c not in left]]
    return _from_sums(pair_sums(df, left, right, list(_centres(df, columns).values())), "var_1", "var_2")


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation, each unordered pair once with var_1 < var_2."""
    columns = sorted(columns)
    pairs = list(combinations(columns, 2))
    return _narrow_pairs(df, pairs) if len(pairs) <= NARROW else _block_pairs(df, columns)


def rank_columns(df: DataFrame, key: Sequence[str], columns: Sequence[str], splits: int | None = None) -> DataFrame:
    """Replace every value by its average rank within its column.

    The table is turned to long form once, ranks are attached by value, and the rows are put
    back together by their key: a fixed number of shuffles however many columns there are.
    A key that occurs twice is an error, as its rows could not be told apart.
    """
    table = ranks(df, columns, splits)
    long = melt_sliced(df, columns, {}, keep=key).drop("slice")
    ranked = attach_by_value(long, table, ["column", "value"], "n", "all_n", "rank")
    grouped = ranked.groupBy(*[col(k) for k in key]).agg(
        *[F.expr(f"max(CASE WHEN column = {text.value(c)} THEN rank END) AS {text.name(c)}") for c in columns],
        F.count(F.lit(1)).alias("__rows"),
    )
    twice = F.raise_error(F.lit(f"key {', '.join(key)} occurs more than once"))
    # The check stands in a used column, so that pruning keeps it.
    checked = {c: F.when(F.col("__rows") <= len(columns), col(c)).otherwise(twice.cast("double")) for c in columns}
    return grouped.withColumns(checked).drop("__rows")


def spearman_pairs(df: DataFrame, columns: Sequence[str], splits: int | None = None) -> DataFrame:
    """Pearson correlation of the ranks, each unordered pair once with var_1 < var_2. Ranks are average ranks per
    column, not per pair of columns; rows need no key."""
    return _from_sums(rank_sums(df, sorted(columns), splits), "var_1", "var_2")


def high_pairs(pairs: DataFrame, threshold: float = 0.7, value: str = "corr") -> DataFrame:
    """Pairs at or above the threshold in absolute value, strongest first."""
    return (
        pairs.withColumn("abs_corr", F.abs(col(value)))
        .where(F.col("abs_corr") >= threshold)
        .select("var_1", "var_2", "abs_corr")
        .orderBy(F.desc("abs_corr"), "var_1", "var_2")
    )


def label_correlation(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Correlation of each column with the label, strongest first."""
    if len(columns) <= NARROW:
        pairs = _narrow_pairs(df, [(c, label) for c in columns])
    else:
        pairs = _block_pairs(df, columns, [label])
    return pairs.select(F.col("var_1").alias("column"), "corr", F.abs("corr").alias("abs_corr")).orderBy(
        F.desc("abs_corr"), "column"
    )


def nullity_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of the missing indicators; columns never or always missing drop out."""
    marks = df.selectExpr(*[f"CAST({text.name(c)} IS NULL AS INT) AS {text.name(c)}" for c in columns])
    return pearson_pairs(marks, columns).where("corr is not null")


# --- categorical association -------------------------------------------------------------


#: Distinct joint values that a block pair of columns is meant to have at most.
CUBE = 100_000


def column_blocks(df: DataFrame, columns: Sequence[str], cube: int = CUBE) -> list[list[str]]:
    """Columns in blocks whose joint values are few: two blocks together have some ``cube`` at most, unless one column alone
    has more. Sizes come from one pass of bounded sketches."""
    row = df.agg(*[F.expr(f"approx_count_distinct({as_text(df, c)}) AS n{i}") for i, c in enumerate(columns)]).first()
    sizes = sorted((int(row[f"n{i}"]) + 1, c) for i, c in enumerate(columns))  # missing is a value here
    blocks: list[list[str]] = []
    room = 0.0
    for n, c in sizes:
        if not blocks or n > room:
            blocks.append([])
            room = cube**0.5
        blocks[-1].append(c)
        room /= n
    return blocks


def _cubes(df: DataFrame, pairs: Pairs, cube: int) -> list[list[tuple[str, str]]]:
    """The pairs dealt to cubes, one for each pair of blocks that has pairs of columns; pairs inside a block go to a cube that has the block anyway."""
    blocks = column_blocks(df, list(dict.fromkeys(c for p in pairs for c in p)), cube)
    home = {c: i for i, block in enumerate(blocks) for c in block}
    dealt: dict[tuple[int, int], list[tuple[str, str]]] = {}
    for a, b in pairs:
        dealt.setdefault((min(home[a], home[b]), max(home[a], home[b])), []).append((a, b))
    for block in [k for k in dealt if k[0] == k[1]]:
        host = next((k for k in dealt if k[0] != k[1] and block[0] in k), None)
        if host is not None:
            dealt[host] += dealt.pop(block)
    return list(dealt.values())


def contingency(df: DataFrame, pairs: Pairs, cube: int = CUBE) -> DataFrame:
    """Cell counts of every column pair: (var_1, var_2, x, y, n).

    A row is counted once for each pair of column blocks, not for each pair of columns; the cells are read off the distinct
    joint values, which are far fewer than rows where columns are categories.
    """
    cubes = _cubes(df, pairs, cube)
    wide = [list(dict.fromkeys(c for p in c_pairs for c in p)) for c_pairs in cubes]
    width = max(map(len, wide), default=0)
    keys = [f"t{i}" for i in range(width)]
    records = [
        {"cube": str(k), **{t: as_text(df, wide[k][i]) if i < len(wide[k]) else "CAST(NULL AS STRING)" for i, t in enumerate(keys)}}
        for k in range(len(cubes))
    ]
    rows = df.selectExpr(*[f"{v} AS {n}" for n, v in records[0].items()]) if len(cubes) == 1 else df.selectExpr(text.rows(records))
    tuples = rows.groupBy("cube", *keys).agg(F.count(F.lit(1)).alias("m"))

    def cells(k: int) -> str:
        at = {c: keys[i] for i, c in enumerate(wide[k])}
        structs = (f"named_struct('var_1', {text.value(a)}, 'var_2', {text.value(b)}, 'x', {at[a]}, 'y', {at[b]})" for a, b in cubes[k])
        return f"WHEN {k} THEN array({', '.join(structs)})"

    each = tuples.selectExpr("m", f"inline(CASE cube {' '.join(cells(k) for k in range(len(cubes)))} END)")
    return each.where("x is not null and y is not null").groupBy("var_1", "var_2", "x", "y").agg(F.sum("m").alias("n"))


def _with_margins(cells: DataFrame) -> DataFrame:
    pair = ["var_1", "var_2"]
    rows = cells.groupBy(*pair, "x").agg(F.sum("n").alias("r"))
    cols = cells.groupBy(*pair, "y").agg(F.sum("n").alias("c"))
    total = cells.groupBy(*pair).agg(F.sum("n").alias("total"))
    return cells.join(rows, [*pair, "x"]).join(cols, [*pair, "y"]).join(total, pair)


def cramers_v(df: DataFrame, pairs: Pairs, yates: bool = True) -> DataFrame:
    """Bias-corrected Cramér's V per pair; a 2 x 2 table gets the continuity correction."""
    cells = contingency(df, pairs)
    pair = ["var_1", "var_2"]
    full = _with_margins(cells)
    n, r, c, total = (F.col(x).cast("double") for x in ("n", "r", "c", "total"))
    expected = r * c / total
    sides = (
        cells.groupBy(*pair, "x").agg(F.sum("n").alias("m")).groupBy(*pair).agg(
            F.count(F.lit(1)).alias("k1"), F.sum(F.lit(1.0) / F.col("m")).alias("inv1")
        )
    ).join(
        cells.groupBy(*pair, "y").agg(F.sum("n").alias("m")).groupBy(*pair).agg(
            F.count(F.lit(1)).alias("k2"), F.sum(F.lit(1.0) / F.col("m")).alias("inv2")
        ),
        pair,
    )
    sums = full.groupBy(*pair).agg(
        F.max("total").alias("total"),
        F.sum(n * n / (r * c)).alias("s"),
        F.max(F.abs(n - expected)).alias("gap"),
    )
    t = F.col("total").cast("double")
    plain = t * (F.col("s") - 1)
    gap = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    corrected = gap * gap * t * F.col("inv1") * F.col("inv2")
    two = (F.col("k1") == 2) & (F.col("k2") == 2)
    chi2 = F.when(two, corrected).otherwise(plain) if yates else plain
    k1, k2 = F.col("k1").cast("double"), F.col("k2").cast("double")
    phi2 = F.greatest(F.lit(0.0), ratio(chi2, t) - ratio((k2 - 1) * (k1 - 1), t - 1))
    k1c = k1 - ratio((k1 - 1) * (k1 - 1), t - 1)
    k2c = k2 - ratio((k2 - 1) * (k2 - 1), t - 1)
    v = F.sqrt(ratio(phi2, F.least(k2c - 1, k1c - 1)))
    return sums.join(sides, pair).select(*pair, F.col("total").alias("n"), chi2.alias("chi2"), v.alias("cramers_v"))


def cramers_v_all(df: DataFrame, columns: Sequence[str], yates: bool = True) -> DataFrame:
    return cramers_v(df, list(combinations(sorted(columns), 2)), yates)


def mutual_information(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Mutual information (nats) of discrete columns with the label, largest first."""
    full = _with_margins(contingency(df, [(c, label) for c in columns]))
    n, r, c, total = (F.col(x).cast("double") for x in ("n", "r", "c", "total"))
    return (
        full.groupBy("var_1")
        .agg(F.sum(n / total * F.ln(n * total / (r * c))).alias("mutual_information"))
        .select(F.col("var_1").alias("column"), "mutual_information")
        .orderBy(F.desc("mutual_information"), "column")
    )


def discretize(df: DataFrame, columns: Sequence[str], distinct: dict[str, int], bins: int = 20, limit: int = 20) -> DataFrame:
    """Quantile-bin the columns with more than ``limit`` values, so that mutual information
    can be counted; a stand-in for a nearest-neighbour estimate."""
    wide = [c for c in columns if distinct[c] > limit]
    if not wide:
        return df
    cuts = quantile_dict(df, wide, [i / bins for i in range(1, bins)])
    out = {}
    for c in wide:
        edges = sorted({v for v in cuts[c] if v is not None})
        steps = " ".join(f"WHEN {text.name(c)} <= {text.value(e)} THEN {i}" for i, e in enumerate(edges))
        out[c] = F.expr(f"CASE WHEN {text.name(c)} IS NULL THEN NULL {steps} ELSE {len(edges)} END")
    return df.withColumns(out)


def distinct_up_to(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int]:
    """Number of values of each column, exact up to ``limit``; beyond it any larger number. Only columns that a sketch takes to
    have few values are counted, so that no task holds the values of a wide one."""
    row = df.agg(*[F.expr(f"approx_count_distinct({as_text(df, c)}) AS n{i}") for i, c in enumerate(columns)]).first()
    found = {c: int(row[f"n{i}"]) for i, c in enumerate(columns)}
    few = [c for c in columns if found[c] <= 2 * limit]
    if few:
        cells = text.rows([{"c": text.value(c), "v": as_text(df, c)} for c in few])
        exact = df.selectExpr(cells).where("v is not null").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        found |= {c: 0 for c in few} | {r["c"]: r["n"] for r in exact.collect()}
    return found


def label_information(df: DataFrame, columns: Sequence[str], label: str, limit: int = 20, bins: int = 20) -> DataFrame:
    """Mutual information of numeric columns with the label, largest first: missing values filled with the exact median,
    columns of at most ``limit`` values counted as they are, the others in quantile bins."""
    filled = fill_median(df.select(*[col(c) for c in columns], col(label)), columns)
    return mutual_information(discretize(filled, columns, distinct_up_to(filled, columns, limit), bins, limit), columns, label)
