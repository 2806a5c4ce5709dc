"""Whole reports over all columns of a table, and scans of other forms of the given tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.catalog.profile_queries import DERIVED, _derived
from riskloom.catalog.registry import ORACLES, query
from riskloom.catalog.views import r, settled, table, view, with_views
from riskloom.operators import association, clustering, contract, profiling
from riskloom.plans.monitoring import analyse
from riskloom.session import staging_path
from riskloom.sources import readers
from riskloom.sources.writers import write_top_importance

LINES_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "qty", "price", "discount", "tax"]
LINES_OTHER = ["l_returnflag", "l_linestatus", "l_shipdate"]
APP_NUMERIC = [
    "SK_ID_CURR", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH", "DAYS_EMPLOYED", "CNT_FAM_MEMBERS", "CNT_CHILDREN",
    "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "FLAG_DOCUMENT_2", "FLAG_DOCUMENT_4", "FLAG_DOCUMENT_5", "TARGET",
]
APP_TEXT = ["CODE_GENDER", "NAME_CONTRACT_TYPE", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_EDUCATION_TYPE", "NAME_INCOME_TYPE"]


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def _outliers(c: str, source: str) -> str:
    return f"""
    select 'outliers' as report, '{c}' as "column", n1, n2, n3, {r("100e0 * n3 / greatest(n1, n2, 1)", 2)} as x1, {r("lo", 2)} as x2, {r("hi", 2)} as x3 from (
      select count(*) filter (where iqr) as n1, count(*) filter (where modz) as n2, count(*) filter (where iqr and modz) as n3, min(v) as lo, max(v) as hi from (
        select v, v < q1 - 3 * (q3 - q1) or v > q3 + 3 * (q3 - q1) as iqr, mad <> 0 and abs(0.6745e0 * (v - med) / case when mad <> 0 then mad else 1 end) > 3.5 as modz
        from (select cast({c} as double) as v from {source} where {c} is not null) rows_,
          (select *, (select quantile_cont(abs(cast({c} as double) - med), 0.5) from {source}) as mad from (
            select quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.5) as med, quantile_cont(cast({c} as double), 0.75) as q3,
              count(distinct {c}) as values_ from {source}) q) limits
        where values_ > 2 and q3 <> q1) flagged) counted where n1 > 0 or n2 > 0"""


def _top(c: str, source: str) -> str:
    """Count of the most frequent value of a column."""
    return f"(select max(m) from (select count(*) as m from {source} where {c} is not null group by {c}) t)"


def _quasi(c: str, source: str) -> str:
    return f"""
    select 'quasi_constant' as report, '{c}' as "column", count(distinct {c}) as n1, null::bigint as n2, null::bigint as n3,
      {r(f"{_top(c, source)} / cast(count({c}) as double)", 2)} as x1, null::double as x2, null::double as x3
    from {source} having {_top(c, source)} / cast(count({c}) as double) >= 0.2"""


def _missing(c: str, source: str) -> str:
    return f"""
    select 'high_missing' as report, '{c}' as "column", count(*) - count({c}) as n1, null::bigint as n2, null::bigint as n3,
      {r(f"(count(*) - count({c})) / cast(count(*) as double)", 2)} as x1, null::double as x2, null::double as x3
    from {source} having (count(*) - count({c})) / cast(count(*) as double) > 0.01"""


def _columns(df: DataFrame, report: str, **names: str) -> DataFrame:
    """A report in the shared columns n1 to n3 (counts) and x1 to x3 (numbers)."""
    kinds = {f"n{i}": "bigint" for i in (1, 2, 3)} | {f"x{i}": "double" for i in (1, 2, 3)}
    return df.select(
        F.lit(report).alias("report"), "column", *[(F.col(names[n]) if n in names else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]
    )


@query(
    "anomaly_scan",
    with_views(
        "dirty_lines",
        body=_union(
            [_outliers(c, "dirty_lines") for c in LINES_NUMERIC]
            + [f(c, "dirty_lines") for f in (_quasi, _missing) for c in LINES_NUMERIC + LINES_OTHER]
        ),
    ),
)
def anomaly_scan(spark, sf_dir):
    """Outliers, nearly constant columns and missing values over all columns of the order lines."""
    found = profiling.scan_anomalies(view(spark, sf_dir, "dirty_lines"), constant_threshold=0.2, missing_threshold=0.01)
    parts = [
        _columns(
            found["outliers"], "outliers", n1="n_outliers_iqr", n2="n_outliers_modified_z", n3="n_outliers_both_methods", x1="pct_agreement", x2="min", x3="max"
        ),
        _columns(found["quasi_constant"], "quasi_constant", n1="n_unique", x1="dominant_share"),
        _columns(found["high_missing"], "high_missing", n1="n_missing", x1="missing_rate"),
    ]
    return settled(parts[0].unionByName(parts[1]).unionByName(parts[2]), 2)


def _part(name: str, column: str = "null::varchar", s: str = "null::varchar", n1: str = "null::bigint", n2: str = "null::bigint", x1: str = "null::double", x2: str = "null::double") -> str:
    return f"""select '{name}' as part, {column} as "column", {s} as s, {n1} as n1, {n2} as n2, {x1} as x1, {x2} as x2"""


def _dominant(part: str, c: str, least: float = 0.0) -> str:
    shown = f"(select cast({c} as {'varchar' if c in APP_TEXT else 'double'}) from app where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
    share = f"{_top(c, 'app')} / cast(count({c}) as double)"
    number, words = ("null::double", shown) if c in APP_TEXT else (r(shown), "null::varchar")
    return _part(part, f"'{c}'", words, f"count(distinct {c})", x1=r(share), x2=number) + f" from app having {share} >= {least}"


@query(
    "table_profile",
    with_views(
        "app",
        body=_union(
            [
                _part("missing", f"'{c}'", n1=f"count(*) - count({c})", x1=r(f"100e0 * (count(*) - count({c})) / count(*)")) + f" from app having count(*) > count({c})"
                for c in APP_NUMERIC + APP_TEXT
            ]
            + [_part("duplicates", n1="count(*)", n2="count(*) - (select count(*) from (select distinct * from app) t)") + " from app"]
            + [_dominant("dominant", c) for c in APP_NUMERIC + APP_TEXT]
            + [_dominant("quasi_constant", c, 0.99) for c in APP_NUMERIC + APP_TEXT]
            + [_dominant("categories", c) for c in APP_TEXT]
            + [
                _part("keys", f"'{c}'", n1=f"count(distinct {c})", n2=_top(c, "app"), x1=r(f"count(*) / cast(count(distinct {c}) as double)"), x2=r(f"case when count(distinct {c}) = count(*) then 1 else 0 end")) + " from app"
                for c in ("SK_ID_CURR", "CNT_CHILDREN")
            ]
            + [_part("day_ranges", f"'{c}'", x1=r(f"min({c})"), x2=r(f"max({c})")) + " from app" for c in ("DAYS_BIRTH", "DAYS_EMPLOYED")]
        ),
    ),
)
def table_profile(spark, sf_dir):
    """All seven parts of the profile of the applications, every column in it."""
    parts = profiling.profile_table(view(spark, sf_dir, "app"), ["SK_ID_CURR", "CNT_CHILDREN"])
    number = F.when(F.col("column").isin(APP_NUMERIC), F.col("dominant_value").try_cast("double"))
    words = F.when(F.col("column").isin(APP_TEXT), F.col("dominant_value"))
    frequent = {"n1": F.col("n_unique"), "x1": F.col("dominant_share"), "x2": number, "s": words}
    shapes = {
        "missing": {"n1": F.col("n_missing"), "x1": F.col("pct_missing")},
        "duplicates": {"column": F.lit(None), "n1": F.col("n_rows"), "n2": F.col("n_duplicates")},
        "dominant": frequent,
        "quasi_constant": frequent,
        "categories": frequent,
        "keys": {"column": F.col("key"), "n1": F.col("n_unique"), "n2": F.col("max_rows"), "x1": F.col("mean_rows"), "x2": F.col("is_unique").cast("int")},
        "day_ranges": {"x1": F.col("min"), "x2": F.col("max")},
    }
    kinds = {"column": "string", "s": "string", "n1": "bigint", "n2": "bigint", "x1": "double", "x2": "double"}
    out = None
    for name, shape in shapes.items():
        shape = {"column": F.col("column"), **shape} if "column" not in shape else shape
        rows = parts[name].select(F.lit(name).alias("part"), *[shape.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        out = rows if out is None else out.unionByName(rows)
    return settled(out)


@query(
    "duplicate_rows_whole",
    "select cast(2 * count(*) as bigint) as n_rows, cast(2 * count(*) - (select count(*) from (select distinct * from lineitem) t) as bigint) as n_duplicates from lineitem",
)
def duplicate_rows_whole(spark, sf_dir):
    """Whole rows compared: every order line delivered twice."""
    rows = table(spark, sf_dir, "lineitem")
    return profiling.duplicate_rows(rows.unionByName(rows))


@query(
    "csv_scan",
    with_views(
        "app",
        body=f"""select CODE_GENDER, NAME_EDUCATION_TYPE, count(*) as n, count(EXT_SOURCE_1) as n_ext, {r("sum(AMT_INCOME_TOTAL)", 1)} as income, cast(sum(DAYS_BIRTH) as bigint) as days
        from app where AMT_CREDIT > 250000 group by all""",
    ),
)
def csv_scan(spark, sf_dir):
    """The applications written as CSV and read back with a declared schema, a filter and five of their columns."""
    rows = view(spark, sf_dir, "app")
    path = staging_path(spark, "applications-csv")
    rows.write.option("header", True).csv(path)
    wanted = ["CODE_GENDER", "NAME_EDUCATION_TYPE", "EXT_SOURCE_1", "AMT_INCOME_TOTAL", "DAYS_BIRTH"]
    back = readers.read_csv(spark, path, rows.schema, wanted, where=[("AMT_CREDIT", ">", 250000.0)])
    return settled(
        back.groupBy("CODE_GENDER", "NAME_EDUCATION_TYPE").agg(
            F.count(F.lit(1)).alias("n"), F.count("EXT_SOURCE_1").alias("n_ext"), F.sum("AMT_INCOME_TOTAL").alias("income"), F.sum("DAYS_BIRTH").alias("days")
        ),
        1,
    )


# --- monitoring ------------------------------------------------------------------------------

WEEK = "(select * from calls_log where created_at >= timestamp '2024-01-31' - interval 168 hours)"
K_OF_LOG = "try_cast(regexp_extract(features, '\"k\": *([0-9]+)', 1) as bigint)"


def _figures(part: str, key: str, value: str, rest: str) -> str:
    return f"select '{part}' as part, {key} as item, {r(value)} as x {rest}"


def _per_day(part: str, value: str, where: str = "true") -> str:
    """A value per day, days between the first and the last without calls included."""
    days = f"(select unnest(range(date_trunc('day', min(created_at)), date_trunc('day', max(created_at)) + interval 1 day, interval 1 day)) as day from {WEEK} where {where})"
    counted = f"(select date_trunc('day', created_at) as day, {value} as v from {WEEK} where {where} group by 1)"
    return _figures(part, "strftime(d.day, '%Y-%m-%d')", "v", f"from {days} d left join {counted} c using (day)")


@query(
    "monitoring_figures",
    with_views(
        "log",
        body=f""", old as (select {K_OF_LOG} as k from calls_log where created_at < timestamp '2024-01-16'),
        new as (select {K_OF_LOG} as k from {WEEK} where status = 'succes'),
        steps as (select k as v, cast(sum(r) over (order by k) as double) as cum_r, cast(sum(c) over (order by k) as double) as cum_c, sum(r) over () as n_r, sum(c) over () as n_c,
            lead(k) over (order by k) as nxt from (select k, sum(r) as r, sum(c) as c from (select k, 1 as r, 0 as c from old union all select k, 0, 1 from new) b where k is not null group by k) g),
        w1 as (select round(sum(abs(cum_r / n_r - cum_c / n_c) * (nxt - v)) / greatest((select stddev_pop(k) from old), 0.001), 4) as score from steps)
        """
        + _union(
            [
                _figures("headline", f"'{k}'", v, f"from {WEEK}")
                for k, v in (
                    ("calls", "count(*)"),
                    ("error_rate", "avg(case when status <> 'succes' then 1 else 0 end)"),
                    ("refusal_rate", "avg(case when decision = 'refusé' then 1 else 0 end) filter (where status = 'succes')"),
                    ("median_latency", "quantile_cont(latency_ms, 0.5) filter (where status = 'succes')"),
                    ("known_share", "avg(case when history_found then 1 else 0 end) filter (where status = 'succes')"),
                )
            ]
            + [_figures("errors", "status || ' ' || error_type", "count(*)", f"from {WEEK} where status <> 'succes' and error_type is not null group by status, error_type")]
            + [_per_day("volume", "count(*)"), _per_day("error_rate", "avg(case when status <> 'succes' then 1 else 0 end)")]
            + [_per_day("refusal_rate", "avg(case when decision = 'refusé' then 1 else 0 end)", "status = 'succes'")]
            + [_per_day(f"latency_{n}", f"quantile_cont(latency_ms, {q})", "status = 'succes'") for n, q in (("median", 0.5), ("p95", 0.95))]
            + [
                _figures("histogram", "cast(b as varchar)", "coalesce(n, 0)", f"""from (select unnest(range(20)) as b) bins left join (
                  select least(cast(floor(probability * 20) as bigint), 19) as b, count(*) as n from {WEEK} where status = 'succes' and probability between 0 and 1 group by 1) c using (b)""")
            ]
            + [
                _figures("drift_score", "'k'", "score", "from w1"),
                _figures("drift_summary", "'columns_drifted'", "case when score > 0.1 then 1 else 0 end", "from w1"),
                _figures("drift_summary", "'columns_compared'", "1", "from w1"),
                _figures("drift_summary", "'share_drifted'", "case when score > 0.1 then 1 else 0 end", "from w1"),
                _figures("drift_summary", "'n_rows'", "(select count(*) from new)", "from w1"),
            ]
        ),
    ),
)
def monitoring_figures(spark, sf_dir):
    """Every figure of the monitoring report of one week, its drift included."""
    log = view(spark, sf_dir, "log")
    old = contract.expand_json(log.where(F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")), "features", T.StructType([T.StructField("k", T.LongType())]))
    report = analyse(log, old, "7d", datetime(2024, 1, 31))

    def part(name: str, df: DataFrame, item: Column, value: str) -> DataFrame:
        return df.select(F.lit(name).alias("part"), item.cast("string").alias("item"), F.col(value).cast("double").alias("x"))

    def named(name: str, df: DataFrame, columns: list[str]) -> DataFrame:
        wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        return part(name, wide.unpivot([], columns, "item", "x"), F.col("item"), "x")

    day = F.date_format("bucket", "yyyy-MM-dd")
    parts = [
        named("headline", report["headline"], ["calls", "error_rate", "refusal_rate", "median_latency", "known_share"]),
        part("errors", report["errors"], F.concat_ws(" ", "status", "error_type"), "calls"),
        part("volume", report["volume"], day, "n"),
        part("error_rate", report["error_rate"], day, "error_rate"),
        part("refusal_rate", report["refusal_rate"], day, "refusal_rate"),
        *[part(f"latency_{m}", report["latency"].where(F.col("measure") == m), day, "ms") for m in ("median", "p95")],
        part("histogram", report["probabilities"], F.col("bin"), "n"),
        part("drift_score", report["drift"], F.col("column"), "score"),
        named("drift_summary", report["drift_summary"], ["columns_drifted", "columns_compared", "share_drifted", "n_rows"]),
    ]
    return settled(reduce(DataFrame.unionByName, parts))


@query("protected_clusters", ORACLES["cluster_reduction"])
def protected_clusters(spark, sf_dir):
    """The same clusters with counts, sums and anomaly flags beside them, each a copy of a clustered column: none of them is touched."""
    rows = _derived(spark, sf_dir)
    names = list(DERIVED)
    beside = {f"{names[0]}_COUNT": names[0], f"{names[1]}_sum": names[1], f"ANOM_{names[2]}": names[2]}
    wide = rows.withColumns({c: F.col(source) for c, source in beside.items()})
    kept, dropped, audit = clustering.fit_drop_list(wide, [*names, *beside], "label", 0.7)
    if set(beside) & {*kept, *dropped}:
        raise ValueError("a protected column was clustered")
    return settled(audit.withColumn("dropped", F.array_join("dropped", ",")))


@query("strongest_to_csv", f"select \"column\" as feature, abs_corr as importance from ({ORACLES['label_correlation']}) t order by abs_corr desc, \"column\" limit 3")
def strongest_to_csv(spark, sf_dir):
    """The columns that go most with the label, as the top of a CSV file and read back."""
    strength = association.label_correlation(_derived(spark, sf_dir), list(DERIVED), "label")
    path = staging_path(spark, "strongest")
    write_top_importance(strength.select(F.col("column").alias("feature"), F.col("abs_corr").alias("importance")), path, 3)
    return settled(spark.read.option("header", True).schema("feature string, importance double").csv(path))
