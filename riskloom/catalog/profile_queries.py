"""Profiles, outliers, bins, samples and associations over the given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from riskloom.catalog.registry import query
from riskloom.catalog.views import r, settled, table, view, with_views
from riskloom.functions.scalars import SPREAD_RANGE, settle, spread_sql
from riskloom.operators import association, binning, clustering, modeling, profiling, sampling

DIRTY = ["qty", "price", "discount", "tax"]


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


# --- profiles ------------------------------------------------------------------------------


@query(
    "missing_table",
    with_views(
        "dirty_lines",
        body=_union(
            [
                f"""select '{c}' as "column", count(*) - count({c}) as n_missing,
                {r(f"100e0 * (count(*) - count({c})) / count(*)")} as pct_missing
                from dirty_lines having count(*) > count({c})"""
                for c in DIRTY
            ]
        ),
    ),
)
def missing_table(spark, sf_dir):
    return settled(profiling.missing_table(view(spark, sf_dir, "dirty_lines")))


@query(
    "high_missing",
    with_views(
        "app",
        body=_union(
            [
                f"""select '{c}' as "column", {r(f"(count(*) - count({c})) / cast(count(*) as double)")} as missing_rate,
                count(*) - count({c}) as n_missing from app having (count(*) - count({c})) / cast(count(*) as double) > 0.15"""
                for c in ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "AMT_INCOME_TOTAL", "NAME_INCOME_TYPE"]
            ]
        ),
    ),
)
def high_missing(spark, sf_dir):
    columns = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "AMT_INCOME_TOTAL", "NAME_INCOME_TYPE"]
    return settled(profiling.high_missing(view(spark, sf_dir, "app"), 0.15, columns))


@query(
    "overall_missing",
    with_views(
        "dirty_lines",
        body=f"""select {r('''((count(*) - count(qty)) + (count(*) - count(discount))) / (4e0 * count(*))''')} as missing_rate
        from dirty_lines""",
    ),
)
def overall_missing(spark, sf_dir):
    return settled(profiling.overall_missing_rate(view(spark, sf_dir, "dirty_lines"), DIRTY))


@query(
    "duplicate_count",
    """select cast(count(*) as bigint) as n_rows, cast(count(*) - (select count(*) from (select distinct l_suppkey, l_quantity, l_returnflag, l_linestatus
    from lineitem) t) as bigint) as n_duplicates from lineitem""",
)
def duplicate_count(spark, sf_dir):
    return profiling.duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"])


@query(
    "key_profile",
    _union(
        [
            f"""select '{k}' as key, count(distinct {k}) as n_unique, count(distinct {k}) = count(*) as is_unique,
            {r(f"count(*) / cast(count(distinct {k}) as double)")} as mean_rows,
            (select max(m) from (select count(*) as m from orders group by {k}) t) as max_rows from orders"""
            for k in ["o_orderkey", "o_custkey"]
        ]
    ),
)
def key_profile(spark, sf_dir):
    return settled(profiling.key_profile(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"]))


@query(
    "value_frequency",
    f"""select p_brand as value, count(*) as n, {r("count(*) / cast(sum(count(*)) over () as double)")} as share from part group by p_brand""",
)
def value_frequency(spark, sf_dir):
    return settled(profiling.value_frequency(table(spark, sf_dir, "part"), "p_brand"))


@query(
    "value_frequency_top",
    """select p_size as value, count(*) as n from part group by p_size order by n desc, value limit 10""",
)
def value_frequency_top(spark, sf_dir):
    return profiling.value_frequency(table(spark, sf_dir, "part"), "p_size", top=10, normalize=False)


DOMINANT_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query(
    "dominant_value",
    _union(
        [
            f"""select '{c}' as "column", (select cast({c} as varchar) from lineitem group by {c} order by count(*) desc, {c} limit 1) as dominant_value,
            {r(f"(select max(m) from (select count(*) as m from lineitem group by {c}) t) / cast(count({c}) as double)")} as dominant_share,
            count(distinct {c}) as n_unique from lineitem"""
            for c in DOMINANT_COLUMNS
        ]
    ),
)
def dominant_value(spark, sf_dir):
    return settled(profiling.dominant_value(table(spark, sf_dir, "lineitem"), DOMINANT_COLUMNS))


@query(
    "quasi_constant",
    with_views(
        "app",
        body=_union(
            [
                f"""select * from (select '{c}' as "column",
                (select cast({c} as varchar) from app where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as dominant_value,
                {r(f"(select max(m) from (select count(*) as m from app where {c} is not null group by {c}) t) / cast(count({c}) as double)")} as dominant_share,
                count(distinct {c}) as n_unique from app) t where dominant_share >= 0.85"""
                for c in ["FLAG_DOCUMENT_4", "FLAG_DOCUMENT_5", "CODE_GENDER", "FLAG_OWN_CAR"]
            ]
        ),
    ),
)
def quasi_constant(spark, sf_dir):
    columns = ["FLAG_DOCUMENT_4", "FLAG_DOCUMENT_5", "CODE_GENDER", "FLAG_OWN_CAR"]
    return settled(profiling.quasi_constant(view(spark, sf_dir, "app"), 0.85, columns))


@query(
    "distinct_counts",
    _union([f"""select '{c}' as "column", count(distinct {c}) as n_unique from part""" for c in ["p_brand", "p_type", "p_size"]]),
)
def distinct_counts(spark, sf_dir):
    return profiling.distinct_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query(
    "describe_numeric",
    with_views(
        "dirty_lines",
        body=_union(
            [
                f"""select '{c}' as "column", count({c}) as n, {r(f"avg({c})")} as mean, {r(f"stddev_samp({c})")} as std,
                {r(f"min({c})")} as min, {r(f"quantile_cont({c}, 0.25)")} as p25, {r(f"quantile_cont({c}, 0.5)")} as p50,
                {r(f"quantile_cont({c}, 0.75)")} as p75, {r(f"max({c})")} as max from dirty_lines"""
                for c in DIRTY
            ]
        ),
    ),
)
def describe_numeric(spark, sf_dir):
    return settled(profiling.describe(view(spark, sf_dir, "dirty_lines"), DIRTY))


@query(
    "label_rate_by_group",
    with_views(
        "app",
        body=f"""select NAME_EDUCATION_TYPE, {r("avg(TARGET)")} as rate, count(TARGET) as n from app
        where NAME_EDUCATION_TYPE is not null group by NAME_EDUCATION_TYPE""",
    ),
)
def label_rate_by_group(spark, sf_dir):
    return settled(profiling.rate_by_group(view(spark, sf_dir, "app"), ["NAME_EDUCATION_TYPE"], "TARGET"))


@query(
    "crosstab_share",
    f"""select o_orderpriority, {r("avg(case when o_orderstatus = 'F' then 1 else 0 end)")} as "F",
    {r("avg(case when o_orderstatus = 'O' then 1 else 0 end)")} as "O",
    {r("avg(case when o_orderstatus = 'P' then 1 else 0 end)")} as "P" from orders group by o_orderpriority""",
)
def crosstab_share(spark, sf_dir):
    return settled(profiling.crosstab_share(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]))


@query(
    "day_ranges",
    with_views(
        "app",
        body="""select 'DAYS_BIRTH' as "column", cast(min(DAYS_BIRTH) as double) as min, cast(max(DAYS_BIRTH) as double) as max from app
        union all select 'DAYS_EMPLOYED', cast(min(DAYS_EMPLOYED) as double), cast(max(DAYS_EMPLOYED) as double) from app""",
    ),
)
def day_ranges(spark, sf_dir):
    return profiling.profile_table(view(spark, sf_dir, "app"), ["SK_ID_CURR"])["day_ranges"]


@query(
    "class_ratio",
    with_views(
        "app",
        body=f"""select cast(sum(case when TARGET = 0 then 1 else 0 end) as bigint) as negatives,
        cast(sum(case when TARGET = 1 then 1 else 0 end) as bigint) as positives,
        {r("sum(case when TARGET = 0 then 1 else 0 end) / cast(sum(case when TARGET = 1 then 1 else 0 end) as double)")} as class_ratio
        from app""",
    ),
)
def class_ratio(spark, sf_dir):
    return settled(profiling.class_ratio(view(spark, sf_dir, "app"), "TARGET"))


@query(
    "conditional_counts",
    with_views(
        "app",
        body="""select count(case when AMT_GOODS_PRICE = 0 then 1 end) as zero_goods, count(case when DAYS_EMPLOYED < 0 then 1 end) as employed,
        count(case when DAYS_EMPLOYED = 365243 then 1 end) as sentinel, count(case when AMT_INCOME_TOTAL < 1000 then 1 end) as poor from app""",
    ),
)
def conditional_counts(spark, sf_dir):
    return profiling.conditional_counts(
        view(spark, sf_dir, "app"),
        {
            "zero_goods": F.col("AMT_GOODS_PRICE") == 0,
            "employed": F.col("DAYS_EMPLOYED") < 0,
            "sentinel": F.col("DAYS_EMPLOYED") == 365243,
            "poor": F.col("AMT_INCOME_TOTAL") < 1000,
        },
    )


# --- outliers ------------------------------------------------------------------------------

# A long right tail: prices to the fourth power, counts of order lines, and a two-valued flag.
OUTLIER_VIEW = """
    outlier_rows as (select o_orderkey, o_totalprice * o_totalprice * o_totalprice / 1e12 as cubed, cast(o_orderkey % 50 as double) as flat,
      case when o_orderkey % 40 = 0 then 1000e0 + o_orderkey % 7 else cast(o_orderkey % 9 as double) end as spiky,
      cast(o_orderkey % 2 as double) as two_valued from orders)"""
OUTLIER_COLUMNS = ["cubed", "flat", "spiky"]


def _outlier_rows(spark, sf_dir):
    text = OUTLIER_VIEW.split("as (", 1)[1].rsplit(")", 1)[0].replace("from orders", "from {orders}")
    return spark.sql(text, orders=table(spark, sf_dir, "orders"))


def _limits(c: str) -> str:
    return f"""
    {c}_q as (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as med, quantile_cont({c}, 0.75) as q3 from outlier_rows),
    {c}_m as (select quantile_cont(abs({c} - med), 0.5) as mad from outlier_rows, {c}_q),
    {c}_f as (select o_orderkey, {c} as x, ({c} < q1 - 1.5e0 * (q3 - q1) or {c} > q3 + 1.5e0 * (q3 - q1)) as iqr,
       (mad <> 0 and abs(0.6745e0 * ({c} - med) / case when mad <> 0 then mad else 1 end) > 3.5) as modz from outlier_rows, {c}_q, {c}_m)"""


OUTLIER_CTES = "with " + OUTLIER_VIEW + "," + ",".join(_limits(c) for c in OUTLIER_COLUMNS)


@query(
    "outlier_report",
    OUTLIER_CTES
    + _union(
        [
            f""" select '{c}' as "column", count(*) filter (where iqr) as n_outliers_iqr, count(*) filter (where modz) as n_outliers_modified_z,
            count(*) filter (where iqr and modz) as n_outliers_both_methods,
            {r("100e0 * count(*) filter (where iqr and modz) / greatest(count(*) filter (where iqr), count(*) filter (where modz), 1)", 2)} as pct_agreement,
            {r("min(x)", 2)} as min, {r("max(x)", 2)} as max from {c}_f having count(*) filter (where iqr) > 0 or count(*) filter (where modz) > 0"""
            for c in OUTLIER_COLUMNS
        ]
    ),
)
def outlier_report(spark, sf_dir):
    rows = _outlier_rows(spark, sf_dir)
    bounds = profiling.fit_outlier_bounds(rows, [*OUTLIER_COLUMNS, "two_valued"], iqr_multiplier=1.5)
    return settled(profiling.outlier_report(rows, bounds), 2)


@query(
    "outliers_per_row",
    OUTLIER_CTES
    + """ select n_outliers_row, count(*) as n from (
      select a.o_orderkey, cast((a.iqr and a.modz)::int + (b.iqr and b.modz)::int + (c.iqr and c.modz)::int as int) as n_outliers_row
      from cubed_f a join flat_f b using (o_orderkey) join spiky_f c using (o_orderkey)) t group by n_outliers_row""",
)
def outliers_per_row(spark, sf_dir):
    rows = _outlier_rows(spark, sf_dir)
    bounds = profiling.fit_outlier_bounds(rows, OUTLIER_COLUMNS, iqr_multiplier=1.5)
    return profiling.outliers_per_row(rows, bounds).groupBy("n_outliers_row").agg(F.count(F.lit(1)).alias("n"))


@query("flagged_rows", OUTLIER_CTES + " select o_orderkey, x as spiky from spiky_f where iqr and modz")
def flagged_rows(spark, sf_dir):
    rows = _outlier_rows(spark, sf_dir)
    bounds = profiling.fit_outlier_bounds(rows, ["spiky"], iqr_multiplier=1.5)
    return profiling.flagged_rows(rows, bounds[0], "both").select("o_orderkey", "spiky")


# --- bins ----------------------------------------------------------------------------------


@query(
    "equal_width_bins",
    f"""with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
    b as (select least(greatest(ceil((o_totalprice - lo) / ((hi - lo) / 5)), 1), 5) as bin, o_orderstatus from orders, e)
    select cast(bin as int) as bin, {r("avg(case when o_orderstatus = 'F' then 1 else 0 end)")} as rate, count(*) as n from b group by bin""",
)
def equal_width_bins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    binned = binning.right_closed_bin(orders, "o_totalprice", binning.equal_width_edges(orders, "o_totalprice", 5), "bin")
    return settled(profiling.rate_by_group(binned, ["bin"], "label"))


@query(
    "quantile_bins",
    f"""with e as (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.5) as b,
      quantile_cont(l_extendedprice, 0.75) as c from lineitem)
    select cast(case when l_extendedprice <= a then 1 when l_extendedprice <= b then 2 when l_extendedprice <= c then 3 else 4 end as int) as bin,
      {r("avg(case when l_returnflag = 'R' then 1 else 0 end)")} as rate, count(*) as n from lineitem, e group by 1""",
)
def quantile_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    edges = binning.quantile_edges(rows, "l_extendedprice", 4)
    binned = binning.right_closed_bin(rows, "l_extendedprice", edges, "bin", lowest=True)
    return settled(profiling.rate_by_group(binned, ["bin"], "label"))


@query(
    "probability_histogram",
    with_views(
        "log",
        body="""select cast(range as int) as bin, range * 0.05e0 as bin_start, count(bin) as n
        from range(20) left join (select least(floor(probability / 0.05e0), 19) as bin from calls_log where probability between 0 and 1) b
        on bin = range group by range""",
    ),
)
def probability_histogram(spark, sf_dir):
    return binning.fixed_histogram(view(spark, sf_dir, "log"), "probability", 0.0, 1.0, 20)


DENSITY_SQL = f"""
    with v as (select value as x, case when ts < timestamp '2024-01-16' then 'reference' else 'current' end as source from events),
    e as (select min(x) as lo, max(x) as hi from v),
    b as (select source, least(floor((x - lo) / ((hi - lo) / 30e0)), 29) as bin, count(*) as n from v, e group by 1, 2),
    t as (select source, count(*) as total from v group by 1)
    select cast(range as int) as bin, {r("lo + (range + 0.5e0) * ((hi - lo) / 30e0)")} as center,
      {r("coalesce(n, 0) / (total * ((hi - lo) / 30e0))", 6)} as density, t.source as source
    from range(30) cross join t cross join e left join b on b.bin = range and b.source = t.source"""


@query("density_compare", DENSITY_SQL)
def density_compare(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    switch = F.lit("2024-01-16").cast("timestamp_ntz")
    out = binning.compared_density(events.where(F.col("ts") < switch), events.where(F.col("ts") >= switch), "value", 30)
    return out.select("bin", settle(F.col("center")).alias("center"), settle(F.col("density"), 6).alias("density"), "source")


# --- samples -------------------------------------------------------------------------------


@query(
    "first_rows",
    "select c_custkey from customer order by c_custkey limit 100",
)
def first_rows(spark, sf_dir):
    return sampling.first_rows(table(spark, sf_dir, "customer", ["c_custkey"]), "c_custkey", 100)


@query(
    "top_rows",
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
)
def top_rows(spark, sf_dir):
    return sampling.top_rows(table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]), "o_totalprice", 20, ["o_orderkey"])


@query(
    "seeded_sample",
    f"select doc_id, lang, n_chars from documents order by {spread_sql('doc_id')}, doc_id limit 100",
)
def seeded_sample(spark, sf_dir):
    return sampling.seeded_sample(table(spark, sf_dir, "documents", ["doc_id", "lang", "n_chars"]), "doc_id", 100)


@query(
    "stratified_sample",
    f"""select doc_id, quality from (select doc_id, quality, row_number() over (partition by quality order by {spread_sql('doc_id')}, doc_id) as rn,
      count(*) over (partition by quality) as m, count(*) over () as total from labels) t
    where rn <= floor(60e0 * m / total + 0.5e0)""",
)
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(table(spark, sf_dir, "labels", ["doc_id", "quality"]), "doc_id", "quality", 60)


@query(
    "stratified_folds",
    f"""select doc_id, quality, cast((row_number() over (partition by quality order by {spread_sql('doc_id')}, doc_id) - 1) % 5 as int) as fold
    from labels""",
)
def stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(table(spark, sf_dir, "labels", ["doc_id", "quality"]), "doc_id", "quality")


@query("distinct_keys", "select distinct o_custkey from orders")
def distinct_keys(spark, sf_dir):
    return sampling.distinct_keys(table(spark, sf_dir, "orders"), "o_custkey")


@query(
    "dummy_scores",
    f"""select doc_id, case when {spread_sql('doc_id')} / {SPREAD_RANGE}e0 < (select avg(quality) from labels) then 1e0 else 0e0 end as score
    from labels""",
)
def dummy_scores(spark, sf_dir):
    return modeling.dummy_scores(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "score")


# --- association ---------------------------------------------------------------------------


def _corr_sql(source: str, pairs, extra: str = "") -> str:
    return _union(
        [
            f"""select '{a}' as var_1, '{b}' as var_2, count(*) filter (where {a} is not null and {b} is not null) as n,
            {r(f"corr({a}, {b})")} as corr from {source}{extra}"""
            for a, b in pairs
        ]
    )


CORR_COLUMNS = ["discount", "price", "qty", "tax"]


@query("pearson_pairs", with_views("dirty_lines", body=_corr_sql("dirty_lines", combinations(CORR_COLUMNS, 2))))
def pearson_pairs(spark, sf_dir):
    return settled(association.pearson_pairs(view(spark, sf_dir, "dirty_lines"), CORR_COLUMNS))


WIDE = {f"c{i:02d}": f"(l_quantity * {i} + l_extendedprice / 1000e0 * {14 - i} + l_tax * {i * i})" for i in range(15)}
WIDE_CTE = "with w as (select " + ", ".join(
    f"case when (l_orderkey + {i}) % 11 <> 0 then {e} end as {n}" for i, (n, e) in enumerate(WIDE.items())
) + " from lineitem) "


@query("pearson_wide", WIDE_CTE + _corr_sql("w", combinations(sorted(WIDE), 2)))
def pearson_wide(spark, sf_dir):
    """Fifteen columns: cross products summed as matrices per task."""
    text = WIDE_CTE.split("as (", 1)[1].rsplit(")", 1)[0].replace("from lineitem", "from {lineitem}")
    wide = spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))
    return settled(association.pearson_pairs(wide, list(WIDE)))


RANK_VIEW = """
    ranked_rows as (select o_orderkey, o_totalprice as price, case when o_orderkey % 6 <> 0 then cast(o_custkey as double) end as client,
      cast(o_orderkey % 3 as double) as third from orders)"""
RANK_COLUMNS = ["client", "price", "third"]


def _rank_rows(spark, sf_dir):
    text = RANK_VIEW.split("as (", 1)[1].rsplit(")", 1)[0].replace("from orders", "from {orders}")
    return spark.sql(text, orders=table(spark, sf_dir, "orders"))


RANKS_SQL = (
    "with "
    + RANK_VIEW
    + ", k as (select o_orderkey, "
    + ", ".join(
        f"case when {c} is not null then rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2e0 end as {c}"
        for c in RANK_COLUMNS
    )
    + " from ranked_rows) "
)


@query("spearman_pairs", RANKS_SQL + _corr_sql("k", combinations(RANK_COLUMNS, 2)))
def spearman_pairs(spark, sf_dir):
    return settled(association.spearman_pairs(_rank_rows(spark, sf_dir), RANK_COLUMNS))


@query("average_ranks", RANKS_SQL + "select o_orderkey, client, price, third from k")
def average_ranks(spark, sf_dir):
    return association.rank_columns(_rank_rows(spark, sf_dir), ["o_orderkey"], RANK_COLUMNS)


DERIVED = {
    "price": "l_extendedprice",
    "price_net": "l_extendedprice * (1 - l_discount)",
    "price_gross": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
    "qty": "l_quantity",
    "qty_noisy": "l_quantity + l_linenumber",
    "qty_double": "l_quantity * 2 - l_linenumber",
    "line": "cast(l_linenumber as double)",
    "discount": "l_discount + 0",
}
DERIVED_CTE = "derived as (select " + ", ".join(f"{e} as {n}" for n, e in DERIVED.items()) + (
    ", case when l_returnflag = 'R' then 1 else 0 end as label from lineitem)"
)


def _derived(spark, sf_dir):
    text = DERIVED_CTE.split("as (", 1)[1].rsplit(")", 1)[0].replace("from lineitem", "from {lineitem}")
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))


PAIRS_CTE = (
    f"with recursive {DERIVED_CTE}, pairs as (select var_1, var_2, abs(corr) as abs_corr from ("
    + _union([f"select '{a}' as var_1, '{b}' as var_2, corr({a}, {b}) as corr from derived" for a, b in combinations(sorted(DERIVED), 2)])
    + ") t where abs(corr) >= 0.7)"
)
COMPONENTS_CTE = PAIRS_CTE + """,
    both_ways as (select var_1 as a, var_2 as b from pairs union select var_2, var_1 from pairs),
    reach as (select a as node, a as other from both_ways union select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a),
    components as (select node, min(other) as component from reach group by node)"""


@query("high_pairs", PAIRS_CTE + f" select var_1, var_2, {r('abs_corr')} as abs_corr from pairs")
def high_pairs(spark, sf_dir):
    return settled(association.high_pairs(association.pearson_pairs(_derived(spark, sf_dir), list(DERIVED)), 0.7))


@query("correlation_clusters", COMPONENTS_CTE + " select node, component from components")
def correlation_clusters(spark, sf_dir):
    pairs = association.high_pairs(association.pearson_pairs(_derived(spark, sf_dir), list(DERIVED)), 0.7)
    return clustering.connected_components(pairs)


LABEL_CORR = "(" + _union([f"select '{c}' as \"column\", corr({c}, label) as corr from derived" for c in sorted(DERIVED)]) + ")"


@query(
    "cluster_sizes",
    COMPONENTS_CTE + " select component, count(*) as cluster_size, string_agg(node, ',' order by node) as members from components group by component",
)
def cluster_sizes(spark, sf_dir):
    pairs = association.high_pairs(association.pearson_pairs(_derived(spark, sf_dir), list(DERIVED)), 0.7)
    return clustering.cluster_sizes(clustering.connected_components(pairs)).withColumn(
        "members", F.array_join("members", ",")
    )


@query(
    "cluster_reduction",
    COMPONENTS_CTE
    + f""", lc as {LABEL_CORR},
    scored as (select node, component, abs(corr) as v, row_number() over (partition by component order by abs(corr) desc, node) as rn
      from components join lc on node = "column")
    select count(*) as cluster_size, max(case when rn = 1 then node end) as kept, {r("max(case when rn = 1 then v end)")} as label_corr,
      coalesce(string_agg(case when rn > 1 then node end, ',' order by node), '') as dropped from scored group by component""",
)
def cluster_reduction(spark, sf_dir):
    _, _, audit = clustering.fit_drop_list(_derived(spark, sf_dir), list(DERIVED), "label", 0.7)
    return settled(audit.withColumn("dropped", F.array_join("dropped", ",")))


@query(
    "label_correlation",
    f"with {DERIVED_CTE} select \"column\", {r('corr')} as corr, {r('abs(corr)')} as abs_corr from {LABEL_CORR} t",
)
def label_correlation(spark, sf_dir):
    return settled(association.label_correlation(_derived(spark, sf_dir), list(DERIVED), "label"))


VARIANTS = {
    "FLOORS_AVG": "l_quantity",
    "FLOORS_MODE": "l_quantity + l_linenumber",
    "FLOORS_MEDI": "l_quantity * 2 - l_linenumber",
    "AREA_AVG": "l_extendedprice",
    "AREA_MODE": "l_extendedprice * (1 - l_discount)",
}
VARIANT_CTE = "variants as (select " + ", ".join(f"{e} as {n}" for n, e in VARIANTS.items()) + (
    ", case when l_returnflag = 'R' then 1 else 0 end as label from lineitem)"
)


def _variant_table(spark, sf_dir):
    text = VARIANT_CTE.split("as (", 1)[1].rsplit(")", 1)[0].replace("from lineitem", "from {lineitem}")
    rows = spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))
    return clustering.variant_comparison(
        association.label_correlation(rows, list(VARIANTS), "label"), ["_AVG", "_MODE", "_MEDI"]
    )


VARIANT_SQL = f"""with {VARIANT_CTE}, c as (
      select 'AREA' as base_variable, corr(AREA_AVG, label) as a, corr(AREA_MODE, label) as b, cast(null as double) as m from variants
      union all select 'FLOORS', corr(FLOORS_AVG, label), corr(FLOORS_MODE, label), corr(FLOORS_MEDI, label) from variants),
    best as (select base_variable, a, b, m, case when abs(a) >= coalesce(abs(b), 0) and abs(a) >= coalesce(abs(m), 0) then '_AVG'
      when abs(b) >= coalesce(abs(m), 0) then '_MODE' else '_MEDI' end as best_suffix from c)"""


@query(
    "variant_comparison",
    VARIANT_SQL + f""" select base_variable, {r('a')} as "_AVG", {r('b')} as "_MODE", {r('m')} as "_MEDI", best_suffix from best""",
)
def variant_comparison(spark, sf_dir):
    return settled(_variant_table(spark, sf_dir))


@query("variant_census", VARIANT_SQL + " select best_suffix, count(*) as n from best group by best_suffix")
def variant_census(spark, sf_dir):
    return clustering.variant_census(_variant_table(spark, sf_dir))


NULL_COLUMNS = ["AMT_INCOME_TOTAL", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "NAME_EDUCATION_TYPE", "AMT_CREDIT"]


@query(
    "nullity_corr",
    with_views(
        "app",
        body=", marks as (select "
        + ", ".join(f"case when {c} is null then 1 else 0 end as {c}" for c in NULL_COLUMNS)
        + " from app) select * from ("
        + _corr_sql("marks", combinations(sorted(set(NULL_COLUMNS) - {"AMT_CREDIT"}), 2))
        + ") t where corr is not null",
    ),
)
def nullity_corr(spark, sf_dir):
    return settled(association.nullity_correlation(view(spark, sf_dir, "app"), NULL_COLUMNS))


def _cells(a: str, b: str, source: str) -> str:
    return f"select '{a}' as var_1, '{b}' as var_2, cast({a} as varchar) as x, cast({b} as varchar) as y from {source} where {a} is not null and {b} is not null"


def _cells_cte(pairs, source: str) -> str:
    return f""", cells as (select var_1, var_2, x, y, cast(count(*) as double) as n from ({_union([_cells(a, b, source) for a, b in pairs])}) t
      group by all),
    rs as (select var_1, var_2, x, sum(n) as r from cells group by all),
    cs as (select var_1, var_2, y, sum(n) as c from cells group by all),
    grid as (select rs.var_1, rs.var_2, r, c, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (partition by rs.var_1, rs.var_2) as total,
      (select count(*) from rs a where a.var_1 = rs.var_1 and a.var_2 = rs.var_2) as k1,
      (select count(*) from cs a where a.var_1 = rs.var_1 and a.var_2 = rs.var_2) as k2
      from rs join cs on rs.var_1 = cs.var_1 and rs.var_2 = cs.var_2
      left join cells on cells.var_1 = rs.var_1 and cells.var_2 = rs.var_2 and cells.x = rs.x and cells.y = cs.y)"""


CRAMER_COLUMNS = ["CODE_GENDER", "FLAG_OWN_CAR", "NAME_CONTRACT_TYPE", "NAME_EDUCATION_TYPE", "NAME_INCOME_TYPE", "TARGET"]


@query(
    "cramers_v",
    with_views(
        "app",
        body=_cells_cte(list(combinations(sorted(CRAMER_COLUMNS), 2)), "app")
        + f""", s as (select var_1, var_2, max(total) as total, max(k1) as k1, max(k2) as k2,
          sum(case when k1 = 2 and k2 = 2 then pow(abs(n - r * c / total) - least(0.5e0, abs(n - r * c / total)), 2) else pow(n - r * c / total, 2) end
              / (r * c / total)) as chi2 from grid group by var_1, var_2)
        select var_1, var_2, cast(total as bigint) as n, {r("chi2")} as chi2,
          {r('''sqrt(greatest(0, chi2 / total - (k2 - 1) * (k1 - 1) / (total - 1))
             / least(k2 - (k2 - 1) * (k2 - 1) / (total - 1) - 1, k1 - (k1 - 1) * (k1 - 1) / (total - 1) - 1))''')} as cramers_v from s""",
    ),
)
def cramers_v(spark, sf_dir):
    return settled(association.cramers_v_all(view(spark, sf_dir, "app"), CRAMER_COLUMNS))


MI_COLUMNS = ["CODE_GENDER", "FLAG_OWN_REALTY", "NAME_INCOME_TYPE", "EXT_SOURCE_1"]


@query(
    "mutual_info_discrete",
    with_views(
        "app",
        body=_cells_cte([(c, "TARGET") for c in MI_COLUMNS], "app")
        + f""" select var_1 as "column", {r("sum(case when n > 0 then n / total * ln(n * total / (r * c)) else 0 end)", 6)} as mutual_information
        from grid group by var_1""",
    ),
)
def mutual_info_discrete(spark, sf_dir):
    return settled(association.mutual_information(view(spark, sf_dir, "app"), MI_COLUMNS, "TARGET"), 6)


MI_BINNED = ["price", "qty"]


@query(
    "mutual_info_binned",
    f"with {DERIVED_CTE}, cuts as (select "
    + ", ".join(
        f"list_sort(list_distinct(quantile_cont({c}, [{', '.join(str(i / 20) for i in range(1, 20))}]))) as {c}_cuts" for c in MI_BINNED
    )
    + " from derived), binned as (select "
    + ", ".join(f"len(list_filter({c}_cuts, lambda e: {c} > e)) as {c}" for c in MI_BINNED)
    + ", line, label from derived, cuts)"
    + _cells_cte([(c, "label") for c in [*MI_BINNED, "line"]], "binned")
    + f""" select var_1 as "column", {r("sum(case when n > 0 then n / total * ln(n * total / (r * c)) else 0 end)", 6)} as mutual_information
      from grid group by var_1""",
)
def mutual_info_binned(spark, sf_dir):
    """Columns with many values are quantile-binned first."""
    rows = _derived(spark, sf_dir)
    columns = [*MI_BINNED, "line"]
    counts = {x["column"]: x["n_unique"] for x in profiling.distinct_counts(rows, columns).collect()}
    return settled(association.mutual_information(association.discretize(rows, columns, counts), columns, "label"), 6)


MI_USED = ["EXT_SOURCE_1", "EXT_SOURCE_2", "AMT_GOODS_PRICE", "AMT_INCOME_TOTAL", "CNT_CHILDREN", "FLAG_DOCUMENT_4"]


def _ladder(c: str) -> str:
    """A column of many values as the number of quantile cuts below it, one of few as it is."""
    return f"case when {c}_n <= 20 then cast({c} as varchar) else cast(len(list_filter({c}_cuts, lambda e: {c} > e)) as varchar) end as {c}"


@query(
    "mutual_info_ranked",
    with_views(
        "app",
        body=", medians as (select "
        + ", ".join(f"quantile_cont({c}, 0.5) as {c}_mid" for c in MI_USED)
        + " from app), filled as (select TARGET, "
        + ", ".join(f"coalesce(cast({c} as double), {c}_mid) as {c}" for c in MI_USED)
        + " from app, medians), cuts as (select "
        + ", ".join(
            f"list_sort(list_distinct(quantile_cont({c}, [{', '.join(str(i / 20) for i in range(1, 20))}]))) as {c}_cuts, count(distinct {c}) as {c}_n"
            for c in MI_USED
        )
        + " from filled), binned as (select TARGET, "
        + ", ".join(_ladder(c) for c in MI_USED)
        + " from filled, cuts)"
        + _cells_cte([(c, "TARGET") for c in MI_USED], "binned")
        + f""" select var_1 as "column", {r("sum(case when n > 0 then n / total * ln(n * total / (r * c)) else 0 end)", 6)} as mutual_information
        from grid group by var_1""",
    ),
)
def mutual_info_ranked(spark, sf_dir):
    """Medians filled in, few-valued columns counted as they are, the others in quantile bins."""
    return settled(association.label_information(view(spark, sf_dir, "app"), MI_USED, "TARGET"), 6)
