"""Cleaning, aggregation, joins and features over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.catalog.registry import ORACLES, query
from riskloom.catalog.views import history, r, settled, table, view, with_views
from riskloom.functions import text
from riskloom.functions.nulls import replace_infinities
from riskloom.functions.scalars import class_weight, decision, years_to_days
from riskloom.operators import aggregation, cleaning, contract, features, joins, modeling, packed
from riskloom.plans import credit
from riskloom.schemas import FeatureParams
from riskloom.session import staging_path
from riskloom.sources.readers import read_history, read_table_dir
from riskloom.sources.writers import save_history, write_history

STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _month_shares() -> str:
    return ", ".join(
        f"cast(sum(case when STATUS = '{v}' then 1 else 0 end) as double) / count(*) as STATUS_{v}_mean"
        for v in ["0", "1", "C", "X"]
    )


CATEGORIES = {
    "bureau": {
        "CREDIT_ACTIVE": STATUSES,
        "CREDIT_CURRENCY": ["currency 1", "currency 2", "currency 3"],
        "CREDIT_TYPE": PRIORITIES,
    },
    "bureau_balance": {"STATUS": ["0", "1", "C", "X"]},
    "previous_application": {"NAME_CONTRACT_STATUS": ["Approved", "Canceled", "Refused"]},
    "credit_card_balance": {"NAME_CONTRACT_STATUS": EVENT_TYPES},
    "pos_cash_balance": {"NAME_CONTRACT_STATUS": STATUSES},
}

MONTH_SUMMARY = f"""
    select SK_ID_BUREAU, min(MONTHS_BALANCE) as MONTHS_BALANCE_min, max(MONTHS_BALANCE) as MONTHS_BALANCE_max,
           count(MONTHS_BALANCE) as MONTHS_BALANCE_count, {_month_shares()}
    from bureau_balance group by SK_ID_BUREAU"""


def _stats_sql(columns: list[str], lead: str = "", whole: tuple[str, ...] = ()) -> str:
    out = []
    for c in columns:
        if c in whole:
            out += [
                f'min({c}) as "{lead}{c}_min"',
                f'max({c}) as "{lead}{c}_max"',
                f'{r(f"avg({c})")} as "{lead}{c}_mean"',
                f'cast(coalesce(sum({c}), 0) as bigint) as "{lead}{c}_sum"',
            ]
        else:
            out += [
                f'{r(f"min({c})")} as "{lead}{c}_min"',
                f'{r(f"max({c})")} as "{lead}{c}_max"',
                f'{r(f"avg({c})")} as "{lead}{c}_mean"',
                f'{r(f"coalesce(sum({c}), 0)")} as "{lead}{c}_sum"',
            ]
    return ", ".join(out)


def _shares_sql(column: str, values: list[str], lead: str = "") -> str:
    return ", ".join(
        f"""{r(f"cast(sum(case when {column} = '{v}' then 1 else 0 end) as double) / count(*)")} as "{lead}{column}_{v}_mean" """
        for v in values
    )


# --- flagship ------------------------------------------------------------------------------


@query(
    "customer_features",
    f"""
    with months as (
      select l_orderkey, min(l_linenumber) as line_min, max(l_linenumber) as line_max, count(l_linenumber) as line_count,
             cast(sum(case when l_returnflag = 'A' then 1 else 0 end) as double) / count(*) as flag_a,
             cast(sum(case when l_returnflag = 'N' then 1 else 0 end) as double) / count(*) as flag_n,
             cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as double) / count(*) as flag_r
      from lineitem group by l_orderkey),
    credits as (
      select o_custkey as c_custkey, {r("min(o_totalprice)")} as o_totalprice_min, {r("max(o_totalprice)")} as o_totalprice_max,
             {r("avg(o_totalprice)")} as o_totalprice_mean, {r("coalesce(sum(o_totalprice), 0)")} as o_totalprice_sum,
             min(line_count) as line_count_min, max(line_count) as line_count_max,
             {r("avg(line_count)")} as line_count_mean, cast(coalesce(sum(line_count), 0) as bigint) as line_count_sum,
             {r("avg(flag_a)")} as flag_a_mean, {r("avg(flag_r)")} as flag_r_mean,
             {r("cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as double) / count(*)")} as status_f_mean,
             {r("cast(sum(case when o_orderstatus = 'O' then 1 else 0 end) as double) / count(*)")} as status_o_mean,
             {r("cast(sum(case when o_orderstatus = 'P' then 1 else 0 end) as double) / count(*)")} as status_p_mean,
             count(*) as credit_count
      from orders left join months on o_orderkey = l_orderkey group by o_custkey)
    select c.c_custkey, c_nationkey, c_mktsegment, {r("c_acctbal")} as c_acctbal, credits.* exclude (c_custkey),
           {r("credits.o_totalprice_sum / case when c_acctbal <> 0 then c_acctbal end")} as debt_ratio
    from customer c left join credits on c.c_custkey = credits.c_custkey""",
)
def customer_features(spark, sf_dir) -> DataFrame:
    """One row per customer: order lines to orders, orders to customers, joined and put in
    relation to the balance."""
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])
    months = aggregation.aggregate_months(lines, "l_orderkey", "l_linenumber", "l_returnflag", ["A", "N", "R"])
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"])
    enriched = orders.join(
        months.select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("l_linenumber_count").alias("line_count"),
            F.col("l_returnflag_A_mean").alias("flag_a"),
            F.col("l_returnflag_R_mean").alias("flag_r"),
        ),
        "o_orderkey",
        "left",
    )
    credits = aggregation.aggregate_by(
        enriched.withColumnRenamed("o_custkey", "c_custkey"),
        "c_custkey",
        ["o_totalprice", "line_count", "flag_a", "flag_r"],
        {"o_orderstatus": STATUSES},
        count_name="credit_count",
    ).select(
        "c_custkey",
        *[f"o_totalprice_{s}" for s in ("min", "max", "mean", "sum")],
        *[f"line_count_{s}" for s in ("min", "max", "mean", "sum")],
        "flag_a_mean",
        "flag_r_mean",
        *[F.col(f"o_orderstatus_{v}_mean").alias(f"status_{v.lower()}_mean") for v in STATUSES],
        "credit_count",
    )
    customer = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"])
    joined = joins.left_join_one(customer, credits, "c_custkey")
    # The ratio is taken on the rounded sum, as in the SQL text.
    joined = settled(joined)
    return settled(joined.withColumn("debt_ratio", F.try_divide("o_totalprice_sum", "c_acctbal")))


# --- cleaning ------------------------------------------------------------------------------


@query(
    "sentinel_flag",
    with_views(
        "app",
        body="""select SK_ID_CURR, DAYS_EMPLOYED = 365243 as DAYS_EMPLOYED_ANOM,
        case when DAYS_EMPLOYED <> 365243 then DAYS_EMPLOYED end as DAYS_EMPLOYED from app""",
    ),
)
def sentinel_flag(spark, sf_dir):
    app = view(spark, sf_dir, "app").select("SK_ID_CURR", "DAYS_EMPLOYED")
    return cleaning.sentinel_to_flag(app, ["DAYS_EMPLOYED", "NOT_A_COLUMN"])


@query(
    "sentinel_blank",
    with_views("app", body="select SK_ID_CURR, case when DAYS_EMPLOYED <> 365243 then DAYS_EMPLOYED end as DAYS_EMPLOYED from app"),
)
def sentinel_blank(spark, sf_dir):
    return cleaning.sentinel_to_null(view(spark, sf_dir, "app").select("SK_ID_CURR", "DAYS_EMPLOYED"), ["DAYS_EMPLOYED"])


@query(
    "flag_sum",
    with_views(
        "app",
        body="""select SK_ID_CURR, coalesce(FLAG_DOCUMENT_2, 0) + coalesce(FLAG_DOCUMENT_4, 0) + coalesce(FLAG_DOCUMENT_5, 0)
        as TOTAL_DOCUMENTS_PROVIDED from app""",
    ),
)
def flag_sum(spark, sf_dir):
    flags = ["FLAG_DOCUMENT_2", "FLAG_DOCUMENT_4", "FLAG_DOCUMENT_5"]
    return cleaning.sum_flags(view(spark, sf_dir, "app").select("SK_ID_CURR", *flags), flags)


@query(
    "cap_and_flag",
    with_views(
        "dirty_lines",
        body="""select l_orderkey, l_linenumber, coalesce(price > 60000 or price < 5000, false) as price_CAPPED_FLAG,
        case when price > 60000 then 60000e0 when price < 5000 then 5000e0 else price end as price from dirty_lines""",
    ),
)
def cap_and_flag(spark, sf_dir):
    rows = view(spark, sf_dir, "dirty_lines").select("l_orderkey", "l_linenumber", "price")
    return cleaning.cap_column(rows, "price", upper=60000.0, lower=5000.0)


@query(
    "row_missing_share",
    with_views(
        "app",
        body=f"""select SK_ID_CURR, {r('''(case when AMT_INCOME_TOTAL is null then 1 else 0 end
        + case when NAME_EDUCATION_TYPE is null then 1 else 0 end + case when NAME_INCOME_TYPE is null then 1 else 0 end
        + case when EXT_SOURCE_1 is null then 1 else 0 end + case when EXT_SOURCE_2 is null then 1 else 0 end
        + case when EXT_SOURCE_3 is null then 1 else 0 end + case when AMT_CREDIT is null then 1 else 0 end) / 7e0''')}
        as pct_nan_row from app""",
    ),
)
def row_missing_share(spark, sf_dir):
    columns = [
        "AMT_INCOME_TOTAL",
        "NAME_EDUCATION_TYPE",
        "NAME_INCOME_TYPE",
        "EXT_SOURCE_1",
        "EXT_SOURCE_2",
        "EXT_SOURCE_3",
        "AMT_CREDIT",
    ]
    out = cleaning.missing_share(view(spark, sf_dir, "app").select("SK_ID_CURR", *columns), columns)
    return settled(out.select("SK_ID_CURR", "pct_nan_row"))


@query(
    "infinities_to_null",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case when l_discount <> 0 then floor(l_extendedprice / l_discount * 100.0e0 + 0.500001e0) / 100.0e0 end as per_discount
       from lineitem""",
)
def infinities_to_null(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    quotient = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide("l_extendedprice", "l_discount")
    )
    out = replace_infinities(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quotient.alias("per_discount")))
    return settled(out, 2)


@query(
    "median_fill",
    with_views(
        "dirty_lines",
        body=f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey,
        {r("coalesce(qty, (select quantile_cont(qty, 0.5) from dirty_lines))")} as qty,
        {r("coalesce(discount, (select quantile_cont(discount, 0.5) from dirty_lines))")} as discount from dirty_lines""",
    ),
)
def median_fill(spark, sf_dir):
    rows = view(spark, sf_dir, "dirty_lines").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", "discount")
    return settled(cleaning.fill_median(rows, ["qty", "discount"]))


@query(
    "fit_caps",
    with_views(
        "dirty_lines",
        body=f"""select 'price' as "column", {r("quantile_cont(price, 0.995)")} as cap from dirty_lines
        union all select 'qty', {r("quantile_cont(qty, 0.99)")} from dirty_lines
        union all select 'tax', {r("quantile_cont(tax, 0.99)")} from dirty_lines""",
    ),
)
def fit_caps(spark, sf_dir):
    caps = cleaning.fit_caps(view(spark, sf_dir, "dirty_lines"), {"price": 0.995, "qty": 0.99, "tax": 0.99})
    return settled(text.frame(spark, [{"column": text.value(c), "cap": text.value(v)} for c, v in caps.items()]))


PARAMS = FeatureParams(
    amt_income_total_cap=9000.0,
    debt_to_income_cap=35.0,
    flag_document_quasi_constant=("FLAG_DOCUMENT_2", "FLAG_DOCUMENT_4", "FLAG_DOCUMENT_5"),
    cols_to_drop_pure=("CNT_CHILDREN",),
    cols_to_drop_housing=("FLOORSMAX_MODE",),
    cols_to_drop_clusters=("FLAG_OWN_REALTY",),
    drop_list_restricted=("AMT_CREDIT", "CNT_FAM_MEMBERS", "PREV_AMT_CREDIT_max", "POS_CNT_INSTALMENT_max"),
    previous_days_cols=("DAYS_FIRST_DUE",),
    categories=CATEGORIES,
)

CLEAN_APP = f"""
    select SK_ID_CURR, coalesce(AMT_INCOME_TOTAL > 9000, false) as AMT_INCOME_TOTAL_CAPPED_FLAG,
      {r("case when AMT_INCOME_TOTAL > 9000 then 9000e0 else AMT_INCOME_TOTAL end")} as AMT_INCOME_TOTAL,
      {r("AMT_CREDIT")} as AMT_CREDIT, DAYS_EMPLOYED = 365243 as DAYS_EMPLOYED_ANOM,
      case when DAYS_EMPLOYED <> 365243 then DAYS_EMPLOYED end as DAYS_EMPLOYED,
      coalesce(FLAG_DOCUMENT_2, 0) + coalesce(FLAG_DOCUMENT_4, 0) + coalesce(FLAG_DOCUMENT_5, 0) as TOTAL_DOCUMENTS_PROVIDED,
      {r('''(case when AMT_INCOME_TOTAL is null then 1 else 0 end + case when DAYS_EMPLOYED = 365243 then 1 else 0 end
        + case when NAME_EDUCATION_TYPE is null then 1 else 0 end + case when NAME_INCOME_TYPE is null then 1 else 0 end
        + case when EXT_SOURCE_1 is null then 1 else 0 end + case when EXT_SOURCE_2 is null then 1 else 0 end
        + case when EXT_SOURCE_3 is null then 1 else 0 end + case when FLAG_DOCUMENT_4 is null then 1 else 0 end) / 22e0''')}
        as pct_nan_row, TARGET
    from app"""


@query("clean_application", with_views("app", body=CLEAN_APP))
def clean_application(spark, sf_dir):
    out = credit.clean_application(view(spark, sf_dir, "app"), PARAMS)
    return settled(
        out.select(
            "SK_ID_CURR",
            "AMT_INCOME_TOTAL_CAPPED_FLAG",
            "AMT_INCOME_TOTAL",
            "AMT_CREDIT",
            "DAYS_EMPLOYED_ANOM",
            "DAYS_EMPLOYED",
            "TOTAL_DOCUMENTS_PROVIDED",
            "pct_nan_row",
            "TARGET",
        )
    )


# --- aggregation ---------------------------------------------------------------------------


@query(
    "generic_aggregate",
    with_views(
        "pos_cash_balance",
        body=f"""select SK_ID_CURR, {_stats_sql(["MONTHS_BALANCE", "CNT_INSTALMENT"], "POS_", ("MONTHS_BALANCE",))},
        {_shares_sql("NAME_CONTRACT_STATUS", STATUSES, "POS_")}, count(*) as "POS_COUNT"
        from pos_cash_balance group by SK_ID_CURR""",
    ),
)
def generic_aggregate(spark, sf_dir):
    rows = view(spark, sf_dir, "pos_cash_balance")
    return settled(aggregation.aggregate_table(rows, "SK_ID_CURR", "POS", ["SK_ID_PREV"], {"NAME_CONTRACT_STATUS": STATUSES}))


@query(
    "wide_aggregate",
    "select l_suppkey, "
    + ", ".join(
        f"{r(f'min({e})', 2)} as W_{n}_min, {r(f'max({e})', 2)} as W_{n}_max, {r(f'avg({e})', 2)} as W_{n}_mean, {r(f'sum({e})', 2)} as W_{n}_sum"
        for n, e in [(f"x{i}", f"(l_extendedprice * {i + 1} / 64)") for i in range(30)]
    )
    + ', count(*) as "W_COUNT" from lineitem group by l_suppkey',
)
def wide_aggregate(spark, sf_dir):
    """Two columns are dealt by key; the thirty are derived from them there."""
    rows = packed.gathered(table(spark, sf_dir, "lineitem", ["l_suppkey", "l_extendedprice"]), "l_suppkey")
    wide = rows.select("l_suppkey", *[(F.col("l_extendedprice") * (i + 1) / 64).alias(f"x{i}") for i in range(30)])
    return settled(aggregation.aggregate_table(wide, "l_suppkey", "W", [], {}), 2)


@query(
    "category_proportions",
    f"""select l_suppkey, {_shares_sql("l_returnflag", ["A", "N", "R"])}, {_shares_sql("l_linestatus", ["F", "O"])}
    from lineitem group by l_suppkey""",
)
def category_proportions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_returnflag", "l_linestatus"])
    cats = aggregation.fit_categories(rows, ["l_returnflag", "l_linestatus"])
    return settled(aggregation.aggregate_by(rows, "l_suppkey", (), cats))


@query(
    "month_summary",
    with_views(
        "bureau_balance",
        body=f"""select SK_ID_BUREAU, MONTHS_BALANCE_min, MONTHS_BALANCE_max, MONTHS_BALANCE_count,
        {", ".join(f"{r(f'STATUS_{v}_mean')} as STATUS_{v}_mean" for v in ["0", "1", "C", "X"])}
        from ({MONTH_SUMMARY}) m""",
    ),
)
def month_summary(spark, sf_dir):
    rows = view(spark, sf_dir, "bureau_balance")
    return settled(aggregation.aggregate_months(rows, "SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS", ["0", "1", "C", "X"]))


BUREAU_WHOLE = ("DAYS_CREDIT", "MONTHS_BALANCE_min", "MONTHS_BALANCE_max", "MONTHS_BALANCE_count")
BUREAU_AGG = f"""select SK_ID_CURR, {_stats_sql(
    ["AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "DAYS_CREDIT", "MONTHS_BALANCE_min", "MONTHS_BALANCE_max", "MONTHS_BALANCE_count",
     "STATUS_0_mean", "STATUS_1_mean", "STATUS_C_mean", "STATUS_X_mean"], "", BUREAU_WHOLE)},
    {_shares_sql("CREDIT_ACTIVE", STATUSES)}, {_shares_sql("CREDIT_CURRENCY", ["currency 1", "currency 2", "currency 3"])},
    {_shares_sql("CREDIT_TYPE", PRIORITIES)}, count(*) as "BUREAU_CREDIT_COUNT"
    from (select * from bureau left join months using (SK_ID_BUREAU)) b group by SK_ID_CURR"""


@query(
    "two_level_aggregate",
    with_views("bureau", "bureau_balance", body=f", months as ({MONTH_SUMMARY}) {BUREAU_AGG}"),
)
def two_level_aggregate(spark, sf_dir):
    cats = {**CATEGORIES["bureau"], **CATEGORIES["bureau_balance"]}
    return settled(
        aggregation.aggregate_credits(view(spark, sf_dir, "bureau"), view(spark, sf_dir, "bureau_balance"), categories=cats)
    )


PREVIOUS_AGG = f"""select SK_ID_CURR, {_stats_sql(["AMT_APPLICATION", "AMT_CREDIT", "DAYS_FIRST_DUE", "DAYS_FIRST_DUE_ANOM"],
    "PREV_", ("DAYS_FIRST_DUE", "DAYS_FIRST_DUE_ANOM"))}, {_shares_sql("NAME_CONTRACT_STATUS", ["Approved", "Canceled", "Refused"], "PREV_")},
    count(*) as "PREV_APPLICATION_COUNT"
    from (select SK_ID_CURR, AMT_APPLICATION, AMT_CREDIT, NAME_CONTRACT_STATUS,
            case when DAYS_FIRST_DUE <> 365243 then DAYS_FIRST_DUE end as DAYS_FIRST_DUE,
            cast(case when DAYS_FIRST_DUE = 365243 then 1 else 0 end as int) as DAYS_FIRST_DUE_ANOM
          from previous_application) p group by SK_ID_CURR"""


@query("previous_aggregate", with_views("previous_application", body=PREVIOUS_AGG))
def previous_aggregate(spark, sf_dir):
    rows = cleaning.sentinel_to_flag(view(spark, sf_dir, "previous_application"), ["DAYS_FIRST_DUE"])
    return settled(aggregation.aggregate_previous(rows, categories=CATEGORIES["previous_application"]))


PAYMENT_AGG = f"""select SK_ID_CURR, {r("avg(AMT_INSTALMENT - AMT_PAYMENT)")} as PAYMENT_DIFF_mean,
    {r("coalesce(sum(AMT_INSTALMENT - AMT_PAYMENT), 0)")} as PAYMENT_DIFF_sum,
    {r("avg(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT)")} as DAYS_PAST_DUE_mean, max(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT) as DAYS_PAST_DUE_max,
    {r("avg(case when DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0 then 1 else 0 end)")} as LATE_PAYMENT_RATE,
    cast(sum(case when DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0 then 1 else 0 end) as bigint) as LATE_PAYMENT_COUNT
    from installments_payments group by SK_ID_CURR"""


@query("payment_behavior", with_views("installments_payments", body=PAYMENT_AGG))
def payment_behavior(spark, sf_dir):
    return settled(aggregation.payment_behavior(view(spark, sf_dir, "installments_payments")))


@query(
    "payment_terms",
    with_views(
        "installments_payments",
        body=f"""select SK_ID_CURR, SK_ID_PREV, {r("AMT_INSTALMENT - AMT_PAYMENT")} as PAYMENT_DIFF,
        DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT as DAYS_PAST_DUE,
        cast(case when DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0 then 1 else 0 end as int) as LATE_PAYMENT_FLAG
        from installments_payments""",
    ),
)
def payment_terms(spark, sf_dir):
    rows = aggregation.payment_terms(view(spark, sf_dir, "installments_payments"))
    return settled(rows.select("SK_ID_CURR", "SK_ID_PREV", "PAYMENT_DIFF", "DAYS_PAST_DUE", "LATE_PAYMENT_FLAG"))


@query(
    "rows_per_key",
    with_views("bureau", body="select SK_ID_CURR, count(*) as n_rows from bureau where SK_ID_CURR is not null group by SK_ID_CURR"),
)
def rows_per_key(spark, sf_dir):
    return aggregation.rows_per_key(view(spark, sf_dir, "bureau"), "SK_ID_CURR")


# --- joins ---------------------------------------------------------------------------------


@query(
    "semi_join_clients",
    """select o_custkey, count(*) as n, cast(sum(o_orderkey) as bigint) as key_sum from orders
    where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by o_custkey""",
)
def semi_join_clients(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    kept = joins.keep_keys(table(spark, sf_dir, "orders"), chosen.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query(
    "chained_semi_join",
    with_views(
        "bureau",
        "bureau_balance",
        body="""select SK_ID_BUREAU, count(*) as n from bureau_balance where SK_ID_BUREAU in (
        select SK_ID_BUREAU from bureau where SK_ID_CURR in (select c_custkey from customer where c_acctbal > 0))
        group by SK_ID_BUREAU""",
    ),
)
def chained_semi_join(spark, sf_dir):
    chosen = read_table_dir(spark, sf_dir, "customer", ["c_custkey"], [("c_acctbal", ">", 0.0)]).withColumnRenamed("c_custkey", "SK_ID_CURR")
    _, months = joins.keep_keys_chained(
        view(spark, sf_dir, "bureau"), view(spark, sf_dir, "bureau_balance"), chosen, "SK_ID_CURR", "SK_ID_BUREAU"
    )
    return months.groupBy("SK_ID_BUREAU").agg(F.count(F.lit(1)).alias("n"))


@query(
    "orphans_anti",
    """select o_orderstatus, count(*) as n from orders where o_orderkey not in (select l_orderkey from lineitem)
    group by o_orderstatus""",
)
def orphans_anti(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey"]).withColumnRenamed("l_orderkey", "o_orderkey")
    lonely = joins.unmatched(table(spark, sf_dir, "orders"), lines, "o_orderkey")
    return lonely.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "restore_column",
    with_views("app", body="select SK_ID_CURR, AMT_INCOME_TOTAL as AMT_INCOME_TOTAL_ORIGINAL, DAYS_BIRTH from app"),
)
def restore_column(spark, sf_dir):
    app = view(spark, sf_dir, "app")
    capped = cleaning.cap_column(app.select("SK_ID_CURR", "DAYS_BIRTH", "AMT_INCOME_TOTAL"), "AMT_INCOME_TOTAL", upper=10.0)
    return joins.restore_column(
        capped.select("SK_ID_CURR", "DAYS_BIRTH"), app, "SK_ID_CURR", "AMT_INCOME_TOTAL", "AMT_INCOME_TOTAL_ORIGINAL"
    ).select("SK_ID_CURR", "AMT_INCOME_TOTAL_ORIGINAL", "DAYS_BIRTH")


@query(
    "unique_key_join",
    """select o_orderkey, c_mktsegment from orders left join customer on o_custkey = c_custkey""",
)
def unique_key_join(spark, sf_dir):
    customer = table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"]).withColumnRenamed("c_custkey", "o_custkey")
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return joins.left_join_one(orders, customer, "o_custkey", check=True).select("o_orderkey", "c_mktsegment")


@query(
    "history_lookup",
    with_views(
        "bureau",
        "credit_card_balance",
        body=f"""select c_custkey as SK_ID_CURR, b.BUREAU_COUNT, c.CC_COUNT, {r("c.CC_SUM")} as CC_SUM,
        b.SK_ID_CURR is not null or c.SK_ID_CURR is not null as history_found
        from customer
        left join (select SK_ID_CURR, count(*) as BUREAU_COUNT from bureau where CREDIT_ACTIVE = 'P' group by 1) b on c_custkey = b.SK_ID_CURR
        left join (select SK_ID_CURR, count(*) as CC_COUNT, sum(AMT_BALANCE) as CC_SUM from credit_card_balance group by 1) c
          on c_custkey = c.SK_ID_CURR""",
    ),
)
def history_lookup(spark, sf_dir):
    credits = view(spark, sf_dir, "bureau").where("CREDIT_ACTIVE = 'P'")
    cards = view(spark, sf_dir, "credit_card_balance")
    tables = {
        "bureau": aggregation.rows_per_key(credits, "SK_ID_CURR", "BUREAU_COUNT"),
        "cards": cards.groupBy("SK_ID_CURR").agg(F.count(F.lit(1)).alias("CC_COUNT"), F.sum("AMT_BALANCE").alias("CC_SUM")),
    }
    clients = table(spark, sf_dir, "customer", ["c_custkey"]).withColumnRenamed("c_custkey", "SK_ID_CURR")
    return settled(joins.lookup_history(clients, tables, "SK_ID_CURR"))


@query(
    "history_store",
    with_views(
        "installments_payments",
        body=f"""select * from ({PAYMENT_AGG}) p where SK_ID_CURR = (select min(o_custkey) from orders)""",
    ),
)
def history_store(spark, sf_dir):
    """Write the aggregate, read it back, and look one client up by key."""
    folder = staging_path(spark, "history")
    write_history({"payment": aggregation.payment_behavior(view(spark, sf_dir, "installments_payments"))}, folder, "SK_ID_CURR", 8)
    first = table(spark, sf_dir, "orders").agg(F.min("o_custkey").alias("k")).first()["k"]
    return settled(read_history(spark, folder, ["payment"], "SK_ID_CURR", first)["payment"])


@query(
    "align_flag_counts",
    with_views(
        "app",
        body="""select SK_ID_CURR, cast(coalesce(FLAG_DOCUMENT_2, 0) + coalesce(FLAG_DOCUMENT_4, 0) as bigint) as flags from app""",
    ),
)
def align_flag_counts(spark, sf_dir):
    app = view(spark, sf_dir, "app").select("SK_ID_CURR", "FLAG_DOCUMENT_2", "FLAG_DOCUMENT_4")
    return joins.row_total(app, ["FLAG_DOCUMENT_2", "FLAG_DOCUMENT_4"], "flags").select("SK_ID_CURR", "flags")


# --- features ------------------------------------------------------------------------------

RATIOS = f"""select SK_ID_CURR, {r("AMT_CREDIT / case when AMT_ANNUITY <> 0 then AMT_ANNUITY end")} as CREDIT_TERM,
    {r("DAYS_BIRTH / -365e0 + AMT_CREDIT / case when AMT_ANNUITY <> 0 then AMT_ANNUITY end / 12e0")} as AGE_AT_LOAN_END,
    {r("AMT_ANNUITY / case when AMT_INCOME_TOTAL <> 0 then AMT_INCOME_TOTAL end")} as ANNUITY_INCOME_PERCENT,
    {r("AMT_CREDIT / case when AMT_INCOME_TOTAL <> 0 then AMT_INCOME_TOTAL end")} as CREDIT_INCOME_PERCENT,
    {r("AMT_INCOME_TOTAL / case when CNT_FAM_MEMBERS <> 0 then CNT_FAM_MEMBERS end")} as INCOME_PER_PERSON,
    {r("AMT_CREDIT / case when AMT_GOODS_PRICE <> 0 then AMT_GOODS_PRICE end")} as CREDIT_GOODS_RATIO,
    {r("cast(DAYS_EMPLOYED as double) / DAYS_BIRTH")} as EMPLOYED_BIRTH_RATIO,
    {r("AMT_ANNUITY / AMT_CREDIT")} as PAYMENT_RATE from app"""
RATIO_NAMES = [
    "CREDIT_TERM",
    "AGE_AT_LOAN_END",
    "ANNUITY_INCOME_PERCENT",
    "CREDIT_INCOME_PERCENT",
    "INCOME_PER_PERSON",
    "CREDIT_GOODS_RATIO",
    "EMPLOYED_BIRTH_RATIO",
    "PAYMENT_RATE",
]


@query("application_ratios", with_views("app", body=RATIOS))
def application_ratios(spark, sf_dir):
    return settled(features.application_ratios(view(spark, sf_dir, "app")).select("SK_ID_CURR", *RATIO_NAMES))


@query(
    "score_summary",
    with_views(
        "app",
        body="""select SK_ID_CURR, least(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3) as EXT_SOURCE_combined_min,
        greatest(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3) as EXT_SOURCE_combined_max,
        cast((EXT_SOURCE_1 is not null)::int + (EXT_SOURCE_2 is not null)::int + (EXT_SOURCE_3 is not null)::int as int)
          as EXT_SOURCE_combined_count_available from app""",
    ),
)
def score_summary(spark, sf_dir):
    out = features.score_summary(view(spark, sf_dir, "app"))
    return out.select("SK_ID_CURR", *[c for c in out.columns if c.startswith("EXT_SOURCE_combined")])


DEBT_SQL = f"""
    select SK_ID_CURR, case when income = 0 and debt > 0 then 35e0 when income = 0 and debt < 0 then 0e0
        when income <> 0 and debt / income > 35 then 35e0 when income <> 0 and debt / income < 0 then 0e0
        when income <> 0 then {r("debt / income")} end as DEBT_TO_INCOME,
      coalesce((income = 0 and debt <> 0) or (income <> 0 and (debt / income > 35 or debt / income < 0)), false) as DEBT_TO_INCOME_CAPPED_FLAG
    from d"""


@query(
    "debt_ratio_capped",
    with_views(
        "app",
        "bureau",
        body=f""", s as (select SK_ID_CURR, coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) as debt from bureau group by SK_ID_CURR),
        d as (select SK_ID_CURR, debt, case when SK_ID_CURR % 23 = 0 then 0e0 else AMT_INCOME_TOTAL end as income
              from app left join s using (SK_ID_CURR)) {DEBT_SQL}""",
    ),
)
def debt_ratio_capped(spark, sf_dir):
    debts = aggregation.aggregate_by(view(spark, sf_dir, "bureau"), "SK_ID_CURR", ["AMT_CREDIT_SUM_DEBT"])
    app = view(spark, sf_dir, "app").select(
        "SK_ID_CURR", F.when(F.expr("SK_ID_CURR % 23 = 0"), F.lit(0.0)).otherwise(F.col("AMT_INCOME_TOTAL")).alias("AMT_INCOME_TOTAL")
    )
    joined = joins.left_join_one(app, debts.select("SK_ID_CURR", "AMT_CREDIT_SUM_DEBT_sum"), "SK_ID_CURR")
    out = features.debt_to_income(joined, 35.0)
    return settled(out.select("SK_ID_CURR", "DEBT_TO_INCOME", "DEBT_TO_INCOME_CAPPED_FLAG"))


@query(
    "scalar_features",
    """select p_partkey, -cast(floor(p_size * 365.25e0) as int) as days,
       case when p_size / 50e0 > 0.24e0 then 'refusé' else 'accordé' end as decision,
       case when p_size % 2 = 1 then 3.82e0 else 1e0 end as weight from part""",
)
def scalar_features(spark, sf_dir):
    part = table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    return part.select(
        "p_partkey",
        years_to_days(F.col("p_size")).alias("days"),
        decision(F.col("p_size") / F.lit(50.0), 0.24).alias("decision"),
        class_weight(F.col("p_size") % 2, 3.82).alias("weight"),
    )


COUNTED = [
    ("bureau", "BUREAU_CREDIT_COUNT"),
    ("previous_application", "PREV_APPLICATION_COUNT"),
    ("credit_card_balance", "CC_COUNT"),
    ("installments_payments", "INST_COUNT"),
    ("pos_cash_balance", "POS_COUNT"),
]


@query(
    "build_features",
    with_views(
        "app",
        "bureau",
        "bureau_balance",
        "previous_application",
        "credit_card_balance",
        "installments_payments",
        "pos_cash_balance",
        body=f""", months as ({MONTH_SUMMARY}),
        clean as ({CLEAN_APP}), ratios as ({RATIOS}), bureau_agg as ({BUREAU_AGG}), previous_agg as ({PREVIOUS_AGG}),
        payment as ({PAYMENT_AGG}),
        cc as (select SK_ID_CURR, {r("sum(AMT_BALANCE)")} as CC_AMT_BALANCE_sum, count(*) as CC_COUNT from credit_card_balance group by 1),
        pos as (select SK_ID_CURR, min(MONTHS_BALANCE) as POS_MONTHS_BALANCE_min, count(*) as POS_COUNT from pos_cash_balance group by 1),
        inst as (select SK_ID_CURR, {r("sum(AMT_PAYMENT)")} as INST_AMT_PAYMENT_sum from installments_payments group by 1)
        select c.SK_ID_CURR, c.AMT_INCOME_TOTAL, c.pct_nan_row, c.TOTAL_DOCUMENTS_PROVIDED, x.CREDIT_TERM, x.PAYMENT_RATE,
          x.CREDIT_GOODS_RATIO, b.BUREAU_CREDIT_COUNT, b.AMT_CREDIT_SUM_sum, b.MONTHS_BALANCE_count_sum, b."CREDIT_ACTIVE_F_mean",
          p."PREV_DAYS_FIRST_DUE_mean", p."PREV_DAYS_FIRST_DUE_ANOM_sum", cc.CC_AMT_BALANCE_sum, cc.CC_COUNT,
          pos.POS_MONTHS_BALANCE_min, pos.POS_COUNT, inst.INST_AMT_PAYMENT_sum, y.LATE_PAYMENT_RATE, y.PAYMENT_DIFF_sum,
          cast(null as double) as NEVER_BUILT
        from clean c join ratios x using (SK_ID_CURR) left join bureau_agg b using (SK_ID_CURR)
        left join previous_agg p using (SK_ID_CURR) left join cc using (SK_ID_CURR) left join pos using (SK_ID_CURR)
        left join inst using (SK_ID_CURR) left join payment y using (SK_ID_CURR)""",
    ),
)
def build_features(spark, sf_dir):
    """The whole path from raw tables to the model's column contract."""
    return settled(credit.build_features(view(spark, sf_dir, "app"), history(spark, sf_dir), PARAMS, _model_contract()))


def _model_contract() -> T.StructType:
    long, double = T.LongType(), T.DoubleType()
    wanted = [
        ("AMT_INCOME_TOTAL", double),
        ("pct_nan_row", double),
        ("TOTAL_DOCUMENTS_PROVIDED", T.IntegerType()),
        ("CREDIT_TERM", double),
        ("PAYMENT_RATE", double),
        ("CREDIT_GOODS_RATIO", double),
        ("BUREAU_CREDIT_COUNT", long),
        ("AMT_CREDIT_SUM_sum", double),
        ("MONTHS_BALANCE_count_sum", long),
        ("CREDIT_ACTIVE_F_mean", double),
        ("PREV_DAYS_FIRST_DUE_mean", double),
        ("PREV_DAYS_FIRST_DUE_ANOM_sum", long),
        ("CC_AMT_BALANCE_sum", double),
        ("CC_COUNT", long),
        ("POS_MONTHS_BALANCE_min", long),
        ("POS_COUNT", long),
        ("INST_AMT_PAYMENT_sum", double),
        ("LATE_PAYMENT_RATE", double),
        ("PAYMENT_DIFF_sum", double),
        ("NEVER_BUILT", double),
    ]
    return T.StructType([T.StructField(n, t) for n, t in wanted])


MODEL = {"LATE_PAYMENT_RATE": 2.0, "CREDIT_TERM": -0.01, "BUREAU_CREDIT_COUNT": 0.02, "pct_nan_row": 1.5, "PREV_DAYS_FIRST_DUE_ANOM_sum": 0.05}


@query(
    "score_raw_tables",
    f"""select SK_ID_CURR, {r("p", 3)} as probability, 0.24e0 as threshold, case when {r("p", 3)} > 0.24e0 then 'refusé' else 'accordé' end as decision, 'v4' as model_version,
      'production' as origine, history_found from (
      select *, 1 / (1 + exp(-(-1.5e0 + {" + ".join(f"({w}e0) * coalesce({c}, 0)" for c, w in MODEL.items())}))) as p,
        BUREAU_CREDIT_COUNT is not null or CC_COUNT is not null or POS_COUNT is not null or "PREV_DAYS_FIRST_DUE_ANOM_sum" is not null or LATE_PAYMENT_RATE is not null
          or INST_AMT_PAYMENT_sum is not null as history_found
      from ({ORACLES["build_features"]}) built) scored""",
)
def score_raw_tables(spark, sf_dir):
    """Raw tables to stored history, requests through both contracts, a model over arrays, probability and decision."""
    app = view(spark, sf_dir, "app")
    stored = credit.build_aggregations(history(spark, sf_dir), PARAMS)
    inputs = T.StructType([f for f in app.schema if f.name != "TARGET"])
    ready = credit.features_for(app.drop("TARGET"), stored, PARAMS, inputs, _model_contract())
    weights = np.array(list(MODEL.values()))

    def predict(x):
        return np.floor(1 / (1 + np.exp(-(-1.5 + np.nan_to_num(x) @ weights))) * 1000 + 0.500001) / 1000

    def score(rows):
        return modeling.score_with(rows, list(MODEL), predict, ["SK_ID_CURR", "history_found"])

    # The model takes features of four digits.
    return settled(credit.score_batch(settled(ready), score, 0.24, "v4", "production"), 3)


@query(
    "bucketed_history",
    with_views(
        "app",
        "bureau",
        "previous_application",
        "credit_card_balance",
        "installments_payments",
        "pos_cash_balance",
        body="select a.SK_ID_CURR, "
        + ", ".join(f"t{i}.n as {n}" for i, (_, n) in enumerate(COUNTED))
        + " from app a "
        + " ".join(f"left join (select SK_ID_CURR, count(*) as n from {t} group by 1) t{i} using (SK_ID_CURR)" for i, (t, _) in enumerate(COUNTED)),
    ),
)
def bucketed_history(spark, sf_dir):
    """The five aggregates stored in buckets of the client and joined in order: nothing of the history moves again."""
    stored = save_history(
        {n: t for n, t in credit.build_aggregations(history(spark, sf_dir), PARAMS).items() if n in credit.JOIN_ORDER}, staging_path(spark, "bucketed"), "SK_ID_CURR", 8
    )
    app = view(spark, sf_dir, "app").select("SK_ID_CURR").repartition(8, "SK_ID_CURR")
    return joins.left_join_all(app, stored, credit.JOIN_ORDER, "SK_ID_CURR", check=True).select("SK_ID_CURR", *[n for _, n in COUNTED])


@query(
    "align_contract",
    """select p_partkey, cast(null as double) as unknown_amount, p_brand, cast(p_size as bigint) as p_size from part""",
)
def align_contract(spark, sf_dir):
    wanted = T.StructType(
        [
            T.StructField("unknown_amount", T.DoubleType()),
            T.StructField("p_brand", T.StringType()),
            T.StructField("p_size", T.LongType()),
        ]
    )
    return contract.align(table(spark, sf_dir, "part"), wanted, "p_partkey")


@query(
    "drop_protected",
    "select s_suppkey, s_acctbal from supplier",
)
def drop_protected(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    return contract.drop_columns(rows, ["s_name", "s_acctbal", "s_nationkey", "absent"], ["s_acctbal"])


@query(
    "population_shift",
    with_views(
        "app",
        body=f"""select SK_ID_CURR, {r("AMT_CREDIT * 1.8e0")} as AMT_CREDIT, {r("AMT_INCOME_TOTAL * 0.6e0")} as AMT_INCOME_TOTAL,
        cast(trunc(least(greatest(DAYS_BIRTH * 0.75e0, -15000), -6600)) as int) as DAYS_BIRTH, 'F' as CODE_GENDER from app""",
    ),
)
def population_shift(spark, sf_dir):
    app = view(spark, sf_dir, "app").select("SK_ID_CURR", "AMT_CREDIT", "AMT_INCOME_TOTAL", "DAYS_BIRTH", "CODE_GENDER")
    return settled(
        contract.shift_population(
            app,
            scale={"AMT_CREDIT": 1.8, "AMT_INCOME_TOTAL": 0.6, "DAYS_BIRTH": 0.75},
            clip={"DAYS_BIRTH": (-15000.0, -6600.0)},
            constant={"CODE_GENDER": "F"},
            whole=["DAYS_BIRTH"],
        )
    )
