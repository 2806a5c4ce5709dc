"""The given retail tables seen as credit data, once for Spark and once as SQL text.

Customers play the applicants, orders their credits and earlier applications, order lines
the months and instalments, events the prediction log. The tables hold no missing values,
so the views add some by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.readers import read_table_dir

# Each view: the source tables and the select list, in SQL both engines read alike.
VIEWS: dict[str, str] = {
    "app": """
        select c_custkey as SK_ID_CURR,
               case when c_acctbal >= 0 then c_acctbal end as AMT_INCOME_TOTAL,
               cast(1000 + (c_custkey * 7919) % 500000 as double) as AMT_CREDIT,
               cast(((c_custkey * 31) % 200) * 100 as double) as AMT_ANNUITY,
               case when c_custkey % 17 = 0 then cast(0 as double)
                    else cast(900 + (c_custkey * 7919) % 480000 as double) end as AMT_GOODS_PRICE,
               -(7000 + (c_custkey * 37) % 18000) as DAYS_BIRTH,
               case when c_custkey % 10 = 0 then cast(365243 as bigint) else -((c_custkey * 11) % 3000) end as DAYS_EMPLOYED,
               cast(c_nationkey % 5 as double) as CNT_FAM_MEMBERS,
               cast(c_nationkey % 3 as bigint) as CNT_CHILDREN,
               case c_nationkey % 7 when 0 then 'XNA' when 1 then 'M' when 2 then 'M' when 3 then 'M' else 'F' end as CODE_GENDER,
               case when c_mktsegment = 'BUILDING' then 'Revolving loans' else 'Cash loans' end as NAME_CONTRACT_TYPE,
               case when c_custkey % 2 = 0 then 'Y' else 'N' end as FLAG_OWN_CAR,
               case when c_custkey % 3 = 0 then 'Y' else 'N' end as FLAG_OWN_REALTY,
               case when c_custkey % 13 = 0 then null
                    when c_custkey % 5 = 0 then 'Lower secondary'
                    when c_custkey % 5 = 1 then 'Secondary / secondary special'
                    when c_custkey % 5 = 2 then 'Incomplete higher'
                    when c_custkey % 5 = 3 then 'Higher education'
                    else 'Academic degree' end as NAME_EDUCATION_TYPE,
               case when c_custkey % 9 = 0 then null else c_mktsegment end as NAME_INCOME_TYPE,
               case when c_custkey % 4 <> 0 then cast((c_custkey * 53) % 100 as double) / 100 end as EXT_SOURCE_1,
               case when c_custkey % 6 <> 0 then cast((c_custkey * 29) % 100 as double) / 100 end as EXT_SOURCE_2,
               case when c_custkey % 12 <> 0 then cast((c_custkey * 71) % 100 as double) / 100 end as EXT_SOURCE_3,
               cast(case when c_custkey % 3 = 0 then 1 else 0 end as int) as FLAG_DOCUMENT_2,
               cast(case when c_custkey % 7 = 0 then null when c_custkey % 8 = 0 then 1 else 0 end as int) as FLAG_DOCUMENT_4,
               cast(case when c_nationkey = 5 then 1 else 0 end as int) as FLAG_DOCUMENT_5,
               cast(case when (c_custkey * 53) % 100 < 30 and c_custkey % 3 = 0 then 1
                         when c_custkey % 19 = 0 then 1 else 0 end as int) as TARGET
        from customer""",
    "bureau": """
        select o_custkey as SK_ID_CURR,
               o_orderkey as SK_ID_BUREAU,
               o_totalprice as AMT_CREDIT_SUM,
               case when o_orderkey % 5 <> 0 then o_totalprice * 0.25e0 - 20000e0 end as AMT_CREDIT_SUM_DEBT,
               -(o_orderkey % 2900) as DAYS_CREDIT,
               o_orderstatus as CREDIT_ACTIVE,
               case o_orderkey % 3 when 0 then 'currency 1' when 1 then 'currency 2' else 'currency 3' end as CREDIT_CURRENCY,
               case when o_orderkey % 8 <> 0 then o_orderpriority end as CREDIT_TYPE
        from orders""",
    "bureau_balance": """
        select l_orderkey as SK_ID_BUREAU,
               cast(-l_linenumber as bigint) as MONTHS_BALANCE,
               case when l_linestatus = 'F' then 'C' when l_returnflag = 'A' then 'X'
                    when l_returnflag = 'R' then '1' else '0' end as STATUS
        from lineitem""",
    "previous_application": """
        select o_custkey as SK_ID_CURR,
               o_orderkey as SK_ID_PREV,
               o_totalprice as AMT_APPLICATION,
               case when o_orderkey % 4 <> 0 then o_totalprice * 0.5e0 end as AMT_CREDIT,
               case when o_orderkey % 7 = 0 then cast(365243 as bigint) else -(o_orderkey % 1500) end as DAYS_FIRST_DUE,
               case o_orderstatus when 'F' then 'Approved' when 'O' then 'Refused' else 'Canceled' end as NAME_CONTRACT_STATUS
        from orders""",
    "credit_card_balance": """
        select user_id as SK_ID_CURR,
               event_id as SK_ID_PREV,
               value as AMT_BALANCE,
               case when event_id % 6 <> 0 then value * 2 end as AMT_DRAWINGS_CURRENT,
               event_type as NAME_CONTRACT_STATUS
        from events""",
    "installments_payments": """
        select o_custkey as SK_ID_CURR,
               l_orderkey as SK_ID_PREV,
               l_extendedprice as AMT_INSTALMENT,
               case when l_quantity <> 50 then l_extendedprice * (1 - l_discount) end as AMT_PAYMENT,
               cast(-(l_orderkey % 2000) as bigint) as DAYS_INSTALMENT,
               case when l_quantity <> 50 then cast(-(l_orderkey % 2000) + l_linenumber - 4 as bigint) end as DAYS_ENTRY_PAYMENT
        from lineitem join orders on l_orderkey = o_orderkey""",
    "pos_cash_balance": """
        select o_custkey as SK_ID_CURR,
               o_orderkey as SK_ID_PREV,
               -(o_orderkey % 96) as MONTHS_BALANCE,
               case when o_orderkey % 9 <> 0 then cast(o_orderkey % 60 as double) end as CNT_INSTALMENT,
               o_orderstatus as NAME_CONTRACT_STATUS
        from orders""",
    "log": """
        select event_id as id,
               ts as created_at,
               user_id as sk_id_curr,
               case when event_type <> 'error' then cast(event_id % 100 as double) / 100 + value / 100000 end as probability,
               case when event_type = 'error' then null
                    when cast(event_id % 100 as double) / 100 + value / 100000 > 0.24e0 then 'refusé' else 'accordé' end as decision,
               case when event_type <> 'error' then user_id % 3 <> 0 end as history_found,
               cast(floor(value * 3) as int) as latency_ms,
               case when event_type <> 'error' then 'succes' when event_id % 3 = 0 then 'erreur' else 'validation' end as status,
               case when event_type <> 'error' then null when event_id % 3 = 0 then 'ValueError'
                    when event_id % 2 = 0 then 'missing:AMT_CREDIT' else 'greater_than:AMT_ANNUITY' end as error_type,
               case when user_id % 4 = 0 then 'production' else 'local' end as origine,
               props as features
        from events""",
    "dirty_lines": """
        select l_orderkey, l_partkey, l_suppkey, l_linenumber,
               case when l_quantity <> 50 then l_quantity end as qty,
               l_extendedprice as price,
               case when l_discount > 0 then l_discount end as discount,
               l_tax + 0 as tax,
               l_returnflag, l_linestatus, l_shipdate
        from lineitem""",
    "scored": """
        select d.doc_id, l.quality as label, cast(d.n_chars % 1000 as double) / 1000 as score
        from documents d join labels l on d.doc_id = l.doc_id""",
}

VIEW_TABLES = {
    "app": ["customer"],
    "bureau": ["orders"],
    "bureau_balance": ["lineitem"],
    "previous_application": ["orders"],
    "credit_card_balance": ["events"],
    "installments_payments": ["lineitem", "orders"],
    "pos_cash_balance": ["orders"],
    "log": ["events"],
    "dirty_lines": ["lineitem"],
    "scored": ["documents", "labels"],
}

HISTORY = [
    "bureau",
    "bureau_balance",
    "previous_application",
    "credit_card_balance",
    "installments_payments",
    "pos_cash_balance",
]


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return read_table_dir(spark, sf_dir, name, columns)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the credit views over the tables of a folder."""
    sources = {t: table(spark, sf_dir, t) for t in VIEW_TABLES[name]}
    text = VIEWS[name]
    for t in sources:
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(text, **sources)


def history(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: view(spark, sf_dir, name) for name in HISTORY}


def with_views(*names: str, body: str) -> str:
    """SQL text that defines the named views before ``body``."""
    parts = [f"{n if n != 'log' else 'calls_log'} as ({VIEWS[n]})" for n in names]
    return "with " + ",\n".join(parts) + "\n" + body


def settled(df: DataFrame, digits: int = 4) -> DataFrame:
    """All floating columns rounded the same way the SQL texts do."""
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    scale = f"{10**digits}.0D"
    return df.withColumns({n: F.expr(f"floor(`{n}` * {scale} + 0.500001D) / {scale}") for n in doubles})


def r(expression: str, digits: int = 4) -> str:
    """The rounding of :func:`settled` as SQL text."""
    scale = f"{10**digits}.0e0"
    return f"(floor(cast({expression} as double) * {scale} + 0.500001e0) / {scale})"
