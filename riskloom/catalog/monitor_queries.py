"""Log, validation, drift and streaming queries over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.catalog.registry import query
from riskloom.catalog.views import r, settled, table, view, with_views
from riskloom.functions import text
from riskloom.functions.scalars import spread_sql
from riskloom.operators import contract, drift, joins, timeline, validation
from riskloom.plans.monitoring import analyse
from riskloom.schemas import Rule
from riskloom.session import staging_path
from riskloom.sources import readers, writers
from riskloom.streaming import jobs, outcomes

REFERENCE_ROWS = 500
BUCKET = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _shown(df: DataFrame, column: str = "bucket") -> DataFrame:
    """Bucket starts as text, so that both engines show the same value."""
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


def _moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- log -----------------------------------------------------------------------------------


@query(
    "log_read",
    with_views(
        "log",
        body="""select id, status, latency_ms from calls_log where created_at >= timestamp '2024-01-20' and status = 'validation'
        order by created_at desc, id desc limit 50""",
    ),
)
def log_read(spark, sf_dir):
    log = view(spark, sf_dir, "log")
    return readers.read_log(log, datetime(2024, 1, 20), "validation", 50).select("id", "status", "latency_ms")


@query(
    "log_window",
    with_views("log", body="select id from calls_log where created_at >= timestamp '2024-01-31' - interval 168 hours"),
)
def log_window(spark, sf_dir):
    return contract.since(view(spark, sf_dir, "log"), "created_at", "7d", _moment("2024-01-31")).select("id")


@query("status_filter", with_views("log", body="select status, count(*) as n from calls_log where status <> 'succes' group by status"))
def status_filter(spark, sf_dir):
    failed = contract.with_status(view(spark, sf_dir, "log"), "succes", success=False)
    return failed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "threshold_filter",
    with_views("log", body="select id, latency_ms from calls_log where latency_ms >= 200 and probability is not null"),
)
def threshold_filter(spark, sf_dir):
    rows = contract.at_least(view(spark, sf_dir, "log"), "latency_ms", 200)
    return contract.non_null(rows, "probability").select("id", "latency_ms")


@query(
    "log_migration",
    """select event_id as id, 'succes' as status, cast(null as varchar) as error_type,
    case when floor(value * 3) > 150 then 'production' else 'local' end as origine from events""",
)
def log_migration(spark, sf_dir):
    """An old log without the newer columns, migrated and reclassified by latency."""
    old = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.floor(F.col("value") * 3).cast("int").alias("latency_ms")
    )
    return writers.reclassify_origin(writers.migrate_log(old)).drop("latency_ms")


@query(
    "log_append",
    with_views(
        "log",
        body="""select id, sk_id_curr, 'v4' as model_version, 0.24e0 as threshold, decision, status, error_type, origine, features from calls_log""",
    ),
)
def log_append(spark, sf_dir):
    """Append the log in two batches, one of them twice, and read it back."""
    folder = staging_path(spark, "log")
    log = view(spark, sf_dir, "log").withColumns({"model_version": F.lit("v4"), "threshold": F.lit(0.24)})
    early = F.col("created_at") < _moment("2024-01-15")
    writers.append_log(writers.log_rows(log.where(early)), folder, 0)
    writers.append_log(writers.log_rows(log.where(early)), folder, 0)
    writers.append_log(writers.log_rows(log.where(~early)), folder, 1)
    return spark.read.parquet(folder).select(
        "id", "sk_id_curr", "model_version", "threshold", "decision", "status", "error_type", "origine", "features"
    )


@query(
    "kpis",
    with_views(
        "log",
        body=f"""select count(*) as calls, {r("avg(case when status <> 'succes' then 1 else 0 end)")} as error_rate,
        {r("avg(case when decision = 'refusé' then 1 else 0 end) filter (where status = 'succes')")} as refusal_rate,
        {r("quantile_cont(latency_ms, 0.5) filter (where status = 'succes')")} as median_latency,
        {r("avg(case when history_found then 1 else 0 end) filter (where status = 'succes')")} as known_share from calls_log""",
    ),
)
def kpis(spark, sf_dir):
    return settled(timeline.headline(view(spark, sf_dir, "log")))


@query(
    "errors_by_type",
    with_views(
        "log", body="select status, error_type, count(*) as calls from calls_log where status <> 'succes' group by status, error_type"
    ),
)
def errors_by_type(spark, sf_dir):
    return timeline.errors_by_type(view(spark, sf_dir, "log"))


@query(
    "before_after_latency",
    with_views(
        "log",
        body="""select case when created_at < timestamp '2024-01-16' then 'avant' else 'apres' end as version, count(*) as n,
        round(cast(min(latency_ms) as double), 0) as min_ms, round(quantile_cont(latency_ms, 0.5) + 1e-9, 0) as median_ms,
        round(quantile_cont(latency_ms, 0.95) + 1e-9, 0) as p95_ms from calls_log where origine = 'production' group by 1""",
    ),
)
def before_after_latency(spark, sf_dir):
    log = view(spark, sf_dir, "log").where("origine = 'production'")
    out = timeline.before_after(log, "created_at", _moment("2024-01-16"))
    return out.withColumn("min_ms", F.col("min_ms").cast("double"))


def _gappy(spark, sf_dir) -> DataFrame:
    """The log without the calls of some hours and days, so that empty buckets occur."""
    log = view(spark, sf_dir, "log")
    return log.where("hour(created_at) % 5 <> 3 and day(created_at) % 6 <> 4")


GAPPY = "calls_log where hour(created_at) % 5 <> 3 and day(created_at) % 6 <> 4"


def _series(unit: str) -> str:
    return f""", g as (select * from {GAPPY}),
    frame as (select unnest(generate_series((select date_trunc('{unit}', min(created_at)) from g),
      (select date_trunc('{unit}', max(created_at)) from g), interval 1 {unit})) as bucket)"""


@query(
    "hourly_volume",
    with_views(
        "log",
        body=_series("hour")
        + f""" select {BUCKET.format('bucket')} as bucket, count(id) as n from frame
        left join g on date_trunc('hour', created_at) = bucket group by 1""",
    ),
)
def hourly_volume(spark, sf_dir):
    return _shown(timeline.volume(_gappy(spark, sf_dir), "created_at", "1 hour"))


@query(
    "daily_error_rate",
    with_views(
        "log",
        body=_series("day")
        + f""" select {BUCKET.format('bucket')} as bucket, {r("avg(case when status <> 'succes' then 1 when status is not null then 0 end)")} as error_rate
        from frame left join g on date_trunc('day', created_at) = bucket group by 1""",
    ),
)
def daily_error_rate(spark, sf_dir):
    return settled(_shown(timeline.error_rate(_gappy(spark, sf_dir), "created_at", "1 day")))


@query(
    "daily_refusal_rate",
    with_views(
        "log",
        body=_series("day")
        + f""" select {BUCKET.format('bucket')} as bucket, {r("avg(case when decision = 'refusé' then 1 when status is not null then 0 end)")} as refusal_rate
        from frame left join (select * from g where status = 'succes') s on date_trunc('day', created_at) = bucket group by 1""",
    ),
)
def daily_refusal_rate(spark, sf_dir):
    return settled(_shown(timeline.refusal_rate(_gappy(spark, sf_dir).where("status = 'succes'"), "created_at", "1 day")))


@query(
    "daily_latency_long",
    with_views(
        "log",
        body=_series("day")
        + f""", q as (select bucket, quantile_cont(latency_ms, 0.5) as median, quantile_cont(latency_ms, 0.95) as p95
          from frame left join g on date_trunc('day', created_at) = bucket group by 1)
        select {BUCKET.format('bucket')} as bucket, 'median' as measure, {r('median')} as ms from q
        union all select {BUCKET.format('bucket')}, 'p95', {r('p95')} from q""",
    ),
)
def daily_latency_long(spark, sf_dir):
    q = timeline.latency_quantiles(_gappy(spark, sf_dir), "created_at", "latency_ms", "1 day", {"median": 0.5, "p95": 0.95})
    return settled(_shown(timeline.to_long(q, ["median", "p95"])))


@query(
    "recent_first",
    with_views("log", body="select id, latency_ms from calls_log order by created_at desc, id desc limit 25"),
)
def recent_first(spark, sf_dir):
    return readers.read_log(view(spark, sf_dir, "log"), limit=25).select("id", "latency_ms")


# --- contract and JSON ---------------------------------------------------------------------

K_OF = "cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) as bigint)"


@query("json_expand", f"select event_id, {K_OF} as k, cast(null as varchar) as absent from events")
def json_expand(spark, sf_dir):
    wanted = T.StructType([T.StructField("k", T.LongType()), T.StructField("absent", T.StringType())])
    return contract.expand_json(table(spark, sf_dir, "events"), "props", wanted, ["event_id"])


@query(
    "coerce_numeric",
    """select o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) as double) as level,
    case when o_orderkey % 3 = 0 then cast(o_orderkey as double) end as mixed from orders""",
)
def coerce_numeric(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("level"),
        F.when(F.expr("o_orderkey % 3 = 0"), F.col("o_orderkey").cast("string")).otherwise(F.lit("n/a")).alias("mixed"),
    )
    return contract.coerce_numeric(rows, ["level", "mixed"])


@query(
    "populated_columns",
    " union all ".join(f"""select '{c}' as "column" from lineitem having count({e}) > 0""" for c, e in (("l_quantity", "l_quantity"), ("never", "null"), ("l_tax", "l_tax"))),
)
def populated_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("never", F.lit(None).cast("double"))
    names = contract.populated_columns(rows, ["l_quantity", "never", "l_tax"])
    return text.frame(spark, [{"column": text.value(n)} for n in names])


@query(
    "usable_payload",
    with_views(
        "app",
        body="""select SK_ID_CURR, '{"SK_ID_CURR":' || SK_ID_CURR || ',"DAYS_BIRTH":' || DAYS_BIRTH || ',"CODE_GENDER":"' || CODE_GENDER || '"' ||
        case when NAME_INCOME_TYPE is not null then ',"NAME_INCOME_TYPE":"' || NAME_INCOME_TYPE || '"' else '' end || '}' as payload
        from app where AMT_INCOME_TOTAL is not null and NAME_EDUCATION_TYPE is not null and DAYS_EMPLOYED <= 0""",
    ),
)
def usable_payload(spark, sf_dir):
    rows = contract.usable_records(
        view(spark, sf_dir, "app"), ["AMT_INCOME_TOTAL", "NAME_EDUCATION_TYPE", "DAYS_EMPLOYED"], ["DAYS_EMPLOYED"]
    )
    types = {"SK_ID_CURR": "long", "DAYS_BIRTH": "int", "CODE_GENDER": "string", "NAME_INCOME_TYPE": "string"}
    return contract.to_payload(rows, types, keep=["SK_ID_CURR"])


@query("renamed", "select c_custkey as client_id, c_name as name, 'Référence' as source from customer")
def renamed(spark, sf_dir):
    return contract.label_source(
        contract.rename(
            table(spark, sf_dir, "customer", ["c_custkey", "c_name"]), {"c_custkey": "client_id", "c_name": "name"}
        ),
        "Référence",
    )


# --- validation ----------------------------------------------------------------------------

ORDER_RULES = (
    Rule("o_orderkey", "int", gt=0),
    Rule("o_totalprice", "float", ge=5000, le=450000),
    Rule("o_orderstatus", "choice", choices=("F", "O")),
    Rule("o_clerk", "text", required=False),
)
ORDER_ERRORS = """case when o_orderkey <= 0 then 'greater_than:o_orderkey' when o_totalprice < 5000 then 'greater_than_equal:o_totalprice'
    when o_totalprice > 450000 then 'less_than_equal:o_totalprice' when o_orderstatus not in ('F', 'O') then 'literal_error:o_orderstatus' end"""


def _checked_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("o_clerk", F.lit(None).cast("string"))
    return validation.validate_columns(rows, ORDER_RULES)


@query(
    "validation_split",
    f"""select status, count(*) as n, cast(sum(o_orderkey) as bigint) as key_sum from (
    select o_orderkey, case when {ORDER_ERRORS} is null then 'succes' else 'validation' end as status from orders) t group by status""",
)
def validation_split(spark, sf_dir):
    good, bad = validation.split_valid(_checked_orders(spark, sf_dir))
    both = good.unionByName(bad)
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("validation_errors", f"select o_orderkey, {ORDER_ERRORS} as error_type from orders where {ORDER_ERRORS} is not null")
def validation_errors(spark, sf_dir):
    _, bad = validation.split_valid(_checked_orders(spark, sf_dir))
    return bad.select("o_orderkey", "error_type")


# Requests made from customers; every seventh or so breaks one rule of the record contract.
REQUESTS = """
    select SK_ID_CURR as request_id,
      case when SK_ID_CURR % 31 = 5 then '{"SK_ID_CURR": 12,' when SK_ID_CURR % 31 = 6 then '[1, 2]' else
      '{"SK_ID_CURR": ' || cast(SK_ID_CURR as varchar(20)) ||
      case when SK_ID_CURR % 7 = 1 then '' else ', "AMT_INCOME_TOTAL": 150000.5' end ||
      case when SK_ID_CURR % 7 = 2 then ', "AMT_CREDIT": "beaucoup"' else ', "AMT_CREDIT": ' || cast(1000 + SK_ID_CURR as varchar(20)) end ||
      ', "AMT_ANNUITY": ' || case when SK_ID_CURR % 7 = 3 then '-1' else '25000' end ||
      ', "AMT_GOODS_PRICE": 450000, "DAYS_BIRTH": ' || cast(DAYS_BIRTH as varchar(20)) ||
      ', "DAYS_EMPLOYED": ' || cast(DAYS_EMPLOYED as varchar(20)) ||
      ', "CNT_FAM_MEMBERS": 2, "CNT_CHILDREN": ' || case when SK_ID_CURR % 7 = 4 then '1.5' else '1' end ||
      ', "CODE_GENDER": "' || CODE_GENDER || '", "NAME_CONTRACT_TYPE": "' || NAME_CONTRACT_TYPE ||
      '", "FLAG_OWN_CAR": "' || FLAG_OWN_CAR || '", "FLAG_OWN_REALTY": "' || FLAG_OWN_REALTY ||
      '", "NAME_EDUCATION_TYPE": ' || coalesce('"' || NAME_EDUCATION_TYPE || '"', 'null') ||
      ', "EXT_SOURCE_1": ' || coalesce(cast(EXT_SOURCE_1 as varchar(20)), 'null') ||
      ', "extra_fields": {"CNT_CHILDREN": 9, "OWN_CAR_AGE": 4}}' end as body
    from app"""
REQUEST_ERROR = """case when SK_ID_CURR % 31 = 5 then 'json_invalid' when SK_ID_CURR % 31 = 6 then 'model_attributes_type'
    when SK_ID_CURR <= 0 then 'greater_than:SK_ID_CURR' when SK_ID_CURR % 7 = 1 then 'missing:AMT_INCOME_TOTAL'
    when SK_ID_CURR % 7 = 2 then 'float_parsing:AMT_CREDIT' when SK_ID_CURR % 7 = 3 then 'greater_than:AMT_ANNUITY'
    when DAYS_BIRTH > -6570 then 'less_than_equal:DAYS_BIRTH' when DAYS_BIRTH < -25550 then 'greater_than_equal:DAYS_BIRTH'
    when DAYS_EMPLOYED > 0 then 'less_than_equal:DAYS_EMPLOYED' when SK_ID_CURR % 7 = 4 then 'int_from_float:CNT_CHILDREN'
    when NAME_EDUCATION_TYPE is null then 'literal_error:NAME_EDUCATION_TYPE' end"""


def _requests(spark, sf_dir):
    return spark.sql(REQUESTS.replace("from app", "from {app}").replace("'{\"SK", "'{{\"SK").replace(
        '"extra_fields": {"CNT_CHILDREN": 9, "OWN_CAR_AGE": 4}}', '"extra_fields": {{"CNT_CHILDREN": 9, "OWN_CAR_AGE": 4}}}}'
    ), app=view(spark, sf_dir, "app"))


@query(
    "request_validation",
    with_views("app", body=f"select SK_ID_CURR as request_id, {REQUEST_ERROR} as error_type from app"),
)
def request_validation(spark, sf_dir):
    return validation.validate_json(_requests(spark, sf_dir), "body").select("request_id", "error_type")


@query(
    "request_rows",
    with_views(
        "app",
        body=f"""select SK_ID_CURR, cast(1000 + SK_ID_CURR as double) as AMT_CREDIT, cast(9 as bigint) as CNT_CHILDREN, CODE_GENDER,
        cast(4 as double) as OWN_CAR_AGE, EXT_SOURCE_1, cast(null as double) as EXT_SOURCE_2
        from (select *, {REQUEST_ERROR} as e from app) t where e is null""",
    ),
)
def request_rows(spark, sf_dir):
    good, _ = validation.split_valid(validation.validate_json(_requests(spark, sf_dir), "body"))
    long, double, text = T.LongType(), T.DoubleType(), T.StringType()
    wanted = [
        ("SK_ID_CURR", long),
        ("AMT_CREDIT", double),
        ("CNT_CHILDREN", long),
        ("CODE_GENDER", text),
        ("OWN_CAR_AGE", double),
        ("EXT_SOURCE_1", double),
        ("EXT_SOURCE_2", double),
    ]
    return validation.flatten_record(good, T.StructType([T.StructField(n, t) for n, t in wanted]))


@query(
    "request_quarantine",
    with_views(
        "app",
        body=f"""select request_id, case when e in ('json_invalid', 'model_attributes_type') then null else request_id end as sk_id_curr,
        'validation' as status, e as error_type, case when e in ('json_invalid', 'model_attributes_type') then '{{}}' else body end as features
        from (select q.request_id, q.body, {REQUEST_ERROR} as e from ({REQUESTS}) q join app on SK_ID_CURR = request_id) t where e is not null""",
    ),
)
def request_quarantine(spark, sf_dir):
    _, bad = validation.split_valid(validation.validate_json(_requests(spark, sf_dir), "body"))
    return validation.reject_rows(bad, "body")


@query(
    "error_counts",
    with_views(
        "app",
        body=f"""select 'validation' as status, e as error_type, count(*) as n from (select {REQUEST_ERROR} as e from app) t
        where e is not null group by e""",
    ),
)
def error_counts(spark, sf_dir):
    return validation.error_counts(validation.validate_json(_requests(spark, sf_dir), "body"))


@query(
    "output_checks",
    with_views("log", body="select id from calls_log where status <> 'succes' or not (probability between 0 and 1)"),
)
def output_checks(spark, sf_dir):
    return validation.bad_outputs(view(spark, sf_dir, "log")).select("id")


# --- drift ---------------------------------------------------------------------------------

SWITCH = "2024-01-16"
HALVES = f"""with both_halves as (select *, {K_OF} as k, ts < timestamp '{SWITCH}' as is_ref from events)"""


def _w1(column: str) -> str:
    return f"""
    select '{column}' as "column", sum(abs(cum_r / n_r - cum_c / n_c) * (nxt - v)) / greatest(max(std), 0.001) as score from (
      select v, cast(sum(r) over (order by v) as double) as cum_r, cast(sum(c) over (order by v) as double) as cum_c,
        sum(r) over () as n_r, sum(c) over () as n_c, lead(v) over (order by v) as nxt,
        (select stddev_pop({column}) from both_halves where is_ref) as std
      from (select {column} as v, count(*) filter (where is_ref) as r, count(*) filter (where not is_ref) as c
            from both_halves where {column} is not null group by 1) g) h"""


def _js(column: str) -> str:
    return f"""
    select '{column}' as "column", sqrt(sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end
        + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2 / ln(2)) as score from (
      select cast(r as double) / sum(r) over () as p, cast(c as double) / sum(c) over () as q
      from (select {column} as v, count(*) filter (where is_ref) as r, count(*) filter (where not is_ref) as c
            from both_halves where {column} is not null group by 1) g) h"""


def _halves(spark, sf_dir, shifted: bool = False):
    wanted = T.StructType([T.StructField("k", T.LongType())])
    rows = contract.expand_json(table(spark, sf_dir, "events"), "props", wanted, ["ts", "value", "event_type"])
    before = F.col("ts") < _moment(SWITCH)
    reference, current = rows.where(before).drop("ts"), rows.where(~before).drop("ts")
    if shifted:
        current = contract.shift_population(current, scale={"value": 1.8}, constant={"event_type": "click"})
    return reference, current


@query("drift_numeric_w1", HALVES + f" select \"column\", 'wasserstein' as method, {r('score', 6)} as score from (" + _w1("value") + " union all " + _w1("k") + ") t")
def drift_numeric_w1(spark, sf_dir):
    reference, current = _halves(spark, sf_dir)
    return settled(drift.wasserstein(reference, current, ["value", "k"]), 6)


@query("drift_categorical_js", HALVES + f" select \"column\", 'jensenshannon' as method, {r('score', 6)} as score from (" + _js("event_type") + ") t")
def drift_categorical_js(spark, sf_dir):
    reference, current = _halves(spark, sf_dir)
    return settled(drift.jensen_shannon(reference, current, ["event_type"]), 6)


SHIFTED = f"""with both_halves as (select {K_OF} as k, ts < timestamp '{SWITCH}' as is_ref,
    case when ts < timestamp '{SWITCH}' then value else value * 1.8e0 end as value,
    case when ts < timestamp '{SWITCH}' then event_type else 'click' end as event_type from events)"""
DETAIL = (
    SHIFTED
    + f""", scores as (select "column", 'wasserstein' as method, score from ({_w1("value")} union all {_w1("k")}) a
      union all select "column", 'jensenshannon', score from ({_js("event_type")}) b)"""
)


@query(
    "drift_detail",
    DETAIL + " select \"column\", method, round(score, 4) as score, 0.1e0 as threshold, round(score, 4) > 0.1e0 as drifted from scores",
)
def drift_detail(spark, sf_dir):
    return drift.drift_detail(*_halves(spark, sf_dir, shifted=True))


@query(
    "drift_summary",
    DETAIL
    + f""" select count(*) filter (where score > 0.1) as columns_drifted, count(*) as columns_compared,
    {r("count(*) filter (where score > 0.1) / cast(count(*) as double)")} as share_drifted,
    (select count(*) from both_halves where not is_ref) as n_rows,
    case when (select count(*) from both_halves where not is_ref) < 500 then 'small sample' else 'sufficient' end as sample_status from scores""",
)
def drift_summary(spark, sf_dir):
    reference, current = _halves(spark, sf_dir, shifted=True)
    return settled(drift.drift_summary(drift.drift_detail(reference, current), current))


@query(
    "share_by_source",
    f"""select source, event_type, n, {r("n / cast(sum(n) over (partition by source) as double)")} as share from (
    select case when ts < timestamp '{SWITCH}' then 'reference' else 'current' end as source, event_type, count(*) as n from events group by 1, 2) t""",
)
def share_by_source(spark, sf_dir):
    return settled(drift.share_by_source(*_halves(spark, sf_dir), "event_type"))


@query(
    "drift_reference",
    with_views(
        "app",
        body=f"""select SK_ID_CURR, AMT_INCOME_TOTAL, case when DAYS_EMPLOYED <> 365243 then DAYS_EMPLOYED end as DAYS_EMPLOYED, CODE_GENDER
        from app order by {spread_sql('SK_ID_CURR')}, SK_ID_CURR limit {REFERENCE_ROWS}""",
    ),
)
def drift_reference(spark, sf_dir):
    """A seeded sample, sentinels blanked, written and read back."""
    path = staging_path(spark, "reference")
    columns = ["SK_ID_CURR", "AMT_INCOME_TOTAL", "DAYS_EMPLOYED", "CODE_GENDER"]
    rows = view(spark, sf_dir, "app")
    drift.build_reference(rows, "SK_ID_CURR", columns, REFERENCE_ROWS, sentinels=["DAYS_EMPLOYED"]).write.parquet(path)
    return readers.read_parquet(spark, path)


@query(
    "monitoring_report",
    with_views(
        "log",
        body="""select 'calls' as part, count(*) as n from calls_log where created_at >= timestamp '2024-01-31' - interval 168 hours
        union all select 'errors', count(*) from calls_log where created_at >= timestamp '2024-01-31' - interval 168 hours and status <> 'succes'
        union all select 'volume', count(*) from calls_log where created_at >= timestamp '2024-01-31' - interval 168 hours
        union all select 'histogram', count(*) from calls_log where created_at >= timestamp '2024-01-31' - interval 168 hours and status = 'succes'
        union all select 'drift_columns', 1""",
    ),
)
def monitoring_report(spark, sf_dir):
    """The whole monitoring report of one week, reduced to its totals."""
    log = view(spark, sf_dir, "log")
    wanted = T.StructType([T.StructField("k", T.LongType())])
    old = contract.expand_json(log.where(F.col("created_at") < _moment("2024-01-16")), "features", wanted)
    report = analyse(log, old, "7d", datetime(2024, 1, 31))

    def total(part: str, df: DataFrame, column: str | None = None) -> DataFrame:
        n = F.count(F.lit(1)) if column is None else F.coalesce(F.sum(column), F.lit(0)).cast("long")
        return df.agg(n.alias("n")).select(F.lit(part).alias("part"), "n")

    parts = [
        total("calls", report["calls"]),
        total("errors", report["errors"], "calls"),
        total("volume", report["volume"], "n"),
        total("histogram", report["probabilities"], "n"),
        total("drift_columns", report["drift"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- streaming -----------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = readers.stream_parquet(spark, sf_dir, "events", schema)
    # Watermarks need an instant; the stored times carry no zone and are read as UTC.
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


DELIVERIES = 4


def _delivered(spark, sf_dir, again: str | None = None) -> DataFrame:
    """The events as a stream of several micro-batches, one stretch of time after the other.

    ``again`` delivers some twice: ``next`` each stretch once more with the following one, ``late`` the first stretch once
    more after the last.
    """
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = events.selectExpr(f"percentile_approx(ts, array({', '.join(str(i / DELIVERIES) for i in range(1, DELIVERIES))})) AS c").first()["c"]
    stretch = sum((F.when(F.col("ts") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    folder = staging_path(spark, "deliveries")
    for i in range(DELIVERIES + (again is not None)):
        parts = [i, *([i - 1] if again == "next" else [])] if i < DELIVERIES or again == "next" else [0]
        events.where(stretch.isin(parts)).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return readers.stream_parquet(spark, folder, "events", events.schema, files=1)


def _drained(spark, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over everything available and read what its sink wrote."""
    folder = staging_path(spark, name)
    jobs.drain(stream, jobs.batch_sink(f"{folder}/out"), f"{folder}/progress", mode)
    # A restart goes on where the first run stopped, and finds nothing new.
    jobs.drain(stream, jobs.batch_sink(f"{folder}/out"), f"{folder}/progress", mode)
    return jobs.read_batches(spark, f"{folder}/out", stream.schema)


LOG_STREAM = """select event_id as id, ts as created_at, user_id as sk_id_curr, cast(floor(value * 3) as int) as latency_ms,
    case when event_type = 'error' then 'erreur' else 'succes' end as status,
    case when event_type = 'error' then null when value > 50 then 'refusé' else 'accordé' end as decision from events"""


def _log_stream(spark, sf_dir, again=None):
    events = _delivered(spark, sf_dir, again)
    return events.selectExpr(
        "event_id as id",
        "ts as created_at",
        "user_id as sk_id_curr",
        "cast(floor(value * 3) as int) as latency_ms",
        "case when event_type = 'error' then 'erreur' else 'succes' end as status",
        "case when event_type = 'error' then null when value > 50 then 'refusé' else 'accordé' end as decision",
    )


@query(
    "stream_kpis",
    f"""select {BUCKET.format("date_trunc('hour', created_at)")} as bucket, count(*) as calls,
    {r("avg(case when status <> 'succes' then 1 else 0 end)")} as error_rate,
    {r("count(*) filter (where decision = 'refusé') / cast(nullif(count(*) filter (where status = 'succes'), 0) as double)")} as refusal_rate
    from ({LOG_STREAM}) t group by 1""",
)
def stream_kpis(spark, sf_dir):
    """Several micro-batches; what comes again long after its hour is refused by the watermark."""
    live = jobs.live_kpis(
        _log_stream(spark, sf_dir, "late"), "created_at", "1 hour", "10 minutes", F.col("status"), F.col("decision") == "refusé"
    )
    return settled(_shown(jobs.latest(_drained(spark, live, "kpis", "update"), ["bucket"])))


@query(
    "stream_latency",
    f"""select {BUCKET.format("date_trunc('day', created_at)")} as bucket, {r("quantile_cont(latency_ms, 0.5)")} as median,
    {r("quantile_cont(latency_ms, 0.95)")} as p95 from ({LOG_STREAM}) t group by 1""",
)
def stream_latency(spark, sf_dir):
    counts = jobs.live_latency_counts(_log_stream(spark, sf_dir), "created_at", "1 day", "10 minutes", F.col("latency_ms"))
    newest = jobs.latest(_drained(spark, counts, "latency", "update"), ["bucket", "value"])
    return settled(_shown(jobs.quantiles_of_counts(newest, {"median": 0.5, "p95": 0.95})))


@query(
    "stream_validate",
    """select 'accepted' as side, count(*) as n, cast(sum(event_id) as bigint) as id_sum from events where value > 1 and value <= 100 and event_type <> 'error'
    union all select 'rejected', count(*), cast(sum(event_id) as bigint) from events where not (value > 1 and value <= 100 and event_type <> 'error')""",
)
def stream_validate(spark, sf_dir):
    """Request bodies arrive as JSON text in several micro-batches; each is split into records and rejects."""
    rules = (
        Rule("event_id", "int", ge=0),
        Rule("value", "float", gt=1, le=100),
        Rule("event_type", "choice", choices=("click", "purchase", "signup", "view")),
    )
    bodies = _delivered(spark, sf_dir).select("event_id", F.to_json(F.struct("event_id", "value", "event_type")).alias("body"))
    folder = staging_path(spark, "validate")
    checked = jobs.validated(bodies, "body", rules)
    jobs.drain(checked, jobs.two_way_sink(f"{folder}/good", f"{folder}/bad"), f"{folder}/progress")
    sides = [("accepted", "good"), ("rejected", "bad")]
    parts = [
        spark.read.parquet(f"{folder}/{d}").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum")).select(
            F.lit(s).alias("side"), "n", "id_sum"
        )
        for s, d in sides
    ]
    return parts[0].unionByName(parts[1])


@query(
    "stream_enrich",
    """select event_id, o.n as order_count, o.n is not null as history_found from events
    left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1) o on user_id = o_custkey""",
)
def stream_enrich(spark, sf_dir):
    """Several micro-batches, each with its own heavy clients joined apart."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    history = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("order_count"))
    folder = staging_path(spark, "enrich")
    sink = jobs.enrich_sink(f"{folder}/out", {"orders": history}, "user_id", ["event_id", "order_count", "history_found"])
    jobs.drain(_delivered(spark, sf_dir), sink, f"{folder}/progress")
    return spark.read.parquet(f"{folder}/out").drop("batch")


SCORE_RULES = (
    Rule("event_id", "int", ge=0),
    Rule("SK_ID_CURR", "int", ge=0),
    Rule("value", "float", gt=1, le=100),
    Rule("event_type", "choice", choices=("click", "purchase", "signup", "view")),
)


def _faulty_model(rows):
    """A model that gives value / (value + 50), and fails in three ways: by raising, by raising otherwise, by a result out of range."""
    if (rows["value"] > 90).any():
        raise OverflowError("value")
    if (rows["event_id"] % 101 == 0).any():
        raise KeyError("event_id")
    p = rows["value"] / (rows["value"] + 50)
    return p.where(rows["event_id"] % 89 != 0, 1.5)


def _event_calls(spark, sf_dir) -> DataFrame:
    """Events as calls: every fiftieth body is broken, every third has further fields, some values break the rules."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    extra = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("channel"), F.col("event_type")))
    whole = F.to_json(F.struct("event_id", F.col("user_id").alias("SK_ID_CURR"), "value", "event_type", extra.alias("extra_fields")))
    broken = F.when(F.col("event_id") % 50 == 7, F.left("whole", F.lit(9))).otherwise(F.col("whole"))
    latency = F.floor(F.col("value") * 3).cast("int")
    return events.withColumn("whole", whole).select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", latency.alias("latency_ms"), broken.alias("body")
    )


@query(
    "stream_score",
    f"""with c as (
      select *, event_id % 50 = 7 as broken, value / (value + 50) as p from events
    ), e as (
      select *, case when broken then 'json_invalid' when value <= 1 then 'greater_than:value' when value > 100 then 'less_than_equal:value'
        when event_type = 'error' then 'literal_error:event_type' end as refused,
        case when value > 90 then 'OverflowError' when event_id % 101 = 0 then 'KeyError' when event_id % 89 = 0 then 'ValidationError' end as failed from c
    ), o as (
      select *, case when refused is not null then 'validation' when failed is not null then 'erreur' else 'succes' end as status from e
    )
    select event_id as id, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at, case when not broken then user_id end as sk_id_curr, 'v4' as model_version, {r("0.24")} as threshold,
      case when status = 'succes' then {r("p")} end as probability,
      case when status = 'succes' then case when p > 0.24e0 then 'refusé' else 'accordé' end end as decision,
      case when status = 'succes' then user_id in (select o_custkey from orders) end as history_found,
      case when status <> 'validation' then cast(floor(value * 3) as int) end as latency_ms, status, coalesce(refused, failed) as error_type, 'production' as origine,
      case when not broken then event_id end as f_event_id, case when not broken then {r("value")} end as f_value, case when not broken then event_type end as f_event_type,
      case when not broken and event_id % 3 = 0 and status <> 'erreur' then event_type end as f_channel
    from o""",
)
def stream_score(spark, sf_dir):
    """Good, refused and failing calls in several micro-batches, all in one log; a restart finds nothing new."""
    folder = staging_path(spark, "scored")
    calls = _event_calls(spark, sf_dir)
    calls.repartitionByRange(4, "id").write.parquet(f"{folder}/calls.parquet")
    orders = table(spark, sf_dir, "orders", ["o_custkey"])
    known = {"orders": orders.select(F.col("o_custkey").alias("user_id")).distinct()}
    sink = outcomes.outcome_sink(
        f"{folder}/log", _faulty_model, ["event_id", "value"], 0.24, "v4", "production", lambda batch: joins.lookup_history(batch, known, "user_id")
    )
    for _ in range(2):
        stream = jobs.validated(readers.stream_parquet(spark, folder, "calls", calls.schema, files=1), "body", SCORE_RULES)
        jobs.drain(stream, sink, f"{folder}/progress")
    log = spark.read.parquet(f"{folder}/log")
    # A refused call keeps its raw body, in which further fields are not merged.
    kept = F.from_json("features", "event_id bigint, value double, event_type string, channel string, extra_fields map<string,string>")
    fields = [F.col(f"f.{c}").alias(f"f_{c}") for c in ("event_id", "value", "event_type")]
    channel = F.coalesce("f.channel", F.col("f.extra_fields")["channel"]).alias("f_channel")
    shown = log.withColumn("f", kept).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    return settled(shown.select(*[c for c in log.columns if c not in ("created_at", "features", "batch", "day")], "created_at", *fields, channel))


@query(
    "stream_dedup",
    "select event_type, count(*) as n, cast(sum(event_id) as bigint) as id_sum from events group by event_type",
)
def stream_dedup(spark, sf_dir):
    """Every call is delivered twice, the second time with a later micro-batch; one copy is kept."""
    kept = jobs.deduplicated(_delivered(spark, sf_dir, "next"), "ts", "10 minutes", ["event_id"]).select("event_id", "event_type")
    return (
        _drained(spark, kept, "dedup", "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))
    )


@query(
    "stream_drift",
    HALVES
    + f""", parts as (select 'value' as "column", 'wasserstein' as method, score from ({_w1("value")}) a
      union all select 'event_type', 'jensenshannon', score from ({_js("event_type")}) b)
    select "column", method, round(score, 4) as score, 0.1e0 as threshold, round(score, 4) > 0.1e0 as drifted from parts""",
)
def stream_drift(spark, sf_dir):
    """Later events as a stream, compared batch by batch with the frozen earlier ones."""
    folder = staging_path(spark, "drift")
    frozen = _frozen_half(spark, sf_dir, folder)
    later = _event_stream(spark, sf_dir).where(F.col("ts") >= F.lit(SWITCH).cast("timestamp"))
    jobs.drain(later, jobs.drift_sink(frozen, f"{folder}/out"), f"{folder}/progress")
    return spark.read.parquet(f"{folder}/out").drop("batch")


def _frozen_half(spark, sf_dir, folder):
    reference = table(spark, sf_dir, "events").where(F.col("ts") < _moment(SWITCH)).select("value", "event_type")
    return drift.freeze_reference(reference, f"{folder}/reference")


@query(
    "stream_drift_windows",
    HALVES
    + """, days as (select distinct date_trunc('day', ts) as day from events where ts >= timestamp '2024-01-16'),
    of_day as (select day, value, event_type, is_ref from both_halves join days on is_ref or date_trunc('day', ts) = day),
    numbers as (
      select day, v, cast(sum(r) over w as double) as cum_r, cast(sum(c) over w as double) as cum_c, sum(r) over (partition by day) as n_r, sum(c) over (partition by day) as n_c,
        lead(v) over w as nxt, (select stddev_pop(value) from both_halves where is_ref) as std
      from (select day, value as v, count(*) filter (where is_ref) as r, count(*) filter (where not is_ref) as c from of_day where value is not null group by all) g
      window w as (partition by day order by v)
    ), labels as (
      select day, cast(r as double) / sum(r) over (partition by day) as p, cast(c as double) / sum(c) over (partition by day) as q
      from (select day, event_type as v, count(*) filter (where is_ref) as r, count(*) filter (where not is_ref) as c from of_day group by all) g
    ), parts as (
      select day, 'value' as "column", 'wasserstein' as method, sum(abs(cum_r / n_r - cum_c / n_c) * (nxt - v)) / greatest(max(std), 0.001) as score from numbers group by day
      union all select day, 'event_type', 'jensenshannon', sqrt(sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2 / ln(2)) from labels group by day
    )
    select strftime(day, '%Y-%m-%d %H:%M:%S') as bucket, "column", method, round(score, 4) as score, 0.1e0 as threshold, round(score, 4) > 0.1e0 as drifted from parts""",
)
def stream_drift_windows(spark, sf_dir):
    """Drift of every day, its values counted in the state of a stream of several micro-batches; the reference is counted once."""
    folder = staging_path(spark, "drift-windows")
    frozen = _frozen_half(spark, sf_dir, folder)
    later = _delivered(spark, sf_dir).where(F.col("ts") >= F.lit(SWITCH).cast("timestamp"))
    live = jobs.live_values(later, "ts", "1 day", "10 minutes", frozen)
    counts = jobs.latest(_drained(spark, live, "values", "update"), ["bucket", "column", "slice", "value", "label"])
    return _shown(drift.drift_of_counts(frozen, counts, ["bucket"]))
