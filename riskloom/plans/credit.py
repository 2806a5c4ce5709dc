"""From raw tables to model-ready rows and scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.nulls import col, replace_infinities, string_names
from riskloom.operators.aggregation import (
    aggregate_credits,
    aggregate_previous,
    aggregate_table,
    fit_categories,
    payment_behavior,
)
from riskloom.operators.cleaning import cap_column, missing_share, sentinel_to_flag, sum_flags
from riskloom.operators.contract import align, drop_columns
from riskloom.operators.features import INCOME, application_ratios, debt_to_income, score_summary
from riskloom.operators.joins import heavy_apart, keep_keys, keep_keys_chained, left_join_all, left_join_one, once_in_order
from riskloom.operators.modeling import stamp
from riskloom.schemas import FeatureParams

KEY = "SK_ID_CURR"
LABEL = "TARGET"

# Columns the ratios need although a drop list names them, and one share that
# is always dropped.
PROTECTED = ("AMT_CREDIT", "CNT_FAM_MEMBERS")
EXTRA_DROP = ("PREV_NAME_CASH_LOAN_PURPOSE_XAP_mean",)

# Join order of the history aggregates; payment behaviour joins after the ratios.
JOIN_ORDER = ("bureau_agg", "previous_agg", "cc_agg", "inst_agg", "pos_agg")
PAYMENT = "payment_behavior_agg"
FOUND = "history_found"


def clean_application(df: DataFrame, params: FeatureParams) -> DataFrame:
    """Sentinel, income cap, missing share, document count, then the three drops. The missing
    share is taken over the columns that exist before any of them is dropped."""
    flagged = cap_column(sentinel_to_flag(df, ["DAYS_EMPLOYED"]), INCOME, upper=params.amt_income_total_cap)
    checked = [c for c in flagged.columns if c not in (KEY, LABEL)]
    counted = sum_flags(missing_share(flagged, checked), params.flag_document_quasi_constant)
    return drop_columns(
        counted, [*params.cols_to_drop_pure, *params.cols_to_drop_housing, *params.cols_to_drop_clusters]
    )


def fit_history_categories(tables: Mapping[str, DataFrame]) -> dict[str, dict[str, list[str]]]:
    """Category lists of every history table, frozen with the other parameters."""
    return {name: fit_categories(df, string_names(df)) for name, df in tables.items() if string_names(df)}


def build_aggregations(tables: Mapping[str, DataFrame], params: FeatureParams) -> dict[str, DataFrame]:
    """The six client-level aggregates; sentinels go before any mean is taken."""
    cats = params.categories
    previous = sentinel_to_flag(tables["previous_application"], params.previous_days_cols)
    bureau_cats = {**cats.get("bureau", {}), **cats.get("bureau_balance", {})}
    return {
        "bureau_agg": aggregate_credits(tables["bureau"], tables["bureau_balance"], categories=bureau_cats or None),
        "previous_agg": aggregate_previous(previous, categories=cats.get("previous_application")),
        "cc_agg": aggregate_table(
            tables["credit_card_balance"], KEY, "CC", ["SK_ID_PREV"], cats.get("credit_card_balance")
        ),
        "inst_agg": aggregate_table(
            tables["installments_payments"], KEY, "INST", ["SK_ID_PREV"], cats.get("installments_payments")
        ),
        "pos_agg": aggregate_table(tables["pos_cash_balance"], KEY, "POS", ["SK_ID_PREV"], cats.get("pos_cash_balance")),
        PAYMENT: payment_behavior(tables["installments_payments"]),
    }


def restrict_history(tables: Mapping[str, DataFrame], clients: DataFrame) -> dict[str, DataFrame]:
    """Only the history of the given clients; months follow the credits kept."""
    out = {}
    for name, df in tables.items():
        if name == "bureau_balance":
            continue
        out[name] = keep_keys(df, clients, KEY)
    out["bureau"], out["bureau_balance"] = keep_keys_chained(
        tables["bureau"], tables["bureau_balance"], clients, KEY, "SK_ID_BUREAU"
    )
    return out


def merge_aggregations(df: DataFrame, aggs: Mapping[str, DataFrame], params: FeatureParams, check: bool = False) -> DataFrame:
    """Join the aggregates in order and drop the redundant columns; rows stay one per client."""
    joined = left_join_all(df, aggs, JOIN_ORDER, KEY, check)
    return drop_columns(drop_columns(joined, EXTRA_DROP), params.drop_list_restricted, PROTECTED)


def add_features(df: DataFrame, aggs: Mapping[str, DataFrame], params: FeatureParams, check: bool = False) -> DataFrame:
    """Score summary, ratios, debt ratio, payment behaviour, then no infinities."""
    ready = debt_to_income(application_ratios(score_summary(df)), params.debt_to_income_cap)
    return replace_infinities(left_join_one(ready, aggs[PAYMENT], KEY, check))


def build_features(
    app: DataFrame,
    tables: Mapping[str, DataFrame],
    params: FeatureParams,
    contract: T.StructType | None = None,
) -> DataFrame:
    """Raw tables to one feature row per client, in the model's column contract if given."""
    aggs = build_aggregations(tables, params)
    df = add_features(merge_aggregations(clean_application(app, params), aggs, params), aggs, params)
    return align(df, contract, KEY) if contract is not None else df


def features_for(
    app: DataFrame,
    history: Mapping[str, DataFrame],
    params: FeatureParams,
    input_contract: T.StructType,
    output_contract: T.StructType,
) -> DataFrame:
    """Requests enriched from the stored history: both contracts applied, presence noted. A client
    that a stored table holds twice is an error, as it would multiply requests. Clients with many
    requests are joined apart; ``app`` is read for the sketch that finds them and for each side."""

    def enrich(requests: DataFrame, tables: Mapping[str, DataFrame], hot: bool) -> DataFrame:
        # The joins that bring a table's columns also tell whether it knows the client: no table is dealt or ordered twice in a task.
        marks = {n: f"hit_{n}__" for n in tables}
        marked = {n: t.withColumn(marks[n], F.lit(True)) for n, t in tables.items()}
        # The hot side has as many clients as there are heavy keys, a bounded number. A marked copy has lost the hint.
        marked = {n: F.broadcast(t) if hot else once_in_order(t, KEY) for n, t in marked.items()}
        df = clean_application(align(requests, input_contract), params)
        df = add_features(merge_aggregations(df, marked, params), marked, params)
        for n in tables:
            if n not in (*JOIN_ORDER, PAYMENT):
                df = left_join_one(df, marked[n].select(KEY, marks[n]), KEY)
        known = F.coalesce(*[F.col(m) for m in marks.values()], F.lit(False))
        df = df.withColumn(FOUND, F.when(F.col(KEY).isNotNull(), known))
        out = align(df, T.StructType([*[f for f in output_contract if f.name != FOUND], T.StructField(FOUND, T.BooleanType())]), KEY)
        return out.select(KEY, *[col(c) for c in out.columns if c != KEY])

    return heavy_apart(app, KEY, history, enrich)


def score_batch(
    features: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    threshold: float,
    version: str,
    origin: str = "local",
    keep: Sequence[str] = (KEY, "probability"),
) -> DataFrame:
    """Feature rows to probability, decision and provenance; ``score`` adds ``probability``."""
    scored = score(features)
    return stamp(scored.select(*[c for c in scored.columns if c in keep or c == "history_found"]), threshold, version, origin)
