from __future__ import annotations

import pytest
from conftest import by_key, one

from riskloom.operators import aggregation, cleaning


def test_generic_table(spark):
    df = spark.createDataFrame([(1, 10, 100), (1, 11, 200), (2, 12, 50)], "SK_ID_CURR long, SK_ID_PREV long, AMT_BALANCE long")
    out = aggregation.aggregate_table(df, "SK_ID_CURR", "CC", ["SK_ID_PREV"])
    assert "CC_SK_ID_PREV_sum" not in out.columns
    rows = by_key(out, "SK_ID_CURR")
    assert rows[1] == {
        "SK_ID_CURR": 1,
        "CC_AMT_BALANCE_min": 100,
        "CC_AMT_BALANCE_max": 200,
        "CC_AMT_BALANCE_mean": 150.0,
        "CC_AMT_BALANCE_sum": 300,
        "CC_COUNT": 2,
    }
    assert rows[2]["CC_AMT_BALANCE_sum"] == 50 and rows[2]["CC_COUNT"] == 1


def test_previous_applications(spark):
    df = spark.createDataFrame(
        [(1, 10, 1000, "Approved", False, True), (1, 11, 3000, "Refused", True, True), (2, 12, 500, "Approved", False, False)],
        "SK_ID_CURR long, SK_ID_PREV long, AMT_APPLICATION long, NAME_CONTRACT_STATUS string, DAYS_FIRST_DUE_ANOM boolean, OTHER boolean",
    )
    out = aggregation.aggregate_previous(df)
    rows = by_key(out, "SK_ID_CURR")
    assert rows[1]["PREV_AMT_APPLICATION_mean"] == 2000
    assert rows[1]["PREV_APPLICATION_COUNT"] == 2 and rows[2]["PREV_APPLICATION_COUNT"] == 1
    assert rows[1]["PREV_NAME_CONTRACT_STATUS_Approved_mean"] == 0.5
    assert rows[1]["PREV_DAYS_FIRST_DUE_ANOM_sum"] == 1
    assert not [c for c in out.columns if "OTHER" in c]  # a boolean that is no anomaly flag is not aggregated


def bureau(spark):
    return spark.createDataFrame(
        [(1, 100, 5000, "Active", "currency 1", "Consumer credit"), (1, 101, 15000, "Closed", "currency 1", "Car loan")],
        "SK_ID_CURR long, SK_ID_BUREAU long, AMT_CREDIT_SUM long, CREDIT_ACTIVE string, CREDIT_CURRENCY string, CREDIT_TYPE string",
    )


def months(spark):
    return spark.createDataFrame(
        [(100, -1, "C"), (100, -2, "0"), (101, -1, "C")], "SK_ID_BUREAU long, MONTHS_BALANCE long, STATUS string"
    )


def test_two_levels(spark):
    row = one(aggregation.aggregate_credits(bureau(spark), months(spark)))
    assert row["BUREAU_CREDIT_COUNT"] == 2
    assert row["AMT_CREDIT_SUM_sum"] == 20000
    assert row["CREDIT_ACTIVE_Active_mean"] == 0.5
    assert row["MONTHS_BALANCE_count_sum"] == 3
    assert row["STATUS_C_mean_mean"] == 0.75


def test_booleans_become_numbers(spark):
    df = spark.createDataFrame(
        [(1, 10, 100, True), (1, 11, 300, False)], "SK_ID_CURR long, SK_ID_PREV long, AMT_PAYMENT long, LATE boolean"
    )
    row = one(aggregation.aggregate_table(df, "SK_ID_CURR", "INST", ["SK_ID_PREV"]))
    assert (row["INST_AMT_PAYMENT_mean"], row["INST_LATE_sum"], row["INST_COUNT"]) == (200, 1, 2)


def test_category_shares(spark):
    df = spark.createDataFrame(
        [(1, 10, 100, "Active"), (1, 11, 200, "Active"), (1, 12, 300, "Completed")],
        "SK_ID_CURR long, SK_ID_PREV long, AMT_BALANCE long, NAME_CONTRACT_STATUS string",
    )
    row = one(aggregation.aggregate_table(df, "SK_ID_CURR", "POS", ["SK_ID_PREV"]))
    assert row["POS_NAME_CONTRACT_STATUS_Active_mean"] == pytest.approx(2 / 3)
    assert row["POS_NAME_CONTRACT_STATUS_Completed_mean"] == pytest.approx(1 / 3)
    assert row["POS_AMT_BALANCE_sum"] == 600


def test_missing_values(spark):
    df = spark.createDataFrame(
        [(1, None, "a"), (1, None, None), (None, 5.0, "a"), (2, 1.0, "b")], "k long, x double, c string"
    )
    rows = by_key(aggregation.aggregate_by(df, "k", ["x"], {"c": ["a", "b"]}, "T", "T_COUNT"), "k")
    assert set(rows) == {1, 2}  # no row for the missing key
    assert rows[1]["T_x_sum"] == 0 and rows[1]["T_x_mean"] is None
    assert rows[1]["T_c_a_mean"] == 0.5 and rows[1]["T_COUNT"] == 2  # a missing category stays in the denominator


def test_wide_tables_are_split_and_put_together(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1.0, 2.0, "a"), (1, 3.0, None, "b"), (2, 5.0, 6.0, "a")], "k long, x double, y double, c string")
    whole = aggregation.aggregate_by(df, "k", ["x", "y"], {"c": ["a", "b"]}, "T", "T_COUNT")
    monkeypatch.setattr(aggregation, "MAX_BUFFERS", 4)
    split = aggregation.aggregate_by(df, "k", ["x", "y"], {"c": ["a", "b"]}, "T", "T_COUNT")
    assert split.columns == whole.columns
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))


def test_names_that_differ_only_in_case(spark):
    df = spark.createDataFrame([(1, "Cash"), (1, "cash")], "k long, c string")
    with pytest.raises(ValueError, match="clash"):
        aggregation.aggregate_table(df, "k", "T")


def test_too_many_categories_is_an_error(spark):
    df = spark.range(20).selectExpr("id AS k", "CAST(id AS STRING) AS c")
    with pytest.raises(ValueError, match="too many"):
        aggregation.fit_categories(df, ["c"], limit=10)


def test_payment_behaviour(spark):
    df = spark.createDataFrame(
        [(1, 100, 100, -30, -35), (1, 100, 80, -60, -55), (2, 50, None, -10, None)],
        "SK_ID_CURR long, AMT_INSTALMENT long, AMT_PAYMENT long, DAYS_INSTALMENT long, DAYS_ENTRY_PAYMENT long",
    )
    rows = by_key(aggregation.payment_behavior(df), "SK_ID_CURR")
    assert (rows[1]["LATE_PAYMENT_RATE"], rows[1]["LATE_PAYMENT_COUNT"]) == (0.5, 1)
    assert (rows[1]["DAYS_PAST_DUE_max"], rows[1]["PAYMENT_DIFF_sum"]) == (5, 20)
    # A payment that never came is not late, but counts as an instalment.
    assert (rows[2]["LATE_PAYMENT_RATE"], rows[2]["PAYMENT_DIFF_sum"], rows[2]["DAYS_PAST_DUE_max"]) == (0.0, 0, None)


def test_sentinel_goes_before_the_mean(spark):
    df = spark.createDataFrame([(1, 10, -500), (1, 11, 365243)], "SK_ID_CURR long, SK_ID_PREV long, DAYS_FIRST_DUE long")
    row = one(aggregation.aggregate_previous(cleaning.sentinel_to_flag(df, ["DAYS_FIRST_DUE"])))
    assert (row["PREV_DAYS_FIRST_DUE_mean"], row["PREV_DAYS_FIRST_DUE_ANOM_sum"]) == (-500, 1)
