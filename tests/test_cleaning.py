from __future__ import annotations

import pytest
from conftest import one

from riskloom.functions.nulls import nan_to_null, replace_infinities
from riskloom.operators import cleaning


def test_sentinel_gets_a_flag_and_is_blanked(spark):
    df = spark.createDataFrame([(-500,), (365243,), (-1200,), (None,)], "DAYS_EMPLOYED long")
    rows = cleaning.sentinel_to_flag(df, ["DAYS_EMPLOYED"]).collect()
    assert [r["DAYS_EMPLOYED_ANOM"] for r in rows] == [False, True, False, False]
    assert [r["DAYS_EMPLOYED"] for r in rows] == [-500, None, -1200, None]


def test_absent_column_is_ignored(spark):
    df = spark.createDataFrame([(1,), (2,)], "OTHER long")
    assert cleaning.sentinel_to_flag(df, ["DAYS_EMPLOYED"]).columns == ["OTHER"]


def test_flags_are_summed_and_dropped(spark):
    names = ["FLAG_DOCUMENT_2", "FLAG_DOCUMENT_4", "FLAG_DOCUMENT_5"]
    df = spark.createDataFrame([(1, 0, 1), (0, 0, 1), (None, None, None)], ", ".join(f"{n} int" for n in names))
    out = cleaning.sum_flags(df, names)
    assert out.columns == ["TOTAL_DOCUMENTS_PROVIDED"]
    assert [r[0] for r in out.collect()] == [2, 1, 0]


def test_cap_from_above(spark):
    df = spark.createDataFrame([(50000.0,), (999999999.0,), (None,)], "AMT_INCOME_TOTAL double")
    rows = cleaning.cap_column(df, "AMT_INCOME_TOTAL", upper=500000.0).collect()
    assert [r["AMT_INCOME_TOTAL"] for r in rows] == [50000.0, 500000.0, None]
    assert [r["AMT_INCOME_TOTAL_CAPPED_FLAG"] for r in rows] == [False, True, False]


def test_cap_on_both_sides(spark):
    df = spark.createDataFrame([(-0.5,), (0.3,), (50.0,)], "DEBT_TO_INCOME double")
    rows = cleaning.cap_column(df, "DEBT_TO_INCOME", upper=10.0, lower=0.0).collect()
    assert [r["DEBT_TO_INCOME"] for r in rows] == [0.0, 0.3, 10.0]
    assert [r["DEBT_TO_INCOME_CAPPED_FLAG"] for r in rows] == [True, False, True]


def test_missing_share_uses_the_fixed_list(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "k int, a double, b double")
    assert one(cleaning.missing_share(df, ["a", "b", "never", "ever"]))["pct_nan_row"] == 0.75


def test_nan_and_infinity_become_null(spark):
    df = spark.createDataFrame([(float("nan"), float("inf")), (1.0, float("-inf")), (None, 2.0)], "a double, b double")
    assert [tuple(r) for r in replace_infinities(nan_to_null(df)).collect()] == [(None, None), (1.0, None), (None, 2.0)]


def test_median_fill_and_fitted_caps(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (10.0,)], "x double")
    assert sorted(r["x"] for r in cleaning.fill_median(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 10.0]
    assert cleaning.fit_caps(df, {"x": 0.75})["x"] == pytest.approx(6.0)
