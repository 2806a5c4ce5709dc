from __future__ import annotations

import pytest
from conftest import by_key, one
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import decision, years_to_days
from riskloom.operators import contract, features, joins
from riskloom.plans import credit
from riskloom.schemas import DOCUMENT_FLAGS, FeatureParams, load_contract, load_params
from riskloom.sources import readers, writers


def test_debt_ratio_without_income(spark):
    df = spark.createDataFrame(
        [(1, 10.0, 0.0), (2, -10.0, 0.0), (3, 0.0, 0.0), (4, 10.0, 5.0), (5, 100.0, 2.0), (6, None, 2.0), (7, -1.0, 2.0)],
        "k int, AMT_CREDIT_SUM_DEBT_sum double, AMT_INCOME_TOTAL double",
    )
    rows = by_key(features.debt_to_income(df, 35.0), "k")
    assert [rows[k]["DEBT_TO_INCOME"] for k in range(1, 8)] == [35.0, 0.0, None, 2.0, 35.0, None, 0.0]
    assert [rows[k]["DEBT_TO_INCOME_CAPPED_FLAG"] for k in range(1, 8)] == [True, True, False, False, True, False, True]
    assert "DEBT_TO_INCOME_CAPPED_FLAG" not in features.debt_to_income(df).columns


def test_ratios_with_zero_denominators(spark):
    df = spark.createDataFrame(
        [(100000.0, 0.0, 50000.0, 90000.0, -10950, None, 0.0)],
        "AMT_CREDIT double, AMT_ANNUITY double, AMT_INCOME_TOTAL double, AMT_GOODS_PRICE double, DAYS_BIRTH long, DAYS_EMPLOYED long, CNT_FAM_MEMBERS double",
    )
    row = one(features.application_ratios(df))
    assert row["CREDIT_TERM"] is None and row["INCOME_PER_PERSON"] is None and row["AGE_AT_LOAN_END"] is None
    assert row["PAYMENT_RATE"] == 0.0 and row["EMPLOYED_BIRTH_RATIO"] is None


def test_scores(spark):
    df = spark.createDataFrame([(0.2, None, 0.7), (None, None, None)], "EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double")
    got = [tuple(r)[3:] for r in features.score_summary(df).collect()]
    assert got == [(0.2, 0.7, 2), (None, None, 0)]


def test_years_and_decisions(spark):
    df = spark.createDataFrame([(44, 0.24), (6, 0.25)], "y int, p double")
    rows = df.select(
        years_to_days(F.col("y")).alias("d"), decision(F.col("p"), 0.24).alias("s"), decision(F.col("p"), 0.24, True).alias("i")
    ).collect()
    assert [tuple(r) for r in rows] == [(-16071, "accordé", "refusé"), (-2191, "refusé", "refusé")]


def test_alignment(spark):
    df = spark.createDataFrame([(1, "x", 5)], "K int, name string, extra int")
    wanted = T.StructType([T.StructField("missing one/two", T.DoubleType()), T.StructField("NAME", T.StringType())])
    out = contract.align(df, wanted, "K")
    assert out.columns == ["K", "missing one/two", "NAME"] and tuple(out.first()) == (1, None, "x")


def test_json_expansion(spark):
    wanted = T.StructType(
        [T.StructField("SK_ID_CURR", T.LongType()), T.StructField("AMT_CREDIT", T.DoubleType()), T.StructField("CODE_GENDER", T.StringType())]
    )
    bodies = ['{"SK_ID_CURR": 1, "AMT_CREDIT": 500000, "UNKNOWN": 42}', '{"SK_ID_CURR": 2, "AMT_CREDIT": "bad"}', "nonsense"]
    df = spark.createDataFrame([(b,) for b in bodies], "features string")
    assert [tuple(r) for r in contract.expand_json(df, "features", wanted).collect()] == [
        (1, 500000.0, None),
        (2, None, None),
        (None, None, None),
    ]
    empty = contract.expand_json(df.limit(0), "features", wanted)
    assert empty.columns == wanted.names and empty.count() == 0


def test_names():
    assert contract.safe_names(["num__A b/c", "x"]) == ["num__A_b_c", "x"]
    with pytest.raises(ValueError):
        contract.safe_names(["a b", "a/b"])
    columns = ["FLOORS_AVG", "FLOORS_MODE", "FLOORS_MEDI", "TOTALAREA_MODE"]
    assert contract.variant_drops(columns, ["_MODE", "_MEDI"], ["TOTALAREA"]) == ["FLOORS_MODE", "FLOORS_MEDI"]
    assert len(DOCUMENT_FLAGS) == 17


def test_join_must_not_multiply_rows(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(PySparkException, match="multiply"):
        joins.left_join_one(left, right, "k", check=True).collect()
    assert joins.left_join_one(left, right.limit(1), "k", check=True).count() == 2


def test_history_lookup_knows_absent_clients(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    a = spark.createDataFrame([(1, None)], "k long, x double")
    b = spark.createDataFrame([(2, 5.0)], "k long, y double")
    rows = by_key(joins.lookup_history(left, {"a": a, "b": b}, "k"), "k")
    assert [rows[k]["history_found"] for k in (1, 2, 3)] == [True, True, False]


def six_tables(spark):
    return {
        "bureau": spark.createDataFrame(
            [(1, 100, 5000.0, 1000.0, "Active", "currency 1", "Car loan")],
            "SK_ID_CURR long, SK_ID_BUREAU long, AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, CREDIT_ACTIVE string, CREDIT_CURRENCY string, CREDIT_TYPE string",
        ),
        "bureau_balance": spark.createDataFrame([(100, -1, "C")], "SK_ID_BUREAU long, MONTHS_BALANCE long, STATUS string"),
        "previous_application": spark.createDataFrame(
            [(1, 10, 1000.0, "Approved", -500), (1, 11, 2000.0, "Refused", 365243)],
            "SK_ID_CURR long, SK_ID_PREV long, AMT_APPLICATION double, NAME_CONTRACT_STATUS string, DAYS_FIRST_DUE long",
        ),
        "credit_card_balance": spark.createDataFrame([(1, 10, 250.0)], "SK_ID_CURR long, SK_ID_PREV long, AMT_BALANCE double"),
        "installments_payments": spark.createDataFrame(
            [(1, 10, 100.0, 100.0, -30, -35), (1, 10, 100.0, 80.0, -60, -55)],
            "SK_ID_CURR long, SK_ID_PREV long, AMT_INSTALMENT double, AMT_PAYMENT double, DAYS_INSTALMENT long, DAYS_ENTRY_PAYMENT long",
        ),
        "pos_cash_balance": spark.createDataFrame([(1, 10, 12.0)], "SK_ID_CURR long, SK_ID_PREV long, CNT_INSTALMENT double"),
    }


PARAMS = FeatureParams(
    amt_income_total_cap=630000.0,
    debt_to_income_cap=35.0,
    flag_document_quasi_constant=("FLAG_DOCUMENT_2",),
    cols_to_drop_pure=("FLAG_MOBIL",),
    drop_list_restricted=("AMT_CREDIT", "POS_CNT_INSTALMENT_max"),
    previous_days_cols=("DAYS_FIRST_DUE", "NOT_THERE"),
)


def app(spark):
    schema = (
        "SK_ID_CURR long, TARGET int, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, AMT_GOODS_PRICE double, "
        "DAYS_BIRTH long, DAYS_EMPLOYED long, CNT_FAM_MEMBERS double, FLAG_DOCUMENT_2 int, FLAG_MOBIL int, "
        "EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double"
    )
    return spark.createDataFrame(
        [
            (1, 0, 1000000.0, 500.0, 50.0, 400.0, -16000, 365243, 2.0, 1, 1, 0.5, None, None),
            (2, 1, 100.0, 500.0, 0.0, 0.0, -9000, -100, 0.0, 0, 1, None, None, None),
        ],
        schema,
    )


def test_aggregates_of_the_six_tables(spark):
    aggs = credit.build_aggregations(six_tables(spark), PARAMS)
    assert set(aggs) == {*credit.JOIN_ORDER, credit.PAYMENT}
    previous = one(aggs["previous_agg"])
    assert (previous["PREV_DAYS_FIRST_DUE_mean"], previous["PREV_DAYS_FIRST_DUE_ANOM_sum"]) == (-500, 1)
    assert one(aggs[credit.PAYMENT])["LATE_PAYMENT_RATE"] == 0.5


def test_whole_path(spark):
    out = credit.build_features(app(spark), six_tables(spark), PARAMS)
    rows = by_key(out, "SK_ID_CURR")
    assert len(rows) == 2 and "POS_CNT_INSTALMENT_max" not in out.columns and "FLAG_MOBIL" not in out.columns
    first, second = rows[1], rows[2]
    # 12 columns next to key and label, two flags: 14; three missing, the sentinel included.
    assert first["pct_nan_row"] == pytest.approx(3 / 14)
    assert first["AMT_INCOME_TOTAL"] == 630000.0 and first["AMT_INCOME_TOTAL_CAPPED_FLAG"] is True
    assert first["AMT_CREDIT"] == 500.0 and first["CREDIT_TERM"] == 10.0
    assert first["PREV_APPLICATION_COUNT"] == 2 and first["LATE_PAYMENT_COUNT"] == 1
    assert second["BUREAU_CREDIT_COUNT"] is None and second["CREDIT_GOODS_RATIO"] is None
    assert second["EXT_SOURCE_combined_count_available"] == 0


def test_one_client_at_a_time_equals_the_batch(spark):
    tables = six_tables(spark)
    params = FeatureParams(**{**PARAMS.__dict__, "categories": credit.fit_history_categories(tables)})
    whole = credit.build_features(app(spark), tables, params)
    wanted = contract.contract_of(whole, ["SK_ID_CURR"])
    history = credit.build_aggregations(tables, params)
    inputs = contract.contract_of(app(spark), ["TARGET"])
    for client in (1, 2):
        single = credit.features_for(app(spark).where(F.col("SK_ID_CURR") == client), history, params, inputs, wanted)
        row = one(single)
        assert row.pop("history_found") is (client == 1)
        expected = by_key(whole, "SK_ID_CURR")[client]
        expected["TARGET"] = row["TARGET"]
        assert row == expected


def test_restricting_the_history(spark):
    tables = six_tables(spark)
    kept = credit.restrict_history(tables, spark.createDataFrame([(2,)], "SK_ID_CURR long"))
    assert set(kept) == set(tables) and all(df.count() == 0 for df in kept.values())


def test_parameters_and_contracts_survive_a_round_trip(spark, tmp_path):
    writers.write_text(spark.range(1), PARAMS.to_json(), str(tmp_path / "params"))
    assert load_params(spark, str(tmp_path / "params")) == PARAMS
    (tmp_path / "columns.json").write_text('["SK_ID_CURR", "CODE_GENDER", "AMT_CREDIT", "FLAG_MOBIL"]')
    loaded = load_contract(spark, str(tmp_path / "columns.json"))
    assert [f.dataType.simpleString() for f in loaded] == ["bigint", "string", "double", "int"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SK_ID_CURR,CODE,AMT\n1,XNA,\n2,,NaN\n")
    schema = T.StructType([T.StructField("SK_ID_CURR", T.LongType()), T.StructField("CODE", T.StringType()), T.StructField("AMT", T.DoubleType())])
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), schema, ["SK_ID_CURR", "CODE", "AMT"]).collect()
    assert [tuple(r) for r in rows] == [(1, "XNA", None), (2, None, None)]
    writers.save_bucketed(spark.range(20).withColumnRenamed("id", "SK_ID_CURR"), "bucketed_history", "SK_ID_CURR", 4)
    joined = spark.table("bucketed_history").hint("merge").join(spark.table("bucketed_history"), "SK_ID_CURR")
    assert joined.count() == 20
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().simpleString().split("Aggregate")[0]
    writers.write_contract(spark.range(1).selectExpr("id", "CAST(1 AS DOUBLE) AS x"), str(tmp_path / "contract"))
    assert spark.read.json(str(tmp_path / "contract")).orderBy("position").first()["name"] == "id"
    spark.sql("drop table bucketed_history")


def test_log_rows_and_migration(spark):
    df = spark.createDataFrame([("v4", 0.24, "{}", 200)], "model_version string, threshold double, features string, latency_ms int")
    row = one(writers.log_rows(df))
    assert (row["status"], row["origine"], row["probability"]) == ("succes", "local", None) and row["created_at"] is not None
    with pytest.raises(PySparkException, match="must not be missing"):
        writers.log_rows(df.drop("features")).collect()
    old = df.select("latency_ms")
    assert one(writers.reclassify_origin(writers.migrate_log(old)))["origine"] == "production"
