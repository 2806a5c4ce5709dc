"""One log for every outcome, lookups of heavy keys, wide aggregates and correlations in one pass."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_profile_and_drift import VALID

from riskloom.operators import aggregation, association, joins, packed, products
from riskloom.sources import readers
from riskloom.streaming import jobs, outcomes


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- one log ---------------------------------------------------------------------------------


def test_faults_stay_with_their_rows():
    calls = []

    def predict(rows):
        calls.append(len(rows))
        if (rows.x == 13).any():
            raise KeyError("x")
        if (rows.x > 90).any():
            raise ZeroDivisionError
        return (rows.x / 100).where(rows.x != 50, None)

    values, errors = outcomes.isolated(predict, pd.DataFrame({"x": range(100)}))
    assert [i for i, e in enumerate(errors) if e] == [13, 50, *range(91, 100)]
    assert errors[13] == "KeyError" and errors[50] == "ValidationError" and errors[95] == "ZeroDivisionError"
    assert values[12] == 0.12 and values[13] is None and len(calls) < 60
    assert outcomes.isolated(predict, pd.DataFrame({"x": []})) == ([], [])
    assert outcomes.isolated(lambda rows: [0.5], pd.DataFrame({"x": [1, 2]}))[0] == [0.5, 0.5]


def test_every_outcome_reaches_the_log(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    extra = ', "extra_fields": {"OWN_CAR_AGE": 3, "AMT_ANNUITY": "x"}'
    batches = [
        [VALID % ("500000", ""), VALID % ("-1", ""), "{oops"],
        [VALID % ("666", ""), VALID % ("400000", extra), VALID.replace("100002", "0") % ("1", "")],
    ]
    for i, bodies in enumerate(batches):
        (inbox / f"{i}.txt").write_text("\n".join(bodies) + "\n")
        os.utime(inbox / f"{i}.txt", (1_000_000 + i, 1_000_000 + i))  # the order of the batches

    def predict(rows):
        if (rows.AMT_CREDIT == 666).any():
            raise ValueError("down")
        return rows.AMT_CREDIT / 1_000_000

    log, progress = str(tmp_path / "log"), str(tmp_path / "progress")
    sink = outcomes.outcome_sink(log, predict, ["AMT_CREDIT"], 0.45, "v4", "production", lambda b: b.withColumn("history_found", F.lit(True)))
    seen = []

    def kept(batch, number):
        seen.append(number)
        sink(batch, number)

    def run():
        jobs.drain(jobs.validated(readers.stream_json(spark, str(inbox), 1)), kept, progress)

    run()
    run()  # nothing new
    assert seen == [0, 1]
    rows = spark.read.parquet(log).collect()
    assert sorted((r["status"], r["error_type"] or "", r["sk_id_curr"], r["decision"]) for r in rows if r["sk_id_curr"] is not None) == [
        ("erreur", "ValueError", 100002, None),
        ("succes", "", 100002, "accordé"),
        ("succes", "", 100002, "refusé"),
        ("validation", "greater_than:AMT_CREDIT", 100002, None),
        ("validation", "greater_than:SK_ID_CURR", 0, None),
    ]
    broken = next(r for r in rows if r["sk_id_curr"] is None)
    assert (broken["status"], broken["error_type"], broken["features"]) == ("validation", "json_invalid", "{}")
    assert all((r["history_found"] is True) == (r["status"] == "succes") and (r["latency_ms"] is None) == (r["status"] == "validation") for r in rows)
    merged = next(json.loads(r["features"]) for r in rows if "OWN_CAR_AGE" in r["features"])
    assert merged["OWN_CAR_AGE"] == 3 and merged["AMT_ANNUITY"] == "x" and merged["AMT_CREDIT"] == 400000
    # The same batch again replaces its rows.
    before = sorted(r["id"] for r in rows)
    again = jobs.validated(spark.read.text(str(inbox / "1.txt")).withColumnRenamed("value", "body"))
    sink(again, 1)
    assert sorted(r["id"] for r in spark.read.parquet(log).collect()) == before


# --- heavy keys ------------------------------------------------------------------------------


def requests(spark, n=30_000, parts=8):
    return spark.range(0, n, 1, parts).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 1000 = 1 THEN NULL ELSE id % 5000 END AS k", "id AS v")


def test_a_heavy_client_is_joined_where_its_rows_lie(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = requests(spark)
        assert joins.heavy_keys(df, "k", 100) == [7]
        history = {"a": spark.range(4000).selectExpr("id AS k", "id * 2 AS a"), "b": spark.range(10, 6000).selectExpr("id AS k", "id * 3 AS b")}
        out = joins.lookup_history(df, history, "k", heavy=joins.heavy_keys(df, "k", 100))
        text = plan(out)
        assert "BroadcastHashJoin" in text and "SortMergeJoin" in text
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
        plain = joins.lookup_history(df, history, "k", heavy=())
        assert out.columns == plain.columns and sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
        assert out.count() == 30_000 and out.where("k = 7").select("history_found", "a", "b").distinct().collect() == [(True, 14, None)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_heavy_keys_of_odd_tables(spark):
    assert joins.heavy_keys(spark.createDataFrame([], "k long"), "k") == []
    assert joins.heavy_keys(spark.createDataFrame([(None,)], "k long"), "k") == []
    assert sorted(joins.heavy_keys(spark.createDataFrame([("a",), ("b",)], "k string"), "k")) == ["a", "b"]
    twice = spark.createDataFrame([(7, 1), (7, 2)], "k long, w long")
    with pytest.raises(PySparkException, match="multiply"):
        joins.lookup_history(requests(spark, 300), {"t": twice}, "k").collect()


def test_each_micro_batch_finds_its_own_heavy_clients(spark, tmp_path):
    for i in range(2):
        requests(spark, 900 * (i + 1), 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls.parquet"))
    stream = readers.stream_parquet(spark, str(tmp_path), "calls", requests(spark).schema, 1)
    history = {"a": spark.range(100).selectExpr("id AS k", "id * 2 AS a")}
    out = str(tmp_path / "out")
    jobs.drain(stream, jobs.enrich_sink(out, history, "k", ["k", "v", "a", "history_found"]), str(tmp_path / "p"))
    rows = spark.read.parquet(out)
    assert rows.select("batch").distinct().count() == 2 and rows.count() == 2700
    assert rows.where("k = 7").select("a").distinct().collect() == [(14,)]
    frozen = jobs.enriched(stream, history, "k", heavy=[7])
    jobs.drain(frozen, jobs.batch_sink(str(tmp_path / "f")), str(tmp_path / "q"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "f")).drop("batch").collect()), key=str) == sorted(map(tuple, rows.drop("batch").select(*frozen.columns).collect()), key=str)


# --- wide aggregates -------------------------------------------------------------------------


def wide(spark, columns=455, rows=400):
    kinds = ["double", "bigint", "int", "float"]
    cells = [f"CASE WHEN (id * {i + 3}) % 11 <> 0 THEN CAST((id * {i * 7 + 1}) % 1009 - 500 AS {kinds[i % 4]}) END AS c{i}" for i in range(columns)]
    return spark.range(0, rows, 1, 4).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 50 = 1 THEN NULL ELSE id % 20 END AS k", "CAST(id % 4 AS STRING) AS s", *cells)


def test_455_columns_in_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "CELLS", 20_000)  # several partial rows per task and key
    wide(spark).write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w"))
    numeric = [c for c in df.columns if c.startswith("c")]
    got = aggregation.aggregate_by(df, "k", numeric, {"s": ["0", "1", "zz"]}, "T", "T_COUNT")
    text = plan(got)
    assert len(re.findall(r"FileScan parquet", text)) == 1 and len(re.findall(r"Exchange hashpartitioning", text)) == 1
    some = numeric[::60] + numeric[-1:]
    few = aggregation.aggregate_by(df, "k", some, {"s": ["0", "1", "zz"]}, "T", "T_COUNT")
    assert "MapInArrow" not in plan(few)
    assert [f.dataType for f in got.select(*few.columns).schema] == [f.dataType for f in few.schema]
    assert sorted(map(tuple, got.select(*few.columns).collect())) == sorted(map(tuple, few.collect()))


def test_packed_buffers_of_odd_values(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [("a", nan, None, 1), ("a", 1.0, None, None), ("b", nan, None, 2**62), ("b", nan, inf, -5), ("c", None, -inf, 3), ("", -0.0, 4.0, 4), (None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, x double, y double, n long").repartition(3)
    plainly = aggregation.aggregate_by(df, "k", ["x", "y", "n"], {}, "", "rows")
    monkeypatch.setattr(aggregation, "MAX_BUFFERS", 2)
    monkeypatch.setattr(packed, "CELLS", 2)
    got = aggregation.aggregate_by(df, "k", ["x", "y", "n"], {}, "", "rows")
    assert got.dtypes == plainly.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, plainly.collect()))
    assert aggregation.aggregate_by(df.limit(0), "k", ["x", "y", "n"], {}, "", "rows").collect() == []


def test_decimals_keep_exact_sums(spark, monkeypatch):
    monkeypatch.setattr(aggregation, "MAX_BUFFERS", 2)
    df = spark.createDataFrame([(1,), (1,)], "k long").selectExpr("k", "CAST(0.1 AS DECIMAL(20, 10)) AS d", "1 AS n")
    row = aggregation.aggregate_by(df, "k", ["d", "n"]).first()
    assert str(row["d_sum"]) == "0.2000000000" and row["n_sum"] == 2


# --- correlations ----------------------------------------------------------------------------


def numbers(n=600, k=9):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(n, k)).round(1)
    base[:, 1] = base[:, 0] + base[:, 1] * 0.2
    base[rng.random((n, k)) < 0.1] = np.nan
    base[: n // 3, 2] = 5.0
    base[:, 3] = 1.0
    return pd.DataFrame(base, columns=[f"x{i}" for i in range(k)])


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.selectExpr(*[f"nanvl({c}, NULL) AS {c}" for c in df.columns]).repartition(5)


def test_products_are_added_in_a_tree(spark):
    pdf = numbers()
    got = by_pairs(association.pearson_pairs(frame(spark, pdf), list(pdf.columns)))
    want = pdf.corr()
    for (a, b), r in got.items():
        assert (r is None and np.isnan(want.loc[a, b])) or r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert len(got) == 36
    text = plan(association.pearson_pairs(frame(spark, pdf), list(pdf.columns)))
    assert "Coalesce" not in text and len(re.findall(r"Exchange hashpartitioning\((task|i)#", text)) == 2
    ranked = association.label_correlation(frame(spark, numbers(k=12)), [f"x{i}" for i in range(11)], "x11").collect()
    corr = numbers(k=12).corr()["x11"]
    assert len(ranked) == 11 and all(r["corr"] is None or r["corr"] == pytest.approx(corr[r["column"]], abs=1e-9) for r in ranked)


def by_pairs(df):
    return {(r["var_1"], r["var_2"]): r["corr"] for r in df.collect()}


@pytest.mark.parametrize("splits", [1, 3, None])
def test_ranks_without_a_melt(spark, monkeypatch, splits):
    pdf = numbers()
    want = pdf.rank().corr()
    monkeypatch.setattr(products, "CELLS", 900)  # several chunks
    monkeypatch.setattr(products, "VALUES", 40)
    got = by_pairs(association.spearman_pairs(frame(spark, pdf), list(pdf.columns), splits))
    assert len(got) == 36
    for (a, b), r in got.items():
        assert (r is None and np.isnan(want.loc[a, b])) or r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_ranks_shuffle_packed_rows_only(spark):
    pdf = pd.concat([numbers(3000)] * 2)  # repeated rows need no key
    df = frame(spark, pdf).repartition(3)
    chunks = products._chunked(9)
    packed_rows = df.mapInArrow(chunks, "chunk bigint, column int, data binary")
    assert packed_rows.count() <= 3 * 9 * 3
    want = pdf.reset_index(drop=True).rank().corr()
    got = by_pairs(association.spearman_pairs(df, list(pdf.columns)))
    assert got[("x0", "x1")] == pytest.approx(want.loc["x0", "x1"], abs=1e-9)
    assert association.spearman_pairs(df.limit(0), ["x0", "x1"]).collect() == []
