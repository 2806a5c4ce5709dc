"""Contingency from blocked cubes, drift against a frozen reference, streams of several batches, profiles from counts."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from conftest import by_key, one
from pyspark.sql import functions as F

from riskloom.operators import association, counted, drift, profiling
from riskloom.sources import readers
from riskloom.streaming import jobs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- contingency -----------------------------------------------------------------------------


def categories(spark, n=900):
    cells = [f"CASE WHEN hash(id, {i}) % 7 <> 0 THEN CAST(pmod(hash(id, {i}), {i + 2}) AS STRING) END AS c{i}" for i in range(6)]
    return spark.range(0, n, 1, 4).selectExpr(*cells, "CAST(id AS STRING) AS wide", "CAST(id % 2 AS INT) AS label")


@pytest.mark.parametrize("cube", [1, 50, 100_000])
def test_cells_of_all_pairs(spark, cube):
    df = categories(spark)
    pairs = [*combinations([f"c{i}" for i in range(6)], 2), ("c0", "wide"), ("label", "c3")]
    got = {(r["var_1"], r["var_2"], r["x"], r["y"]): r["n"] for r in association.contingency(df, pairs, cube).collect()}
    pdf = df.toPandas()
    want = {}
    for a, b in pairs:
        for (x, y), n in pdf.dropna(subset=[a, b]).groupby([a, b]).size().items():
            want[(a, b, str(x), str(y))] = n
    assert got == want


def test_rows_are_not_exploded_once_per_pair(spark):
    df = categories(spark)
    columns = [f"c{i}" for i in range(6)]
    pairs = list(combinations(columns, 2))
    assert len(association._cubes(df, pairs, 100_000)) == 1 and 1 < len(association._cubes(df, pairs, 1000)) < len(pairs)
    assert sorted(sum(association.column_blocks(df, columns, 1000), [])) == columns
    # Whole rows are counted first; pairs are read off the distinct tuples.
    text = plan(association.contingency(df, pairs))
    assert text.count("Generate") == 1 and text.index("Generate") < text.rindex("HashAggregate")


def test_information_with_medians_and_few_values(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"few": rng.integers(0, 5, 800).astype(float), "many": rng.normal(size=800), "label": rng.integers(0, 2, 800)})
    pdf["many"] += pdf.label
    pdf.loc[::7, "few"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("few", F.nanvl("few", F.lit(None)))
    assert association.distinct_up_to(df, ["few", "many"], 20)["few"] == 5 and association.distinct_up_to(df, ["few", "many"], 20)["many"] > 20
    got = by_key(association.label_information(df, ["few", "many"], "label"), "column")
    filled = pdf.few.fillna(pdf.few.median())
    joint = pd.crosstab(filled, pdf.label) / len(pdf)
    want = (joint * np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))).to_numpy().sum()
    assert got["few"]["mutual_information"] == pytest.approx(want) and got["many"]["mutual_information"] > 0.05


# --- frozen reference ------------------------------------------------------------------------


def samples(spark):
    ref = spark.range(400).selectExpr("id AS SK_ID_CURR", "CASE WHEN id % 9 <> 0 THEN CAST(id % 37 AS DOUBLE) END AS x", "CAST(id % 5 AS STRING) AS c")
    cur = spark.range(300).selectExpr("id AS SK_ID_CURR", "CAST(id % 23 + 90 AS STRING) AS x", "CAST(id % 7 AS STRING) AS c", "id % 3 AS day")
    return ref, cur


def test_frozen_drift_equals_drift_of_both_samples(spark, tmp_path):
    ref, cur = samples(spark)
    frozen = drift.freeze_reference(ref, str(tmp_path / "ref"))
    again = drift.load_reference(spark, str(tmp_path / "ref"))
    assert again == frozen and len(frozen.edges["x"]) > 50
    # A sample far outside the reference still falls into several slices.
    assert drift.counted_values(cur, frozen).where("column = 'x'").select("slice").distinct().count() > 1
    want = by_key(drift.drift_detail(ref, cur), "column")
    got = by_key(drift.drift_of_counts(again, drift.counted_values(cur, again)), "column")
    assert got == want and got["x"]["drifted"]
    for r in drift.drift_of_counts(again, drift.counted_values(cur, again, ["day"]), ["day"]).collect():
        day = by_key(drift.drift_detail(ref, cur.where(F.col("day") == r["day"]).drop("day")), "column")
        assert r["score"] == day[r["column"]]["score"]


def test_references_add_up(spark, tmp_path):
    ref, cur = samples(spark)
    parts = [drift.freeze_reference(ref.where(f"SK_ID_CURR % 3 {op} 0"), str(tmp_path / n)) for op, n in (("=", "a"), ("<>", "b"))]
    both = drift.merge_references(spark, *parts, str(tmp_path / "both"))
    whole = drift.freeze_reference(ref, str(tmp_path / "whole"))
    assert by_key(drift.drift_of_counts(both, drift.counted_values(cur, both)), "column") == by_key(drift.drift_of_counts(whole, drift.counted_values(cur, whole)), "column")
    moments = [by_key(r.columns(spark).drop("edges"), "column")["x"] for r in (both, whole)]
    assert moments[0]["n"] == moments[1]["n"] and moments[0]["m2"] == pytest.approx(moments[1]["m2"])


def test_the_reference_is_read_once(spark, tmp_path):
    ref, cur = samples(spark)
    ref.write.parquet(str(tmp_path / "rows"))
    frozen = drift.freeze_reference(spark.read.parquet(str(tmp_path / "rows")), str(tmp_path / "ref"))
    assert str(tmp_path / "rows") not in plan(drift.drift_of_counts(frozen, drift.counted_values(cur, frozen)))


# --- streams ---------------------------------------------------------------------------------

CALLS = "id long, ts timestamp, status string, decision string"


def deliver(spark, folder, rows, number):
    df = spark.createDataFrame(rows, "id long, at string").selectExpr("id", "CAST(at AS TIMESTAMP) AS ts", "'succes' AS status", "'refusé' AS decision")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/calls.parquet")
    return df.schema


def test_copies_in_later_batches_and_evicted_state(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / d) for d in ("inbox", "out", "progress"))
    first = [(i, f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    schema = deliver(spark, inbox, first, 0)
    deliver(spark, inbox, [(28, "2024-01-01 00:28:00"), *((100 + i, f"2024-01-01 00:{30 + i}:00") for i in range(20))], 1)
    stream = readers.stream_parquet(spark, inbox, "calls", schema, 1)
    kept = jobs.deduplicated(stream, "ts", "10 minutes", ["id"])
    seen = jobs.drain(kept, jobs.batch_sink(out), progress)
    assert len([p for p in seen if p["numInputRows"]]) == 2
    assert sorted(r["id"] for r in spark.read.parquet(out).select("id").collect()) == [*range(30), *range(100, 120)]
    # A restart goes on: an hour later all old state leaves, and a very old copy is refused as late.
    deliver(spark, inbox, [(200, "2024-01-01 02:00:00")], 2)
    deliver(spark, inbox, [(3, "2024-01-01 00:03:00"), (201, "2024-01-01 02:01:00"), (200, "2024-01-01 02:00:00")], 3)
    seen = jobs.drain(kept, jobs.batch_sink(out), progress)
    held, late = jobs.state_rows(seen)
    assert held == 2 and late >= 1
    ids = [r["id"] for r in spark.read.parquet(out).select("id").collect()]
    assert len(ids) == len(set(ids)) and {200, 201} <= set(ids)
    assert jobs.drain(kept, jobs.batch_sink(out), progress) == [] or spark.read.parquet(out).count() == len(ids)


def test_late_calls_do_not_change_closed_windows(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / d) for d in ("inbox", "out", "progress"))
    schema = deliver(spark, inbox, [(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00")], 0)
    deliver(spark, inbox, [(3, "2024-01-01 03:00:00")], 1)
    deliver(spark, inbox, [(5, "2024-01-01 03:30:00")], 2)
    deliver(spark, inbox, [(4, "2024-01-01 00:30:00")], 3)
    stream = readers.stream_parquet(spark, inbox, "calls", schema, 1)
    live = jobs.live_kpis(stream, "ts", "1 hour", "10 minutes", F.col("status"), F.col("decision") == "refusé")
    seen = jobs.drain(live, jobs.batch_sink(out), progress, "update")
    rows = by_key(jobs.latest(jobs.read_batches(spark, out, live.schema), ["bucket"]), "bucket")
    assert sorted(r["calls"] for r in rows.values()) == [2, 2]
    assert jobs.state_rows(seen)[0] == 1 and jobs.state_rows(seen)[1] >= 1


def test_values_per_window_leave_the_state(spark, tmp_path):
    ref, _ = samples(spark)
    frozen = drift.freeze_reference(ref, str(tmp_path / "ref"))
    for k in range(3):
        cur = spark.range(60).selectExpr(f"timestamp_seconds(1704067200 + {k} * 86400 + id * 60) AS ts", f"CAST(id % 5 + {k} * 10 AS DOUBLE) AS x", "CAST(id % 5 AS STRING) AS c")
        cur.coalesce(1).write.mode("append").parquet(str(tmp_path / "calls.parquet"))
    stream = readers.stream_parquet(spark, str(tmp_path), "calls", cur.schema, 1)
    live = jobs.live_values(stream, "ts", "1 day", "10 minutes", frozen)
    seen = jobs.drain(live, jobs.batch_sink(str(tmp_path / "out")), str(tmp_path / "p"), "update")
    assert jobs.state_rows(seen)[0] == 10  # the values of the last day alone
    counts = jobs.latest(jobs.read_batches(spark, str(tmp_path / "out"), live.schema), ["bucket", "column", "slice", "value", "label"])
    got = drift.drift_of_counts(frozen, counts, ["bucket"])
    rows = spark.read.parquet(str(tmp_path / "calls.parquet"))
    for r in got.collect():
        day = rows.where(F.date_trunc("day", "ts") == F.lit(r["bucket"])).select("x", "c")
        assert r["score"] == by_key(drift.drift_detail(ref, day), "column")[r["column"]]["score"]
    assert got.count() == 6


# --- profiles from counts --------------------------------------------------------------------


def odd_table(spark):
    return spark.range(0, 500, 1, 4).selectExpr(
        "id AS DAYS_key",
        "CASE WHEN id % 4 <> 0 THEN id * id * 0.5D END AS DAYS_sq",
        "CAST(CASE WHEN id < 496 THEN 3 ELSE id END AS INT) AS almost",
        "CAST(id % 3 AS STRING) AS word",
        "CAST(NULL AS DOUBLE) AS empty",
        "CAST(9007199254740992 + id % 3 AS BIGINT) AS big",
        "CASE WHEN id % 2 = 0 THEN -0.0D ELSE 0.0D END AS zero",
        "date_add(DATE '2024-01-01', CAST(id % 4 AS INT)) AS day",
        "CAST(id % 5 AS DECIMAL(10, 2)) AS money",
        "id % 2 = 0 AS flag",
    )


def test_counts_give_the_profile(spark):
    df = odd_table(spark)
    parts = profiling.profile_table(df, ["DAYS_key", "word"])
    assert by_key(parts["missing"], "column") == by_key(profiling.missing_table(df), "column")
    assert by_key(parts["dominant"], "column") == by_key(profiling.dominant_value(df), "column")
    assert by_key(parts["quasi_constant"], "column") == by_key(profiling.quasi_constant(df), "column")
    assert by_key(parts["keys"], "key") == by_key(profiling.key_profile(df, ["DAYS_key", "word"]), "key")
    assert by_key(parts["categories"], "column") == by_key(profiling.category_profile(df), "column")
    assert by_key(parts["day_ranges"], "column") == by_key(profiling.value_ranges(df, ["DAYS_key", "DAYS_sq"]), "column")
    assert one(parts["duplicates"]) == {"n_rows": 500, "n_duplicates": 0}


def test_counts_give_the_anomalies(spark):
    df = odd_table(spark)
    found = profiling.scan_anomalies(df, iqr_multiplier=0.5, modified_z_threshold=1.0)
    bounds = profiling.fit_outlier_bounds(df, iqr_multiplier=0.5)
    assert found["outliers"].collect() == profiling.outlier_report(df, bounds, 1.0).collect() != []
    assert {b.column for b in bounds} >= {"DAYS_sq", "DAYS_key"} and not {b.column for b in bounds} & {"almost", "zero", "empty"}
    sq = next(b for b in bounds if b.column == "DAYS_sq")
    values = np.array([i * i * 0.5 for i in range(500) if i % 4])
    q1, med, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    assert (sq.lower, sq.upper, sq.median) == pytest.approx((q1 - 0.5 * (q3 - q1), q3 + 0.5 * (q3 - q1), med))
    assert sq.mad == pytest.approx(np.median(np.abs(values - med)))
    assert [r["column"] for r in found["high_missing"].collect()] == ["empty"]
    assert profiling.scan_anomalies(df.limit(0))["outliers"].collect() == []


def test_a_profile_reads_the_table_three_times(spark, tmp_path, monkeypatch):
    odd_table(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    scans = []
    count = counted.count_columns
    monkeypatch.setattr(counted, "count_columns", lambda *a, **k: scans.append(2) or count(*a, **k))
    parts = profiling.profile_table(df, ["word"])
    scans += [len(re.findall(r"InMemoryFileIndex\(\d+ paths\)\[file:" + re.escape(str(tmp_path / "t")), plan(p))) for p in parts.values()]
    assert sum(scans) == 3
