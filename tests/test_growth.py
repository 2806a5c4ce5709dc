"""What a query moves, computes and holds grows no faster than its input."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from test_features_and_plan import PARAMS, app, six_tables
from test_profile_and_drift import VALID

from riskloom.catalog import QUERIES
from riskloom.operators import aggregation, contract, packed
from riskloom.plans import credit
from riskloom.schemas import FeatureParams
from riskloom.sources import readers
from riskloom.streaming import jobs, outcomes


def test_rows_of_a_key_stand_together_and_aggregate_to_the_same(spark):
    rows = spark.range(0, 6000, numPartitions=6).selectExpr("IF(id % 601 = 600, NULL, id % 500) AS k", "CAST(id AS DOUBLE) AS x")
    dealt = packed.gathered(rows, "k")
    keys = dealt.rdd.mapPartitions(lambda part: [[r["k"] for r in part]]).collect()
    assert all(part == sorted(part) for part in keys) and len({k for part in keys for k in part}) == 500
    assert sum(len(set(part)) for part in keys) == 500 and sum(map(len, keys)) == rows.where("k IS NOT NULL").count()

    def aggregated(df):
        wide = df.select("k", *[(F.col("x") * (i + 1)).alias(f"x{i}") for i in range(30)])
        return sorted(map(tuple, aggregation.aggregate_table(wide, "k", "W").collect()))

    assert aggregated(dealt) == aggregated(rows)


def test_wide_aggregate_deals_two_columns_before_thirty_are_derived(spark, data_dir):
    plan = QUERIES["wide_aggregate"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    first, second = (m.start() for m in re.finditer("MapInArrow", plan))
    assert "REBALANCE_PARTITIONS_BY_COL" in plan[second:] and "REBALANCE" not in plan[:second] and first < second


def test_a_micro_batch_of_one_file_is_checked_once_by_many_tasks(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.txt").write_text("\n".join([VALID % ("500000", ""), VALID % ("-1", ""), "{oops"] * 100) + "\n")
    seen = []

    def enrich(batch):
        known = batch.select("status").distinct().count()
        seen.append((batch, known, batch.rdd.getNumPartitions(), batch.storageLevel.useMemory))
        return batch.withColumn("history_found", F.lit(True))

    sink = outcomes.outcome_sink(str(tmp_path / "log"), lambda rows: [0.5] * len(rows), ["AMT_CREDIT"], 0.24, "v4", "production", enrich)
    jobs.drain(jobs.validated(readers.stream_json(spark, str(inbox))), sink, str(tmp_path / "progress"))
    ((batch, known, tasks, stored),) = seen
    assert known == 2 and tasks >= spark.sparkContext.defaultParallelism and stored
    assert not batch.storageLevel.useMemory
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {(r["status"], r["count"]) for r in log.groupBy("status").count().collect()} == {("succes", 100), ("validation", 200)}


def test_each_stored_table_is_joined_once_and_tells_who_is_known(spark):
    tables = six_tables(spark)
    params = FeatureParams(**{**PARAMS.__dict__, "categories": credit.fit_history_categories(tables)})
    history = {n: t.localCheckpoint() for n, t in credit.build_aggregations(tables, params).items()}
    wanted = contract.contract_of(credit.build_features(app(spark), tables, params), ["SK_ID_CURR", "TARGET"])
    inputs = contract.contract_of(app(spark), ["TARGET"])
    known = app(spark).where("SK_ID_CURR = 1").drop("TARGET")
    calls = known
    for other in ("9999", "NULL"):
        calls = calls.unionByName(known.withColumn("SK_ID_CURR", F.expr(f"CAST({other} AS BIGINT)")))
    extra = {**history, "notes": spark.createDataFrame([(9999, "n")], "SK_ID_CURR long, note string")}
    for stored, unknown in ((history, False), (extra, True)):
        ready = credit.features_for(calls.unionByName(known), stored, params, inputs, wanted)
        found = sorted(((r["SK_ID_CURR"], r["history_found"]) for r in ready.collect()), key=str)
        assert found == [(1, True), (1, True), (9999, unknown), (None, None)]
    # Heavy clients and the others, each with one left join a table; the others' check of the keys takes no join.
    plan = credit.features_for(calls, history, params, inputs, wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 * len(history) and plan.count("Join Inner") == len(history)
