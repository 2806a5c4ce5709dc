from __future__ import annotations

import json

from conftest import by_key
from pyspark.sql import functions as F
from test_features_and_plan import PARAMS, app, six_tables
from test_profile_and_drift import VALID

from riskloom.operators import contract, modeling, validation
from riskloom.plans import credit
from riskloom.schemas import FeatureParams, record_schema
from riskloom.sources import readers
from riskloom.streaming import jobs


def write_requests(folder, name, bodies):
    (folder / name).write_text("\n".join(bodies) + "\n")


def test_requests_are_split_once_even_after_a_restart(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    write_requests(inbox, "a.txt", [VALID % ("500000", ""), VALID % ("-1", "")])
    good, bad, progress = (str(tmp_path / d) for d in ("good", "bad", "progress"))

    def run():
        jobs.drain(jobs.validated(readers.stream_json(spark, str(inbox))), jobs.two_way_sink(good, bad), progress)

    run()
    run()  # nothing new
    assert spark.read.parquet(good).count() == 1
    write_requests(inbox, "b.txt", [VALID % ("7", ""), "{oops"])
    run()
    assert spark.read.parquet(good).count() == 2
    rejects = spark.read.parquet(bad)
    assert {r["error_type"] for r in rejects.collect()} == {"greater_than:AMT_CREDIT", "json_invalid"}
    assert {r["features"] for r in rejects.collect()} >= {"{}"}


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    sink = jobs.batch_sink(str(tmp_path / "out"))
    for _ in range(2):
        sink(spark.range(5), 0)
    sink(spark.range(3), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_request_to_log(spark, tmp_path):
    """Record, history, features, score, decision and log row in one job."""
    tables = six_tables(spark)
    params = FeatureParams(**{**PARAMS.__dict__, "categories": credit.fit_history_categories(tables)})
    history = credit.build_aggregations(tables, params)
    whole = credit.build_features(app(spark), tables, params)
    wanted = contract.contract_of(whole, ["SK_ID_CURR", "TARGET"])
    inputs = contract.contract_of(app(spark), ["TARGET"])
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    known = (VALID % ("500000", "")).replace("100002", "1")
    write_requests(inbox, "a.txt", [known, known, VALID % ("500000", "")])

    def score(batch):
        good, _ = validation.split_valid(batch)
        rows = validation.flatten_record(good, inputs)
        ready = credit.features_for(rows, history, params, inputs, wanted)
        scored = credit.score_batch(
            ready, lambda d: d.withColumn("probability", F.when(F.col("history_found"), 0.9).otherwise(0.1)), 0.24, "v4"
        )
        return scored.select(
            F.col("SK_ID_CURR").alias("sk_id_curr"),
            "probability",
            "decision",
            "history_found",
            F.to_json(F.struct("SK_ID_CURR")).alias("features"),
        )

    stream = jobs.validated(readers.stream_json(spark, str(inbox)))
    sink = jobs.scored_log_sink(str(tmp_path / "log"), score, "v4", 0.24, "production")
    jobs.drain(stream, sink, str(tmp_path / "progress"))
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((r["sk_id_curr"], r["decision"], r["history_found"]) for r in log) == [
        (1, "refusé", True),
        (1, "refusé", True),
        (100002, "accordé", False),
    ]
    assert len({r["id"] for r in log}) == 3 and {r["status"] for r in log} == {"succes"}
    assert {r["origine"] for r in log} == {"production"} and json.loads(log[0]["features"])


def test_sketch_and_exact_latency_agree_on_the_stream(spark, data_dir, tmp_path):
    schema = spark.read.parquet(f"{data_dir}/events.parquet").schema
    events = readers.stream_parquet(spark, data_dir, "events", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    live = jobs.live_kpis(
        events, "ts", "1 day", "1 hour", F.lit("succes"), F.lit(False), F.floor(F.col("value")).cast("int")
    )
    jobs.drain(live, jobs.batch_sink(str(tmp_path / "k")), str(tmp_path / "p"), "update")
    rows = by_key(jobs.latest(jobs.read_batches(spark, str(tmp_path / "k"), live.schema), ["bucket"]), "bucket")
    counts = jobs.live_latency_counts(events, "ts", "1 day", "1 hour", F.floor(F.col("value")).cast("int"))
    jobs.drain(counts, jobs.batch_sink(str(tmp_path / "c")), str(tmp_path / "q"), "update")
    newest = jobs.latest(jobs.read_batches(spark, str(tmp_path / "c"), counts.schema), ["bucket", "value"])
    exact = by_key(jobs.quantiles_of_counts(newest, {"median": 0.5, "p95": 0.95}), "bucket")
    assert set(exact) == set(rows) and sum(r["calls"] for r in rows.values()) == 1000
    for bucket, r in rows.items():
        assert abs(r["latency_quantiles"][0] - exact[bucket]["median"]) <= 15


def test_record_schema_and_stamp(spark):
    assert record_schema()["SK_ID_CURR"].dataType.simpleString() == "bigint" and len(record_schema()) == 23
    row = modeling.stamp(spark.createDataFrame([(0.25,)], "probability double"), 0.24, "v", "local").first()
    assert (row["decision"], row["model_version"]) == ("refusé", "v")
