"""Rows, columns and files that must not get lost: missing keys and labels, unlisted text, part files, infinities."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.operators import aggregation, association, ordered, profiling, sampling
from riskloom.sources import readers
from riskloom.streaming import jobs


@pytest.fixture(scope="module")
def holes(spark):
    key = F.when(F.col("id") % 100 == 0, None).otherwise(F.col("id"))
    label = F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 2)
    return spark.range(1000).select(key.alias("k"), label.cast("int").alias("y"))


def test_missing_keys_and_labels_stay(holes):
    folds = sampling.stratified_folds(holes, "k", "y")
    assert folds.count() == 1000
    assert sampling.seeded_sample(holes, "k", 1000).count() == 1000


def test_unlisted_text_is_encoded(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "y")], "k int, c1 string, c2 string")
    some = aggregation.aggregate_table(df, "k", "T", categories={"c1": ["a", "b"]})
    assert set(some.columns) == set(aggregation.aggregate_table(df, "k", "T").columns)


def test_repeated_keys_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 1.0)], "k int, a double, b double")
    with pytest.raises(Exception, match="occurs more than once"):
        association.rank_columns(df, ["k"], ["a", "b"]).collect()


def test_infinities_are_no_edges(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, float("inf")).otherwise(F.col("id").cast("double")).alias("v"))
    edges = ordered.fit_edges(df, ["v"], 8)
    assert all(abs(e) < float("inf") for e in edges["v"])
    assert ordered.exact_quantiles(df, ["v"], [0.25]).count() == 1


def test_every_group_column_is_looked_at(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "b", 0), (None, "b", 1)], "g string, h string, y int")
    assert profiling.rate_by_group(df, ["g", "h"], "y").count() == 1


@pytest.mark.parametrize("parts", [1, 3])
def test_a_stream_reads_all_part_files(spark, tmp_path, parts):
    df = spark.range(90).withColumn("v", F.col("id") * 2)
    df.repartition(parts).write.parquet(str(tmp_path / "t.parquet"))
    stream = readers.stream_parquet(spark, str(tmp_path), "t", df.schema, files=1)
    seen = []
    jobs.drain(stream, lambda batch, number: seen.append(batch.count()), str(tmp_path / "progress"))
    assert sum(seen) == 90 and len([n for n in seen if n]) == parts


def test_a_stream_reads_a_lone_file(spark, data_dir, tmp_path):
    schema = spark.read.parquet(f"{data_dir}/region.parquet").schema
    seen = []
    jobs.drain(readers.stream_parquet(spark, data_dir, "region", schema), lambda batch, number: seen.append(batch.count()), str(tmp_path / "progress"))
    assert sum(seen) == 5
