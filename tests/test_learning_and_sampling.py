"""Nothing of held-out rows reaches a model; seeds are independent; samples keep their size; joins keep theirs."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.functions.scalars import spread
from riskloom.operators import joins, modeling, sampling


def test_held_out_rows_reach_no_fit(spark):
    # The value 999 lies in fold 0 only.
    df = spark.range(90).selectExpr("id", "int(id % 3) AS fold", "double(id % 2) AS label", "CASE WHEN id = 0 THEN 999D ELSE double(id % 7) END AS x")
    seen = []

    def prepare(known):
        seen.append(known.agg(F.max("x")).first()[0])
        return VectorAssembler(inputCols=["x"], outputCol="features").transform

    estimator = LogisticRegression(maxIter=2)
    out = modeling.out_of_fold(df, estimator, folds=3, prepare=prepare)
    assert out.count() == 90 and seen == [6.0, 999.0, 999.0]
    seen.clear()
    _, trials = modeling.search(df, estimator, {"regParam": [0.0, 0.1]}, folds=3, prepare=prepare)
    assert trials.count() == 2 and seen == [6.0, 999.0, 999.0, 999.0]


def test_seeds_are_independent(spark):
    shift = spread(F.col("id"), 43) - spread(F.col("id"), 42)
    assert spark.range(1000).select(shift.alias("s")).distinct().count() > 990


def test_samples_have_their_size(spark):
    rows = spark.range(5000).selectExpr("id AS k", "id % 3 AS v")
    first = sampling.seeded_sample(rows, "k", 200)
    assert first.count() == 200
    assert {r["k"] for r in first.collect()} == {r["k"] for r in sampling.seeded_sample(rows.repartition(7), "k", 200).collect()}
    repeated = spark.range(500).selectExpr("1L AS k", "id AS v")
    assert sampling.seeded_sample(repeated, "k", 10).count() == 10
    words = spark.range(300).selectExpr("concat('key ', id) AS k")
    assert sampling.seeded_sample(words, "k", 30).count() == 30


def test_a_repeated_key_is_refused(spark):
    left = spark.range(5).withColumnRenamed("id", "k")
    once = spark.range(3).selectExpr("id AS k", "id * 2 AS w")
    assert joins.left_join_all(left, {"a": once}, ["a"], "k", check=True).count() == 5
    with pytest.raises(Exception, match="would multiply rows"):
        joins.left_join_all(left, {"a": once.unionByName(once)}, ["a"], "k", check=True).collect()
