"""Shuffled partners from one numbering, families over folds, bucketed history, samples below a cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import by_key, one
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.operators import evaluation, joins, modeling, sampling
from riskloom.plans import credit
from riskloom.sources import writers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stretch", [1_000_000, 40])
def test_every_column_is_shuffled_from_one_numbering(spark, stretch):
    df = spark.range(300).selectExpr("id", *[f"id * {i} AS c{i}" for i in range(1, 6)])
    columns = [f"c{i}" for i in range(1, 6)]
    out = modeling.permuted(df, "id", columns, stretch=stretch)
    assert plan(out).count("Exchange hashpartitioning") == 1
    pdf = out.toPandas()
    assert len(pdf) == 300 and sorted(pdf.id) == list(range(300))
    for i, c in enumerate(columns, 1):
        assert sorted(pdf[f"{c}__drawn"]) == sorted(pdf[c])
        partner = pdf[f"{c}__drawn"] // i
        assert (partner != pdf.id).all()
        assert abs(np.corrcoef(partner, pdf.id)[0, 1]) < 0.25
    assert not (pdf["c1__drawn"] == pdf["c2__drawn"] // 2).any()


def test_permutation_of_few_rows(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (2, 20.0, None)], "id long, a double, b double")
    rows = by_key(modeling.permuted(df, "id", ["a", "b"]), "id")
    assert {r["a__drawn"] for r in rows.values()} == {10.0, 20.0} and len(rows) == 2
    assert modeling.permuted(df.limit(0), "id", ["a"]).count() == 0


def test_permutation_importance_finds_the_column_that_counts(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(600), "a": rng.normal(size=600), "b": rng.normal(size=600)})
    pdf["label"] = (pdf.a > 0).astype(int)
    got = by_key(modeling.permutation_importance(spark.createDataFrame(pdf), "id", ["a", "b"], "label", lambda d: d.withColumn("score", F.col("a"))), "feature")
    assert got["a"]["auc_loss"] > 0.4 and got["b"]["auc_loss"] == 0


def test_families_side_by_side(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(240, 3)), columns=["x", "y", "z"])
    pdf["label"] = ((pdf.x + 0.3 * pdf.y) > 0).astype(int)
    pdf["fold"] = np.arange(240) % 3
    pdf["id"] = range(240)
    seen = []

    def prepare(known):
        seen.append(known.count())
        return lambda rows: modeling.weighted(VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(rows), "label")

    scores = modeling.family_scores(spark.createDataFrame(pdf), modeling.baselines("weight"), 3, prepare=prepare).select("family", "id", "label", "score", "held_out", "fold")
    rows = scores.toPandas()
    assert seen == [160, 160, 160]  # one preparation per fold, without its held-out rows
    assert sorted(set(rows.family)) == ["boosted", "forest", "logistic", "perceptron"] and len(rows) == 4 * 240 and (rows.held_out == rows.fold).all()
    table = by_key(modeling.family_table(scores), "family")
    for name, part in rows.groupby("family"):
        pos, neg = part.score[part.label == 1].to_numpy(), part.score[part.label == 0].to_numpy()
        auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        hit = part.score >= 0.5
        tp, fp, fn = int((hit & (part.label == 1)).sum()), int((hit & (part.label == 0)).sum()), int((~hit & (part.label == 1)).sum())
        got = table[name]
        assert got["auc"] == pytest.approx(auc) and got["recall"] == pytest.approx(tp / (tp + fn))
        assert got["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn)) and got["f2"] == pytest.approx(5 * tp / (5 * tp + 4 * fn + fp))
        assert got["cost"] == 10 * fn + fp and got["auc"] > 0.8


def test_bucketed_history_is_joined_where_it_lies(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = {n: spark.range(200).selectExpr("id AS SK_ID_CURR", f"id * {i} AS c{i}") for i, n in enumerate(credit.JOIN_ORDER, 2)}
        stored = writers.save_history(tables, str(tmp_path / "h"), "SK_ID_CURR", 4)
        clients = spark.range(0, 250, 1, 3).withColumnRenamed("id", "SK_ID_CURR").repartition(4, "SK_ID_CURR")
        out = joins.left_join_all(clients, stored, credit.JOIN_ORDER, "SK_ID_CURR", check=True)
        text = plan(out)
        # The clients' own deal is the only exchange: neither the joins nor the check of unique keys move a stored table.
        assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text and text.count("SortMergeJoin") == 10
        assert out.count() == 250 and one(out.where("SK_ID_CURR = 7"))["c4"] == 28
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_stratified_sample_orders_little(spark):
    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 1 WHEN id % 10 = 1 THEN NULL ELSE 0 END AS label")
    got = sampling.stratified_sample(df, "id", "label", 500)
    pdf = got.toPandas()
    assert (pdf.label == 1).sum() == 56 and (pdf.label == 0).sum() == 444 and pdf.label.isna().sum() == 56
    ordered = df.toPandas()
    import hashlib

    ordered["s"] = [int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:8], 16) for i in ordered.id]
    assert set(pdf[pdf.label == 1].id) == set(ordered[ordered.label == 1].sort_values(["s", "id"]).id[:56])
    repeated = spark.range(4000).selectExpr("CAST(id % 3 AS BIGINT) AS id", "CAST(id % 2 AS INT) AS label")
    assert sampling.stratified_sample(repeated, "id", "label", 1000).count() == 1000
    assert sampling.stratified_sample(df.limit(0), "id", "label", 10).count() == 0


def test_metrics_by_group(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("b", 1, 0.1)], "g string, y int, s double")
    rows = by_key(evaluation.class_metrics(df, "y", "s", by=["g"]), "g")
    assert (rows["a"]["cost"], rows["b"]["cost"], rows["a"]["recall"]) == (1, 10, 1.0)


def test_a_model_of_any_size_is_not_sent_around(spark):
    weights = np.ones(1000)
    df = spark.createDataFrame([(1, 2.0)], "id long, x double")
    with pytest.raises(ValueError, match="too large"):
        modeling.score_with(df, ["x"], lambda x: x[:, 0] * weights[0], ["id"], most_bytes=1000)
    assert modeling.score_with(df, ["x"], lambda x: x[:, 0], ["id"]).first()["probability"] == 2.0
