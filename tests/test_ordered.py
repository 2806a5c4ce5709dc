"""Ordered statistics against brute force, with skew, ties and missing values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions.scalars import SPREAD_RANGE, spread
from riskloom.operators import association, drift, evaluation, ordered, sampling


def skewed(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.35, 7.0, rng.lognormal(1, 2, n).round(3))
    y = rng.integers(0, 5, n).astype(float)
    return pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.6, "hot", "cold"), "x": x, "y": y})


@pytest.mark.parametrize("splits", [1, 2, 16, 64])
def test_quantiles_do_not_depend_on_the_number_of_slices(spark, splits):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.25, 0.5, 0.951, 1.0]
    out = {r["column"]: r for r in ordered.exact_quantiles(df, ["x", "y"], probs, splits=splits).collect()}
    for c in ("x", "y"):
        assert [out[c][f"q{i}"] for i in range(5)] == pytest.approx(list(pdf[c].quantile(probs)))
    grouped = ordered.exact_quantiles(df, ["x"], [0.5, 0.95], by=["g"], splits=splits).collect()
    for r in grouped:
        assert [r["q0"], r["q1"]] == pytest.approx(list(pdf[pdf.g == r["g"]].x.quantile([0.5, 0.95])))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=40))
def test_quantiles_of_short_lists(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = ordered.exact_quantiles(df, ["x"], [0.1, 0.5, 0.9], splits=4).collect()
    here = [v for v in values if v is not None]
    if not here:
        assert out == []
    else:
        assert [out[0][f"q{i}"] for i in range(3)] == pytest.approx(list(np.quantile(here, [0.1, 0.5, 0.9])))


@pytest.mark.parametrize("splits", [1, 16])
def test_ranks_and_spearman(spark, splits):
    pdf = skewed(800)
    pdf.loc[::9, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None)))
    got = association.rank_columns(df, ["id"], ["x", "y"], splits).toPandas().sort_values("id")
    np.testing.assert_allclose(got.x, pdf.x.rank())
    np.testing.assert_allclose(got.y, pdf.y.rank())
    row = association.spearman_pairs(df, ["x", "y"], splits).first()
    assert row["corr"] == pytest.approx(pdf.x.rank().corr(pdf.y.rank()))


def test_heavy_values_are_attached_without_a_shuffle_of_their_key(spark):
    pdf = skewed(2000)
    df = spark.createDataFrame(pdf).selectExpr("id", "x AS value", "'x' AS column")
    table = ordered.ranks(df.withColumnRenamed("value", "x"), ["x"], 8)
    out = ordered.attach_by_value(df, table, ["column", "value"], "n", "all_n", "rank", share=10)
    got = out.toPandas().sort_values("id")
    np.testing.assert_allclose(got["rank"], pdf.x.rank())


@pytest.mark.parametrize("splits", [1, 16])
def test_auc_with_ties(spark, splits):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500)
    s = (rng.random(500) + 0.3 * y).round(1)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    assert evaluation.roc_auc(df, "y", "s", splits=splits).first()["auc"] == pytest.approx(want)


def test_auc_of_one_class_is_missing(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert evaluation.roc_auc(df, "y", "s").first()["auc"] is None


@pytest.mark.parametrize("splits", [1, 16])
def test_wasserstein_matches_brute_force(spark, splits):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 700).round(2), rng.normal(3, 2, 400).round(2)
    grid = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid[:-1], side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid[:-1], side="right") / len(b)
    want = np.sum(np.abs(fa - fb) * np.diff(grid)) / a.std()
    ref, cur = (spark.createDataFrame(pd.DataFrame({"x": v})) for v in (a, b))
    assert drift.wasserstein(ref, cur, ["x"], splits).first()["score"] == pytest.approx(want)


def test_positions_are_a_full_deal(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS g")
    out = ordered.numbered(df, ["g"], spread(F.col("id")), SPREAD_RANGE, ["id"], splits=16).toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part.position) == list(range(len(part)))
        assert set(part.group_size) == {len(part)}


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    a = sampling.seeded_sample(df.repartition(7), "id", 50).toPandas().id
    b = sampling.seeded_sample(df.coalesce(1), "id", 50).toPandas().id
    assert len(a) == 50 and set(a) == set(b)
    folds = sampling.stratified_folds(df, "id", "label", 5).toPandas()
    assert (folds.groupby(["label", "fold"]).size().unstack().max(axis=1) - folds.groupby(["label", "fold"]).size().unstack().min(axis=1)).max() <= 1
    part = sampling.stratified_sample(df, "id", "label", 100).toPandas()
    assert part.label.sum() == 20 and len(part) == 100
