"""Physical plans: no Cartesian products, no ordering of raw rows in one task, pruned scans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from riskloom.catalog import QUERIES
from riskloom.operators import association, joins, ordered
from riskloom.sources import readers

BATCH = sorted(
    n
    for n in QUERIES
    if not n.startswith("stream_") and n not in ("fit_score_batch", "oof_auc", "train_validation_gap", "hyper_search", "importance_top")
)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cartesian_product(spark, data_dir, name):
    text = plan(QUERIES[name](spark, data_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_flagship_reads_only_its_columns(spark, data_dir):
    text = plan(QUERIES["customer_features"](spark, data_dir))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("l_returnflag" in s and "l_extendedprice" not in s for s in scans)
    assert len(scans) == 3


def test_key_lookup_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "SK_ID_CURR").write.parquet(str(tmp_path / "t"))
    from riskloom.sources.readers import read_history

    text = plan(read_history(spark, str(tmp_path), ["t"], "SK_ID_CURR", 7)["t"])
    assert "EqualTo(SK_ID_CURR,7)" in text


def test_quantiles_do_not_shuffle_every_row(spark, data_dir):
    df = spark.read.parquet(f"{data_dir}/lineitem.parquet")
    text = plan(ordered.exact_quantiles(df, ["l_extendedprice"], [0.5], splits=16))
    # Rows meet the wanted slices by broadcast before anything is exchanged.
    assert "BroadcastHashJoin" in text and "LeftSemi" in text


def test_salting_gives_the_same_rows(spark):
    left = spark.range(300).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "id AS v")
    right = spark.range(50).selectExpr("id AS k", "id * 2 AS w")
    for salt in (1, 8):
        kept = joins.keep_keys(left, right, "k", salt)
        assert kept.columns == ["k", "v"] and kept.count() == left.where("k < 50").count()
        assert joins.unmatched(left, right, "k", salt).count() == left.where("k >= 50").count()
        joined = joins.left_join_one(left, right, "k", check=True, salt=salt)
        assert joined.count() == 300 and joined.agg(F.sum("w")).first()[0] == left.where("k < 50").agg(F.sum(F.expr("k * 2"))).first()[0]


def test_floating_filters_reach_the_scan(spark, data_dir, tmp_path):
    assert "GreaterThan(c_acctbal,0.0)" in plan(QUERIES["chained_semi_join"](spark, data_dir))
    spark.sql("SELECT * FROM VALUES (1, 1D), (2, double('NaN')), (3, NULL), (4, -1D) AS t(k, x)").write.parquet(str(tmp_path / "t"))
    for sign, kept in ((">", [1]), (">=", [1]), ("<", [4]), ("=", [])):
        df = readers.read_parquet(spark, str(tmp_path / "t"), ["k"], [("x", sign, 0.0)])
        assert sorted(r.k for r in df.collect()) == kept and df.columns == ["k"]
        assert re.search(r"PushedFilters: \[IsNotNull\(x\), \w+\(x,0\.0\)", plan(df))
    with pytest.raises(ValueError):
        readers.read_parquet(spark, str(tmp_path / "t"), where=[("x", "=", float("nan"))])


def test_partial_correlation_sums_do_not_grow_with_input_splits(spark, data_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey"]
    df = spark.read.parquet(f"{data_dir}/lineitem.parquet").select(*columns)
    few, many = (association.pearson_pairs(df.repartition(n), columns) for n in (2, 64))
    # Scans keep all their tasks; partial sums meet by task first, so that the last exchange has a row per group and column at most.
    assert "Coalesce" not in plan(many) and re.search(r"hashpartitioning\(i#.*hashpartitioning\(task#", plan(many), re.S)
    first, second = ({(r.var_1, r.var_2): (r.n, round(r.corr, 9)) for r in x.collect()} for x in (few, many))
    assert first == second and len(first) == 15
