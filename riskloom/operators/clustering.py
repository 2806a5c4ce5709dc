"""Groups of correlated columns and the column to keep from each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.nulls import col
from riskloom.functions.scalars import base_name
from riskloom.operators.association import high_pairs, label_correlation, pearson_pairs
from riskloom.session import checkpointed


def connected_components(edges: DataFrame, a: str = "var_1", b: str = "var_2", rounds: int = 200) -> DataFrame:
    """(node, component): nodes joined by a chain of edges share the smallest node name.

    Each round gives every node the smallest label among itself and its neighbours, then
    follows the label's own label, which shortens long chains quickly. Neighbour minima are
    hash aggregates with partial results, so a node with very many edges is no hot spot.
    Rounds are cut by a checkpoint in the shared folder.
    """
    both = checkpointed(
        edges.select(col(a).alias("src"), col(b).alias("dst"))
        .unionByName(edges.select(col(b).alias("src"), col(a).alias("dst")))
        .distinct()
    )
    labels = checkpointed(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "node"))
    for _ in range(rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        new = (
            labels.join(near, "node")
            .join(hop, "label", "left")
            .select(
                "node",
                F.col("label").alias("old"),
                F.least("label", "near", "hop").alias("label"),
            )
        )
        new = checkpointed(new)
        moved = new.where("label <> old").limit(1).count()
        labels = new.drop("old")
        if not moved:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")


def cluster_sizes(components: DataFrame) -> DataFrame:
    """Clusters, largest first, with their members in order."""
    return (
        components.groupBy("component")
        .agg(F.count(F.lit(1)).alias("cluster_size"), F.sort_array(F.collect_list("node")).alias("members"))
        .orderBy(F.desc("cluster_size"), "component")
    )


def best_of_cluster(components: DataFrame, label_corr: DataFrame) -> DataFrame:
    """Per member: its correlation with the label and whether it is the one to keep. A member
    without a correlation ranks last; ties go to the smaller name. Rows are column names,
    so a cluster is never larger than the table is wide."""
    scored = components.join(label_corr.select(F.col("column").alias("node"), "abs_corr"), "node", "left")
    order = Window.partitionBy("component").orderBy(F.col("abs_corr").desc_nulls_last(), "node")
    return scored.withColumn("keep", F.row_number().over(order) == 1)


def reduce_clusters(components: DataFrame, label_corr: DataFrame) -> DataFrame:
    """Audit table: size, kept column, its correlation, dropped columns."""
    ranked = best_of_cluster(components, label_corr)
    return (
        ranked.groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("cluster_size"),
            F.max(F.when(F.col("keep"), F.col("node"))).alias("kept"),
            F.round(F.max(F.when(F.col("keep"), F.col("abs_corr"))), 4).alias("label_corr"),
            F.sort_array(F.collect_list(F.when(~F.col("keep"), F.col("node")))).alias("dropped"),
        )
        .orderBy(F.desc("cluster_size"), "component")
        .drop("component")
    )


def unprotected(columns: Sequence[str], suffixes: Sequence[str] = ("_COUNT", "_sum"), parts: Sequence[str] = ("ANOM",)) -> list[str]:
    """Columns that may be clustered: counts, anomaly flags and sums are left alone."""
    return [c for c in columns if not c.endswith(tuple(suffixes)) and not any(p in c for p in parts)]


def fit_drop_list(
    df: DataFrame, columns: Sequence[str], label: str, threshold: float = 0.8, protect: bool = True
) -> tuple[list[str], list[str], DataFrame]:
    """Columns to keep and to drop among correlated clusters, and the audit table."""
    columns = unprotected(columns) if protect else list(columns)
    pairs = high_pairs(pearson_pairs(df, columns), threshold)
    components = connected_components(pairs)
    strength = checkpointed(label_correlation(df, columns, label))
    # One row per clustered column reaches the driver: the lists become frozen parameters.
    rows = best_of_cluster(components, strength).select("node", "keep").orderBy("node").collect()
    audit = reduce_clusters(components, strength)
    return [r["node"] for r in rows if r["keep"]], [r["node"] for r in rows if not r["keep"]], audit


def variant_comparison(label_corr: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Per base name: the label correlation of each variant and the strongest variant."""
    rows = label_corr.where(F.col("column").rlike("(" + "|".join(suffixes) + ")$")).select(
        base_name(F.col("column"), tuple(suffixes)).alias("base_variable"),
        F.regexp_extract("column", "(" + "|".join(suffixes) + ")$", 1).alias("suffix"),
        "corr",
    )
    wide = rows.groupBy("base_variable").agg(
        *[F.max(F.when(F.col("suffix") == s, F.col("corr"))).alias(s) for s in suffixes]
    )
    choices = F.array(*[F.struct(F.abs(col(s)).alias("v"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(suffixes)])
    best = F.array_max(F.filter(choices, lambda x: x["v"].isNotNull()))
    return wide.withColumn("best_suffix", best["s"]).orderBy("base_variable")


def variant_census(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy("best_suffix").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "best_suffix")
