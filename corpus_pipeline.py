"""A corpus made ready for training, in four stages. Each stage's rows are written before the next one reads them.

quality        documents that the quality classifier rejects go
near_dedup     one document of each group of near copies stays: the one with the smallest id
substring      passages of 50 words that a document with a smaller id has are cut out
packing        sequences, length buckets and batches of what is left
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import anchors, chosen_path, packing, quality
from riskloom.llm.common import staged, table

#: The columns that all stages but the last hand on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PASSAGE = 50


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more. The model learns from the labels of ids whose remainder is not 1.

    Rows are judged one by one: a null or empty text is scored as such, rows without an id and repeated rows are scored like
    any other, ties at 0.5 stay. Without labels every score is one half, so that all rows stay. An empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels")
    rest = quality.remainder(F.col("doc_id"))
    taught = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1)).filter(rest != 1).distinct()
    learnt = docs.select("doc_id", "text").join(taught, "doc_id")
    described = quality.described(learnt, keep=("quality",)).withColumn("fold", (rest == 2).cast("int"))
    scorer = quality.fit(staged(described, "labelled"))
    return quality.judged(docs, scorer, COLUMNS).filter("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are similar to 0.8 or more: the one with the smallest id.

    Empty and null texts are like nothing and stay, and so do rows without an id, which no group can name. Of rows that
    repeat an id the one of the smallest text stays, null first. An empty table gives an empty one.
    """
    kept = chosen_path.near_duplicates(docs, shingle=5, share=(80, 100)).filter("kept").select(F.col("doc_id").alias("_x_kept")).distinct()
    chosen = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_x_kept")), "left_semi").select(*COLUMNS)
    chosen = staged(chosen, "single")
    repeated = chosen.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("_x_n")).filter("_x_n > 1").select("doc_id")
    if not repeated.take(1):
        return chosen
    # Only rows of repeated ids are shuffled with their texts; a hash aggregate keeps one for each task and id.
    one = chosen.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("_x_row"))
    return chosen.join(repeated, "doc_id", "left_anti").unionByName(one.select("doc_id", "_x_row.*"))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; a text may become empty, its row stays.

    A null text comes out empty. Rows without an id are compared with nothing and keep their text; rows that repeat an id are
    not earlier than each other, so that neither is cut by the other. An empty table gives an empty one.
    """
    cut = anchors.without_repeats(docs, keep=("doc_id", "lang", "source", "n_chars"), window=PASSAGE, finish=anchors.cleaned, result=anchors.CLEANED)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, padded, bucket, batch, place.

    Null, empty and wordless texts have no piece. Rows without an id and rows that repeat one are packed like any other; equal
    rows take neighbouring places. An empty table gives an empty one.
    """
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("substring", without_passages),
    ("packing", packed),
]

#: Scores are fitted numbers, which SQL cannot give; tests hold the stages against brute force on a small table.
ORACLE_SQL = None


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the last but one stage leaves them: what is packed, texts and all."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    name, stage = STAGES[-1]
    return staged(stage(spark, cleaned(spark, sf_dir), sf_dir), f"pipeline-{name}")
