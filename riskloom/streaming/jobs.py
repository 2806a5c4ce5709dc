"""Streaming jobs: validate, enrich, score, log, watch.

Every job is the batch operator applied to a stream. Sinks write each micro-batch under its
own number, so a batch replayed after a failure replaces itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from riskloom.functions.nulls import col, is_true
from riskloom.operators.drift import FrozenReference, counted_values, drift_of_counts
from riskloom.operators.joins import lookup_history
from riskloom.operators.ordered import cumulate, pick_quantiles, wanted_ranks
from riskloom.operators.validation import reject_rows, split_valid, validate_json
from riskloom.schemas import REQUEST_RULES, SUCCESS, Rule
from riskloom.sources.writers import append_log, log_rows

Sink = Callable[[DataFrame, int], None]


#: Keeps state on local disk beside memory, so that it may outgrow the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(stream: DataFrame, sink: Sink, checkpoint: str, mode: str = "append", available_now: bool = False) -> StreamingQuery:
    """Run ``sink`` on every micro-batch; progress and state are kept in ``checkpoint``."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    writer = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    # A query keeps the settings of the moment it starts.
    conf.set(key, ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def drain(stream: DataFrame, sink: Sink, checkpoint: str, mode: str = "append") -> list[dict]:
    """Process everything that is available and stop; what each micro-batch reported is returned."""
    query = start(stream, sink, checkpoint, mode, available_now=True)
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def state_rows(progress: Sequence[dict]) -> tuple[int, int]:
    """Rows that the stateful operators hold after the last micro-batch, and rows they refused as late over all of them."""
    held = sum(o["numRowsTotal"] for o in progress[-1]["stateOperators"]) if progress else 0
    return held, sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])


def batch_sink(folder: str) -> Sink:
    """Parquet sink with one folder per micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return write


def read_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All batches of a sink, with their number; no batch yet gives no rows."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(folder)


def latest(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of each key of an update-mode sink."""
    rest = [c for c in batches.columns if c not in (*keys, "batch")]
    newest = batches.groupBy(*[col(k) for k in keys]).agg(
        F.max_by(F.struct(*[col(c) for c in rest]), F.col("batch")).alias("r")
    )
    return newest.select(*[col(k) for k in keys], *[F.col("r").getField(c).alias(c) for c in rest])


#: Tasks for each core over which the bodies of a micro-batch are dealt.
TASKS_PER_CORE = 3


def validated(stream: DataFrame, body: str = "body", rules: Sequence[Rule] = REQUEST_RULES) -> DataFrame:
    """Checked records of a stream of bodies. A micro-batch is often one file, which one task reads; its bodies are dealt
    evenly before they are parsed, the costly part."""
    if stream.isStreaming:
        stream = stream.repartition(TASKS_PER_CORE * stream.sparkSession.sparkContext.defaultParallelism)
    return validate_json(stream, body, rules)


def two_way_sink(accepted: str, rejected: str, body: str = "body") -> Sink:
    """Write valid records and rejects of one batch to two folders."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        good, bad = split_valid(kept)
        batch_sink(accepted)(good.drop("errors", "error_type"), number)
        batch_sink(rejected)(reject_rows(bad, body), number)
        kept.unpersist()

    return write


def enriched(stream: DataFrame, history: Mapping[str, DataFrame], key: str, heavy: Sequence = ()) -> DataFrame:
    """Join the stored history to each record and note whether the client is known. ``heavy`` lists clients that send a large
    part of all records, for instance those of the log so far; :func:`enrich_sink` finds them in every micro-batch."""
    return lookup_history(stream, history, key, heavy=heavy)


def enrich_sink(folder: str, history: Mapping[str, DataFrame], key: str, keep: Sequence[str]) -> Sink:
    """Enrich each micro-batch, its own heavy clients joined apart, and write the columns ``keep``."""

    def write(batch: DataFrame, number: int) -> None:
        batch_sink(folder)(lookup_history(batch, history, key).select(*[col(c) for c in keep]), number)

    return write


def scored_log_sink(folder: str, score: Callable[[DataFrame], DataFrame], version: str, threshold: float, origin: str) -> Sink:
    """Score each batch and append its log rows; ``score`` returns sk_id_curr, probability,
    decision, history_found and features."""

    def write(batch: DataFrame, number: int) -> None:
        rows = score(batch).withColumns(
            {"model_version": F.lit(version), "threshold": F.lit(float(threshold)), "origine": F.lit(origin)}
        )
        append_log(log_rows(rows), folder, number)

    return write


def live_kpis(
    stream: DataFrame,
    ts: str,
    width: str,
    late: str,
    status: Column,
    refused: Column,
    latency: Column | None = None,
) -> DataFrame:
    """Calls, error rate and refusal rate per window. Latency quantiles, if asked for, come
    from a sketch of fixed size; see :func:`live_latency_counts` for exact ones."""
    ok = is_true(status == SUCCESS)
    extra = []
    if latency is not None:
        extra = [F.percentile_approx(F.when(ok, latency), [0.5, 0.95], 10000).alias("latency_quantiles")]
    grouped = stream.withWatermark(ts, late).groupBy(F.window(col(ts), width)).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & is_true(refused)).alias("refused"),
        *extra,
    )
    rates = [
        F.try_divide(F.col("failed"), F.col("calls")).alias("error_rate"),
        F.try_divide(F.col("refused"), F.col("calls") - F.col("failed")).alias("refusal_rate"),
    ]
    tail = [F.col("latency_quantiles")] if latency is not None else []
    return grouped.select(F.col("window.start").alias("bucket"), "calls", *rates, *tail)


def live_latency_counts(stream: DataFrame, ts: str, width: str, late: str, latency: Column) -> DataFrame:
    """Calls per window and latency: state that spreads over all tasks and from which exact
    quantiles follow."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(col(ts), width), latency.cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("bucket"), "value", "n")
    )


def quantiles_of_counts(counts: DataFrame, probs: Mapping[str, float], slice_width: float = 64.0) -> DataFrame:
    """Exact interpolated quantiles per bucket from value counts."""
    sliced = counts.withColumn("slice", F.floor(F.col("value") / F.lit(slice_width)).cast("int"))
    run = cumulate(sliced, ["bucket"], ["n"])

    covered = run.selectExpr("bucket", "value", "cum_n - n AS from_", "cum_n AS to_")
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("n"))
    return pick_quantiles(covered, wanted_ranks(totals, ["bucket"], probs), ["bucket"], ["bucket"], probs).drop("n")


def drift_sink(frozen: FrozenReference, folder: str, threshold: float = 0.1) -> Sink:
    """Compare each micro-batch with the frozen reference, whose rows are never read again."""

    def write(batch: DataFrame, number: int) -> None:
        batch_sink(folder)(drift_of_counts(frozen, counted_values(batch, frozen), threshold=threshold), number)

    return write


def live_values(stream: DataFrame, ts: str, width: str, late: str, frozen: FrozenReference) -> DataFrame:
    """How often each value occurs per event-time window: state from which the drift of every window follows, see
    ``drift_of_counts`` with ``by=["bucket"]``. Windows leave the state when the watermark has passed them."""
    marked = stream.withWatermark(ts, late)
    windowed = marked.withColumn("bucket", F.window(col(ts), width))
    counts = counted_values(windowed, frozen, ["bucket"])
    return counts.withColumn("bucket", F.col("bucket.start"))


def deduplicated(stream: DataFrame, ts: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Drop calls delivered again within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
