"""One log for every call: scored, refused by the rules, or failed while it was scored.

A scoring function takes a batch of rows and may raise. The channel below keeps a fault to the rows that cause it: a batch
that raises is halved until the single rows that raise are found, and the rest is scored. Each row leaves with a probability
or with the class of its error, so one bad record neither ends a micro-batch nor takes others with it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from riskloom.functions import text
from riskloom.functions.nulls import col, is_true
from riskloom.functions.scalars import GRANTED, REFUSED
from riskloom.schemas import EXTRAS, FAILED, REJECTED, SUCCESS
from riskloom.sources.writers import append_log, log_rows

#: Rows of features to one probability each, in their order.
Predict = Callable[[pd.DataFrame], Sequence[float]]

# Fixed value: the error class of a result outside the output contract.
BAD_OUTPUT = "ValidationError"

CHANNEL = (T.StructField("probability", T.DoubleType()), T.StructField("failure", T.StringType()), T.StructField("took_ms", T.IntegerType()))


def isolated(predict: Predict, rows: pd.DataFrame) -> tuple[list[float | None], list[str | None]]:
    """A probability or an error class for every row. k rows that raise among n cost some k log n calls."""
    values: list[float | None] = [None] * len(rows)
    errors: list[str | None] = [None] * len(rows)
    open_parts = [(0, len(rows))] if len(rows) else []
    while open_parts:
        a, b = open_parts.pop()
        try:
            got = [float("nan") if x is None else float(x) for x in predict(rows.iloc[a:b])]
            if len(got) != b - a:
                raise IndexError(f"{len(got)} results for {b - a} rows")
        except Exception as e:  # noqa: BLE001 - whatever a model raises is the result of its row
            if b - a == 1:
                errors[a] = type(e).__name__
            else:
                middle = (a + b) // 2
                open_parts += [(a, middle), (middle, b)]
            continue
        for i, p in enumerate(got, a):
            if 0 <= p <= 1:
                values[i] = p
            else:
                errors[i] = BAD_OUTPUT
    return values, errors


def guarded(df: DataFrame, predict: Predict, inputs: Sequence[str], run: Column) -> DataFrame:
    """``df`` with ``probability``, ``failure`` (class of the error) and ``took_ms`` (time of the row's batch, per row).

    The function sees the columns ``inputs`` of the rows where ``run`` holds, batch by batch; other rows pass untouched.
    """
    inputs = list(inputs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch.column(batch.num_columns - 1)
            began = time.perf_counter()
            values, errors = isolated(predict, pa.Table.from_batches([batch]).select(inputs).filter(chosen).to_pandas())
            took = int((time.perf_counter() - began) * 1000 / max(1, len(values)))
            at = iter(range(len(values)))
            places = [next(at) if r else None for r in chosen.to_pylist()]
            probability = pa.array([None if i is None else values[i] for i in places], pa.float64())
            failure = pa.array([None if i is None else errors[i] for i in places], pa.string())
            spent = pa.array([None if i is None else took for i in places], pa.int32())
            names = [*batch.schema.names[:-1], *[f.name for f in CHANNEL]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], probability, failure, spent], names=names)

    marked = df.withColumn("__run", is_true(run))
    return marked.mapInArrow(score, T.StructType([*df.schema.fields, *CHANNEL]))


def _features(calls: DataFrame, body: str) -> DataFrame:
    """``features``: what the log keeps of a call. A refused one keeps its raw body (``{}`` if it is no object), a failed one
    its own fields, a scored one its own and its further fields merged flat, of which a further field wins over its namesake."""
    fields = calls.schema["record"].dataType.names
    others = ", ".join(f"{text.value(f)}, CASE WHEN NOT map_contains_key(extras, {text.value(f)}) THEN record.{text.name(f)} END" for f in fields)
    extras = F.get_json_object(col(body), f"$.{EXTRAS}")
    # Two JSON objects as one: the first without its last brace, the second without its first.
    own = F.expr(f"to_json(named_struct({others}))")
    merged = F.when(own == "{}", extras).otherwise(F.concat(F.regexp_replace(own, "[}]$", ","), F.substring(extras, 2, 1 << 30)))
    raw = F.when(F.json_object_keys(col(body)).isNotNull(), col(body)).otherwise(F.lit("{}"))
    whole = F.when((F.col("status") == FAILED) | (F.size("extras") == 0), F.to_json("record")).otherwise(merged)
    return calls.withColumn("features", F.when(F.col("status") == REJECTED, raw).otherwise(whole))


def outcome_rows(
    checked: DataFrame,
    predict: Predict,
    inputs: Sequence[str],
    threshold: float,
    version: str,
    origin: str,
    body: str = "body",
    key: str = "SK_ID_CURR",
) -> DataFrame:
    """One log row for every row of ``checked`` (see ``validate_json``), whatever became of it.

    Refused by the rules: status ``validation``, the first error, the raw body (``{}`` if it is no object). Raised or gave no
    probability: ``erreur`` and the error's class. Else ``succes`` with probability and decision. ``inputs`` name columns of
    ``checked`` or fields of its record. Columns ``id``, ``created_at``, ``history_found`` and ``latency_ms`` are kept where
    given; without ``latency_ms`` the scoring time is logged.
    """
    fields = checked.schema["record"].dataType.names
    own = set(checked.columns)
    spread = checked.withColumns({c: F.col("record").getField(c) for c in inputs if c not in own and c in fields})
    scored = guarded(spread, predict, inputs, F.col("status") == SUCCESS)
    scored = scored.withColumns(
        {
            "status": F.when(F.col("failure").isNotNull(), F.lit(FAILED)).otherwise(F.col("status")),
            "error_type": F.coalesce("error_type", "failure"),
        }
    )
    good = F.col("status") == SUCCESS
    ran = F.col("status") != REJECTED
    logged = _features(scored, body)
    kept = [c for c in ("id", "created_at") if c in own]
    return log_rows(
        logged.select(
            *kept,
            (F.col("record").getField(key) if key in fields else F.lit(None)).cast("long").alias("sk_id_curr"),
            F.lit(version).alias("model_version"),
            F.lit(float(threshold)).alias("threshold"),
            "probability",
            F.when(good, F.when(F.col("probability") > threshold, REFUSED).otherwise(GRANTED)).alias("decision"),
            (F.when(good, F.col("history_found")) if "history_found" in own else F.lit(None)).cast("boolean").alias("history_found"),
            F.when(ran, F.col("latency_ms") if "latency_ms" in own else F.col("took_ms")).cast("int").alias("latency_ms"),
            "status",
            "error_type",
            F.lit(origin).alias("origine"),
            "features",
        )
    )


def outcome_sink(
    folder: str,
    predict: Predict,
    inputs: Sequence[str],
    threshold: float,
    version: str,
    origin: str,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    body: str = "body",
    key: str = "SK_ID_CURR",
) -> Callable[[DataFrame, int], None]:
    """Streaming sink: every call of a micro-batch of checked records into the one log, under the batch's number, so that a
    replayed batch replaces itself. ``enrich`` adds what ``inputs`` need and the record does not hold, such as history; it may
    read the batch several times, which is checked once."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK) if enrich else batch
        try:
            ready = enrich(kept) if enrich else kept
            append_log(outcome_rows(ready, predict, inputs, threshold, version, origin, body, key), folder, number)
        finally:
            if enrich:
                kept.unpersist()

    return write
