"""Wide aggregates in one pass: minimum, maximum, sum and count of hundreds of columns per key.

A generated aggregate of that many buffers is not compiled to machine code, and cut into narrower ones it scans its source
once for each. Here a task reduces its rows, some hundred thousand at a time, to one row per key whose buffers are arrays;
these rows are dealt by key, and equal keys, which then stand together, are merged array by array. The source is read
once, one exchange carries partial rows only, and memory is bounded: no key's rows or partial rows are ever held together.

A partial row is several times as wide as a row. Where a task meets most keys only a few times among the rows that it holds at a
time, partial rows hardly reduce anything; such rows are dealt by key first (:func:`gathered`), before wide columns are derived.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskloom.functions import text
from riskloom.functions.nulls import col

#: Cells that a task gathers before it reduces them to a row per key.
CELLS = 8_000_000
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType)

#: Buffers of each kind: values that leave a minimum, a maximum, a sum as they are, and how two are merged. NaN counts as
#: larger than every number, as in Spark.
_LOW, _HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min
BUFFERS = {
    "lmin": (np.int64, _LOW, np.minimum),
    "lmax": (np.int64, _HIGH, np.maximum),
    "lsum": (np.int64, 0, np.add),
    "dmin": (np.float64, np.nan, np.fmin),
    "dmax": (np.float64, -np.inf, np.maximum),
    "dsum": (np.float64, 0.0, np.add),
    "seen": (np.int64, 0, np.add),
    "hits": (np.int64, 0, np.add),
}


def gathered(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by key, the rows of a key one after the other; rows without a key, which no aggregate takes, are left out.

    For narrow rows of many keys, before wide columns are derived from them: each key then leaves the aggregate's first
    step as about one partial row. Adaptive execution splits a partition that a hot key makes large.
    """
    return df.where(col(key).isNotNull()).hint("rebalance", col(key)).sortWithinPartitions(col(key))


def can_pack(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whole numbers and floating ones; decimals keep their exact sums elsewhere."""
    return all(isinstance(df.schema[c].dataType, (*WHOLE, *REAL)) for c in columns)


def _arrays(parts: dict[str, np.ndarray]) -> list[pa.Array]:
    """A list column for each matrix, one row for each of its rows."""
    out = []
    for name, matrix in parts.items():
        kind = pa.int64() if BUFFERS[name][0] is np.int64 else pa.float64()
        ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
        out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix).ravel(), kind)))
    return out


def _reduced(parts: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
    """Rows from each of ``starts`` to the next, merged."""
    out = {}
    for name, matrix in parts.items():
        if not matrix.shape[1]:
            out[name] = matrix[starts]
        elif name == "dsum":
            # Running sums in the order of the rows, as Spark's own aggregate takes them.
            group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(matrix)))
            out[name] = np.column_stack([np.bincount(group, weights=matrix[:, j], minlength=len(starts)) for j in range(matrix.shape[1])])
        else:
            out[name] = BUFFERS[name][2].reduceat(matrix, starts, axis=0)
    return out


def _matrix(batch: pa.Table, names: Sequence[str], kind: type, missing: float) -> np.ndarray:
    out = np.empty((batch.num_rows, len(names)), dtype=kind)
    for j, n in enumerate(names):
        column = batch.column(n)
        if column.null_count:
            # The fill is set through the mask: a NaN fill must not turn NaN values into missing ones, nor the reverse.
            mask = column.is_null().to_numpy()
            out[:, j] = column.fill_null(0).to_numpy()
            out[mask, j] = missing
        else:
            out[:, j] = column.to_numpy()
    return out


def _partial(batch: pa.Table, whole: Sequence[str], real: Sequence[str], marks: Sequence[str], names: Sequence[str]) -> pa.RecordBatch:
    """One row per key of ``batch``."""
    codes = batch.column("k").combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    order = np.argsort(codes.indices.to_numpy(), kind="stable")
    sorted_codes = codes.indices.to_numpy()[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))
    batch = batch.take(pa.array(order))
    present = np.empty((len(order), len(whole) + len(real) + len(marks) + 1), dtype=np.int64)
    for j, n in enumerate([*whole, *real]):
        present[:, j] = batch.column(n).is_valid().to_numpy()
    present[:, len(whole) + len(real)] = 1
    hits = np.column_stack([batch.column(n).to_numpy() for n in marks]).astype(np.int64) if marks else np.empty((len(order), 0), dtype=np.int64)
    parts = {name: _matrix(batch, whole if name[0] == "l" else real, kind, fill) for name, (kind, fill, _) in BUFFERS.items() if name not in ("seen", "hits")}
    parts |= {"seen": present[:, : len(whole) + len(real) + 1], "hits": hits}
    keys = codes.dictionary.take(pa.array(sorted_codes[starts]))
    return pa.RecordBatch.from_arrays([keys, *_arrays(_reduced(parts, starts))], names=list(names))


def _merged(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Equal keys, which stand together, to one row each. The last key of a batch waits for the next one."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        keys = rows.column(0).combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        codes = keys.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        parts = {n: np.asarray(rows.column(n).combine_chunks().flatten()).reshape(len(codes), -1) for n in names[1:]}
        out = pa.RecordBatch.from_arrays([keys.take(pa.array(starts)), *_arrays(_reduced(parts, starts))], names=list(names))
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def packed_aggregates(df: DataFrame, key: str, numeric: Sequence[str], marks: Sequence[str]) -> tuple[DataFrame, dict[str, dict[str, str]], list[str], str]:
    """One row per key (rows without one are left out), and how to read its buffers in SQL text.

    Returns the frame, whose key column is ``k``; for every column of ``numeric`` the texts of its ``min``, ``max``, ``sum`` and
    ``count``; for every condition of ``marks`` (SQL text) the text of how often it held; and the text of the row count.
    """
    kinds = {c: df.schema[c].dataType for c in numeric}
    whole = [c for c in numeric if isinstance(kinds[c], WHOLE)]
    real = [c for c in numeric if isinstance(kinds[c], REAL)]
    narrow = df.where(col(key).isNotNull()).selectExpr(
        f"{text.name(key)} AS k",
        *[f"CAST({text.name(c)} AS BIGINT) AS l{i}" for i, c in enumerate(whole)],
        *[f"CAST({text.name(c)} AS DOUBLE) AS d{i}" for i, c in enumerate(real)],
        *[f"coalesce({m}, false) AS h{i}" for i, m in enumerate(marks)],
    )
    ls, ds, hs = ([f"{p}{i}" for i in range(n)] for p, n in (("l", len(whole)), ("d", len(real)), ("h", len(marks))))
    names = ["k", *BUFFERS]
    array = {n: T.ArrayType(T.LongType() if kind is np.int64 else T.DoubleType()) for n, (kind, _, _) in BUFFERS.items()}
    schema = T.StructType([T.StructField("k", df.schema[key].dataType), *[T.StructField(n, array[n]) for n in BUFFERS]])
    at_once = max(1, CELLS // max(1, len(ls) + len(ds) + len(hs)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= at_once:
                yield _partial(pa.Table.from_batches(held), ls, ds, hs, names)
                held = []
        if held:
            yield _partial(pa.Table.from_batches(held), ls, ds, hs, names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merged(batches, names)

    rows = narrow.mapInArrow(partial, schema).repartition("k").sortWithinPartitions("k").mapInArrow(merge, schema)
    reads = {}
    for p, columns, offset in (("l", whole, 0), ("d", real, len(whole))):
        for i, c in enumerate(columns):
            some = f"seen[{offset + i}] > 0"
            kind = kinds[c].simpleString()
            reads[c] = {
                "min": f"CASE WHEN {some} THEN CAST({p}min[{i}] AS {kind}) END",
                "max": f"CASE WHEN {some} THEN CAST({p}max[{i}] AS {kind}) END",
                "sum": f"CASE WHEN {some} THEN {p}sum[{i}]{' + 0D' if p == 'd' else ''} END",
                "count": f"seen[{offset + i}]",
            }
    return rows, reads, [f"hits[{i}]" for i in range(len(marks))], f"seen[{len(numeric)}]"
