"""Sums over rows of the products of all pairs of columns, and the same over their ranks.

Every task adds up its rows as small matrices. Their rows are then added in a tree: first within groups of tasks, then for
each matrix row over the groups, so that scans keep all their tasks and the last exchange sees one row per group and
column, whatever the number of files.

Ranks need every column in order. Rows are cut into chunks, stored once, column by column. A chunk sends the distinct
values of each column, slice by slice, to the tasks that order the slices, and gets their ranks back: what is shuffled is
one packed row per chunk, column and slice, never one per cell, and rows need no key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.operators.ordered import fit_edges
from riskloom.session import split_count, staging_path

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
PARTIAL = "task int, i int, sums array<double>"

#: Cells of a chunk, and distinct values that a slice is meant to hold.
CELLS, VALUES = 2_000_000, 500_000


class Products:
    """Centred sums of columns ``a`` against columns ``b``; without ``b`` each pair of ``a`` once."""

    def __init__(self, a: int, b: Sequence[int] | None = None):
        self.a, self.b = slice(0, a), list(b) if b is not None else slice(0, a)
        self.first = (lambda i: 0) if b is not None else (lambda i: i + 1)
        self.total: list[np.ndarray] | None = None

    def add(self, centred: np.ndarray) -> None:
        """Rows to add; NaN is missing."""
        m = (~np.isnan(centred)).astype(np.float64)
        x = np.nan_to_num(centred, nan=0.0, posinf=np.inf, neginf=-np.inf)
        sq = x * x
        part = [p[:, self.a].T @ q[:, self.b] for p, q in ((m, m), (x, m), (m, x), (sq, m), (m, sq), (x, x))]
        self.total = part if self.total is None else [s + t for s, t in zip(self.total, part)]

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        """Row i of all six matrices, side by side."""
        for i in range(len(self.total[0]) if self.total is not None else 0):
            yield i, np.concatenate([s[i, self.first(i) :] for s in self.total])


def _batch(rows: Sequence[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array([task] * len(rows), pa.int32()), pa.array([i for i, _ in rows], pa.int32()), pa.array([s for _, s in rows], pa.list_(pa.float64()))],
        names=["task", "i", "sums"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task added up by ``i``."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, s in zip(batch.column("i").to_pylist(), batch.column("sums")):
            s = s.values.to_numpy()
            held[i] = held[i] + s if i in held else s
    if held:
        yield _batch(sorted(held.items(), key=lambda r: r[0]))


def tree_added(partial: DataFrame, left: Sequence[str], right: Sequence[str] | None) -> DataFrame:
    """(var_1, var_2, sums) from one row per task and matrix row."""
    grouped = partial.repartition("task").mapInArrow(_added, PARTIAL)
    whole = grouped.repartition("i").mapInArrow(_added, PARTIAL)
    # The six parts of a row have the same width.
    fields = ", ".join(f"'{s}', sums[{k} * w + t]" for k, s in enumerate(SUMS))
    first = "0" if right is not None else "i + 1"
    cells = whole.selectExpr("i", "sums", "size(sums) DIV 6 AS w").where("w > 0")
    cells = cells.selectExpr("i", f"inline(transform(sequence(0, CAST(w - 1 AS INT)), t -> named_struct('j', {first} + t, {fields})))")
    names = [F.get(F.array(*[F.lit(c) for c in side]), F.col(at)).alias(var) for side, at, var in ((left, "i", "var_1"), (right or left, "j", "var_2"))]
    return cells.select(*names, *SUMS)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Numbers of a batch, NaN where missing."""
    out = np.empty((batch.num_rows, batch.num_columns))
    for j, column in enumerate(batch.columns):
        out[:, j] = column.to_numpy(zero_copy_only=False)
    return out


def pair_sums(df: DataFrame, left: Sequence[str], right: Sequence[str] | None, means: Sequence[float]) -> DataFrame:
    """Sums of all pairs of ``left``, or of ``left`` against ``right``, around the given means."""
    columns = [*left, *[c for c in right or [] if c not in left]]
    centre = np.array(means, dtype=np.float64)
    at = [columns.index(c) for c in right] if right is not None else None
    k = len(left)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = Products(k, at)
        for batch in batches:
            if batch.num_rows:
                products.add(matrix(batch) - centre)
        if products.total is not None:
            yield _batch(list(products.rows()))

    narrow = df.selectExpr(*[f"CAST({text.name(c)} AS DOUBLE) AS x{i}" for i, c in enumerate(columns)])
    return tree_added(narrow.mapInArrow(partial, PARTIAL), left, right)


# --- ranks -----------------------------------------------------------------------------------


def _chunked(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to one row per chunk and column, its values as bytes."""
    at_once = max(1024, CELLS // width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        number = TaskContext.get().partitionId() << 32

        def chunk() -> pa.RecordBatch:
            whole = np.concatenate(held) + 0.0  # one zero
            return pa.RecordBatch.from_arrays(
                [pa.array([number] * width, pa.int64()), pa.array(range(width), pa.int32()), pa.array([whole[:, j].tobytes() for j in range(width)], pa.binary())],
                names=["chunk", "column", "data"],
            )

        for batch in batches:
            if batch.num_rows:
                held.append(matrix(batch))
            if sum(map(len, held)) >= at_once:
                yield chunk()
                held, number = [], number + 1
        if held:
            yield chunk()

    return cut


def _numbers(raw: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), dtype=kind)


def _sent(edges: Sequence[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks to their distinct values and how often they occur, one row per column and slice."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for chunk, column, data in zip(*batch.columns):
                c = column.as_py()
                values = _numbers(data)
                values, counts = np.unique(values[~np.isnan(values)], return_counts=True)
                cut = np.searchsorted(edges[c], values, side="right")
                for s in np.unique(cut):
                    here = cut == s
                    out.append((c, int(s), chunk.as_py(), values[here].tobytes(), counts[here].astype(np.int64).tobytes()))
            if out:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["column", "slice", "chunk", "vals", "counts"])

    return send


def _ranked(group: pa.Table) -> pa.Table:
    """Ranks within one slice for each chunk's values, and the slice's size."""
    each = [_numbers(v) for v in group.column("vals")]
    counts = np.concatenate([_numbers(c, np.int64) for c in group.column("counts")])
    values, place = np.unique(np.concatenate(each), return_inverse=True)
    total = np.zeros(len(values), dtype=np.int64)
    np.add.at(total, place, counts)
    upto = np.cumsum(total)
    rank = (upto - total + (total + 1) / 2.0)[place]
    cuts = np.cumsum([len(v) for v in each])[:-1]
    ranks = pa.array([r.tobytes() for r in np.split(rank, cuts)], pa.binary())
    size = pa.array([int(upto[-1])] * len(each), pa.int64())
    return pa.table([group.column("column"), group.column("slice"), group.column("chunk"), group.column("vals"), ranks, size], names=["column", "slice", "chunk", "vals", "ranks", "size"])


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rank_sums(df: DataFrame, columns: Sequence[str], splits: int | None = None) -> DataFrame:
    """Sums of all pairs of columns, each value replaced by its average rank in its column, around the mean rank."""
    k = len(columns)
    narrow = df.selectExpr(*[f"CAST({text.name(c)} AS DOUBLE) AS x{i}" for i, c in enumerate(columns)])
    # Stored chunks read the same after a lost executor; rows that came in another order would not.
    chunks = _staged(narrow.mapInArrow(_chunked(k), "chunk bigint, column int, data binary"), "chunks")
    cuts = fit_edges(narrow, [f"x{i}" for i in range(k)], splits or _splits(chunks))
    edges = [np.array(cuts[f"x{i}"]) for i in range(k)]
    sent = chunks.mapInArrow(_sent(edges), "column int, slice int, chunk bigint, vals binary, counts binary")
    ranked = sent.groupBy("column", "slice").applyInArrow(_ranked, "column int, slice int, chunk bigint, vals binary, ranks binary, size bigint")
    ranked = _staged(ranked, "ranks")
    # One number per column and slice, as many as there are edges.
    sizes = [np.zeros(len(e) + 1, dtype=np.int64) for e in edges]
    for r in ranked.groupBy("column", "slice").agg(F.max("size").alias("size")).collect():
        sizes[r["column"]][r["slice"]] = r["size"]
    before = [np.cumsum(s) - s for s in sizes]
    centre = [(s.sum() + 1) / 2.0 for s in sizes]

    def combine(rows: pa.Table, ranks: pa.Table) -> pa.Table:
        known: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(k)]
        for c, s, v, r in zip(ranks.column("column").to_pylist(), ranks.column("slice").to_pylist(), ranks.column("vals"), ranks.column("ranks")):
            known[c].append((s, _numbers(v), _numbers(r) + (before[c][s] - centre[c])))
        data = {c: _numbers(d) for c, d in zip(rows.column("column").to_pylist(), rows.column("data"))}
        out = np.full((len(data[0]), k), np.nan)
        for c in range(k):
            if known[c]:
                table = sorted(known[c], key=lambda x: x[0])
                values, at = np.concatenate([t[1] for t in table]), np.concatenate([t[2] for t in table])
                here = ~np.isnan(data[c])
                out[here, c] = at[np.searchsorted(values, data[c][here])]
        products = Products(k)
        products.add(out)
        return pa.Table.from_batches([_batch(list(products.rows()))])

    partial = chunks.groupBy("chunk").cogroup(ranked.groupBy("chunk")).applyInArrow(combine, PARTIAL)
    return tree_added(partial.mapInArrow(_added, PARTIAL), columns, None)


def _splits(chunks: DataFrame) -> int:
    """Slices that hold some VALUES values each; at least as many as shuffles have tasks."""
    rows = (chunks.where(F.col("column") == 0).agg(F.sum(F.length("data"))).first()[0] or 0) // 8
    return max(split_count(chunks.sparkSession), rows // VALUES)
