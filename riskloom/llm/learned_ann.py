"""Nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into parts of equal size; a small network learns which parts
a vector's neighbours lie in. Every row is indexed under its likeliest part; a query is compared exactly with
all rows of its several likeliest parts. How many is set on held-out rows, for a wanted recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import staged

#: Rows that the graph is built on, and rows that the number of parts to search is set on, at most.
SAMPLE, HELD_OUT = 8192, 512
#: Rows of a part, and queries routed to it, that one task compares at once, on average.
BLOCK, QUERIES = 32_768, 8_192
#: Parts are at least so many, whatever the number of rows, and a part of a sample that teaches them has at least so many rows.
LEAST_PARTS, TAUGHT_BY = 32, 8


def top_products(queries: np.ndarray, rows: np.ndarray, k: int, same: bool = False) -> np.ndarray:
    """For each query the places of the k rows of largest product (``same``: but its own place)."""
    out = []
    for a in range(0, len(queries), 512):
        s = queries[a : a + 512] @ rows.T
        if same:
            s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        k_ = min(k, s.shape[1] - same)
        out.append(np.argpartition(-s, k_ - 1, axis=1)[:, :k_] if k_ < s.shape[1] else np.argsort(-s, axis=1)[:, :k_])
    return np.vstack(out)


def halves(edges: tuple[np.ndarray, np.ndarray], n: int, rng: np.random.Generator, rounds: int = 40) -> np.ndarray:
    """0 or 1 for each of n nodes, as many of each: nearby nodes of the graph alike.

    The second eigenvector of the graph's walk, by power iteration, is cut at its median; then the nodes
    that gain most by changing sides are swapped in pairs while the cut shrinks.
    """
    a, b = edges
    degree = np.bincount(a, minlength=n) + 1.0
    x = rng.normal(size=n)
    for _ in range(rounds):
        x = x - (x * degree).sum() / degree.sum()
        x = (np.bincount(a, weights=x[b], minlength=n) + x) / degree
        x /= max(np.linalg.norm(x), 1e-12)
    side = np.zeros(n, dtype=np.int64)
    side[np.argsort(x, kind="stable")[n // 2 :]] = 1
    cut = (side[a] != side[b]).sum()
    for _ in range(12):
        across = np.bincount(a, weights=(side[a] != side[b]).astype(float), minlength=n)
        gain = 2 * across - np.bincount(a, minlength=n)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swap = int(((gain[left[:m]] + gain[right[:m]]) > 0).sum() * 0.5)
        if not swap:
            break
        trial = side.copy()
        trial[left[:swap]], trial[right[:swap]] = 1, 0
        new = (trial[a] != trial[b]).sum()
        if new >= cut:
            break
        side, cut = trial, new
    return side


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node of the neighbour graph (rows of ``near``: neighbours), by repeated halving."""
    n = len(near)
    a = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    b = np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    label = np.zeros(n, dtype=np.int64)
    for _ in range(int(math.log2(parts))):
        nxt = label * 2
        for part in np.unique(label):
            members = np.flatnonzero(label == part)
            place = np.full(n, -1)
            place[members] = np.arange(len(members))
            keep = (place[a] >= 0) & (place[b] >= 0)
            nxt[members] += halves((place[a[keep]], place[b[keep]]), len(members), rng)
        label = nxt
    return label


@dataclass
class Router:
    """A network with one hidden layer: vector to chances of parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(_unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def train(x: np.ndarray, wanted: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 30) -> Router:
    """Cross entropy against ``wanted`` (a distribution over parts for each row), by Adam in small batches."""
    n, d, parts = len(x), x.shape[1], wanted.shape[1]
    p = [rng.normal(size=(d, hidden)) * math.sqrt(2 / d) * math.sqrt(d) / 4, np.zeros(hidden), rng.normal(size=(hidden, parts)) / math.sqrt(hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    u = _unit(x)
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(n)
        for s in range(0, n, 128):
            i = order[s : s + 128]
            h = u[i] @ p[0] + p[1]
            r = np.maximum(h, 0)
            z = r @ p[2] + p[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - wanted[i]) / len(i)
            gh = (g @ p[2].T) * (h > 0)
            t += 1
            for k, grad in enumerate((u[i].T @ gh + 1e-4 * p[0], gh.sum(0), r.T @ g + 1e-4 * p[2], g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def fit(sample: np.ndarray, held_out: np.ndarray, parts: int, k: int, recall: float, seed: int = 7) -> Router:
    """A router over ``parts`` parts (a power of two) that searches as few of them as give ``recall`` of the ``k`` nearest
    rows of the sample."""
    rng = np.random.default_rng(seed)
    if parts <= 1:
        d = sample.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = top_products(sample, sample, 16, same=True)
    label = balanced_parts(near, parts, rng)
    wanted = np.zeros((len(sample), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(sample)), near.shape[1]), label[near].ravel()), 1.0)
    wanted[np.arange(len(sample)), label] += 4.0
    router = train(sample, wanted / wanted.sum(axis=1, keepdims=True), rng)
    own = router.chances(sample).argmax(axis=1)
    asked = held_out if len(held_out) else sample[:HELD_OUT]
    truth = top_products(asked, sample, k, same=False)
    ranks = np.argsort(-router.chances(asked), axis=1, kind="stable")
    place = np.empty_like(ranks)
    np.put_along_axis(place, ranks, np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(place, own[truth], axis=1)
    found = [(needed < m).mean() for m in range(1, parts + 1)]
    router.probes = next((m for m, share in enumerate(found, 1) if share >= recall), parts)
    return router


def parts_of(rows: int, sample: int, rows_per_part: int, most_parts: int) -> int:
    """How many parts: one rule at all sizes. A power of two near rows / rows_per_part, from LEAST_PARTS to ``most_parts``, and
    no more than a sample can teach; fewer than two from a sample of less than sixteen rows."""
    wanted = 1 << max(0, round(math.log2(max(1, rows / rows_per_part))))
    taught = 1 << max(0, int(math.log2(max(1, sample / TAUGHT_BY))))
    return min(max(wanted, LEAST_PARTS), most_parts, taught)


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part, each id once.

    Rows with a null id and vectors that are null, zero, or hold null or non-finite components take no part.
    Of rows with one id, the least vector stays.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("vector"))
    sound = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(sound).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _vectors(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, d)


def _compare(d: int, k: int):
    """The k best rows of a block for every query of a chunk."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q, c = _vectors(left.column("query"), d), _vectors(right.column("vector"), d)
            qid, cid = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
            longest = np.linalg.norm(c, axis=1).max()
            for a in range(0, len(q), 128):
                s = q[a : a + 128] @ c.T
                s[qid[a : a + 128, None] == cid[None, :]] = -np.inf
                cut = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                size = np.linalg.norm(q[a : a + 128], axis=1) * longest
                for i in range(len(s)):
                    near = np.flatnonzero((s[i] >= cut[i] - 1e-12 * size[i]) & (s[i] > -np.inf))
                    score = np.cumsum(c[near] * q[a + i], axis=1)[:, -1]
                    best = np.lexsort((cid[near], -score))[:k]
                    found.append((np.full(len(best), qid[a + i]), cid[near][best], score[best]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return compare


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.95, rows_per_part: int = BLOCK, most_parts: int = 256, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: for ids divisible by ``every``, the ``k`` rows found of largest inner product.

    Products are summed in double precision in order of the components; ties go to the smaller id; a query
    is not its own candidate. A query that its parts leave with fewer than ``k`` candidates is compared with
    all parts, so every query gets ``k`` rows, or all candidates. Rows of a part are cut into blocks and its queries into
    chunks, by hashes of their ids, so that a part that holds most rows or queries is many tasks of bounded size. Vectors
    whose length is not the commonest one take no part.

    How many parts a query searches is set on held-out rows: of all rows' ``k`` nearest as many stand in the sample as the
    sample is of all rows, so that many nearest rows of the sample must be found.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = staged(usable(vectors), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, n = sizes["d"], sizes["count"]
    rows = rows.filter(F.size("vector") == d)
    x = _vectors(rows.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(SAMPLE + HELD_OUT).select("vector").toArrow().column("vector"), d)
    held = min(HELD_OUT, len(x) // 8)
    parts = parts_of(n, len(x) - held, rows_per_part, most_parts)
    router = fit(x[held:], x[:held], parts, min(k, max(1, math.ceil(k * len(x) / n))), recall, seed)
    shared = spark.sparkContext.broadcast(router)  # some ten thousand numbers, whatever the input

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("vector")
                ranks = np.argsort(-shared.value.chances(_vectors(column, d)), axis=1, kind="stable").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column, pa.array(list(ranks), type=pa.list_(pa.int32()))], names=["vec_id", "vector", "parts"])

    routed = staged(rows.mapInArrow(route, "vec_id bigint, vector array<double>, parts array<int>"), "routed")
    # A row for each part: what it holds, and below what is asked of it.
    counts = {r[0]: r[1] for r in routed.groupBy(F.col("parts")[0]).count().collect()}
    filled = F.array(*[F.lit(p).cast("int") for p in counts])
    size_of = F.create_map(*[F.lit(v) for p, c in counts.items() for v in (p, c)])
    asked = routed.filter(F.col("vec_id") % every == 0).withColumn("parts", F.filter("parts", lambda p: F.array_contains(filled, p)))
    first = F.slice("parts", 1, router.probes)
    reach = F.aggregate(first, F.lit(0).cast("bigint"), lambda a, p: a + F.element_at(size_of, p))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.explode(F.when(reach > k, first).otherwise(F.col("parts"))).alias("part"))
    queries = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    if not queries:
        return spark.createDataFrame([], schema)

    def pieces(sizes: dict[int, int], at_once: int) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(v).cast("int") for p, c in sizes.items() for v in (p, math.ceil(c / at_once))]), F.col("part")), F.lit(1))

    def each(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    blocks, chunks = pieces(counts, BLOCK), pieces(queries, QUERIES)
    index = routed.select("vec_id", "vector", F.col("parts")[0].alias("part"))
    index = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn("chunk", each(chunks))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), chunks).cast("int")).withColumn("block", each(blocks))
    group = ("part", "block", "chunk")
    found = asked.groupBy(*group).cogroup(index.groupBy(*group)).applyInArrow(_compare(d, k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
