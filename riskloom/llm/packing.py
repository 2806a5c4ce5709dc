"""Packing into optimal length buckets.

A dynamic program over the global histogram of piece lengths chooses the bucket boundaries that minimise
padding; inside a bucket, batches hold as many rows as the token budget allows.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import gapless, spread_unit, staged

WORD = r"[^\x20\x09-\x0D]+"


def bucket_bounds(histogram: Mapping[int, int], buckets: int) -> list[int]:
    """The at most ``buckets`` boundaries, ascending, that give the least padding.

    Every length is padded to the smallest boundary that holds it. Each round allows one boundary more;
    its best predecessor is found on the lower hull of lines, as slopes fall and lengths rise, so the cost
    is (lengths x buckets). Of equal paddings the one with fewer boundaries, then smaller boundaries, wins.
    """
    sizes = sorted(n for n, rows in histogram.items() if rows > 0)
    if not sizes:
        return []
    rows = [0, *accumulate(histogram[n] for n in sizes)]
    tokens = [0, *accumulate(n * histogram[n] for n in sizes)]
    count, infinite = len(sizes), float("inf")
    best: list[float] = [0, *[infinite] * count]
    choice: list[list[int]] = []
    costs: list[float] = []
    for _ in range(min(buckets, count)):
        nxt: list[float] = [infinite] * (count + 1)
        origin = [0] * (count + 1)
        hull: list[tuple[int, float, int]] = []  # slope, intercept, index
        head = 0
        for j in range(1, count + 1):
            i = j - 1
            if best[i] < infinite:
                line = (-rows[i], best[i] + tokens[i], i)
                while len(hull) - head >= 2 and _hidden(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = sizes[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] < hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                slope, intercept, i = hull[head]
                nxt[j] = slope * x + intercept + x * rows[j] - tokens[j]
                origin[j] = i
        choice.append(origin)
        costs.append(nxt[count])
        best = nxt
    used = min(range(len(costs)), key=lambda k: (costs[k], k))
    bounds, j = [], count
    for k in range(used, -1, -1):
        bounds.append(sizes[j - 1])
        j = choice[k][j]
    return bounds[::-1]


def _hidden(a, b, c) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", context: int = 4096) -> DataFrame:
    """Sequences of at most ``context`` word tokens: ``doc_id``, ``piece``, ``first_token``, ``n_tokens``.

    A longer document is cut into several; nothing is dropped. Null and wordless texts give no piece.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    counted = staged(docs.select(F.col(doc_id).alias("doc_id"), words.alias("_x_words")).filter(F.col("_x_words") > 0), "packing")
    last = F.floor((F.col("_x_words") - 1) / context)
    cut = counted.select("doc_id", "_x_words", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    first = F.col("piece") * context
    return cut.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(context), F.col("_x_words") - first).cast("long").alias("n_tokens"))


def pack(sequences: DataFrame, buckets: int = 16, budget: int = 65_536, context: int = 4096) -> DataFrame:
    """Adds ``bucket``, ``padded``, ``batch`` and ``place`` to rows with doc_id, piece, n_tokens.

    The histogram has at most ``context`` entries, whatever the input. A bucket's rows are put in an order
    spread by the md5 of their id and numbered without gaps in slices, so a bucket that holds most rows is
    never one task; ``budget // padded`` rows (one at least) make a batch. Empty input gives no rows.
    Equal rows take neighbouring places. ``n_tokens`` over ``context`` is an error.
    """
    counted = sequences.groupBy("n_tokens").agg(F.count("*").alias("_x_rows"))
    histogram = {r[0]: r[1] for r in counted.collect()}
    if any(n > context for n in histogram):
        raise ValueError("a sequence is longer than the context")
    bounds = bucket_bounds(histogram, buckets)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    padded = F.array_min(F.filter(edges, lambda e: e >= F.col("n_tokens")))
    placed = sequences.withColumn("padded", padded).withColumn("bucket", F.array_position(edges, F.col("padded")).cast("int"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string"))
    placed = staged(placed.withColumn("_x_unit", spread_unit(key)), "packed") if bounds else placed.withColumn("_x_unit", F.lit(0.0))
    numbered = gapless(placed, ["bucket"], ["doc_id", "piece"], "_x_unit", "_x_number")
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded"))).cast("long")
    out = numbered.withColumn("batch", F.floor(F.col("_x_number") / per).cast("long")).withColumn("place", (F.col("_x_number") % per).cast("int"))
    return out.drop("_x_unit", "_x_number")
