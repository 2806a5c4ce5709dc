"""Shared parts: reading, staging, word hashes, gapless numbers, slices of a wide order.

Names that start with ``_x_`` are internal; operators select the columns they need, so other columns of
the input, whatever their names, never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import staging_path

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action go when it has ended; what it wrote is in shared storage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    schema = df.schema
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread_unit(key: Column) -> Column:
    """A number in [0, 1) from the md5 of ``key``; both Spark and plain SQL can compute it."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def gapless(df: DataFrame, by: list[str], order: list[str], unit: str, out: str, rows_per_slice: int = 50_000) -> DataFrame:
    """Numbers 0, 1, ... within each group of ``by``, in the order of ``unit`` then ``order``.

    ``unit`` is a column in [0, 1) that spreads evenly. Groups of any size are cut into slices of it,
    ordered slice by slice; a group's earlier slices are added from a table with a row per group and slice,
    itself summed in two levels, so that no task holds a group. Rows with equal order may swap numbers.
    """
    total = df.count()
    slices = max(1, math.ceil(total / rows_per_slice)) * 4 if total > rows_per_slice else 8
    wide = max(1, math.isqrt(slices))
    cut = df.withColumn("_x_slice", F.floor(F.col(unit) * slices).cast("long"))
    keys = [f"_x_by{i}" for i in range(len(by))]
    sizes = cut.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("_x_slice").alias("_x_s")).agg(F.count("*").alias("_x_n"))
    sizes = sizes.withColumn("_x_block", F.floor(F.col("_x_s") / wide))
    from pyspark.sql import Window

    blocks = sizes.groupBy(*keys, "_x_block").agg(F.sum("_x_n").alias("_x_bn"))
    before = Window.partitionBy(*keys).orderBy("_x_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_x_b0", F.coalesce(F.sum("_x_bn").over(before), F.lit(0))).drop("_x_bn")
    inside = Window.partitionBy(*keys, "_x_block").orderBy("_x_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_x_s0", F.coalesce(F.sum("_x_n").over(inside), F.lit(0)))
    starts = starts.join(blocks, [*keys, "_x_block"]).select(*keys, "_x_s", (F.col("_x_s0") + F.col("_x_b0")).alias("_x_start"))
    match = [cut[c].eqNullSafe(starts[k]) for c, k in zip(by, keys)] + [cut["_x_slice"] == starts["_x_s"]]
    ranked = cut.withColumn("_x_rank", F.row_number().over(Window.partitionBy(*by, "_x_slice").orderBy(unit, *order)))
    joined = ranked.join(starts, match)
    return joined.withColumn(out, (F.col("_x_start") + F.col("_x_rank") - 1).cast("long")).drop("_x_slice", "_x_rank", "_x_s", "_x_start", *keys)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole word (the finisher of a public mixer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i below ``count``; ``base`` is odd."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        steps = np.full(count, b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


#: Bytes or words whose sums are taken at once, which bounds memory for texts of any length.
SEGMENT, LONG_WORD = 1 << 15, 1 << 12
_BYTE_POWERS = _powers(0xD6E8FEB86659FD93, SEGMENT + LONG_WORD + 1)


@lru_cache(maxsize=16)
def _window_powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers((0x9E3779B97F4A7C15 * (2 * seed + 1)) & MASK64 | 1, SEGMENT + 1)


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends; space and 0x09 to 0x0D stand between words."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    space = (data == 32) | ((data - np.uint8(9)) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0] or not space[-1]:
        edges = np.concatenate(([] if space[0] else [0], edges, [] if space[-1] else [len(data)])).astype(np.int64)
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, taken from running sums, then mixed."""
    data = np.frombuffer(raw, dtype=np.uint8)
    sizes = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    power, inverse = _BYTE_POWERS
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = len(starts) if int(starts[-1]) < first + SEGMENT else int(np.searchsorted(starts, first + SEGMENT))
        last = min(int(ends[j - 1]), first + SEGMENT + LONG_WORD)
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum(data[first:last] * power[: last - first], out=sums[1:])
        at = starts[i:j] - first
        out[i:j] = (sums[np.minimum(ends[i:j], last) - first] - sums[at]) * inverse[at]
        i = j
    out += sizes.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in np.flatnonzero(sizes > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
    return mixed(out)


def window_hashes(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """One 64-bit number for each run of ``width`` consecutive words, from running sums."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.empty(n, dtype=np.uint64)
    power, inverse = _window_powers(seed)
    if width > SEGMENT // 2:
        raise ValueError("a window of so many words is not supported")
    step = SEGMENT - width
    for a in range(0, n, step):
        part = hashes[a : min(a + step, n) + width - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        m = len(part) - width + 1
        np.multiply(sums[width:] - sums[:m], inverse[:m], out=total[a : a + m])
    return mixed(total + np.uint64((seed * 0xD1342543DE82EF95 + width) & MASK64))
