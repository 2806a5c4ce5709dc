"""Small scalar expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.nulls import is_true

# The two decision labels and the days-per-year factor.
REFUSED = "refusé"
GRANTED = "accordé"
DAYS_PER_YEAR = 365.25


def years_to_days(years: Column) -> Column:
    """Years before the application as a negative whole number of days, truncated."""
    return -(years * F.lit(DAYS_PER_YEAR)).cast("int")


def decision(probability: Column, threshold: float | Column, inclusive: bool = False) -> Column:
    """Decision label; serving refuses above the threshold, the sweep at or above it."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = probability >= t if inclusive else probability > t
    return F.when(probability.isNotNull(), F.when(hit, F.lit(REFUSED)).otherwise(F.lit(GRANTED)))


def class_weight(label: Column, positive_weight: float | Column) -> Column:
    """Row weight: ``positive_weight`` for the positive class, one otherwise."""
    w = positive_weight if isinstance(positive_weight, Column) else F.lit(float(positive_weight))
    return F.when(is_true(label == 1), w).otherwise(F.lit(1.0))


def spread(key: Column, seed: int = 42) -> Column:
    """A repeatable pseudo-random whole number in [0, 2**32) from a key of any kind.

    The start of the md5 of key and seed: seeds are independent of each other, and other SQL
    engines give the same number. Missing for a missing key.
    """
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{int(seed)}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


SPREAD_RANGE = 1 << 32


def spread_sql(key: str, seed: int = 42) -> str:
    """The text of :func:`spread` in SQL, for whole or text keys."""
    return f"cast('0x' || substr(md5(cast({key} as varchar) || ':{int(seed)}'), 1, 8) as bigint)"


def base_name(name: Column, suffixes: tuple[str, ...]) -> Column:
    """A feature's name without its variant suffix."""
    return F.regexp_replace(name, "(" + "|".join(re.escape(s) for s in suffixes) + ")$", "")


def pair_key(a: Column, b: Column) -> Column:
    """The same value for (a, b) and (b, a)."""
    return F.struct(F.least(a, b).alias("var_1"), F.greatest(a, b).alias("var_2"))


def settle(x: Column, digits: int = 4) -> Column:
    """Round half up with a hair of slack, so sums taken in another order round alike."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * F.lit(scale) + F.lit(0.500001)).cast("double") / F.lit(scale)
