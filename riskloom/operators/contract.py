"""Fixed column contracts: align, project, rename, expand."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import text
from riskloom.functions.nulls import col, numeric_or_null


def drop_columns(df: DataFrame, columns: Iterable[str], protect: Iterable[str] = ()) -> DataFrame:
    """Drop what is present and not protected; absent names are ignored."""
    keep = set(protect)
    return df.drop(*[c for c in columns if c in df.columns and c not in keep])


def align(df: DataFrame, contract: T.StructType, key: str | None = None) -> DataFrame:
    """Exactly the contract's columns in its order: absent ones are added as missing, extra
    ones dropped. ``key`` is kept in front when the contract does not list it."""
    have = {c.lower(): c for c in df.columns}
    out = []
    if key and key.lower() in have and key not in contract.names:
        out.append(text.name(key))
    for f in contract:
        source = have.get(f.name.lower())
        value = text.name(source) if source else "NULL"
        out.append(f"CAST({value} AS {f.dataType.simpleString()}) AS {text.name(f.name)}")
    return df.selectExpr(*out)


def contract_of(df: DataFrame, drop: Iterable[str] = ()) -> T.StructType:
    skip = set(drop)
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema if f.name not in skip])


def contract_rows(df: DataFrame) -> list[tuple[int, str, str]]:
    """(position, name, type) per column, as stored next to a fitted model."""
    return [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]


def safe_names(names: Sequence[str]) -> list[str]:
    """Names a model library accepts: every run of other characters becomes one underscore."""
    out = [re.sub(r"[^A-Za-z0-9_]+", "_", n) for n in names]
    seen: dict[str, str] = {}
    for old, new in zip(names, out):
        if seen.setdefault(new.lower(), old) != old:
            raise ValueError(f"{seen[new.lower()]!r} and {old!r} both become {new!r}")
    return out


def names_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def variant_drops(columns: Sequence[str], drop: Sequence[str], keep: Sequence[str] = ()) -> list[str]:
    """Columns ending in a dropped suffix, except those of the bases listed in ``keep``."""
    out = []
    for c in columns:
        for s in drop:
            if c.endswith(s) and c[: -len(s)] not in keep:
                out.append(c)
    return out


def type_census(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    for f in df.schema:
        out[f.dataType.simpleString()] = out.get(f.dataType.simpleString(), 0) + 1
    return out


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def expand_json(df: DataFrame, column: str, contract: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """A JSON object column as typed columns: unknown keys dropped, absent ones missing.

    Values are read as text and then converted, so one malformed field does not blank the
    whole record.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType(), True) for f in contract])
    parsed = df.select(*[col(k) for k in keep], F.from_json(col(column), texts).alias("r_"))
    kept = [text.name(k) for k in keep]
    fields = [f"try_cast(r_.{text.name(f.name)} AS {f.dataType.simpleString()}) AS {text.name(f.name)}" for f in contract]
    return parsed.selectExpr(*kept, *fields)


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: numeric_or_null(col(c).cast("string")) for c in columns})


def populated_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one value; one aggregate row reaches the driver."""
    if not columns:
        return []
    row = df.agg(*[F.expr(f"count({text.name(c)}) AS n{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"n{i}"] > 0]


# The named look-back windows, in hours; None is the whole history.
LOOK_BACK_HOURS = {"24h": 24, "7d": 24 * 7, "30d": 24 * 30, "all": None}


def since(df: DataFrame, column: str, window: str, now: datetime | Column) -> DataFrame:
    """Rows of a named look-back window ending at ``now``."""
    hours = LOOK_BACK_HOURS[window]
    if hours is None:
        return df
    end = now if isinstance(now, Column) else F.lit(now)
    return df.where(col(column) >= end - F.expr(f"INTERVAL {hours} HOURS"))


def bucket_width(window: str) -> str:
    """Hourly series up to two days, daily beyond."""
    hours = LOOK_BACK_HOURS[window]
    return "1 hour" if hours is not None and hours <= 48 else "1 day"


def with_status(df: DataFrame, status: str, success: bool = True, column: str = "status") -> DataFrame:
    return df.where(col(column) == status if success else col(column) != status)


def at_least(df: DataFrame, column: str, value: float) -> DataFrame:
    return df.where(col(column) >= F.lit(value))


def non_null(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(col(c).isNotNull())
    return df


def key_equals(df: DataFrame, key: str, value: int) -> DataFrame:
    return df.where(col(key) == F.lit(value))


def usable_records(df: DataFrame, required: Sequence[str], not_positive: Sequence[str]) -> DataFrame:
    """Records with every required field present and no sentinel in the day offsets."""
    condition = F.lit(True)
    for c in required:
        condition = condition & col(c).isNotNull()
    for c in not_positive:
        condition = condition & ~F.coalesce(col(c) > 0, F.lit(False))
    return df.where(condition)


def to_payload(df: DataFrame, types: Mapping[str, str], into: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """One JSON object per row with typed fields; missing fields are left out."""
    fields = [col(c).cast(t).alias(c) for c, t in types.items()]
    return df.select(*[col(k) for k in keep], F.to_json(F.struct(*fields)).alias(into))


def shift_population(
    df: DataFrame,
    scale: Mapping[str, float] | None = None,
    clip: Mapping[str, tuple[float, float]] | None = None,
    constant: Mapping[str, object] | None = None,
    whole: Sequence[str] = (),
) -> DataFrame:
    """What-if population: scale, then clip, then truncate columns; set others to a constant."""
    changes: dict[str, Column] = {}
    for c, factor in (scale or {}).items():
        changes[c] = col(c) * F.lit(float(factor))
    for c, (low, high) in (clip or {}).items():
        base = changes.get(c, col(c))
        changes[c] = F.when(base.isNotNull(), F.least(F.greatest(base, F.lit(low)), F.lit(high)))
    for c in whole:
        changes[c] = changes.get(c, col(c)).cast("int")
    for c, v in (constant or {}).items():
        changes[c] = F.lit(v)
    return df.withColumns(changes)


def label_source(df: DataFrame, label: str, into: str = "source") -> DataFrame:
    return df.withColumns({into: F.lit(label)})


def union_labelled(frames: Mapping[str, DataFrame], into: str = "source") -> DataFrame:
    """Stack frames by name, each row carrying the label of its frame."""
    out = None
    for label, df in frames.items():
        part = label_source(df, label, into)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
