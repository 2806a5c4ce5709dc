"""Fitted preprocessing: impute, scale, one-hot and ordinal encoding from frozen values."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.functions.nulls import col
from riskloom.operators.aggregation import fit_categories
from riskloom.operators.contract import safe_names
from riskloom.operators.ordered import quantile_dict
from riskloom.operators.profiling import dominant_value


@dataclass(frozen=True)
class Preprocessor:
    """Everything ``transform`` needs; batch and stream use the same frozen numbers."""

    medians: dict[str, float]
    centers: dict[str, float]
    scales: dict[str, float]
    modes: dict[str, str]
    categories: dict[str, list[str]]
    orders: dict[str, list[str]]
    empty: list[str]

    def input_columns(self) -> list[str]:
        return [*self.medians, *self.empty, *self.categories, *self.orders]

    def feature_names(self) -> list[str]:
        raw = [f"num__{c}" for c in [*self.medians, *self.empty]]
        raw += [f"nom__{c}_{v}" for c, values in self.categories.items() for v in values]
        raw += [f"ord__{c}" for c in self.orders]
        return safe_names(raw)

    def expressions(self, columns: Sequence[str]) -> list[str]:
        have = set(columns)

        def source(c: str, kind: str, fill: object) -> str:
            x = f"CAST({text.name(c) if c in have else 'NULL'} AS {kind})"
            return f"coalesce({x}, {text.value(fill)})"

        out = []
        for c, m in self.medians.items():
            x = source(c, "DOUBLE", m)
            if c in self.scales:
                x = f"({x} - {text.value(self.centers[c])}) / {text.value(self.scales[c])}"
            out.append(x)
        out += ["CAST(NULL AS DOUBLE)" for _ in self.empty]
        for c, values in self.categories.items():
            x = source(c, "STRING", self.modes.get(c))
            out += [f"CASE WHEN {x} = {text.value(v)} THEN 1D ELSE 0D END" for v in values]
        for c, order in self.orders.items():
            x = source(c, "STRING", self.modes.get(c))
            levels = " ".join(f"WHEN {text.value(v)} THEN {i}D" for i, v in enumerate(order))
            stop = f"raise_error(concat({text.value(f'unknown value in {c}: ')}, {x}))"
            out.append(f"CASE {x} {levels} ELSE CAST({stop} AS DOUBLE) END")
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Fixed output columns in fixed order, in one projection."""
        exprs = self.expressions(df.columns)
        return df.selectExpr(
            *[text.name(k) for k in keep], *[f"{e} AS {text.name(n)}" for e, n in zip(exprs, self.feature_names())]
        )

    def to_vector(self, df: DataFrame, keep: Sequence[str] = (), into: str = "features") -> DataFrame:
        """The encoded row as one vector, assembled before any shuffle."""
        flat = self.transform(df, keep)
        names = [n for n in self.feature_names() if n not in safe_names([f"num__{c}" for c in self.empty])]
        return VectorAssembler(inputCols=names, outputCol=into, handleInvalid="error").transform(flat).select(
            *[col(k) for k in keep], into
        )

    def vector_names(self) -> list[str]:
        skip = set(safe_names([f"num__{c}" for c in self.empty]))
        return [n for n in self.feature_names() if n not in skip]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "Preprocessor":
        return cls(**json.loads(text))


def fit_preprocessor(
    df: DataFrame,
    numeric: Sequence[str],
    nominal: Sequence[str] = (),
    ordinal: Mapping[str, Sequence[str]] | None = None,
    scale: bool = False,
    approx: bool = False,
) -> Preprocessor:
    """Medians, modes, categories and (optionally) population mean and deviation.

    A numeric column without any value is reported in ``empty`` and stays missing.
    """
    ordinal = dict(ordinal or {})
    medians = {c: v[0] for c, v in quantile_dict(df, numeric, [0.5], approx=approx).items()} if numeric else {}
    empty = [c for c in numeric if medians[c] is None]
    filled = {c: float(m) for c, m in medians.items() if m is not None}
    centers: dict[str, float] = {}
    scales: dict[str, float] = {}
    if scale and filled:
        x = [f"coalesce(CAST({text.name(c)} AS DOUBLE), {text.value(m)})" for c, m in filled.items()]
        row = df.agg(
            *[F.expr(f"avg({e}) AS a{i}") for i, e in enumerate(x)],
            *[F.expr(f"stddev_pop({e}) AS s{i}") for i, e in enumerate(x)],
        ).first()
        for i, c in enumerate(filled):
            centers[c] = float(row[f"a{i}"])
            scales[c] = float(row[f"s{i}"]) or 1.0
    texts = [*nominal, *ordinal]
    modes = {r["column"]: r["dominant_value"] for r in dominant_value(df, texts).collect()} if texts else {}
    return Preprocessor(
        filled, centers, scales, modes, fit_categories(df, list(nominal)), {c: list(v) for c, v in ordinal.items()}, empty
    )
