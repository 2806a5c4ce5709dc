"""Training, out-of-fold scores, search, importance, attribution and batch scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.functions.nulls import col
from riskloom.functions.scalars import SPREAD_RANGE, class_weight, decision, spread
from riskloom.operators.evaluation import class_metrics, roc_auc
from riskloom.operators.profiling import class_ratio
from riskloom.session import checkpointed


#: A family's estimator for rows with so many features.
Family = Callable[[int], Estimator]


def baselines(weight: str | None = None, label: str = "label", seed: int = 42) -> dict[str, Family]:
    """The model families compared before tuning."""
    kw = {"featuresCol": "features", "labelCol": label}
    w = {"weightCol": weight} if weight else {}
    return {
        "logistic": lambda width: LogisticRegression(maxIter=100, **kw, **w),
        "forest": lambda width: RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, **kw, **w),
        "boosted": lambda width: GBTClassifier(maxIter=30, maxDepth=4, seed=seed, **kw, **w),
        "perceptron": lambda width: MultilayerPerceptronClassifier(layers=[width, 16, 2], maxIter=100, seed=seed, **kw),
    }


#: From the rows that may be learnt from to a function that makes any rows ready for a model.
Prepare = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def weights_of(df: DataFrame, label: str, into: str = "weight") -> Callable[[DataFrame], DataFrame]:
    """A function that balances the classes as ``df`` has them: positives weigh as much as there are
    negatives per positive."""
    r = float(class_ratio(df, label).first()["class_ratio"] or 1.0)
    return lambda rows: rows.withColumn(into, class_weight(col(label), r))


def weighted(df: DataFrame, label: str, into: str = "weight") -> DataFrame:
    """``df`` with its own classes balanced."""
    return weights_of(df, label, into)(df)


def as_it_is(known: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Nothing to prepare."""
    return lambda rows: rows


def dummy_scores(df: DataFrame, key: str, label: str, seed: int = 42, into: str = "score") -> DataFrame:
    """0/1 guesses drawn with the prior of the positive class, repeatable by key."""
    prior = df.agg(F.avg(col(label).cast("double")).alias("p")).first()["p"]
    draw = spread(col(key), seed) / F.lit(float(SPREAD_RANGE))
    return df.withColumn(into, F.when(draw < F.lit(float(prior)), F.lit(1.0)).otherwise(F.lit(0.0)))


def with_probability(scored: DataFrame, into: str = "score") -> DataFrame:
    """Probability of the positive class as a plain number."""
    rest = [c for c in scored.columns if c not in ("rawPrediction", "probability", "prediction", into)]
    return scored.select(*[col(c) for c in rest], vector_to_array("probability")[1].alias(into))


def out_of_fold(
    df: DataFrame, estimator: Estimator, folds: int = 5, fold: str = "fold", sides: bool = False, prepare: Prepare = as_it_is
) -> DataFrame:
    """Score every row by a model that did not see it. With ``sides`` the training rows of each
    fold are scored too; ``side`` tells them apart.

    ``prepare`` is fitted on the training rows of each fold (fills, scales, categories, weights),
    so nothing of the held-out rows reaches the model. The rows are written to the shared folder
    once: every fit passes over them, and a lost executor must not bring the feature building back."""
    return family_scores(df, {"": lambda width: estimator}, folds, fold, sides, prepare).drop("family")


#: Fits that run at a time.
SIDE_BY_SIDE = 4


def family_scores(
    df: DataFrame,
    families: Mapping[str, Family],
    folds: int = 5,
    fold: str = "fold",
    sides: bool = False,
    prepare: Prepare = as_it_is,
    side_by_side: int = SIDE_BY_SIDE,
) -> DataFrame:
    """Out-of-fold scores of several model families: ``family``, ``held_out`` and ``score`` with every row.

    Each fold is prepared once for all families, and the fits of folds and families run ``side_by_side`` at a time on one
    stored table: one fit alone leaves executors idle at the end of each of its passes.
    """
    data = checkpointed(df)

    def prepared(i: int) -> tuple[Callable[[DataFrame], DataFrame], DataFrame, int]:
        known = data.where(col(fold) != i)
        ready = prepare(known)
        train = checkpointed(ready(known)) if len(families) > 1 else ready(known)
        first = train.select("features").first()
        return ready, train, first["features"].size if first else 0

    def fitted(job: tuple[str, int]) -> DataFrame:
        name, i = job
        ready, train, width = folds_ready[i]
        model = families[name](width).fit(train)
        rows = data if sides else data.where(col(fold) == i)
        scored = with_probability(model.transform(ready(rows))).withColumns({"held_out": F.lit(i), "family": F.lit(name)})
        if sides:
            scored = scored.withColumn("side", F.when(col(fold) == i, F.lit("validation")).otherwise(F.lit("train")))
        return scored

    jobs = [(name, i) for name in families for i in range(folds)]
    folds_ready = [prepared(i) for i in range(folds)]
    with ThreadPoolExecutor(max_workers=side_by_side) as pool:
        parts = list(pool.map(inheritable_thread_target(data.sparkSession)(fitted), jobs))
    return reduce(DataFrame.unionByName, parts)


def family_table(scores: DataFrame, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """AUC, recall, F1, F2 and business cost of every family over its out-of-fold scores."""
    auc = roc_auc(scores, label, "score", by=["family"]).select("family", "auc")
    return auc.join(class_metrics(scores, label, "score", threshold, by=["family"]).select("family", "recall", "f1", "f2", "cost"), "family")


def fold_auc(oof: DataFrame, label: str = "label", score: str = "score", fold: str = "held_out") -> DataFrame:
    return roc_auc(oof, label, score, by=[fold])


def train_validation_gap(df: DataFrame, estimator: Estimator, folds: int = 5, label: str = "label", prepare: Prepare = as_it_is) -> DataFrame:
    """Mean AUC on training and held-out rows, and the gap between them."""
    per = roc_auc(out_of_fold(df, estimator, folds, sides=True, prepare=prepare), label, "score", by=["held_out", "side"])
    means = per.groupBy().agg(
        F.avg(F.when(F.col("side") == "train", F.col("auc"))).alias("train_auc"),
        F.avg(F.when(F.col("side") == "validation", F.col("auc"))).alias("validation_auc"),
    )
    return means.withColumn("gap", F.col("train_auc") - F.col("validation_auc"))


def search(
    df: DataFrame,
    estimator: Estimator,
    grid: Mapping[str, Sequence[object]],
    folds: int = 5,
    fold: str = "fold",
    label: str = "label",
    prepare: Prepare = as_it_is,
) -> tuple[Model, DataFrame]:
    """Grid search by mean cross-validated AUC on the given folds: best model and all trials.

    ``prepare`` is fitted on each fold's training rows, and on all rows for the best model."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    maps = builder.build()
    evaluator = BinaryClassificationEvaluator(labelCol=label, numBins=0)  # every threshold, at any size
    data, totals = checkpointed(df), [0.0] * len(maps)
    for i in range(folds):
        known = data.where(col(fold) != i)
        ready = prepare(known)
        train, held = ready(known), ready(data.where(col(fold) == i))
        for m, model in estimator.fitMultiple(train, maps):
            totals[m] += evaluator.evaluate(model.transform(held))
    rows = [(i, str({p.name: v for p, v in m.items()}), t / folds) for i, (m, t) in enumerate(zip(maps, totals))]
    best = max(range(len(maps)), key=lambda i: (totals[i], -i))
    trials = df.sparkSession.createDataFrame(rows, "trial int, params string, mean_auc double")
    return estimator.fit(prepare(data)(data), maps[best]), trials.orderBy(F.desc("mean_auc"), "trial")


def importance(df: DataFrame, model: Model, names: Sequence[str]) -> DataFrame:
    """Importance per feature, ranked; absolute coefficients for a linear model."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(n, float(abs(v))) for n, v in zip(names, values.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def linear_attribution(
    df: DataFrame, key: str, columns: Sequence[str], weights: Sequence[float], means: Sequence[float], top: int = 5
) -> DataFrame:
    """Largest contributions weight * (value - mean) of each row: (key, rank, feature, contribution)."""
    records = []
    for c, w, m in zip(columns, weights, means):
        part = f"{text.value(float(w))} * ({text.name(c)} - {text.value(float(m))})"
        records.append(
            f"named_struct('size', abs({part}), 'feature', {text.value(c)}, 'contribution', {part}, "
            f"'value', CAST({text.name(c)} AS DOUBLE))"
        )
    ordered = f"slice(sort_array(array({', '.join(records)}), false), 1, {int(top)})"
    return df.selectExpr(text.name(key), f"posexplode({ordered}) AS (pos, p)").selectExpr(
        text.name(key), "pos + 1 AS rank", "p.feature", "p.contribution", "p.value"
    )


def global_attribution(
    df: DataFrame, columns: Sequence[str], weights: Sequence[float], means: Sequence[float]
) -> DataFrame:
    """Mean absolute contribution per feature."""
    parts = [
        F.expr(f"avg(abs({text.value(float(w))} * ({text.name(c)} - {text.value(float(m))}))) AS a{i}")
        for i, (c, w, m) in enumerate(zip(columns, weights, means))
    ]
    cells = text.rows([{"feature": text.value(c), "mean_abs": f"a{i}"} for i, c in enumerate(columns)])
    return df.agg(*parts).selectExpr(cells).orderBy(F.desc("mean_abs"), "feature")


#: Rows of a stretch of the drawn order within which values change places; one task orders a stretch.
STRETCH = 1_000_000


def permuted(df: DataFrame, key: str, columns: Sequence[str], seed: int = 42, stretch: int = STRETCH) -> DataFrame:
    """``df`` with ``<column>__drawn`` for every column: its value in another row, all of them from one numbering.

    Rows are put in an order drawn by key and seed and cut into stretches; the i-th column is taken from the row i places on,
    round the stretch. In a random order any fixed distance gives a random partner, and different columns get different ones,
    so one exchange and one ordering serve any number of columns.
    """
    parts = max(1, math.ceil(df.count() / stretch))
    drawn = F.coalesce(spread(col(key), seed), F.lit(0))
    cut = df.withColumns({"__order": drawn, "__part": F.floor(drawn * parts / SPREAD_RANGE).cast("int")})
    inside = Window.partitionBy("__part").orderBy("__order", col(key))
    placed = cut.withColumns({"__at": F.row_number().over(inside) - 1, "__size": F.count(F.lit(1)).over(Window.partitionBy("__part"))})
    # The first rows once more behind the last ones, as partners only; they stay in their partition.
    again = placed.withColumn("__place", F.explode(F.sequence(F.col("__at").cast("bigint"), F.col("__size") + len(columns) - 1, F.col("__size"))))
    round_ = Window.partitionBy("__part").orderBy("__place")
    partners = {f"{c}__drawn": F.lead(col(c), i).over(round_) for i, c in enumerate(columns, 1)}
    whole = again.withColumns(partners).where(F.col("__place") < F.col("__size"))
    return whole.drop("__order", "__part", "__at", "__size", "__place")


def permutation_importance(
    df: DataFrame, key: str, columns: Sequence[str], label: str, score: Callable[[DataFrame], DataFrame], seed: int = 42
) -> DataFrame:
    """Loss of AUC when one column is shuffled; ``score`` adds a ``score`` column. All variants of a row, the untouched one
    among them, are scored together, and all their AUCs are taken in one pass."""
    rows = permuted(df, key, columns, seed)
    whole = [col(c) for c in df.columns]
    variants = [F.struct(F.lit(None).cast("string").alias("__feature"), *whole)]
    variants += [F.struct(F.lit(c).alias("__feature"), *[col(f"{n}__drawn").alias(n) if n == c else col(n) for n in df.columns]) for c in columns]
    each = rows.select(F.explode(F.array(*variants)).alias("v")).select("v.*")
    found = roc_auc(score(each).withColumn("feature", F.coalesce("__feature", F.lit(""))), label, "score", by=["feature"])
    base = F.max(F.when(F.col("feature") == "", F.col("auc"))).over(Window.partitionBy(F.lit(0)))  # one row per column
    return (
        found.select("feature", (base - F.col("auc")).alias("auc_loss")).where("feature <> ''").orderBy(F.desc("auc_loss"), "feature")
    )


def score_with(
    df: DataFrame,
    columns: Sequence[str],
    predict: Callable[[np.ndarray], np.ndarray],
    keep: Sequence[str],
    into: str = "probability",
    most_bytes: int = 256 << 20,
) -> DataFrame:
    """Score with a model Spark does not know: ``predict`` gets a (rows, columns) array per
    batch. The model is broadcast once per executor; one of more than ``most_bytes`` is an error, and
    is better read by ``predict`` from a path that all executors share."""
    narrow = df.select(*[col(k) for k in keep], *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    packed = cloudpickle.dumps(predict)
    if len(packed) > most_bytes:
        raise ValueError(f"a model of {len(packed)} bytes is too large to send to every executor")
    holder = df.sparkSession.sparkContext.broadcast(packed)
    inputs = [f"x{i}" for i in range(len(columns))]
    keys = list(keep)
    schema = narrow.select(*[col(k) for k in keep], F.lit(0.0).alias(into)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = cloudpickle.loads(holder.value)
        for pdf in batches:
            out = pdf[keys].copy()
            out[into] = np.asarray(model(pdf[inputs].to_numpy(dtype="float64")), dtype="float64")
            yield out

    return narrow.mapInPandas(run, schema)


def stamp(df: DataFrame, threshold: float, version: str, origin: str, probability: str = "probability") -> DataFrame:
    """Decision and provenance of each score."""
    return df.withColumns(
        {
            "threshold": F.lit(float(threshold)),
            "decision": decision(col(probability), threshold),
            "model_version": F.lit(version),
            "origine": F.lit(origin),
        }
    )
