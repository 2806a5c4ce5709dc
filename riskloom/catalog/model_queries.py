"""Preprocessing, evaluation, training and scoring over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.catalog.registry import query
from riskloom.catalog.views import r, settled, table, view, with_views
from riskloom.functions.nulls import col
from riskloom.functions.scalars import spread_sql
from riskloom.operators import evaluation, modeling, preparation, sampling
from riskloom.schemas import EDUCATION_LEVELS
from riskloom.session import checkpointed, staging_path
from riskloom.sources import writers

# --- evaluation ----------------------------------------------------------------------------


@query(
    "auc",
    with_views(
        "scored",
        body=f""", g as (select score, cast(sum(label) as double) as pos, cast(count(*) - sum(label) as double) as neg from scored group by score),
        w as (select pos, neg, sum(neg) over (order by score) - neg as below from g)
        select cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg,
          {r("sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))", 6)} as auc from w""",
    ),
)
def auc(spark, sf_dir):
    return settled(evaluation.roc_auc(view(spark, sf_dir, "scored"), "label", "score"), 6)


@query(
    "auc_by_group",
    f"""with s as (select lang, n_chars % 50 as score, quality from documents join labels using (doc_id)),
    g as (select lang, score, cast(sum(quality) as double) as pos, cast(count(*) - sum(quality) as double) as neg from s group by 1, 2),
    w as (select lang, pos, neg, sum(neg) over (partition by lang order by score) - neg as below from g)
    select lang, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg,
      {r("sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0)", 6)} as auc from w group by lang""",
)
def auc_by_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", ["doc_id", "lang", "n_chars"])
    rows = docs.join(table(spark, sf_dir, "labels", ["doc_id", "quality"]), "doc_id")
    return settled(evaluation.roc_auc(rows.withColumn("score", F.col("n_chars") % 50), "quality", "score", by=["lang"]), 6)


CELLS = """, cells as (select cast(count(*) filter (where label = 1 and score >= 0.5) as double) as tp,
    cast(count(*) filter (where label = 0 and score >= 0.5) as double) as fp,
    cast(count(*) filter (where label = 1 and score < 0.5) as double) as fn,
    cast(count(*) filter (where label = 0 and score < 0.5) as double) as tn from scored)"""


@query(
    "confusion_metrics",
    with_views(
        "scored",
        body=CELLS
        + f""" select cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn,
        {r("(tp + tn) / (tp + tn + fp + fn)")} as accuracy, {r("tp / (tp + fp)")} as precision, {r("tp / (tp + fn)")} as recall,
        {r("2 * tp / (2 * tp + fn + fp)")} as f1, {r("5 * tp / (5 * tp + 4 * fn + fp)")} as f2, cast(10 * fn + fp as bigint) as cost from cells""",
    ),
)
def confusion_metrics(spark, sf_dir):
    return settled(evaluation.class_metrics(view(spark, sf_dir, "scored"), "label", "score", 0.5))


@query(
    "business_cost",
    with_views(
        "scored",
        body="""select cast(sum(case when label = 1 and score <= 0.24 then 10 when label = 0 and score > 0.24 then 1 else 0 end) as bigint) as cost
        from scored""",
    ),
)
def business_cost(spark, sf_dir):
    rows = view(spark, sf_dir, "scored").withColumn("predicted", (F.col("score") > 0.24).cast("int"))
    return evaluation.business_cost(rows, "label", "predicted")


SWEEP = """, grid as (select (range + 10) / 100e0 as threshold from range(81)),
    sweep as (select threshold, count(*) filter (where label = 1 and score < threshold) as fn,
      count(*) filter (where label = 0 and score >= threshold) as fp from grid, scored group by threshold)"""


@query("threshold_sweep", with_views("scored", body=SWEEP + " select threshold, fn, fp, 10 * fn + fp as cost from sweep"))
def threshold_sweep(spark, sf_dir):
    return evaluation.threshold_sweep(view(spark, sf_dir, "scored"), "label", "score")


@query(
    "best_threshold",
    with_views("scored", body=SWEEP + " select threshold, 10 * fn + fp as cost from sweep order by cost, threshold limit 1"),
)
def best_threshold(spark, sf_dir):
    return evaluation.best_threshold(evaluation.threshold_sweep(view(spark, sf_dir, "scored"), "label", "score"))


@query(
    "refusal_rate",
    with_views("scored", body=f"select {r('avg(case when score > 0.24 then 1 else 0 end)')} as refusal_rate from scored"),
)
def refusal_rate(spark, sf_dir):
    return settled(evaluation.refusal_share(view(spark, sf_dir, "scored"), "score", 0.24))


@query(
    "score_extremes",
    with_views(
        "scored",
        body="""select (select doc_id from scored order by score desc, doc_id limit 1) as highest,
        (select doc_id from scored order by score, doc_id limit 1) as lowest, max(score) as highest_score, min(score) as lowest_score from scored""",
    ),
)
def score_extremes(spark, sf_dir):
    return evaluation.extremes(view(spark, sf_dir, "scored"), "doc_id", "score")


# --- preprocessing -------------------------------------------------------------------------

NUMERIC = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "DAYS_BIRTH", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "FLAG_DOCUMENT_2"]
NOMINAL = ["CODE_GENDER", "NAME_INCOME_TYPE", "FLAG_OWN_REALTY"]
ORDINAL = {"NAME_EDUCATION_TYPE": EDUCATION_LEVELS}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _fitted(app: DataFrame, scale: bool = False) -> preparation.Preprocessor:
    return preparation.fit_preprocessor(app, NUMERIC, NOMINAL, ORDINAL, scale=scale)


def _median(c: str) -> str:
    return f"coalesce(cast({c} as double), (select quantile_cont(cast({c} as double), 0.5) from app))"


def _mode(c: str) -> str:
    return f"coalesce({c}, (select {c} from app where {c} is not null group by {c} order by count(*) desc, {c} limit 1))"


LEVELS = " ".join(f"when '{v}' then {i}e0" for i, v in enumerate(EDUCATION_LEVELS))
ENCODED = (
    [f"{r(_median(c))} as num__{c}" for c in NUMERIC]
    + [f"case when {_mode('CODE_GENDER')} = '{v}' then 1e0 else 0e0 end as nom__CODE_GENDER_{v}" for v in ["F", "M", "XNA"]]
    + [f"case when {_mode('NAME_INCOME_TYPE')} = '{v}' then 1e0 else 0e0 end as nom__NAME_INCOME_TYPE_{v}" for v in SEGMENTS]
    + [f"case when {_mode('FLAG_OWN_REALTY')} = '{v}' then 1e0 else 0e0 end as nom__FLAG_OWN_REALTY_{v}" for v in ["N", "Y"]]
    + [f"case {_mode('NAME_EDUCATION_TYPE')} {LEVELS} end as ord__NAME_EDUCATION_TYPE"]
)


@query("impute_encode", with_views("app", body="select SK_ID_CURR, " + ", ".join(ENCODED) + " from app"))
def impute_encode(spark, sf_dir):
    app = view(spark, sf_dir, "app")
    return settled(_fitted(app).transform(app, ["SK_ID_CURR"]))


@query(
    "scale_numeric",
    with_views(
        "app",
        body=", filled as (select SK_ID_CURR, "
        + ", ".join(f"{_median(c)} as {c}" for c in ["AMT_INCOME_TOTAL", "EXT_SOURCE_1"])
        + f""" from app) select SK_ID_CURR, {r("(AMT_INCOME_TOTAL - avg(AMT_INCOME_TOTAL) over ()) / stddev_pop(AMT_INCOME_TOTAL) over ()")}
        as num__AMT_INCOME_TOTAL, {r("(EXT_SOURCE_1 - avg(EXT_SOURCE_1) over ()) / stddev_pop(EXT_SOURCE_1) over ()")} as num__EXT_SOURCE_1
        from filled""",
    ),
)
def scale_numeric(spark, sf_dir):
    app = view(spark, sf_dir, "app")
    fitted = preparation.fit_preprocessor(app, ["AMT_INCOME_TOTAL", "EXT_SOURCE_1"], scale=True)
    return settled(fitted.transform(app, ["SK_ID_CURR"]))


# --- scoring with fixed weights ------------------------------------------------------------

WEIGHTS = {"EXT_SOURCE_1": -2.5, "EXT_SOURCE_2": -1.25, "EXT_SOURCE_3": 0.5}
MEANS = {"EXT_SOURCE_1": 0.5, "EXT_SOURCE_2": 0.4, "EXT_SOURCE_3": 0.6}


def _known(spark, sf_dir) -> DataFrame:
    """Every client; a missing score is the model's mean."""
    return view(spark, sf_dir, "app").select("SK_ID_CURR", *[F.coalesce(col(c), F.lit(MEANS[c])).alias(c) for c in WEIGHTS])


KNOWN = ", known as (select SK_ID_CURR, " + ", ".join(f"coalesce({c}, {MEANS[c]}e0) as {c}" for c in WEIGHTS) + " from app)"
LOGIT = " + ".join(f"({w}e0) * {c}" for c, w in WEIGHTS.items())


@query(
    "score_foreign_model",
    with_views(
        "app",
        body=KNOWN
        + f""" select SK_ID_CURR, {r(f"1 / (1 + exp(-(1 + {LOGIT})))")} as probability, 0.24e0 as threshold,
        case when 1 / (1 + exp(-(1 + {LOGIT}))) > 0.24 then 'refusé' else 'accordé' end as decision, 'v4' as model_version,
        'local' as origine from known""",
    ),
)
def score_foreign_model(spark, sf_dir):
    """A model that is a plain Python function over arrays, applied batch by batch."""
    weights = np.array(list(WEIGHTS.values()))

    def predict(x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(1.0 + x @ weights)))

    scored = modeling.score_with(_known(spark, sf_dir), list(WEIGHTS), predict, ["SK_ID_CURR"])
    return settled(modeling.stamp(scored, 0.24, "v4", "local"))


ATTRIBUTION = KNOWN + ", parts as (" + " union all ".join(
    f"select SK_ID_CURR, '{c}' as feature, ({w}e0) * ({c} - {MEANS[c]}e0) as contribution, {c} as value from known" for c, w in WEIGHTS.items()
) + ")"


@query(
    "linear_attribution",
    with_views(
        "app",
        body=ATTRIBUTION
        + f""" select SK_ID_CURR, cast(rank as int) as rank, feature, {r("contribution")} as contribution, {r("value")} as value from (
          select *, row_number() over (partition by SK_ID_CURR order by abs(contribution) desc, feature desc) as rank from parts) t where rank <= 2""",
    ),
)
def linear_attribution(spark, sf_dir):
    rows = _known(spark, sf_dir)
    return settled(modeling.linear_attribution(rows, "SK_ID_CURR", list(WEIGHTS), list(WEIGHTS.values()), list(MEANS.values()), 2))


@query(
    "global_attribution",
    with_views("app", body=ATTRIBUTION + f" select feature, {r('avg(abs(contribution))')} as mean_abs from parts group by feature"),
)
def global_attribution(spark, sf_dir):
    return settled(
        modeling.global_attribution(_known(spark, sf_dir), list(WEIGHTS), list(WEIGHTS.values()), list(MEANS.values()))
    )


# --- training (results depend on the optimiser, so no SQL text) -----------------------------


def _training_rows(spark, sf_dir) -> tuple[DataFrame, preparation.Preprocessor]:
    app = view(spark, sf_dir, "app")
    fitted = _fitted(app, scale=True)
    vectors = fitted.to_vector(app, ["SK_ID_CURR", "TARGET"]).withColumnRenamed("TARGET", "label")
    return checkpointed(modeling.weighted(vectors, "label")), fitted


def _folded(spark, sf_dir, folds: int) -> DataFrame:
    """Raw rows with a fold; fills, scales, categories and weights are fitted inside the folds."""
    rows = view(spark, sf_dir, "app").select("SK_ID_CURR", *NUMERIC, *NOMINAL, *ORDINAL, F.col("TARGET").alias("label"))
    return sampling.stratified_folds(rows, "SK_ID_CURR", "label", folds)


def _prepared(known: DataFrame):
    fitted, weigh = _fitted(known, scale=True), modeling.weights_of(known, "label")
    return lambda rows: weigh(fitted.to_vector(rows, ["SK_ID_CURR", "label", "fold"]))


def _logistic() -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=20)


@query("fit_score_batch")
def fit_score_batch(spark, sf_dir):
    """Train on all rows, score all rows, decide, and stamp the provenance."""
    rows, _ = _training_rows(spark, sf_dir)
    model = _logistic().fit(rows)
    scored = modeling.with_probability(model.transform(rows), "probability").select("SK_ID_CURR", "probability")
    return modeling.stamp(scored, 0.24, "logistic-1", "local")


@query("oof_auc")
def oof_auc(spark, sf_dir):
    """AUC of each held-out fold."""
    return settled(modeling.fold_auc(modeling.out_of_fold(_folded(spark, sf_dir, 5), _logistic(), prepare=_prepared)))


@query("train_validation_gap")
def train_validation_gap(spark, sf_dir):
    """Mean AUC on training and held-out rows."""
    return settled(modeling.train_validation_gap(_folded(spark, sf_dir, 5), _logistic(), folds=5, prepare=_prepared))


@query("hyper_search")
def hyper_search(spark, sf_dir):
    """Grid search on three stratified folds."""
    _, trials = modeling.search(_folded(spark, sf_dir, 3), _logistic(), {"regParam": [0.0, 0.1]}, folds=3, prepare=_prepared)
    return settled(trials)


@query("importance_top")
def importance_top(spark, sf_dir):
    """Feature importance of a forest, written as the top of a CSV file and read back."""
    rows, fitted = _training_rows(spark, sf_dir)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=20, maxDepth=5, seed=42)
    path = staging_path(spark, "importance")
    writers.write_top_importance(modeling.importance(rows, forest.fit(rows), fitted.vector_names()), path, 30)
    return spark.read.option("header", True).schema("feature string, importance double").csv(path)


SHUFFLED = ["EXT_SOURCE_1", "EXT_SOURCE_2"]


def _auc_of(score: str, name: str) -> str:
    """Rank sum of the positives, average ranks on ties."""
    return f"""select '{name}' as feature, (sum(place) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0e0)
      / (cast(count(*) filter (where y = 1) as double) * count(*) filter (where y <> 1)) as auc from (
        select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0e0 as place from (select TARGET as y, {score} as s from partners) a) b"""


def _shuffled_score(shuffled: str) -> str:
    return " + ".join(f"({w}e0) * {c}{'__drawn' if c == shuffled else ''}" for c, w in WEIGHTS.items())


@query(
    "permutation_importance",
    with_views(
        "app",
        body=", rows_ as (select SK_ID_CURR, TARGET, "
        + ", ".join(f"coalesce({c}, 0.5e0) as {c}" for c in WEIGHTS)
        + f""" from app), placed as (select *, row_number() over (order by {spread_sql("SK_ID_CURR")}, SK_ID_CURR) - 1 as p, count(*) over () as n from rows_),
        partners as (select a.*, """
        + ", ".join(f"x{i}.{c} as {c}__drawn" for i, c in enumerate(SHUFFLED, 1))
        + " from placed a "
        + " ".join(f"join placed x{i} on x{i}.p = (a.p + {i}) % a.n" for i in range(1, len(SHUFFLED) + 1))
        + "), aucs as ("
        + " union all ".join(_auc_of(_shuffled_score(c), c) for c in ["", *SHUFFLED])
        + f") select feature, {r("(select auc from aucs where feature = '') - auc")} as auc_loss from aucs where feature <> ''",
    ),
)
def permutation_importance(spark, sf_dir):
    """AUC lost when a score is shuffled between clients."""
    rows = view(spark, sf_dir, "app").select("SK_ID_CURR", "TARGET", *[F.coalesce(col(c), F.lit(0.5)).alias(c) for c in WEIGHTS])
    score = " + ".join(f"({w}D) * {c}" for c, w in WEIGHTS.items())
    return settled(
        modeling.permutation_importance(rows, "SK_ID_CURR", SHUFFLED, "TARGET", lambda d: d.withColumn("score", F.expr(score)))
    )


@query("baseline_comparison")
def baseline_comparison(spark, sf_dir):
    """Four model families and the dummy over the same three folds, by AUC, recall, F1, F2 and cost."""
    rows = _folded(spark, sf_dir, 3)
    scores = modeling.family_scores(rows, modeling.baselines("weight"), 3, prepare=_prepared).select("family", "SK_ID_CURR", "label", "score")
    dummy = modeling.dummy_scores(rows, "SK_ID_CURR", "label").select(F.lit("dummy").alias("family"), "SK_ID_CURR", "label", "score")
    return settled(modeling.family_table(scores.unionByName(dummy)))
