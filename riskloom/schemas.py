"""Contracts: the request record, the prediction log, and the frozen parameters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """One field of a record: how it is parsed and what it may hold."""

    name: str
    kind: str  # "int", "float", "choice" or "text"
    required: bool = True
    gt: float | None = None
    ge: float | None = None
    le: float | None = None
    choices: tuple[str, ...] = ()

    @property
    def spark_type(self) -> T.DataType:
        return {"int": T.LongType(), "float": T.DoubleType()}.get(self.kind, T.StringType())


# Education levels from lowest to highest; the order is the encoding.
EDUCATION_LEVELS = (
    "Lower secondary",
    "Secondary / secondary special",
    "Incomplete higher",
    "Higher education",
    "Academic degree",
)

# The request record. Field order decides which error is reported first.
REQUEST_RULES = (
    Rule("SK_ID_CURR", "int", gt=0),
    Rule("AMT_INCOME_TOTAL", "float", gt=0),
    Rule("AMT_CREDIT", "float", gt=0),
    Rule("AMT_ANNUITY", "float", gt=0),
    Rule("AMT_GOODS_PRICE", "float", gt=0),
    Rule("DAYS_BIRTH", "int", ge=-25550, le=-6570),
    Rule("DAYS_EMPLOYED", "int", le=0),
    Rule("CNT_FAM_MEMBERS", "float", ge=1),
    Rule("CNT_CHILDREN", "int", ge=0),
    Rule("CODE_GENDER", "choice", choices=("F", "M", "XNA")),
    Rule("NAME_CONTRACT_TYPE", "choice", choices=("Cash loans", "Revolving loans")),
    Rule("FLAG_OWN_CAR", "choice", choices=("Y", "N")),
    Rule("FLAG_OWN_REALTY", "choice", choices=("Y", "N")),
    Rule("NAME_EDUCATION_TYPE", "choice", choices=EDUCATION_LEVELS),
    Rule("EXT_SOURCE_1", "float", required=False, ge=0, le=1),
    Rule("EXT_SOURCE_2", "float", required=False, ge=0, le=1),
    Rule("EXT_SOURCE_3", "float", required=False, ge=0, le=1),
    Rule("NAME_INCOME_TYPE", "text", required=False),
    Rule("NAME_FAMILY_STATUS", "text", required=False),
    Rule("NAME_HOUSING_TYPE", "text", required=False),
    Rule("OCCUPATION_TYPE", "text", required=False),
    Rule("ORGANIZATION_TYPE", "text", required=False),
    Rule("REGION_POPULATION_RELATIVE", "float", required=False),
)
EXTRAS = "extra_fields"

# Outcomes of one call.
SUCCESS = "succes"
REJECTED = "validation"
FAILED = "erreur"

# Columns of the prediction log.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("sk_id_curr", T.LongType()),
        T.StructField("model_version", T.StringType(), False),
        T.StructField("threshold", T.DoubleType(), False),
        T.StructField("probability", T.DoubleType()),
        T.StructField("decision", T.StringType()),
        T.StructField("history_found", T.BooleanType()),
        T.StructField("latency_ms", T.IntegerType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("error_type", T.StringType()),
        T.StructField("origine", T.StringType(), False),
        T.StructField("features", T.StringType(), False),
    ]
)
LOG_DEFAULTS = {"status": SUCCESS, "origine": "local"}


def record_schema(rules: tuple[Rule, ...] = REQUEST_RULES) -> T.StructType:
    return T.StructType([T.StructField(r.name, r.spark_type) for r in rules])


# The days columns of earlier applications that use the sentinel, and the
# document flags that are folded into one count.
PREVIOUS_DAYS = (
    "DAYS_FIRST_DRAWING",
    "DAYS_FIRST_DUE",
    "DAYS_LAST_DUE_1ST_VERSION",
    "DAYS_LAST_DUE",
    "DAYS_TERMINATION",
)
DOCUMENT_FLAGS = tuple(f"FLAG_DOCUMENT_{i}" for i in (2, 4, 5, 7, *range(9, 22)))


@dataclass(frozen=True)
class FeatureParams:
    """What training froze: two caps, the column lists, and the category lists per table."""

    amt_income_total_cap: float
    debt_to_income_cap: float
    cols_to_drop_pure: tuple[str, ...] = ()
    flag_document_quasi_constant: tuple[str, ...] = DOCUMENT_FLAGS
    cols_to_drop_housing: tuple[str, ...] = ()
    cols_to_drop_clusters: tuple[str, ...] = ()
    cols_to_drop_rate_interest: tuple[str, ...] = ()
    drop_list_restricted: tuple[str, ...] = ()
    previous_days_cols: tuple[str, ...] = PREVIOUS_DAYS
    categories: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "FeatureParams":
        raw = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def load_params(spark: SparkSession, path: str) -> FeatureParams:
    """Read frozen parameters from any file system Spark can reach."""
    return FeatureParams.from_json(spark.read.text(path, wholetext=True).first()[0])


def load_contract(spark: SparkSession, path: str, types: dict[str, T.DataType] | None = None) -> T.StructType:
    """Read an ordered JSON list of column names; types come from ``types`` or the name."""
    names = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return T.StructType([T.StructField(n, (types or {}).get(n) or guess_type(n)) for n in names])


# Text columns of the application table.
NOMINAL = (
    "NAME_CONTRACT_TYPE",
    "CODE_GENDER",
    "FLAG_OWN_CAR",
    "FLAG_OWN_REALTY",
    "NAME_TYPE_SUITE",
    "NAME_INCOME_TYPE",
    "NAME_FAMILY_STATUS",
    "NAME_HOUSING_TYPE",
    "OCCUPATION_TYPE",
    "WEEKDAY_APPR_PROCESS_START",
    "ORGANIZATION_TYPE",
    "FONDKAPREMONT_MODE",
    "HOUSETYPE_MODE",
    "WALLSMATERIAL_MODE",
    "EMERGENCYSTATE_MODE",
)
ORDINAL = {"NAME_EDUCATION_TYPE": EDUCATION_LEVELS}


def guess_type(name: str) -> T.DataType:
    """Type of an application column by its name."""
    if name in NOMINAL or name in ORDINAL:
        return T.StringType()
    if name.startswith(("SK_ID", "DAYS_")):
        return T.LongType()
    if name.startswith("FLAG_"):
        return T.IntegerType()
    return T.DoubleType()
