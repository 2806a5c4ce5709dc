"""Business ratios and score summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.nulls import col, is_true, ratio
from riskloom.operators.cleaning import cap_flag, cap_value

# Names of the application columns used by the ratios.
INCOME = "AMT_INCOME_TOTAL"
CREDIT = "AMT_CREDIT"
ANNUITY = "AMT_ANNUITY"
GOODS = "AMT_GOODS_PRICE"
BIRTH = "DAYS_BIRTH"
EMPLOYED = "DAYS_EMPLOYED"
FAMILY = "CNT_FAM_MEMBERS"
SCORES = ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")


def application_ratios(df: DataFrame) -> DataFrame:
    """The eight ratios of one application; a zero denominator gives a missing value."""
    term = ratio(col(CREDIT), col(ANNUITY))
    return df.withColumns(
        {
            "CREDIT_TERM": term,
            "AGE_AT_LOAN_END": col(BIRTH) / F.lit(-365.0) + term / F.lit(12.0),
            "ANNUITY_INCOME_PERCENT": ratio(col(ANNUITY), col(INCOME)),
            "CREDIT_INCOME_PERCENT": ratio(col(CREDIT), col(INCOME)),
            "INCOME_PER_PERSON": ratio(col(INCOME), col(FAMILY)),
            "CREDIT_GOODS_RATIO": ratio(col(CREDIT), col(GOODS)),
            "EMPLOYED_BIRTH_RATIO": ratio(col(EMPLOYED), col(BIRTH)),
            "PAYMENT_RATE": ratio(col(ANNUITY), col(CREDIT)),
        }
    )


def score_summary(df: DataFrame, scores: Sequence[str] = SCORES, prefix: str = "EXT_SOURCE_combined") -> DataFrame:
    """Smallest, largest and number of available scores."""
    cols = [col(c) for c in scores]
    available = F.lit(0)
    for c in cols:
        available = available + c.isNotNull().cast("int")
    return df.withColumns(
        {
            f"{prefix}_min": F.least(*cols),
            f"{prefix}_max": F.greatest(*cols),
            f"{prefix}_count_available": available,
        }
    )


def debt_to_income(
    df: DataFrame,
    cap: float | None = None,
    debt: str = "AMT_CREDIT_SUM_DEBT_sum",
    income: str = INCOME,
    into: str = "DEBT_TO_INCOME",
) -> DataFrame:
    """Debt over income, capped to [0, cap] with a flag.

    Debt against no income is beyond any bound, so with a cap it takes the bound and the
    flag; no debt against no income stays missing and unflagged.
    """
    value = ratio(col(debt), col(income))
    if cap is None:
        return df.withColumns({into: value})
    over = is_true((col(income) == 0) & (col(debt) > 0))
    under = is_true((col(income) == 0) & (col(debt) < 0))
    return df.withColumns(
        {
            f"{into}_CAPPED_FLAG": over | under | cap_flag(value, cap, 0.0),
            into: F.when(over, F.lit(float(cap))).when(under, F.lit(0.0)).otherwise(cap_value(value, cap, 0.0)),
        }
    )
