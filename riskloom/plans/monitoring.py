"""The monitoring report of a prediction log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from riskloom.operators.binning import fixed_histogram
from riskloom.operators.contract import bucket_width, contract_of, expand_json, since, with_status
from riskloom.operators.drift import MIN_ROWS, drift_detail, drift_summary
from riskloom.operators.timeline import (
    error_rate,
    errors_by_type,
    headline,
    latency_quantiles,
    refusal_rate,
    to_long,
    volume,
)
from riskloom.schemas import SUCCESS
from riskloom.session import checkpointed


def analyse(
    log: DataFrame, reference: DataFrame, window: str, now: datetime, exclude: Sequence[str] = ("SK_ID_CURR",)
) -> dict[str, DataFrame]:
    """Every number of the monitoring page from one scan of the log: the calls of the window are written to the shared folder.

    Rates use all calls; drift, decisions and latency use the successful ones only.
    """
    calls = checkpointed(since(log, "created_at", window, now))
    ok = with_status(calls, SUCCESS)
    width = bucket_width(window)
    quantiles = {"median": 0.5, "p95": 0.95}
    current = expand_json(ok, "features", contract_of(reference))
    out = {
        "calls": calls,
        "successes": ok,
        "headline": headline(calls),
        "errors": errors_by_type(calls),
        "volume": volume(calls, "created_at", width),
        "error_rate": error_rate(calls, "created_at", width),
        "refusal_rate": refusal_rate(ok, "created_at", width),
        "latency": to_long(latency_quantiles(ok, "created_at", "latency_ms", width, quantiles), list(quantiles)),
        "probabilities": fixed_histogram(ok, "probability", 0.0, 1.0, 20),
        "current": current,
    }
    if current.limit(MIN_ROWS).count() >= MIN_ROWS:
        detail = drift_detail(reference, current, exclude=exclude)
        out["drift"] = detail
        out["drift_summary"] = drift_summary(detail, current)
    return out
