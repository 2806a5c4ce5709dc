"""Every registered query against its SQL text on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from compare import compare, connect, oracle_rows  # noqa: E402

from riskloom.catalog import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        assert compare(df.columns, rows, *oracle_rows(connect(data_dir), ORACLES[name])) == ""
    else:
        assert rows


def test_every_text_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
