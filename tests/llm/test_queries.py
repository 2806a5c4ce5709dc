"""The corpus queries against their SQL texts, and the pipeline's stages against what they promise."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import compare, connect, oracle_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from riskloom.llm.common import staged, table  # noqa: E402
from riskloom.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    assert compare(df.columns, [tuple(r) for r in df.collect()], *oracle_rows(connect(data_dir), ORACLES[name])) == ""


def test_stages(spark, data_dir):
    docs = table(spark, data_dir, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in table(spark, data_dir, "labels").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, data_dir), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, single, cut, packed = ({r.doc_id: r for r in seen[n].collect()} for n, _ in corpus_pipeline.STAGES)
    labelled = [i for i in before if i in quality]
    assert sum((i in good) == bool(quality[i]) for i in labelled) >= 0.95 * len(labelled)
    texts = [r.text for r in single.values()]
    assert len(texts) == len(set(texts)) and set(single) <= set(good)
    assert set(cut) == set(single) and all(r.n_chars == len(r.text) for r in cut.values() if r.text != before[r.doc_id].text)
    assert set(packed) == {i for i, r in cut.items() if r.text.split()}
