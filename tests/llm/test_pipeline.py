"""The stages of the pipeline on odd rows and against brute force; what the operators promise of repeated ids and scale."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import chosen_path, fingerprint, quality, separators

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def written(spark, tmp_path, rows, labels):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def prose(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(k)}" for k in rng.integers(0, 10**6, n))


A, B, C = prose(1), prose(2), prose(3)
NEAR = A.replace(A.split()[40], "changed")
ROWS = [(1, A), (2, NEAR), (3, B), (3, B), (4, None), (5, ""), (5, ""), (None, C), (None, C), (6, C), (7, "few"), (8, f"{prose(4)} {B}"), (9, B), (9, prose(9))]


def test_one_of_each_keeps_one_of_repeated_rows(spark):
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, frame(spark, ROWS), "").collect()), key=str)
    # 9 has the text of 3 and one of its own, so that 3, the smallest, stands for both.
    assert got == sorted([(1, A), (3, B), (4, None), (5, ""), (None, C), (None, C), (6, C), (7, "few"), (8, ROWS[11][1])], key=str)


def test_passages_go_from_later_documents(spark):
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.without_passages(spark, frame(spark, [(8, ROWS[11][1]), (3, B), (None, B), (4, None), (10, "a  b")]), "").collect()), key=str)
    first = prose(4)
    assert [(i, WORD.findall(t)) for i, t, _ in got] == sorted([(8, first.split()), (3, B.split()), (None, B.split()), (4, []), (10, ["a", "b"])], key=str)
    assert next(n for i, _, n in got if i == 8) == len(next(t for i, t, _ in got if i == 8))


def test_stages_take_empty_tables_and_odd_rows(spark, tmp_path):
    folder = written(spark, tmp_path, ROWS, [(1, 1, 0), (None, 1, 0), (3, None, 0)])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), folder).collect() == []
        assert stage(spark, frame(spark, [(4, None), (None, None), (5, "")]), folder).count() in (0, 3)


def test_the_whole_run_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    shared = prose(77, 60)
    rows, labels = [], []
    for i in range(90):
        text = prose(100 + i, int(rng.integers(60, 200)))
        if i % 9 == 4:
            text = " ".join(f"{w}###" for w in text.split())
        elif i % 9 == 5:
            text = rows[i - 5][1].replace(" w1", " z1", 1)
        elif i % 9 == 7:
            text = f"{text} {shared} {prose(500 + i, 30)}"
        rows.append((i, text))
        labels.append((i, int(i % 9 != 4), 0))
    folder = written(spark, tmp_path, rows, labels)
    kept = {i: t for i, t in rows if i % 9 != 4}

    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    single = {}
    for i, t in sorted(kept.items()):
        s = shingles(t)
        if not any(5 * len(s & shingles(u)) >= 4 * len(s | shingles(u)) for u in single.values()):
            single[i] = t
    cut = {}
    for i, t in sorted(single.items()):
        words, gone = t.split(), set()
        earlier = {tuple(u.split()[k : k + 50]) for j, u in single.items() if j < i for k in range(len(u.split()) - 49)}
        for k in range(len(words) - 49):
            if tuple(words[k : k + 50]) in earlier:
                gone |= set(range(k, k + 50))
        cut[i] = [w for k, w in enumerate(words) if k not in gone]
    got = {r.doc_id: WORD.findall(r.text) for r in corpus_pipeline.cleaned(spark, folder).collect()}
    assert got == cut and len(cut) < len(single) + 1 and any(len(cut[i]) < len(single[i].split()) for i in cut)
    packs = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.n_tokens for r in packs} == {i: len(w) for i, w in cut.items()}


# 9


def test_texts_that_share_an_id_keep_their_links(spark):
    a, b = prose(21), prose(22)
    rows = [(5, a), (5, b), (7, a.replace(a.split()[3], "x")), (8, b.replace(b.split()[3], "x")), (9, prose(23)), (10, b), (5, "")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in chosen_path.near_duplicates(frame(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items() if k[1]} == {(5, 76): 5, (7, 76): 5, (8, 76): 5, (9, 76): 9, (10, 76): 5}
    assert got[(5, 0)] == (5, True) and not got[(8, 76)][1]


# 2


def test_ids_of_every_value_and_no_broadcast(spark, tmp_path, monkeypatch):
    least = -(1 << 63)
    rows = [(least, "a"), (None, "b"), (0, "c"), ((1 << 63) - 1, "")]
    ranks = [(bytes([i]), i) for i in range(256)]
    out = separators.counted_documents(frame(spark, rows), ranks, r"\S+", 50_256)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString().split("Location")[0]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in out.collect()) == [(False, 0, 1), (True, least, 1), (True, 0, 1), (True, (1 << 63) - 1, 0)]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_files_of_any_size_give_the_same_counts(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(separators, "WHOLE_FILE", limit)
    tokens = np.array([1, 2, 9] * 500 + [4, 4], dtype="<u2")
    (tmp_path / "part-0").write_bytes(tokens.tobytes())
    rows = separators.count_tokens(spark, str(tmp_path), 9, 64).collect()
    assert len(rows) == 501 and {r.n_tokens for r in rows} == {2} and sorted(r.first_token for r in rows) == [3 * i for i in range(501)]


# 3


def test_scores_come_from_the_kernel_alone(spark):
    """The Fourier model is close to the exact Gaussian kernel ridge of its width and penalty."""
    rng = np.random.default_rng(6)
    width = len(quality.statistics(""))
    stats = rng.normal(size=(500, width)) * np.linspace(0.5, 2, width)
    good = (stats[:, 0] + np.sin(stats[:, 1]) > 0).astype(int)
    rows = [(x.tolist(), int(y), i % 2) for i, (x, y) in enumerate(zip(stats[:400], good))]
    df = spark.createDataFrame(rows, "stats array<double>, quality int, fold int")
    scorer = quality.fit(df, features=800)
    assert len(scorer.weights) == 801 and scorer.features(stats).shape == (500, 801)
    z = np.clip((stats - scorer.centre) / scorer.scale, -8, 8)
    base = scorer.width / scorer.directions.std()
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2) / (2 * base**2))
    agree = {}
    for ridge in quality.RIDGES:
        y = 2.0 * good[:400] - 1
        exact = kernel[400:, :400] @ np.linalg.solve(kernel[:400, :400] + ridge * 400 * np.eye(400), y - y.mean()) + y.mean()
        agree[ridge] = np.corrcoef(exact, scorer.raw(stats[400:]))[0, 1]
    assert max(agree.values()) > 0.95
    assert ((scorer.score(stats[400:]) >= 0.5) == (good[400:] == 1)).mean() > 0.8


# 4


def test_one_word_more_keeps_the_likeness(spark):
    words = prose(31, 300).split()
    own = " ".join(words)
    others = {"front": "new " + own, "middle": " ".join([*words[:150], "new", *words[150:]]), "less": " ".join(words[:99] + words[100:]), "other": prose(32, 300)}
    df = spark.createDataFrame([(k, own, t) for k, t in others.items()], "k string, a string, b string")
    near = {r.k: r.near for r in df.select("k", fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("near")).collect()}
    assert min(near["front"], near["middle"], near["less"]) >= 0.8 and near["other"] < 0.4
