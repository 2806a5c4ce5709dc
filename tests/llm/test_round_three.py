"""Ranked search, quality rules and spelling variants against brute force, odd rows included."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskloom.llm import geometric, pivots, rules

SCHEMA = "doc_id bigint, text string, term string, n bigint, word string, score int, item_id bigint"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, *["x", 1, "y", 2, 3][: len(schema.split(",")) - len(r)]) for r in rows], schema)


# 11


def lowered(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def ranked(docs, items, top=10):
    terms = {}
    for i, text in items:
        terms.setdefault(i, set()).update(re.findall(geometric.TERM, lowered(text)))
    tf = [(d, Counter(re.findall(geometric.TERM, lowered(t)))) for d, t in docs]
    documents, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for i, wanted in terms.items():
        rows = []
        for d, c in tf:
            m = 100 - 90 + 90 * sum(c.values()) * documents // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(i, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


ODD = [(1, "One two THREE, three"), (2, "one two three three"), (2, "one two three three"), (None, "one two three three"), (3, None), (4, ""), (5, "... --- "), (6, "Ünï ünï naïve_two ÉTÉ"), (7, "two " * 500 + "rare"), (8, "é1 2b"), (-9, "rare")]
ASKED = [(1, "Three one"), (2, None), (3, ""), (4, "naïve ÉTÉ étÉ"), (5, "RARE two"), (5, "one"), (None, "two"), (7, "nowhere")]


def test_ranks_of_odd_rows(spark):
    items = spark.createDataFrame([(i, t, 5, "x") for i, t in ASKED], "item_id bigint, text string, doc_id int, term string")
    got = geometric.search(frame(spark, ODD), items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(ODD, ASKED)
    several = geometric.search(frame(spark, ODD), items, top=2, terms_a_pass=2)
    assert sorted(map(tuple, several.collect()), key=str) == ranked(ODD, ASKED, 2)


def test_ranks_of_nothing(spark):
    items = spark.createDataFrame(ASKED, "item_id bigint, text string")
    assert geometric.search(frame(spark, []), items).collect() == []
    assert geometric.search(frame(spark, [(1, None), (2, "-")]), items).collect() == []
    assert geometric.search(frame(spark, ODD), items.limit(0)).collect() == []


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(geometric, "PIECE", 7)
    text = "Abc de" + "x" * 30 + " fg,hi ÄÖ\n" * 9
    assert [t.decode() for p in geometric.terms_of(text) for t in p] == re.findall(geometric.TERM, lowered(text))


@pytest.mark.parametrize("copies", [0, 300])
def test_blocks_are_exact(monkeypatch, copies):
    monkeypatch.setattr(geometric, "BLOCK", 8)
    rng = np.random.default_rng(copies)
    words, rows = 60, []
    for _ in range(900):
        t = np.unique(rng.zipf(1.3, 12) % words)
        rows.append((t, rng.integers(1, 50, len(t)) * 1000))
    rows += [rows[5]] * copies
    ids = rng.permutation(len(rows))
    starts = np.cumsum([0] + [len(t) for t, _ in rows])
    items = [np.unique(rng.integers(0, words, 9)) for _ in range(40)]
    shard = geometric.Shard(ids, starts, np.concatenate([t for t, _ in rows]), np.concatenate([s for _, s in rows]), geometric.companions(items, words))
    before = [(10**9, -1)]
    for item in items:
        scores = [(int(s[np.isin(t, item)].sum()), int(i)) for (t, s), i in zip(rows, ids)]
        want = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1]))
        assert shard.search(item, [], 10) == want[:10]
        assert shard.search(item, before, 5) == [*before, *want[:4]]
    # Summaries do bound their blocks, some lists have several, and some documents are never scored.
    assert any(len(b[1]) > 2 for b in shard.blocks.values())
    seen = []
    monkeypatch.setattr(geometric.Shard, "exact", lambda self, r, w, f=geometric.Shard.exact: seen.append(len(r)) or f(self, r, w))
    shard.search(items[0], [], 10)
    assert 0 < sum(seen) < sum(np.isin(items[0], t).any() for t, _ in rows)


# 12


def measures(text):
    words = re.findall(rules.WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(rules.WORD, x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {p for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for p in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


PROSE = " ".join(f"the word{i} of thing{i} is with end{i}" for i in range(12))
TEXTS = [
    (1, PROSE),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (5, " ".join(["again and again"] * 30)),
    (6, " ".join(f"{w}###" for w in PROSE.split())),
    (7, PROSE.upper()),
    (8, "\n".join(["the same line of it"] * 3 + ["", " ", PROSE])),
    (9, "a b c a b c x y z b c x naïve one 𝔘𝔫"),
    (9, "a b c a b c x y z b c x naïve one 𝔘𝔫"),
    (None, "\n".join(f"- the item of list {i}, and it is in the row..." for i in range(20))),
    (11, " ".join(f"zw{i}q" for i in range(60))),
    (12, "one two one two one two"),
    (13, "the a " * 40_000 + PROSE),
]


def test_measures(spark):
    rows = rules.judged(frame(spark, TEXTS)).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=str)
    assert got == sorted(((i, *measures(t)) for i, t in TEXTS), key=str)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed_rules)
    failed = {r.doc_id: r.failed_rules for r in rows}
    assert {r.doc_id for r in rows if r.kept} == {1, 8}
    assert "symbols" in failed[6] and failed[7] == ["capitals"] and failed[None] == ["cut_lines", "list_lines"] and failed[11] == ["stop_words"]
    assert rules.judged(frame(spark, [])).collect() == []


def test_rules_are_a_table(spark):
    docs = frame(spark, TEXTS)
    few = (rules.Rule("short", "n_words", "n_lines", None, 10_000),)
    assert {r.doc_id for r in rules.judged(docs, few).collect() if r.failed_rules == ["short"]} >= {1, 5, 6, 7, 11}
    assert all(r.failed_rules == [] for r in rules.judged(docs, ()).collect())


def test_rules_stay_in_the_jvm(spark):
    plan = rules.judged(frame(spark, TEXTS).repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


# 13


def spelled(docs, every=199, least=5):
    counts = Counter()
    for i, text in docs:
        for run in re.findall(pivots.RUN, lowered(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    lost = defaultdict(set)
    for w in words:
        for p in range(len(w)):
            lost[p, w[:p] + w[p + 1 :]].add(w)
    near = defaultdict(set)
    for (_, rest), ws in lost.items():
        for w in ws:
            near[w] |= ws - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def test_variants(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abéÉ"), rng.integers(6, 10))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaa", "abababab", "babababa", "k" * 300, "k" * 299]
    base += [w[:3] + x + w[4:] for w in base[:20] for x in "aé"] + [w[:-1] for w in base[:20]] + ["b" + w for w in base[:20]]
    docs = [(None, " ".join([w] * int(5 ** rng.integers(1, 4)))) for w in base]
    docs += [(1, None), (2, ""), (3, "short runs"), (4, "Ünïcödé×÷ÿ " * 6), (4, "Ünïcödé×÷ÿ " * 6), (5, " ".join(base) * 3)]
    docs += [(i, " ".join(rng.choice(base, 200))) for i in range(6, 30)]
    for every in (199, 3):
        got = pivots.variants(frame(spark, docs), every=every)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        rows = sorted(map(tuple, got.collect()))
        assert rows == spelled(docs, every) and any(r[4] > 1 for r in rows)
    assert pivots.variants(frame(spark, [])).collect() == [] and pivots.variants(frame(spark, [(1, None)])).collect() == []
    with pytest.raises(ValueError):
        pivots.variants(frame(spark, docs), least_chars=4)


def test_roots_follow_long_chains(spark):
    links = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(25)] + [("x", "y")]
    got = dict(map(tuple, pivots.rooted(spark.createDataFrame(links, "word string, form string")).collect()))
    assert got == {**{w: "w25" for w, _ in links}, "x": "y"}


def test_pivots_are_the_cheapest_disjoint_pair(spark):
    rng = np.random.default_rng(2)
    words = list({"".join(rng.choice(list("abcd"), rng.integers(6, 9))) for _ in range(80)})
    rows = pivots.prefixes(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")).collect()
    df = Counter(g for w in words for g in {w[i : i + 2] for i in range(len(w) - 1)})
    for r in rows:
        grams = sorted((df[r.word[i : i + 2]], r.word[i : i + 2], i) for i in range(len(r.word) - 1))
        assert sorted((g.df, g.gram, g.at) for g in r.prefix) == [g for g in grams if g[:2] <= grams[2][:2]]
        costs = [a[0] + b[0] for a in grams[:3] for b in grams[:3] if b[2] >= a[2] + 2]
        assert r.pair.cost == min(costs) and r.pair.second >= r.pair.first + 2
