"""The corpus operators against brute force on small inputs, with nulls, empty texts, ties and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from riskloom.llm import anchors, chosen_path, extract, fingerprint, hash_tree, learned_ann, packing, prefix_bpe, quality, separators
from riskloom.llm.common import table

RANKS = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))]
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(RANKS), special_tokens={})
LONG = " ".join(f"word{i}" for i in range(3000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
SCHEMA = "doc_id bigint, text string, bucket string, stats int, node string, _x int"
ROWS = [
    (1, "a plain text of some words, and more of them to come", "x", 1, None, 1),
    (2, "a plain text of some words, and more of them to come", None, None, "n", 2),
    (3, None, "x", 1, None, None),
    (4, "", None, 1, "n", 3),
    (5, "word", "y", 1, None, 4),
    (6, LONG, None, 1, None, 5),
    (7, f"Before it {PASSAGE} after it", "z", 1, None, 6),
    (8, f"Other words {PASSAGE}\nend", "z", 1, None, 7),
    (9, LONG.replace("word1500 ", "changed "), "z", 1, None, 8),
    (9, LONG.replace("word1500 ", "changed "), "z", 1, None, 8),
    (None, "a plain text of some words, and more of them to come", "x", 1, None, 1),
    (11, "  spaces   and more \t tabs ", "x", 1, None, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def test_bounds_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        histogram = {int(n): int(c) for n, c in zip(rng.choice(40, 7, replace=False) + 1, rng.integers(1, 9, 7))}
        sizes = sorted(histogram)

        def padding(bounds, histogram=histogram):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in histogram.items())

        for k in (1, 2, 3, 7, 9):
            got = packing.bucket_bounds(histogram, k)
            best = min(padding([*c, sizes[-1]]) for r in range(min(k, 7)) for c in itertools.combinations(sizes[:-1], r))
            assert len(got) <= k and padding(got) == best
    assert packing.bucket_bounds({}, 4) == []


def test_pack(docs, none):
    rows = packing.pack(packing.pieces(docs, context=1000), buckets=3, budget=2500, context=1000).collect()
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        assert r.n_tokens <= r.padded and r.place < max(1, 2500 // r.padded)
    assert tokens[6] == 3000 and tokens[9] == 6000 and tokens[None] == len(ROWS[10][1].split()) and 3 not in tokens and 4 not in tokens
    places = [(r.bucket, r.batch, r.place) for r in rows]
    assert len(set(places)) == len(places)
    assert packing.pack(packing.pieces(none)).collect() == []


# 2


@pytest.mark.parametrize("block", [512, 4096, 8 << 20])
def test_separator_scan(docs, none, block):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in separators.counted_documents(docs, RANKS, public_tokenizers.PATTERN, 50256, block).collect())
    assert got == sorted((r[0] is not None, r[0] or 0, len(ORACLE.encode_ordinary(r[1] or ""))) for r in ROWS)
    assert separators.counted_documents(none, RANKS, public_tokenizers.PATTERN, 50256).collect() == []


def test_scan_of_a_file_cut_short(spark, tmp_path):
    tokens = np.array([5, 6, 9, 9, 7, 9, 1, 2], dtype="<u2")
    (tmp_path / "part-0").write_bytes(tokens.tobytes() + b"\x01")
    (tmp_path / "part-1").write_bytes(b"")
    for block in (2, 4, 6, 100):
        rows = sorted((r.ordinal, r.first_token, r.n_tokens) for r in separators.count_tokens(spark, str(tmp_path), 9, block).collect())
        assert rows == [(0, 0, 2), (1, 3, 0), (2, 4, 1), (3, 6, 2)]


# 3


def test_quality_held_out(spark, data_dir):
    rows = quality.quality(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")).toPandas()
    both = rows.merge(table(spark, "/root/testdata/sf0.01", "labels").toPandas(), on="doc_id")
    unseen = both[both.held_out]
    assert (unseen.predicted == unseen.quality).mean() > 0.95
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(rows.doc_id, rows.held_out))
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_quality_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, None), (6, 0, 1), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(none, labels).collect() == []


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    """A text with the least hash and more copies than SCALE_ROWS, among others: the kernel keeps its width."""
    monkeypatch.setattr(quality, "SCALE_ROWS", 100)
    rng = np.random.default_rng(4)
    width = len(quality.statistics(""))
    stats = rng.normal(size=(600, width))
    good = (np.sin(2 * stats[:, 0]) + stats[:, 1] > 0).astype(int)
    schema = "stats array<double>, quality int, fold int"
    rows = [(x.tolist(), int(y), i % 2) for i, (x, y) in enumerate(zip(stats, good))]
    df = spark.createDataFrame(rows, schema)
    least = df.orderBy(F.xxhash64("stats")).first()
    alone = quality.fit(df)
    for copies in (300, 3000):
        scorer = quality.fit(df.union(spark.createDataFrame([tuple(least)] * copies, schema)))
        assert np.allclose(scorer.directions, alone.directions) and np.allclose(scorer.scale, alone.scale)
        assert 0.5 < scorer.scale.min() and 1 < 1 / scorer.directions.std() < 2 * np.sqrt(2 * width)
    two = quality.fit(spark.createDataFrame([rows[0], rows[1]] * 2, schema))
    assert 1 / two.directions.std() > 1


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    rows = rng.integers(1, 20, 50).astype(float)
    knots, heights = quality.isotonic(np.arange(50.0), rng.binomial(rows.astype(int), np.linspace(0.1, 0.9, 50)).astype(float), rows)
    assert (np.diff(heights) >= 0).all() and (np.diff(knots) > 0).all()


# 4


def test_edited_texts(docs, none):
    known = [r for r in ROWS if r[0] is not None]
    rows = {}
    for r in fingerprint.edited(fingerprint.edited_pairs(docs)).collect():
        rows.setdefault(r.doc_id, r)
    texts = {r[0]: r[1] or "" for r in known}
    texts[None] = ROWS[10][1]
    following = dict(zip([None, *sorted(texts.keys() - {None})], [*sorted(texts.keys() - {None}), None]))
    for i, text in texts.items():
        if i == 9:
            continue  # two rows of one id follow each other
        half = len(text) // 2
        changed = text[: len(text) - half] + texts[following[i]][:half]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[1].fingerprint == rows[2].fingerprint == rows[None].fingerprint and rows[1].near_next == 1.0
    assert rows[3].fingerprint == rows[4].fingerprint != rows[5].fingerprint and rows[6].near_next < 0.5 < rows[9].near_edited + 0.5
    assert fingerprint.edited(fingerprint.edited_pairs(none)).collect() == []


def test_fingerprints_add_up(spark):
    df = spark.createDataFrame([("one line here\nand two", "three\nfour and more words", "three\none line here\nfour and more words\nand two")], "a string, b string, c string")
    a, b, c = (fingerprint.fingerprint(df[x]) for x in "abc")
    r = df.select((fingerprint.plus(a, b) == c).alias("sum"), (fingerprint.minus(c, b) == a).alias("rest"), (a == b).alias("same")).first()
    assert r["sum"] and r["rest"] and not r["same"]


# 5

PAGE = """<html><body><header class="top"><a href=/>Site</a></header><div id="cookie-notice">We use cookies</div><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
<div class="content"><h1>Title &amp; more</h1><p>First  para <a href=x>link</a> text, long enough to be real.<p>Second &eacute; para <b>bo</b>ld text<br>goes on at length.<form><input><button>Go</button></form>
<div class="ad">Buy</div></div><div class="comments"><p>A reader said so.</p></div><footer>(c)</footer><script>var a="</p>"</script></body></html>"""


def test_extract(spark):
    rows = [(1, "u", PAGE, 0), (2, None, None, 0), (3, "v", "", 0), (4, "w", "<article><p><b>open <br>tags", 0), (4, "w", "no markup &lt;here", 0), (None, "x", "<div>" * 3000 + "deep", 0)]
    got = [(r.page_id, r.text, r.n_chars) for r in extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()]
    assert got[0][1] == "Title & more First para link text, long enough to be real. Second é para bold text goes on at length."
    assert got[1:] == [(2, "", 0), (3, "", 0), (4, "open tags", 9), (4, "no markup <here", 15), (None, "deep", 4)]


ARTICLE = "<h1>A title</h1><p>First of the text, long enough to be real.</p><p>Second of the text, that goes on at length.</p>"
TEXT = "A title First of the text, long enough to be real. Second of the text, that goes on at length."
SMALL = '<div class="sidebar"><p>Read this too.</p></div><div id="related"><article class="card"><p>Another one.</p></article></div>'
TALK = "".join(f'<li class="comment"><p>Reader {i} said this and that of it, at some length.</p></li>' for i in range(9))


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<body><div class="layout with-sidebar"><article>{ARTICLE}</article>{SMALL}</div></body>', TEXT),
        (f'<body><div class="no-sidebar">{ARTICLE}</div></body>', TEXT),
        (f'<body><div id="page" class="has-header"><div class="skip-rail"><main>{ARTICLE}<div class="sidebar"><p>Read this too.</p></div></main></div></div></body>', TEXT),
        (f'<body><form id="aspnetForm"><div>{ARTICLE}</div><input><button>Go</button></form></body>', TEXT),
        (f'<body><form role="form"><div class="content">{ARTICLE}</div><div class="sidebar"><p>Read this too.</p></div></form></body>', TEXT),
        (f'<body><article class="post">{ARTICLE.replace("<h1>A title</h1>", "<div class=entry-header><h1>A title</h1></div>")}<form>Mail <p>us</p></form></article></body>', TEXT),
        (f'<body><div class="has-header"><div class="no-sidebar">{ARTICLE.replace("h1", "p")}</div></div></body>', TEXT),
        (f'<body><article class="post related-open">{ARTICLE}</article></body>', TEXT),
        (f'<body><div class="post">{ARTICLE}</div><div id="comments"><ol class="commentlist">{TALK}</ol></div></body>', TEXT),
        (f'<body><div class="ad">{ARTICLE * 3}</div><article><p>A short text.</p></article></body>'.replace("h1", "p"), "A short text."),
        (f'<body><article>{ARTICLE}</article><div hidden class="layout">{ARTICLE}</div><div class="nav">Go on</div></body>', TEXT),
    ],
)
def test_named_wrappers(page, text):
    assert extract.main_text(page) == text


# 6


def test_encoding(docs, none):
    ids = {r.doc_id: r.ids for r in prefix_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(ids[r[0]] == ORACLE.encode_ordinary(r[1] or "") for r in ROWS)
    by = {}
    for r in prefix_bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect():
        by.setdefault(r.doc_id, r)
    for i, text, *_ in ROWS:
        ids = ORACLE.encode_ordinary(text or "")
        assert by[i].n_tokens == len(ids) and by[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert prefix_bpe.digests(none, RANKS, public_tokenizers.PATTERN).collect() == []
    back = {r.doc_id: bytes(r.bytes).decode() for r in prefix_bpe.decode(prefix_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    assert back[6] == LONG and back[3] == ""


def test_encoder_like_the_library():
    enc = prefix_bpe.TextEncoder(RANKS, public_tokenizers.PATTERN)
    rng = np.random.default_rng(5)
    alphabet = list("abAB 's're''  \n\t\r\x0b\x1c\x85\xa0​ éß漢12½Ⅷ٣!?._😀́\x00")
    for _ in range(1500):
        text = "".join(rng.choice(alphabet, rng.integers(0, 14)))
        ids = ORACLE.encode_ordinary(text)
        assert enc.ids(text) == ids and enc.digest(text)[1] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        pieces = enc.pieces.findall(text)
        more = text + "".join(rng.choice(alphabet, 3))
        k = prefix_bpe.restart(pieces)
        assert enc.pieces.findall(more)[:k] == pieces[:k]


def test_appends_and_edits():
    bpe = prefix_bpe.PrefixBpe(RANKS)
    rng = np.random.default_rng(6)
    text = LONG.encode()[:1500]
    last = bpe.last_tokens(text)
    assert bpe.ids_of(last) == ORACLE._encode_single_piece(text)
    assert bpe.last_tokens(text + b"ing things", last) == bpe.last_tokens(text + b"ing things")
    for _ in range(25):
        a = int(rng.integers(len(text)))
        b, new = min(len(text), a + int(rng.integers(9))), bytes(rng.choice(list(b"ing tha"), rng.integers(0, 8)))
        assert bpe.replace(text, last, a, b, new) == (text[:a] + new + text[b:], bpe.last_tokens(text[:a] + new + text[b:]))


# 7


def test_nearest(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.vstack([centres[i % 12] + rng.normal(size=16) for i in range(3000)])
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(4000, None, 0), (4020, [0.0] * 16, 0), (4040, [float("nan")] * 16, 0), (4060, [None] * 16, 0), (None, [1.0] * 16, 0), (5, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = {}
    for r in learned_ann.nearest(df, rows_per_part=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    found = 0
    for q in range(0, 3000, 20):
        truth = np.lexsort((np.arange(3000), -s[q]))[:20]
        found += len({v for v, _ in got[q]} & set(truth.tolist()))
        assert len(got[q]) == 20 and all(abs(s[q, v] - w) < 1e-9 for v, w in got[q]) and [w for _, w in got[q]] == sorted((w for _, w in got[q]), reverse=True)
    assert set(got) == set(range(0, 3000, 20)) and found / (20 * 150) >= 0.9
    few = learned_ann.nearest(df.filter("vec_id < 7")).collect()
    assert [r.query_id for r in few] == [0] * 6
    assert learned_ann.nearest(df.limit(0)).collect() == []


# 8


def removed(rows, window):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,block", [(13, 7), (13, 3), (50, None), (3, 2)])
def test_repeats(docs, none, window, block):
    got = sorted((tuple(r) for r in anchors.without_repeats(docs, window=window, block=block).collect()), key=str)
    assert got == removed(ROWS, window)
    assert anchors.without_repeats(none).collect() == []


def test_cleaned_text_and_spans(docs):
    texts = {r.doc_id: r for r in anchors.without_repeats(docs, finish=anchors.cleaned, result=anchors.CLEANED).collect()}
    assert texts[8].text == "Other words end" and texts[8].n_removed == 60 and texts[7].text == ROWS[6][1] and texts[11].text == ROWS[11][1]
    spans = {r.doc_id: r.repeats for r in anchors.without_repeats(docs, finish=anchors.spans, result=anchors.SPANS).collect()}
    assert spans[8] == [[2, 62]] and spans[7] == [] and spans[9] == [[0, 1500], [1501, 3000]]


def test_rows_of_one_id_or_none_spread(spark):
    """Rows that share an id, or have none, are not all dealt to one task."""
    from pyspark import TaskContext

    finish = lambda raw, starts, ends, gone: (TaskContext.get().partitionId(), int(gone.sum()))
    result = ("task bigint, n bigint", pa.schema([("task", pa.int64()), ("n", pa.int64())]))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        for one in (7, None):
            rows = [(one, f"{PASSAGE} text {i}") for i in range(80)]
            got = anchors.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), finish=finish, result=result).collect()
            assert len(got) == 80 and {r.n for r in got} == {0} and len({r.task for r in got}) > 1
    finally:
        spark.conf.set(key, before)


# 9


def grouped(rows, width, share):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = (t or "").encode().translate(chosen_path.LOWER).split()
            sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and share[1] * common >= share[0] * (len(sets[a]) + len(sets[b]) - common) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if v == high else v for i, v in label.items()}
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_near_duplicates(docs, none):
    for width, share in ((3, (85, 100)), (5, (80, 100))):
        rows = chosen_path.near_duplicates(docs, shingle=width, share=share).collect()
        assert len(rows) == len(ROWS)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == grouped(ROWS, width, share)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    assert chosen_path.near_duplicates(none).collect() == []


def test_large_nodes_and_gatherings(spark, monkeypatch):
    """A chain of near copies around one text, with limits so low that nodes branch and gatherings are cut."""
    for name, value in (("SMALL", 8), ("BLOCK", 10), ("LOOKED_AT", 4), ("BLOCK_SHINGLES", 3000)):
        monkeypatch.setattr(chosen_path, name, value)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        words = list(base) if i % 3 else [f"v{rng.integers(400)}" for _ in range(120)]
        for at in rng.integers(0, len(words), int(rng.integers(0, 6))):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=3, share=(85, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == grouped(rows, 3, (85, 100))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.component for r in chosen_path.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}


# 10


def test_sharding(spark, docs, none):
    tree = hash_tree.even_tree(16)
    grown = hash_tree.with_new_region(tree, 16)
    rows = hash_tree.place(docs, tree, grown).collect()
    assert len(rows) == len(ROWS) and {r.size for r in rows if r.doc_id in (3, 4)} == {1}
    many = hash_tree.place(spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text"), tree, grown).toPandas()
    sizes = many["shard"].value_counts()
    assert set(sizes.index) == set(range(16)) and sizes.min() > 1000 and sizes.max() < 1500
    moved = many[many["shard"] != many["grown_shard"]]
    assert set(moved["grown_shard"]) == {16} and 900 < len(moved) < 1500
    for _, part in many.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert many["text_crc32"].tolist() == [zlib.crc32(str(i).encode()) for i in many["doc_id"]]
    heavier = {**tree, "r0": {k: {s: 3.0 for s in shards} for k, shards in tree["r0"].items()}}
    again = hash_tree.place(spark.range(5000).selectExpr("id as doc_id", "'' as text"), tree, heavier).toPandas()
    away = again[again["shard"] != again["grown_shard"]]
    assert set(away["grown_shard"]) <= {0, 1, 2, 3} and not set(away["shard"]) & {0, 1, 2, 3}
    assert hash_tree.place(none, tree, grown).collect() == []
