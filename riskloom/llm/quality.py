"""Quality scores: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import staged

#: Distinct labelled statistics used at most for their scaling and the kernel width (the fit itself uses all rows).
SCALE_ROWS = 20_000
FEATURES = 384
#: Tried in all pairs: kernel widths as multiples of the median distance, and penalties.
WIDTHS = (1.0, 2.0, 4.0, 8.0)
RIDGES = (1e-8, 1e-7, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2)
#: Scores are counted in this many bins before the isotonic fit.
BINS = 4096

ASCII_CLASSES = np.zeros(256, dtype=np.int64)
for _name, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\r\x0b\x0c", b"\n", b".,;:?!'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~"), 1):
    for _c in _chars:
        ASCII_CLASSES[_c] = _name
ASCII_CLASSES[128:192] = 9  # continuation bytes
ASCII_CLASSES[192:] = 10  # first bytes of longer characters
ASCII_CLASSES[[c for c in range(32) if ASCII_CLASSES[c] == 0] + [127]] = 11
CLASSES = 12


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def statistics(text: str | None) -> list[float]:
    """What a score may know of a text: shares and shapes of its characters, words and lines.

    Computed over the whole text; null counts as empty, which gives all zeros. Nothing of language, source
    or id goes in.
    """
    text = text or ""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(ASCII_CLASSES, weights=counts, minlength=CLASSES)
    chars = len(raw) - kinds[9]
    words = text.split()
    n = len(words)
    freq = Counter(words)
    top = sum(c for _, c in freq.most_common(5))
    once = sum(1 for c in freq.values() if c == 1)
    follows = sum(1 for a, b in zip(words, words[1:]) if a == b)
    pairs = len(set(zip(words, words[1:])))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n) if n else np.zeros(1, dtype=np.int64)
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    dups = len(full) - len(set(full))
    letters = kinds[1] + kinds[2] + kinds[10]
    probabilities = counts[counts > 0] / max(1, len(raw))
    entropy = float(-(probabilities * np.log2(probabilities)).sum()) if len(raw) else 0.0
    ended = sum(1 for w in words if w[-1] in ".!?…")
    odd = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?!…")
    doubled = sum(1 for w in words if len(w) > 1 and w[-1] == w[-2] and not w[-1].isalnum())
    capital = sum(1 for w in words if w[0].isupper())
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    numeric = sum(1 for w in words if any(c.isdigit() for c in w))
    bare = sum(1 for w in words if not any(c.isalpha() for c in w))
    return [
        np.log1p(chars), np.log1p(n), _share(letters, chars), _share(kinds[2], letters), _share(kinds[3], chars), _share(kinds[4], chars),
        _share(kinds[6], chars), _share(kinds[7], chars), _share(kinds[8], chars), _share(kinds[10], chars), _share(kinds[11], chars), entropy,
        _share(len(freq), n), _share(once, n), _share(top, n), _share(follows, n), _share(pairs, n - 1) if n > 1 else 0.0, float(lengths.mean()),
        float(lengths.std()), np.log1p(float(lengths.max())), np.log1p(len(full)), _share(dups, len(full)), _share(n, len(full)), _share(ended, n),
        _share(odd, n), _share(doubled, n), _share(capital, n), _share(upper, n), _share(numeric, n), _share(bare, n), _share(n, np.sqrt(len(freq)) if freq else 0) ** 0.5,
    ]


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stats (array<double>) and the columns of ``keep`` for every row."""
    slim = docs.select(F.col(doc_id).alias("_x_id"), F.col(text).alias("_x_text"), *keep)
    kept = slim.drop("_x_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [[float(v) for v in statistics(t.as_py())] for t in batch.column("_x_text")]
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != "_x_text"]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(stats, type=pa.list_(pa.float64()))], names=[*[n for n, _ in rest], "stats"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return slim.mapInArrow(run, f"{fields}, stats array<double>").withColumnRenamed("_x_id", "doc_id")


@dataclass
class Scorer:
    """A fitted model; a few hundred kilobytes, whatever it was fitted on."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    heights: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    width: float = 1.0

    def features(self, stats: np.ndarray, width: float | None = None) -> np.ndarray:
        """Random Fourier features and a constant: their products approximate a Gaussian kernel, ``width`` times as wide as the
        median distance. Nothing else goes in, so all that a score knows it knows through the kernel."""
        z = np.clip((stats - self.centre) / self.scale, -8, 8)
        waves = np.cos(z @ (self.directions / (width or self.width)) + self.offsets) * np.sqrt(2 / len(self.offsets))
        return np.hstack([waves, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.heights), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("stats")
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


#: Products of features, products with labels, rows, sum of labels squared.
Normal = tuple[np.ndarray, np.ndarray, float, float]


def _sums(labelled: DataFrame, scorer: Scorer, widths: tuple[float, ...]) -> list[list[Normal]]:
    """The normal equations of each width and fold, from one pass.

    Each partition adds up its own; the partitions' sums are added in a tree, so the driver adds few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(scorer.offsets) + 2
        totals, seen = np.zeros((len(widths), 2, size, size)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            stats, y, k = _matrix(batch), 2.0 * np.asarray(batch.column("quality")) - 1, np.asarray(batch.column("fold"))
            for w, width in enumerate(widths):
                whole = np.hstack([scorer.features(stats, width), y[:, None]])
                for fold in (0, 1):
                    part = whole[k == fold]
                    totals[w, fold] += part.T @ part
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([totals.tobytes()], type=pa.binary())], names=["sums"])

    sums = labelled.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
    total = sums.treeReduce(lambda a, b: a + b, 3) if not sums.isEmpty() else None
    if total is None:
        return []
    size = len(scorer.offsets) + 2
    return [[(g[:-1, :-1], g[:-1, -1], g[-2, -2], g[-1, -1]) for g in folds] for folds in total.reshape(len(widths), 2, size, size)]


def _ridge(gram: np.ndarray, target: np.ndarray, rows: float, ridge: float) -> np.ndarray:
    penalty = np.eye(len(gram)) * ridge * max(rows, 1.0)
    penalty[-1, -1] = 1e-9 * max(rows, 1.0)
    return np.linalg.solve(gram + penalty, target)


def _loss(w: np.ndarray, part) -> float:
    gram, target, _, labels = part
    return float(w @ gram @ w - 2 * w @ target + labels)


def isotonic(at: np.ndarray, good: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and heights of the non-decreasing fit of shares good / rows at ascending ``at`` (adjacent violators pooled)."""
    blocks: list[list[float]] = []  # sum of good, rows, sum of places
    for x, g, n in zip(at, good, rows):
        blocks.append([g, n, x * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    knots = np.array([b[2] / b[1] for b in blocks])
    # One more good and one more bad row in each block keep the ends off 0 and 1.
    heights = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])
    return knots, np.maximum.accumulate(heights)


def _distinct_sample(used: DataFrame, distinct: int) -> np.ndarray:
    """At most SCALE_ROWS of the about ``distinct`` different statistics, those of the least hashes.

    Copies of a text count as one row, however many there are. Only what lies below twice the wanted share of the hashes
    is gathered, so neither the shuffle nor the driver's part grows with the input.
    """
    place = F.xxhash64("stats")
    if distinct > SCALE_ROWS:
        used = used.filter(place < min((1 << 63) - 1, int((2 * SCALE_ROWS / distinct - 0.5) * 2.0**64)))
    return np.array([r[0] for r in used.select("stats").distinct().orderBy(place).limit(SCALE_ROWS).collect()], dtype=float)


def fit(labelled: DataFrame, seed: int = 20, features: int = FEATURES) -> Scorer:
    """A scorer from rows with stats, quality (0 or 1) and fold (0 or 1).

    Scaling and median distance come from at most SCALE_ROWS different statistics; all rows go into the normal equations. Each
    fold is scored by the weights of the other to choose kernel width and ridge and to fit the calibration. Rows whose
    label is neither 0 nor 1 are left out. Without rows of both labels every score is the share of label 1,
    or one half without rows.
    """
    used = labelled.filter(F.col("quality").isin(0, 1)).select("stats", F.col("quality").cast("double").alias("quality"), F.col("fold").cast("int").alias("fold"))
    totals = used.agg(F.count("*"), F.avg("quality"), F.approx_count_distinct(F.xxhash64("stats"))).first()
    sample = _distinct_sample(used, totals[2])
    rng = np.random.default_rng(seed)
    width = sample.shape[1] if len(sample) else len(statistics(""))
    centre, scale = (np.median(sample, axis=0), sample.std(axis=0)) if len(sample) else (np.zeros(width), np.ones(width))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((sample - centre) / scale, -8, 8) if len(sample) else np.zeros((1, width))
    picks = rng.integers(0, len(z), (2, 2000))
    apart = np.linalg.norm(z[picks[0]] - z[picks[1]], axis=1)
    apart = apart[apart > 0]  # a row picked twice says nothing of the width
    gamma = max(float(np.median(apart)), 1e-3) if len(apart) else 1.0
    scorer = Scorer(centre, scale, rng.normal(size=(width, features)) / gamma, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1))
    sums = _sums(used, scorer, WIDTHS)
    if not sums or totals[1] in (0.0, 1.0):
        share = 0.5 if not totals[0] else float(totals[1])
        scorer.heights = np.array([share, share])
        return scorer

    def crossed(parts: list[Normal], ridge: float) -> list[np.ndarray]:
        """Each fold's weights from the other fold; from itself if the other is empty."""
        full = [p if p[2] > 0 else parts[1 - i] for i, p in enumerate(parts)]
        return [_ridge(*p[:3], ridge) for p in full[::-1]]

    def loss(choice: tuple[int, float]) -> float:
        return sum(_loss(w, p) for w, p in zip(crossed(sums[choice[0]], choice[1]), sums[choice[0]]))

    at, ridge = min(((w, r) for w in range(len(WIDTHS)) for r in RIDGES), key=loss)
    parts, scorer.width = sums[at], WIDTHS[at]
    by_fold = crossed(parts, ridge)
    scorer.weights = _ridge(parts[0][0] + parts[1][0], parts[0][1] + parts[1][1], parts[0][2] + parts[1][2], ridge)
    models = [Scorer(scorer.centre, scorer.scale, scorer.directions, scorer.offsets, w, width=scorer.width) for w in by_fold]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stats, fold = _matrix(batch), np.asarray(batch.column("fold"))
                raw = np.where(fold == 0, models[0].raw(stats), models[1].raw(stats))
                bins = np.clip(np.floor((np.clip(raw, -2, 2) + 2) / 4 * BINS), 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("quality")], names=["bin", "quality"])

    counted = used.mapInArrow(place, "bin bigint, quality double").groupBy("bin").agg(F.sum("quality").alias("good"), F.count("*").alias("rows")).orderBy("bin").collect()
    bins = (np.array([r["bin"] for r in counted]) + 0.5) / BINS * 4 - 2
    scorer.knots, scorer.heights = isotonic(bins, np.array([r["good"] for r in counted]), np.array([float(r["rows"]) for r in counted]))
    return scorer


def scored(stats: DataFrame, scorer: Scorer) -> DataFrame:
    """``stats`` (any columns) without its stats, with ``score`` and ``predicted``."""
    shared = stats.sparkSession.sparkContext.broadcast(scorer)
    kept = stats.drop("stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            rest = [(n, batch.column(n)) for n in batch.schema.names if n != "stats"]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(scores, type=pa.float64())], names=[*[n for n, _ in rest], "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return stats.mapInArrow(run, f"{fields + ', ' if fields else ''}score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; ids with remainder 1 are never learnt from.

    Rows with a null id are scored, not held out and not learnt from. If an id has labels that differ, it
    counts once for each. Repeated rows are each scored; they learn as often as they occur.
    """
    stats = staged(described(docs), "statistics")
    rest = remainder(F.col("doc_id"))
    taught = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1)).filter(rest != 1).distinct()
    joined = stats.join(taught, "doc_id").withColumn("fold", (rest == 2).cast("int"))
    scorer = fit(staged(joined, "labelled"))
    out = scored(stats.withColumn("held_out", F.coalesce(rest == 1, F.lit(False))), scorer)
    return out.select("doc_id", "held_out", "score", "predicted")


def judged(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with ``score`` and ``predicted``, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by the number of features
    slim = docs.select(*keep, F.col(text).alias("_x_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t.as_py()) for t in batch.column("_x_text")])
            scores = shared.value.score(stats) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores, type=pa.float64())], names=[*keep, "score"])

    fields = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, f"{fields}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
