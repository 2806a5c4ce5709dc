"""Ranked lexical search with geometrically blocked posting lists.

Documents become forward rows (the terms of the items that they hold, with their counts) and are dealt, as they lie, into
shards of a bounded number of rows. In a shard, the posting list of a term is cut into blocks of documents that look alike:
each posting goes to the most similar of some leaders, by inner products of randomly projected score vectors. A block stores
the largest score of every term among its documents (coordinatewise maximum). An item walks its terms from the one with the
largest score down, until what is left of them cannot reach its tenth document; a block is skipped only if the sum of its
maxima over those terms stays below the tenth score. All scores are 64-bit integers, so bounds and scores compare exactly.
Shards hand on their best rows; a window over these gives the final ranks.

Items are searched in passes of a bounded number of terms, so that what goes to every task is bounded, too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import staged

#: Terms that one pass over the documents looks for, on average; documents and postings of a shard; documents of a block; dimensions of the projection.
TERMS_A_PASS, SHARD_ROWS, SHARD_POSTINGS, BLOCK, DIMENSIONS = 50_000, 8_192, 4_000_000, 64, 16
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
UNIT, ROOM, SLOPE, SATURATION = 1000, 100, 90, 8
NO_ID = np.iinfo(np.int64).max

# ASCII letters and digits and all bytes above 127 belong to terms; A-Z become a-z, everything else a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

FORWARD = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
FOUND = "item bigint, doc_id bigint, score bigint"


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8, in pieces of bounded size."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= PIECE else raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id and term, each pair once. Rows of one id are one item; items without terms have no rows."""
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col(item_id).cast("bigint").alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), 0)).alias("term")).distinct()


def forward(docs: DataFrame, vocabulary: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (all terms of the text, repeats counted), and the counts of those terms that are in ``vocabulary``, by its places."""
    places = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(vocabulary)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                total, counts = 0, Counter()
                for piece in terms_of(text.as_py()):
                    total += len(piece)
                    counts.update(map(places.get, piece))
                counts.pop(None, None)
                n.append(total)
                terms.append(list(counts.keys()))
                tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(rows, FORWARD)


class Shard:
    """Some documents: their postings both ways, and the blocked lists that items have asked for so far."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, scores: np.ndarray, asked_with: list[np.ndarray]):
        self.ids, self.starts, self.terms, self.scores, self.asked_with = ids, starts, terms, scores, asked_with
        self.vocabulary = vocabulary = len(asked_with)
        rows = np.repeat(np.arange(len(ids)), np.diff(starts))
        by_term = np.argsort(terms, kind="stable")
        self.list_rows, self.list_scores = rows[by_term], scores[by_term]
        self.list_starts = np.searchsorted(terms[by_term], np.arange(vocabulary + 1))
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.projected: np.ndarray | None = None

    def most(self, term: int) -> int:
        a, b = self.list_starts[term], self.list_starts[term + 1]
        return int(self.list_scores[a:b].max()) if b > a else 0

    def _projection(self) -> np.ndarray:
        if self.projected is None:
            signs = np.random.default_rng(7).choice(np.float32([-1, 1]), (self.vocabulary, DIMENSIONS))
            sums = np.zeros((len(self.terms) + 1, DIMENSIONS), dtype=np.float64)
            np.cumsum(signs[self.terms] * self.scores[:, None].astype(np.float32), axis=0, out=sums[1:])
            flat = sums[self.starts[1:]] - sums[self.starts[:-1]]
            self.projected = (flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        return self.projected

    def postings_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of these documents, and which of them each belongs to."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        first = np.cumsum(sizes) - sizes
        return np.arange(len(owner)) - first[owner] + self.starts[rows][owner], owner

    def blocked(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A posting list in blocks: document rows, block starts, and the summaries as sorted keys (block, term) with their maxima.

        A summary has the coordinates that items with this term can ask for. A list of one block gets none: its own maximum
        stands for it.
        """
        if term not in self.blocks:
            rows = self.list_rows[self.list_starts[term] : self.list_starts[term + 1]]
            if len(rows) <= BLOCK:
                self.blocks[term] = rows, np.array([0, len(rows)]), np.empty(0, np.int64), np.empty(0, np.int64)
            else:
                points = self._projection()[rows]
                leaders = points[:: max(1, BLOCK)][: math.ceil(len(rows) / BLOCK)]
                nearest = np.empty(len(rows), dtype=np.int64)
                for a in range(0, len(rows), 4096):
                    nearest[a : a + 4096] = (points[a : a + 4096] @ leaders.T).argmax(axis=1)
                rows = rows[np.argsort(nearest, kind="stable")]
                sizes = np.bincount(nearest)
                # A leader with many documents near it, copies for one, is cut into several blocks.
                starts = np.concatenate([np.arange(e - s, e, BLOCK) for s, e in zip(sizes, np.cumsum(sizes)) if s] + [[len(rows)]]).astype(np.int64)
                places, owner = self.postings_of(rows)
                asked = np.zeros(self.vocabulary, dtype=bool)
                asked[self.asked_with[term]] = True
                kept = asked[self.terms[places]]
                places, owner = places[kept], owner[kept]
                block = np.searchsorted(starts, np.arange(len(rows)), side="right") - 1
                keys = block[owner] * self.vocabulary + self.terms[places]
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                self.blocks[term] = rows, starts, keys[heads], np.maximum.reduceat(self.scores[places[order]], heads)
        return self.blocks[term]

    def exact(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Scores of documents; ``wanted`` marks the item's terms."""
        places, owner = self.postings_of(rows)
        hit = wanted[self.terms[places]]
        out = np.zeros(len(rows), dtype=np.int64)
        np.add.at(out, owner[hit], self.scores[places[hit]])
        return out

    def search(self, item: np.ndarray, best: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
        """``best`` (score, id; best first) with this shard's documents in it, no more than ``top``."""
        wanted = np.zeros(self.vocabulary, dtype=bool)
        wanted[item] = True
        seen = np.zeros(len(self.ids), dtype=bool)
        lists = sorted(((m, int(t)) for t in item if (m := self.most(t)) > 0), reverse=True)
        left = np.cumsum([m for m, _ in lists][::-1])[::-1] if lists else []
        for i, (m, term) in enumerate(lists):
            least = best[-1][0] if len(best) == top else 0
            # What has none of the terms walked so far cannot get more than the rest gives; equal scores may win by their id.
            if left[i] < least:
                break
            rows, starts, keys, maxima = self.blocked(term)
            blocks = len(starts) - 1
            if len(keys):
                asked = np.add.outer(np.arange(blocks) * self.vocabulary, np.array([t for _, t in lists[i:]]))
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                bounds = np.where(keys[at] == asked, maxima[at], 0).sum(axis=1)
            else:
                bounds = np.full(blocks, left[i])
            # Blocks that promise most come first, few at a time, so that the others meet a higher tenth score.
            order = np.argsort(-bounds, kind="stable")
            a, width = 0, 1
            while a < blocks:
                least = best[-1][0] if len(best) == top else 0
                if bounds[order[a]] < least:
                    break
                some = order[a : a + width]
                some = some[bounds[some] >= least]
                chosen = np.concatenate([rows[starts[b] : starts[b + 1]] for b in some])
                chosen = chosen[~seen[chosen]]
                seen[chosen] = True
                best = _merged(best, self.exact(chosen, wanted), self.ids[chosen], top)
                a, width = a + width, width * 2
        return best


def companions(items: list[np.ndarray], vocabulary: int) -> list[np.ndarray]:
    """For every term, the terms of the items that it stands in."""
    users: list[list[np.ndarray]] = [[] for _ in range(vocabulary)]
    for item in items:
        for t in item:
            users[t].append(item)
    return [u[0] if len(u) == 1 else np.unique(np.concatenate(u)) if u else np.empty(0, np.int64) for u in users]


def _merged(best: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, top: int) -> list[tuple[int, int]]:
    if len(best) == top:
        keep = scores >= best[-1][0]
        scores, ids = scores[keep], ids[keep]
    if len(scores) > top:
        keep = scores >= np.partition(scores, len(scores) - top)[len(scores) - top]
        scores, ids = scores[keep], ids[keep]
        chosen = np.lexsort((ids, -scores))[:top]
        scores, ids = scores[chosen], ids[chosen]
    return sorted([*best, *((int(s), int(d)) for s, d in zip(scores, ids) if s > 0)], key=lambda x: (-x[0], x[1]))[:top]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, n, starts, terms and tfs of a bounded number of documents and postings at a time."""
    held: list[tuple] = []
    rows = postings = 0

    def joined() -> tuple:
        ids, n, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held))
        return ids, n, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), terms, tfs

    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
            terms, tfs = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
            held.append((ids, part.column(1).to_numpy(), sizes, terms.astype(np.int64), tfs))
            rows, postings = rows + len(ids), postings + len(terms)
            if rows >= SHARD_ROWS or postings >= SHARD_POSTINGS:
                yield joined()
                held, rows, postings = [], 0, 0
    if held:
        yield joined()


def best_of_shards(rows: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """Each task's best documents of each item (by its place in ``items``); a null id stands last among equals."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        asked_with = companions(items, len(weights))
        for ids, n, starts, terms, tfs in _shards(batches):
            m = np.array([ROOM - SLOPE + SLOPE * int(x) * documents // total for x in n], dtype=np.int64)
            m = np.repeat(m, np.diff(starts))
            scores = weights[terms] * (1_000_000 * UNIT * tfs // (UNIT * tfs + SATURATION * m))
            shard = Shard(ids, starts, terms, scores, asked_with)
            for i, item in enumerate(items):
                best[i] = shard.search(item, best[i], top)
        got = [(i, None if d == NO_ID else d, s) for i, rs in enumerate(best) for s, d in rs]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["item", "doc_id", "score"])

    return rows.mapInArrow(found, FOUND)


def weight(documents: int, df: Column) -> Column:
    return F.floor(F.lit(float(UNIT)) * F.log(F.lit(float(2 * documents + 2)) / (2 * df + 1).cast("double"))).cast("bigint")


def search(docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", terms_a_pass: int = TERMS_A_PASS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score (bigint): the ``top`` documents of every item with a score above 0.

    Equal scores by ascending doc_id, a null id last; rows that repeat an id are documents of their own. Rows of one item id are
    one item. Null and empty texts hold no term: such documents are never found and do not count as documents, such items get no
    rows. An empty table on either side gives an empty one; other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    asked = staged(item_terms(items, item_id, item_text), "asked")
    passes = max(1, math.ceil(asked.count() / terms_a_pass))
    numbered = asked.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)).cast("int"))
    out = None
    for k in range(passes):
        # An average of terms_a_pass terms: what is gathered here is bounded, whatever the number of items.
        per_item = numbered.filter(F.col("pass") == k).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        vocabulary = sorted({t for r in per_item for t in r.terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        rows = staged(forward(docs, vocabulary, doc_id, text), "forward")
        whole = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        if not whole.documents or not per_item:
            continue
        df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for r in df.select("term", weight(whole.documents, F.col("df")).alias("w")).collect():
            weights[r.term] = r.w
        wanted = [np.array(sorted(place[t] for t in r.terms), dtype=np.int64) for r in per_item]
        found = best_of_shards(rows.filter(F.size("terms") > 0), wanted, weights, whole.documents, whole.total, top)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(per_item)], "item bigint, item_id bigint")
        part = found.join(names, "item").drop("item")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
