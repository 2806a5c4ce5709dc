"""Near duplicates by a chosen-path similarity join on sets of word shingles.

Equal sets are one class. Each class has a signature of minwise tokens. A tree starts with all classes; a
node branches by the tokens at one position of the signature, chosen by the node, and at times a second, so
that two classes of the wanted similarity are expected to stay together in about one child. Nodes of few
classes are compared exhaustively by signature. Several independent trees make the chance to miss a pair
negligible. In a large node, classes close to a pivot become candidates with it and leave; only what lies
around a pivot's classes is still compared with them (signature distance is a metric, so nothing farther
can be close to one). So a large group of near copies costs one comparison for each member, not for each pair.

Candidates that hang together are gathered once, with their whole sets, and linked exactly; a gathering of
more than BLOCK classes or BLOCK_SHINGLES shingles is cut into blocks that share pivots, and what the blocks leave apart is then
compared with all blocks. Only links that join what is still apart are kept, so output is linear.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import mixed, staged, window_hashes, word_hashes, word_places

POSITIONS = 128
#: Nodes of at most so many classes are compared exhaustively; classes, and their shingles, that one task links.
SMALL, BLOCK, BLOCK_SHINGLES = 4096, 4096, 4_000_000
#: Members of a large node among which pivots are looked for, and pivots of a node.
LOOKED_AT, PIVOTS = 64, 4
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

_FACTORS = mixed(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(raw: bytes | None, width: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles; a text of fewer words is one shingle, an empty one none."""
    lower = (raw or b"").translate(LOWER)
    starts, ends = word_places(lower)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(word_hashes(lower, starts, ends), min(width, len(starts)), 11))


def signature(tokens: np.ndarray) -> np.ndarray:
    """The least of each of POSITIONS hash functions over a set that is not empty."""
    out = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(tokens), 8192):
        part = mixed(tokens[a : a + 8192])
        for b in range(0, POSITIONS, 32):
            np.minimum(out[b : b + 32], (part[None, :] * _FACTORS[b : b + 32, None]).min(axis=1), out=out[b : b + 32])
    return (out >> np.uint64(32)).astype("<u4")


def least_agreement(similar: float) -> float:
    """Below this share of equal positions a pair is taken to be below ``similar``: 4.5 deviations lower."""
    return similar - 4.5 * math.sqrt(similar * (1 - similar) / POSITIONS)


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype="<u4").reshape(-1, POSITIONS)


def children(nodes: np.ndarray, signatures: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows and the child nodes they go to: by the node's position, and its second if it has one."""
    choice = mixed(nodes + np.uint64(0x1F83D9ABFB41BD6B))
    first = (choice % np.uint64(POSITIONS)).astype(np.int64)
    second = ((choice >> np.uint64(8)) % np.uint64(POSITIONS)).astype(np.int64)
    extra = (choice >> np.uint64(40)).astype(float) / (1 << 24) < 1.2 * (1 / similar - 1)
    rows = np.arange(len(nodes))
    at = np.concatenate([rows, rows[extra]])
    position = np.concatenate([first, second[extra]])
    token = signatures[at, position].astype(np.uint64)
    return at, mixed(mixed(nodes[at] + token * np.uint64(0x9E3779B97F4A7C15)) + position.astype(np.uint64))


class Forest:
    """Joins of numbered things; tells which joins were needed."""

    def __init__(self, labels: list[int]):
        self.up = list(range(len(labels)))
        seen: dict[int, int] = {}
        for i, label in enumerate(labels):
            self.join(seen.setdefault(label, i), i)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def close_pairs(ids: np.ndarray, signatures: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of a small node that join all members which agree in at least that share, directly or by others."""
    n, out = len(ids), []
    apart = np.arange(n)
    for i in range(n):
        others = apart != apart[i]
        if not others.any():
            break
        agree = np.count_nonzero(signatures == signatures[i], axis=1) >= least * POSITIONS
        for j in np.flatnonzero(agree & others):
            if apart[j] != apart[i]:
                out.append((int(ids[i]), int(ids[j])))
                apart[apart == apart[j]] = apart[i]
    return out


def links(ids: list[int], sets: list[np.ndarray], share: tuple[int, int], labels: list[int] | None = None, only: int | None = None) -> list[tuple[int, int]]:
    """Links, each needed to join what is apart, between sets with share[1] * common >= share[0] * union.

    ``labels`` tells what is joined already. With ``only``, pairs among the first so many and with others count.
    """
    n, out = len(ids), []
    if n < 2:
        return out
    sizes = np.array([len(s) for s in sets])
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    forest = Forest(labels if labels is not None else list(range(n)))
    seen = np.zeros(int(tokens.max()) + 1, dtype=bool)
    left = len({forest.root(i) for i in range(n)})
    for i in range(n if only is None else only):
        if left < 2:
            break
        mine = tokens[starts[i] : starts[i] + sizes[i]]
        seen[mine] = True
        common = np.add.reduceat(seen[tokens], starts, dtype=np.int64)
        seen[mine] = False
        for j in np.flatnonzero(share[1] * common >= share[0] * (sizes[i] + sizes - common)):
            if j != i and forest.join(i, int(j)):
                out.append((ids[i], ids[int(j)]))
                left -= 1
    return out


def _pivots(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Of a node's members looked at: the one most like the rest, then the most central of those not close to it."""
    sigs = np.stack([np.frombuffer(s, dtype="<u4") for s in pdf["sig"]])
    ids = pdf["class_id"].to_numpy()
    agree = np.stack([(sigs == s).mean(axis=1) for s in sigs])
    free, chosen = np.ones(len(ids), dtype=bool), []
    while free.any() and len(chosen) < PIVOTS:
        best = int(np.argmax(np.where(free, agree.mean(axis=1), -1)))
        chosen.append(best)
        free &= agree[best] < least
    return pd.DataFrame({"node": [pdf["node"].iloc[0]], "pivot_ids": [ids[chosen].tolist()], "pivots": [sigs[chosen].tobytes()]})


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (the smallest id reachable) of every id in ``edges`` (a, b), by stars.

    Alternates two steps until nothing changes: each id's larger neighbours go to its smallest one, then its
    smaller neighbours do. Rows only ever join an id with one minimum; no list of neighbours is made.
    """
    pairs = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, before = staged(pairs, "edges"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        pairs = staged(small.filter(F.col("a") != F.col("b")).distinct(), "edges")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # Nothing changes any more only when every id but the smallest points at the smallest.
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def classes(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """doc_id, n_shingles, class_id of every row; least_id, same (digest) and sig of its class with rows of the class's least id.

    A class is one set, whatever ids its rows have, so rows that share an id and differ in text are in classes of their own.
    class_id is a number of the class (null for an empty set or a null id), least_id the smallest id of its rows.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            sigs = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([digest(s) for s in sets], type=pa.binary()), pa.array(sigs, type=pa.binary())], names=["doc_id", "n_shingles", "same", "sig"])

    sets = staged(slim.mapInArrow(run, "doc_id bigint, n_shingles bigint, same binary, sig binary"), "sets")
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    first = sets.filter(some).groupBy("same").agg(F.min("doc_id").alias("least_id"))
    # Numbers of written rows: unique, and the same ever after.
    first = staged(first.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    shows = some & (F.col("doc_id") == F.col("least_id"))
    return sets.join(first, "same", "left").select(
        "doc_id", "n_shingles", F.when(some, F.col("class_id")).alias("class_id"), *[F.when(shows, F.col(c)).alias(c) for c in ("least_id", "same", "sig")]
    )


def _by_node(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Close pairs of every node in a partition sorted by node; nodes may go on in the next batch."""
    nodes, ids, sigs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, POSITIONS), "<u4")

    def pairs(nodes: np.ndarray, ids: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate((np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1]))), [len(nodes)])) if len(nodes) else np.zeros(1, int)
        size = np.diff(starts)
        two = starts[:-1][size == 2]
        close = two[(sigs[two] == sigs[two + 1]).mean(axis=1) >= least] if len(two) else two
        a, b = ids[close].tolist(), ids[close + 1].tolist()
        for s, n in zip(starts[:-1][size > 2], size[size > 2]):
            for x, y in close_pairs(ids[s : s + n], sigs[s : s + n], least):
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            nodes = np.concatenate([nodes, np.asarray(batch.column("node"))])
            ids = np.concatenate([ids, np.asarray(batch.column("class_id"))])
            sigs = np.concatenate([sigs, _sig(batch.column("sig"))])
            whole = int(np.searchsorted(nodes, nodes[-1]))
            yield pairs(nodes[:whole], ids[:whole], sigs[:whole])
            nodes, ids, sigs = nodes[whole:], ids[whole:], sigs[whole:]
    yield pairs(nodes, ids, sigs)


def candidates(reps: DataFrame, similar: float, trees: int) -> DataFrame:
    """Pairs a, b of classes that hang together by signature; ``reps`` has class_id, sig."""
    least = least_agreement(similar)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs, ids = _sig(batch.column("sig")), np.asarray(batch.column("class_id"))
                for tree in range(trees):
                    at, node = children(np.full(len(ids), mixed(np.array([tree + 1], dtype=np.uint64))[0], dtype=np.uint64), sigs, similar)
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[at])], names=["node", "class_id"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each member of large nodes against the node's pivots: linked, around, or going on to children."""
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs, ids, nodes = _sig(batch.column("sig")), np.asarray(batch.column("class_id")), np.asarray(batch.column("node"))
            best, which = np.full(len(ids), -1.0), np.full(len(ids), -1, dtype=np.int64)
            around: list[list[int]] = [[] for _ in ids]
            shares: list[list[float]] = [[] for _ in ids]
            for i, (raw, pivot_ids) in enumerate(zip(batch.column("pivots"), batch.column("pivot_ids"))):
                pivots = np.frombuffer(raw.as_py(), dtype="<u4").reshape(-1, POSITIONS)
                agree = (pivots == sigs[i]).mean(axis=1)
                names = pivot_ids.as_py()
                k = int(agree.argmax())
                best[i], which[i] = agree[k], names[k]
                shares[i] = agree.tolist()
                around[i] = [p for p, s in zip(names, agree) if 2 * least - 1 <= s < least]
            linked = best >= least
            free = np.flatnonzero(~linked)
            # Classes of two pivots may be close to one another where the pivots are: then both are gathered together.
            joined = [(i, p, s) for i in np.flatnonzero(linked) if which[i] == ids[i] for p, s in zip(batch.column("pivot_ids")[i].as_py(), shares[i]) if p != ids[i] and s >= 3 * least - 2]
            at, child = children(nodes[free].view(np.uint64), sigs[free], similar)
            rows = [("link", int(nodes[i]), int(ids[i]), int(which[i]), float(best[i])) for i in np.flatnonzero(linked)]
            rows += [("join", int(nodes[i]), int(ids[i]), p, float(s)) for i, p, s in joined]
            rows += [("near", int(nodes[i]), int(ids[i]), p, float(s)) for i in free for p, s in zip(batch.column("pivot_ids")[i].as_py(), shares[i]) if p in around[i]]
            rows += [("go", int(c), int(ids[free[j]]), 0, 0.0) for j, c in zip(at, child.view(np.int64))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["kind", "node", "class_id", "pivot", "share"])

    found: list[DataFrame] = []
    rows = reps.mapInArrow(roots, "node bigint, class_id bigint")
    while True:
        rows = staged(rows, "nodes")
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
        sized = staged(rows.join(sizes, "node"), "sized")
        small = sized.filter(F.col("size") <= SMALL).join(reps, "class_id").select("node", "class_id", "sig")
        found.append(staged(small.repartition("node").sortWithinPartitions("node", "class_id").mapInArrow(lambda b: _by_node(b, least), "a bigint, b bigint"), "pairs"))
        large = sized.filter(F.col("size") > SMALL)
        if not large.take(1):
            return reduce(DataFrame.unionByName, found)
        large = staged(large.join(reps, "class_id").select("node", "class_id", "sig"), "large")
        looked = Window.partitionBy("node").orderBy(F.xxhash64("class_id", "node"))
        seen = large.withColumn("_x_n", F.row_number().over(looked)).filter(F.col("_x_n") <= LOOKED_AT).select("node", "class_id", "sig")
        pivots = seen.groupBy("node").applyInPandas(lambda p: _pivots(p, least), "node bigint, pivot_ids array<bigint>, pivots binary")
        tried = staged(large.join(pivots, "node").mapInArrow(split, "kind string, node bigint, class_id bigint, pivot bigint, share double"), "tried")
        linked = tried.filter("kind = 'link'")
        found.append(tried.filter("kind = 'join' or (kind = 'link' and class_id <> pivot)").select(F.col("class_id").alias("a"), F.col("pivot").alias("b")))
        near = tried.filter("kind = 'near'")
        if near.take(1):
            found.append(staged(_around(near, linked, reps, least), "around"))
        rows = tried.filter("kind = 'go'").select("node", "class_id").distinct()


def _around(near: DataFrame, linked: DataFrame, reps: DataFrame, least: float, chunk: int = 256) -> DataFrame:
    """Close pairs between classes around a pivot and those linked with it, block by block."""
    key = ["node", "pivot"]
    chunks = near.groupBy(*key).agg(F.ceil(F.count("*") / chunk).alias("_x_chunks"))
    blocks = linked.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("_x_blocks"))
    both = chunks.join(blocks, key)
    left = near.join(both, key).withColumn("chunk", F.pmod(F.xxhash64("class_id"), "_x_chunks")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_x_blocks") - 1)))
    right = linked.join(both, key).withColumn("block", F.pmod(F.xxhash64("class_id"), "_x_blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_x_chunks") - 1)))
    columns = [*key, "chunk", "block", "class_id", "sig"]
    # New names of the same columns, as both sides come from one table.
    left, right = (x.join(reps, "class_id").select(*[F.col(c).alias(c) for c in columns]) for x in (left, right))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            sigs, ids = np.stack([np.frombuffer(s, dtype="<u4") for s in b["sig"]]), b["class_id"].to_numpy()
            for i, s in zip(a["class_id"], a["sig"]):
                agree = (sigs == np.frombuffer(s, dtype="<u4")).mean(axis=1)
                k = int(agree.argmax())
                if agree[k] >= least:
                    out.append((i, ids[k]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return left.groupBy(*key, "chunk", "block").cogroup(right.groupBy(*key, "chunk", "block")).applyInPandas(compare, "a bigint, b bigint")


def _linked_blocks(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Exact links of every (gathering, block) in a partition sorted by both; one is held at a time."""
    key, ids, sets = None, [], []

    def made() -> pa.RecordBatch:
        pairs = links(ids, sets, share)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], type=pa.int64()), pa.array([p[1] for p in pairs], type=pa.int64()), pa.array([key[0]] * len(pairs), type=pa.int64())], names=["a", "b", "gathering"])

    for batch in batches:
        for g, b, i, s in zip(*(batch.column(c) for c in ("gathering", "block", "class_id", "tokens"))):
            at = (g.as_py(), b.as_py())
            if at != key:
                if len(ids) > 1:
                    yield made()
                key, ids, sets = at, [], []
            if not ids or ids[-1] != i.as_py():
                ids.append(i.as_py())
                sets.append(np.frombuffer(s.as_py(), dtype="<u8"))
    if len(ids) > 1:
        yield made()


def linked(docs: DataFrame, gathered: DataFrame, reps: DataFrame, doc_id: str, text: str, shingle: int, share: tuple[int, int]) -> DataFrame:
    """Links a, b that join classes as the whole sets say; ``gathered`` has id and component (the gathering), ``reps`` the classes."""
    weighed = gathered.join(reps.select(F.col("class_id").alias("id"), "n_shingles"), "id")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("bigint")
    sizes = weighed.groupBy("component").agg(blocks.alias("blocks"))
    whose = reps.select("class_id", "least_id", "same")
    gathered = staged(weighed.join(sizes, "component").select(F.col("id").alias("class_id"), F.col("component").alias("gathering"), "blocks").join(whose, "class_id"), "gathered")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("least_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            # An id may have other texts, too; the class's own is told by its digest.
            own = pa.array([digest(x) == y.as_py() for x, y in zip(sets, batch.column("same"))], type=pa.bool_())
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("gathering", "blocks", "class_id")], pa.array([x.astype("<u8").tobytes() for x in sets], type=pa.binary())], names=["gathering", "blocks", "class_id", "tokens"])
            yield out.filter(own)

    # Texts go to their gatherings by a shuffle at every size: the list of gathered classes grows with the documents.
    sets = texts.hint("merge").join(gathered.hint("merge"), "least_id").select("gathering", "blocks", "class_id", "same", "text").mapInArrow(tokens, "gathering bigint, blocks bigint, class_id bigint, tokens binary")
    some_large = bool(gathered.filter(F.col("blocks") > 1).take(1))
    if some_large:
        sets = staged(sets, "tokens")
    placed = sets.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("bigint"))
    columns = ["gathering", "block", "class_id", "tokens"]
    work = placed.select(*columns)
    if some_large:
        order = Window.partitionBy("gathering").orderBy(F.xxhash64("class_id"))
        shown = gathered.filter(F.col("blocks") > 1).withColumn("_x_n", F.row_number().over(order)).filter(F.col("_x_n") <= LOOKED_AT).select("class_id")
        pivots = sets.join(shown, "class_id", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        work = work.unionByName(pivots.select(*columns))
    found = work.repartition("gathering", "block").sortWithinPartitions("gathering", "block", "class_id").mapInArrow(lambda b: _linked_blocks(b, share), "a bigint, b bigint, gathering bigint")
    found = staged(found, "links")
    if not some_large:
        return found.select("a", "b")
    # What the blocks left apart in a large gathering, against all of its blocks.
    label = components(found.select("a", "b"))
    large = placed.filter(F.col("blocks") > 1).join(label, F.col("class_id") == F.col("id"), "left").withColumn("label", F.coalesce("component", "class_id")).select("gathering", "blocks", "block", "class_id", "label", "tokens")
    large = staged(large, "large")
    counted = large.groupBy("gathering", "label").agg(F.count("*").alias("n"))
    main = counted.groupBy("gathering").agg(F.max(F.struct("n", "label")).alias("main")).select("gathering", F.col("main.label").alias("main"))
    rest = large.join(main, "gathering").filter(F.col("label") != F.col("main")).drop("main")
    amount = rest.groupBy("gathering").agg(F.ceil(F.count("*") / 256).alias("_x_chunks"))
    left = rest.join(amount, "gathering").withColumn("chunk", F.pmod(F.xxhash64("class_id"), "_x_chunks")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    right = large.join(amount, "gathering").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_x_chunks") - 1)))
    keys = ["gathering", "chunk", "block"]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        both = pd.concat([a, b[~b["class_id"].isin(a["class_id"])]])
        pairs = links(both["class_id"].tolist(), [np.frombuffer(s, dtype="<u8") for s in both["tokens"]], share, both["label"].tolist(), len(a))
        return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

    columns = [*keys, "class_id", "label", "tokens"]
    left, right = (x.select(*[F.col(c).alias(c) for c in columns]) for x in (left, right))
    more = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a bigint, b bigint")
    return found.select("a", "b").unionByName(more)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, share: tuple[int, int] = (80, 100), trees: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Words are lower-cased in A-Z and cut at ASCII white space; texts with ``share[1]`` * common shingles >=
    ``share[0]`` * shingles of either are linked, confirmed on whole sets. A component is all that links
    reach; its smallest id is kept. Empty and null texts are linked with nothing. Rows with a null id are
    linked with nothing and kept, without a component. Rows of one id and different texts join their
    components. Repeated rows have the same result each. An empty table gives no rows.
    """
    similar = share[0] / share[1]
    known = staged(classes(docs, doc_id, text, shingle), "known")
    shown = known.filter(F.col("sig").isNotNull()).groupBy("class_id")
    reps = staged(shown.agg(F.max("n_shingles").alias("n_shingles"), *[F.min(c).alias(c) for c in ("least_id", "same", "sig")]), "reps")
    known = known.select("doc_id", "n_shingles", "class_id")
    pairs = candidates(reps.select("class_id", "sig"), similar, trees)
    edges = linked(docs, components(pairs), reps, doc_id, text, shingle, share) if pairs.take(1) else None
    # Ids with several texts join the classes of these.
    several = known.filter(F.col("class_id").isNotNull()).groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a <> b")
    if several.take(1):
        own = known.join(several.select("doc_id", "a"), "doc_id").filter(F.col("class_id") != F.col("a")).select("a", F.col("class_id").alias("b"))
        edges = own if edges is None else edges.unionByName(own)
    least = reps.select(F.col("class_id").alias("id"), "least_id")
    if edges is not None:
        labels = components(edges).join(least, "id")
        smallest = labels.groupBy("component").agg(F.min("least_id").alias("_x_least"))
        joined = labels.join(smallest, "component").select("id", "_x_least")
        least = least.join(joined, "id", "left").select("id", F.coalesce("_x_least", "least_id").alias("least_id"))
    out = known.join(least, known["class_id"] == least["id"], "left")
    component = F.coalesce("least_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
