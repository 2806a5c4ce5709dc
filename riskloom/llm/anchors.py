"""Removal of repeated passages by fixed-block anchors.

A passage of ``window`` words holds a whole block of ``block`` words at a place divisible by ``block``
(window >= 2 * block - 1). So the non-overlapping blocks of all documents are indexed, every rolling window
of ``block`` words is a probe, and a probe that meets a block of a document with a smaller id is an anchor.
Anchors are extended: all windows of ``window`` words that hold one are compared by a 96-bit hash, and those
that start in a document with a smaller id cover their words; neighbouring ones make up maximal repeats.

Documents are dealt to groups by a hash of id and text, so rows of one id spread too; rows without an id take no part. What a group asks of the index is one entry for each of
its distinct keys, so a passage that many documents share is one entry for each group, and no list of its
documents or pairs of them is ever made. Entries travel in packed arrays, one for each group and bucket.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import shuffle_tasks, staged, window_hashes, word_hashes, word_places

GROUP_BYTES, BUCKET_BYTES = 32 << 20, 16 << 20
NO_DOC = np.iinfo(np.int64).max
#: Bits of a block's key that travel; chance meetings only cost work, as extension compares the words again.
KEY_SHIFT = np.uint64(16)

def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A key's bucket; it rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a.tobytes()) for a in arrays], dtype="<i8").tobytes(), *[a.tobytes() for a in arrays]])


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, dtype="<i8", count=len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def _six(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = raw.reshape(-1, 6)
    return wide.view("<u8").ravel().astype(np.uint64)


def _ordinals(ids: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """The ids that the columns use, then each column as places in them, in two bytes where those do."""
    used = np.unique(np.concatenate(columns)) if columns else ids
    kind = "<u2" if len(used) < 1 << 16 else "<u4"
    return [used.astype("<i8"), *[np.searchsorted(used, c).astype(kind) for c in columns]]


def _wide(places: np.ndarray, used: np.ndarray, many: int) -> np.ndarray:
    return used[places.view("<u2" if len(used) < 1 << 16 else "<u4")][:many]


def _docs_of(table: pa.Table) -> Iterator[tuple[int | None, bytes, np.ndarray, np.ndarray]]:
    """Id, text and the places of its words."""
    for ids, texts in zip(table.column("_x_id").chunks, table.column("_x_text").chunks):
        for i, t in zip(ids, texts):
            raw = t.as_py()
            yield i.as_py(), raw, *word_places(raw)


def _anchors(table: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    """A group's distinct keys: the largest id that probes each, the smallest id that has it as a block."""
    keys, docs, aligned = [], [], []
    for doc, raw, starts, ends in _docs_of(table):
        if doc is not None and len(starts) >= window:
            k = window_hashes(word_hashes(raw, starts, ends), block, 1)
            keys.append(k)
            docs.append(np.full(len(k), doc, dtype=np.int64))
            aligned.append(np.arange(len(k)) % block == 0)
    out: dict[str, list] = {"bucket": [], "group": [], "asked": []}
    if keys:
        k, d, a = np.concatenate(keys), np.concatenate(docs), np.concatenate(aligned)
        order = np.argsort(k)
        k, d, a = k[order], d[order], a[order]
        at = _runs(k)
        most, least = np.maximum.reduceat(d, at), np.minimum.reduceat(np.where(a, d, NO_DOC), at)
        k, bucket = k[at] >> KEY_SHIFT, _bucket(k[at], buckets)
        ends = np.append(_runs(bucket), len(bucket))
        group = table.column("_x_group")[0].as_py()
        for s, e in zip(ends[:-1], ends[1:]):
            has = np.flatnonzero(least[s:e] != NO_DOC).astype("<u4")
            used, probe, index = _ordinals(d, most[s:e], least[s:e][has])
            out["bucket"].append(int(bucket[s]))
            out["group"].append(group)
            out["asked"].append(_pack(used, _six(k[s:e]), probe, has, index))
    return pa.table(out, schema=pa.schema([("bucket", pa.int64()), ("group", pa.int64()), ("asked", pa.binary())]))


def _met(table: pa.Table) -> pa.Table:
    """For each group the keys that some document probes and a document with a smaller id has as a block."""
    groups, keys, most, least = [], [], [], []
    for chunk in table.to_batches():
        for group, raw in zip(chunk.column("group"), chunk.column("asked")):
            used, six, probe, has, index = _unpack(raw.as_py(), "<i8", "u1", "u1", "<u4", "u1")
            k = _from_six(six)
            low = np.full(len(k), NO_DOC, dtype=np.int64)
            low[has] = _wide(index, used, len(has))
            groups.append(np.full(len(k), group.as_py(), dtype=np.int64))
            keys.append(k)
            most.append(_wide(probe, used, len(k)))
            least.append(low)
    g, k, m, low = (np.concatenate(x) for x in (groups, keys, most, least))
    order = np.argsort(k, kind="stable")
    at = _runs(k[order])
    hit = np.minimum.reduceat(low[order], at) < np.maximum.reduceat(m[order], at)
    chosen = order[np.repeat(hit, np.diff(np.append(at, len(k))))]
    return _by_group(g[chosen], lambda i: _six(k[chosen][i]).tobytes())


def _by_group(groups: np.ndarray, packed: Callable[[np.ndarray], bytes]) -> pa.Table:
    order = np.argsort(groups, kind="stable")
    ends = np.append(_runs(groups[order]), len(groups)) if len(groups) else np.array([0])
    rows = [(int(groups[order[s]]), packed(order[s:e])) for s, e in zip(ends[:-1], ends[1:])]
    return pa.table({"_x_group": pa.array([r[0] for r in rows], type=pa.int64()), "answer": pa.array([r[1] for r in rows], type=pa.binary())})


class _Keys:
    """Ascending keys with a table of their low bits, which turns most strangers away at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << max(10, int(len(keys)).bit_length() + 3)) - 1)
        self.low = np.zeros(int(self.mask) + 1, dtype=bool)
        self.low[keys & self.mask] = True

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are among these, and the first place of each."""
        maybe = np.flatnonzero(self.low[keys & self.mask]) if len(self.keys) else np.zeros(0, dtype=np.int64)
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        found = self.keys[at] == keys[maybe]
        return maybe[found], at[found]


def _second(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The other 32 bits of the windows that start at ``at``."""
    if not len(at):
        return np.zeros(0, dtype="<u4")
    edge = np.concatenate(([True], at[1:] > at[:-1] + 1))
    starts, ends = at[edge], at[np.concatenate((edge[1:], [True]))]
    parts = [window_hashes(h[s : e + window], window, 3) for s, e in zip(starts, ends)]
    return (np.concatenate(parts) >> np.uint64(32)).astype("<u4")


def _extended(docs: pa.Table, answers: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    """The hashes of a group's windows that hold an anchor: smallest and largest id of each."""
    anchors = np.unique(_from_six(np.frombuffer(b"".join(a.as_py() for a in answers.column("answer")), dtype=np.uint8)))
    first, second, owner = [], [], []
    known = _Keys(anchors)
    for doc, raw, starts, ends in _docs_of(docs) if len(anchors) else ():
        if doc is not None and len(starts) >= window:
            h = word_hashes(raw, starts, ends)
            met = known.places(window_hashes(h, block, 1) >> KEY_SHIFT)[0]
            if len(met):
                anchored = np.zeros(len(h) - block + 2, dtype=np.int64)
                anchored[met + 1] = 1
                found = np.cumsum(anchored)
                at = np.flatnonzero(found[window - block + 1 :] > found[: len(h) - window + 1])
                first.append(window_hashes(h, window, 2)[at])
                second.append(_second(h, at, window))
                owner.append(np.full(len(at), doc, dtype=np.int64))
    out: dict[str, list] = {"bucket": [], "group": [], "asked": []}
    if first:
        a, b, d = np.concatenate(first), np.concatenate(second), np.concatenate(owner)
        order = np.lexsort((b, a))
        a, b, d = a[order], b[order], d[order]
        at = np.union1d(_runs(a), _runs(b))
        low, high = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
        a, b, bucket = a[at], b[at], _bucket(a[at], buckets)
        ends = np.append(_runs(bucket), len(bucket))
        group = docs.column("_x_group")[0].as_py()
        for s, e in zip(ends[:-1], ends[1:]):
            used, lo, hi = _ordinals(d, low[s:e], high[s:e])
            out["bucket"].append(int(bucket[s]))
            out["group"].append(group)
            out["asked"].append(_pack(used, a[s:e].astype("<u8"), b[s:e], lo, hi))
    return pa.table(out, schema=pa.schema([("bucket", pa.int64()), ("group", pa.int64()), ("asked", pa.binary())]))


def _first_owner(table: pa.Table) -> pa.Table:
    """For each group its windows that a document with a smaller id than its largest has, and the smallest id."""
    groups, a, b, low, high = [], [], [], [], []
    for chunk in table.to_batches():
        for group, raw in zip(chunk.column("group"), chunk.column("asked")):
            used, x, y, lo, hi = _unpack(raw.as_py(), "<i8", "<u8", "<u4", "u1", "u1")
            groups.append(np.full(len(x), group.as_py(), dtype=np.int64))
            a.append(x)
            b.append(y)
            low.append(_wide(lo, used, len(x)))
            high.append(_wide(hi, used, len(x)))
    g, x, y, lo, hi = (np.concatenate(z) for z in (groups, a, b, low, high))
    order = np.lexsort((y, x))
    at = np.union1d(_runs(x[order]), _runs(y[order]))
    least = np.empty(len(x), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(lo[order], at), np.diff(np.append(at, len(x))))
    chosen = np.flatnonzero(least < hi)
    return _by_group(g[chosen], lambda i: _pack(x[chosen][i].astype("<u8"), y[chosen][i], least[chosen][i].astype("<i8")))


def _covered(doc: int | None, raw: bytes, starts: np.ndarray, ends: np.ndarray, known: _Keys, b: np.ndarray, low: np.ndarray, same: int, window: int) -> np.ndarray:
    """Which words of a document are covered by a window that a document with a smaller id has."""
    gone = np.zeros(len(starts) + 1, dtype=np.int64)
    if doc is not None and len(starts) >= window and len(known.keys):
        h = word_hashes(raw, starts, ends)
        found, at = known.places(window_hashes(h, window, 2))
        second = _second(h, found, window)
        hit = np.zeros(len(found), dtype=bool)
        for step in range(same):  # one, but for colliding hashes
            place = np.minimum(at + step, len(known.keys) - 1)
            hit |= (known.keys[place] == known.keys[at]) & (b[place] == second) & (low[place] < doc)
        gone[found[hit]] += 1
        gone[found[hit] + window] -= 1
    return np.cumsum(gone[:-1]) > 0


def _finished(docs: pa.Table, answers: pa.Table, window: int, finish, kinds: pa.Schema) -> pa.Table:
    parts = [_unpack(x.as_py(), "<u8", "<u4", "<i8") for x in answers.column("answer")]
    a, b, low = (np.concatenate(z) for z in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    order = np.lexsort((b, a))
    a, b, low = a[order].astype(np.uint64), b[order], low[order]
    known, same = _Keys(a), int(np.diff(np.append(_runs(a), len(a))).max()) if len(a) else 0
    made = [finish(raw, starts, ends, _covered(doc, raw, starts, ends, known, b, low, same, window)) for doc, raw, starts, ends in _docs_of(docs)]
    kept = docs.drop_columns(["_x_id", "_x_text", "_x_group"])
    for i, f in enumerate(kinds):
        kept = kept.append_column(f, pa.array([m[i] for m in made], type=f.type))
    return kept


def _joined(raw: bytes, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> bytes:
    """The kept words joined by one space."""
    if not kept.any():
        return b""
    data = np.frombuffer(raw + b" ", dtype=np.uint8)
    inner = ends[:-1]
    if kept.all() and ends[-1] - starts[0] == len(raw) and (starts[1:] == inner + 1).all() and (data[inner] == 32).all():
        return raw
    data = data.copy()
    data[ends] = 32
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts[kept]] += 1
    step[ends[kept] + 1] -= 1
    return data[np.cumsum(step[:-1], dtype=np.int8).view(bool)].tobytes()[:-1]


def digest(raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple[int, int, str]:
    """Words, words removed, SHA-256 of the kept words joined by one space."""
    return len(gone), int(gone.sum()), hashlib.sha256(_joined(raw, starts, ends, ~gone)).hexdigest()


DIGEST = ("n_words bigint, n_removed bigint, kept_sha256 string", pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))


def spans(raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple[int, list[list[int]]]:
    """Words, and the maximal repeats as [first word, word after the last]."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return len(gone), edge.reshape(-1, 2).tolist()


SPANS = ("n_words bigint, repeats array<array<bigint>>", pa.schema([("n_words", pa.int64()), ("repeats", pa.list_(pa.list_(pa.int64())))]))


def cleaned(raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple[int, str]:
    """Words removed, and the text without them and without the white space that follows each."""
    if not gone.any():
        return 0, raw.decode("utf-8", "replace")
    until = np.append(starts[1:], len(raw))
    step = np.zeros(len(raw) + 1, dtype=np.int8)
    step[starts[gone]] += 1
    step[until[gone]] -= 1
    keep = np.cumsum(step[:-1], dtype=np.int8) == 0
    return int(gone.sum()), np.frombuffer(raw, dtype=np.uint8)[keep].tobytes().decode("utf-8", "replace")


CLEANED = ("n_removed bigint, text string", pa.schema([("n_removed", pa.int64()), ("text", pa.string())]))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = 13, block: int | None = None, finish=digest, result=DIGEST) -> DataFrame:
    """The columns of ``keep`` and what ``finish`` makes of each row's words and the mask of repeated ones.

    A word is repeated if it lies in ``window`` consecutive words that also start in a document with a smaller id.
    All is judged on the input. Null texts have no words; rows with a null id repeat nothing and are
    repeated by nothing; rows with the same id do not repeat each other. Texts below ``window`` words and
    empty tables pass unchanged. Lost tasks are redone from the input and the written answers.
    """
    block = block or (window + 1) // 2
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole aligned block")
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = shuffle_tasks(spark)
    groups, buckets = max(2 * tasks, math.ceil(total / GROUP_BYTES)), max(tasks, math.ceil(total / BUCKET_BYTES))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_x_id"), whole.alias("_x_text"), *[F.col(c) for c in keep if c != text])
    rows = rows.withColumn("_x_group", F.pmod(F.xxhash64("_x_id", "_x_text"), F.lit(groups)).cast("bigint"))
    unknown, rows = rows.filter(F.col("_x_id").isNull()), rows.filter(F.col("_x_id").isNotNull())
    slim = rows.select("_x_group", "_x_id", "_x_text")
    asked, answer = "bucket bigint, group bigint, asked binary", "_x_group bigint, answer binary"

    anchors = slim.groupBy("_x_group").applyInArrow(lambda t: _anchors(t, window, block, buckets), asked)
    met = staged(anchors.groupBy("bucket").applyInArrow(_met, answer), "anchors")
    extended = slim.groupBy("_x_group").cogroup(met.groupBy("_x_group")).applyInArrow(lambda d, a: _extended(d, a, window, block, buckets), asked)
    owners = staged(extended.groupBy("bucket").applyInArrow(_first_owner, answer), "owners")
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep if c != text)
    fields = f"{fields + ', ' if fields else ''}{result[0]}"

    def unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = pa.table({"answer": pa.array([], type=pa.binary())})
        for batch in batches:
            yield from _finished(pa.Table.from_batches([batch]), nothing, window, finish, result[1]).to_batches()

    known = rows.groupBy("_x_group").cogroup(owners.groupBy("_x_group")).applyInArrow(lambda d, a: _finished(d, a, window, finish, result[1]), fields)
    return known.unionByName(unknown.mapInArrow(unchanged, fields))
