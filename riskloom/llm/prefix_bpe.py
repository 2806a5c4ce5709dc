"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a piece there is one token with which its encoding ends: the token whose pairing
with the last token of what stands before it is one that the merges leave apart. One array of last tokens
holds the encodings of all prefixes, so bytes can be appended without redoing what stands before them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunks (words with the space before them) whose ids one worker keeps, in each of two generations.
CHUNKS = 300_000


def read_ranks(spark: SparkSession, path: str) -> list[tuple[bytes, int]]:
    """A rank file: a base64 token and its rank in each line. Its size is that of a vocabulary."""
    lines = open(path, "rb").read().split(b"\n") if "://" not in path else [r[0].encode() for r in spark.read.text(path).collect()]
    return [(base64.b64decode(t), int(n)) for t, n in (x.split() for x in lines if x)]


class PrefixBpe:
    """Encodes pieces of bytes; ``ranks`` are (token, rank), rank also being the id."""

    def __init__(self, ranks: list[tuple[bytes, int]]):
        self.ids = dict(ranks)
        self.tokens = {n: t for t, n in ranks}
        self.longest = max(map(len, self.ids), default=0)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.apart: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.sizes = {n: len(t) for t, n in ranks}
        self.finder = ahocorasick.Automaton()  # all tokens that end at a byte; bytes as Latin-1 text
        for token, n in sorted(ranks, key=lambda r: r[1]):
            self.finder.add_word(token.decode("latin-1"), (n, len(token)))
            if len(token) > 1:
                left, right = self._last_merge(token, n)
                if left is not None:
                    self.halves[n] = (left, right)
                    self.joined[left, right] = n
        self.finder.make_automaton()

    def _last_merge(self, token: bytes, rank: int):
        """The two tokens that the merges of lower rank leave of ``token``; (None, None) if not two."""
        parts = [self.ids[token[i : i + 1]] for i in range(len(token)) if token[i : i + 1] in self.ids]
        if len(parts) != len(token):
            return None, None
        while len(parts) > 2:
            found = min(((m, i) for i in range(len(parts) - 1) if (m := self.ids.get(self.tokens[parts[i]] + self.tokens[parts[i + 1]], rank)) < rank), default=None)
            if found is None:
                return None, None
            parts[found[1] : found[1] + 2] = [found[0]]
        return tuple(parts)

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens, standing side by side, as they are.

        Undoes merges from the later one backwards: at each time the pieces that touch at the seam must
        not make a token that would have been merged before the merge undone last.
        """
        if self.pairs >= 1_000_000:
            self.apart.clear()
            self.pairs = 0
        self.pairs += 1
        known = self.apart.setdefault(left, {})[right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        # Times of merges, right side after left side for equal ranks: merges run from the left.
        until = (1 << 60, 0)
        while True:
            made = self.joined.get((left, right))
            if made is not None and (made, 0) < until:
                return False
            split_left, split_right = self.halves.get(left), self.halves.get(right)
            if split_left is None and split_right is None:
                return True
            if split_right is None or (split_left is not None and left > right):
                until, left = (left, 0), split_left[1]
            else:
                until, right = (right, 1), split_right[0]

    def last_tokens(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """``last[i]`` is the last token of the encoding of ``piece[:i]`` (``last[0]`` is -1).

        Given the array of an earlier, shorter ``piece``, only what the new bytes add is worked out.
        """
        size = len(piece)
        start = len(last) - 1 if last else 0
        out = [*last, *[-1] * (size - start)] if last else [-1] * (size + 1)
        near = max(0, start - self.longest)
        rights = self.apart
        for stop, (token, size) in self.finder.iter(piece[near:].decode("latin-1")):
            stop += near + 1
            if out[stop] < 0 and stop > start:
                if stop > size:
                    before = out[stop - size]
                    if before < 0:
                        continue
                    try:
                        if not rights[before][token]:
                            continue
                    except KeyError:
                        if not self.stays_apart(before, token):
                            continue
                out[stop] = token
        return out

    def ids_of(self, last: list[int]) -> list[int]:
        """The encoding that an array of last tokens holds."""
        out, at, sizes = [], len(last) - 1, self.sizes
        while at:
            token = last[at]
            if token < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        return [whole] if whole is not None else self.ids_of(self.last_tokens(piece))

    def replace(self, piece: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """``piece`` with ``piece[start:stop]`` replaced, and its array; worked out only near the edit.

        Behind the edit, old entries hold again from where as many in a row as the longest token has bytes
        are the same as before: an entry hangs only on those.
        """
        text = piece[:start] + new + piece[stop:]
        out = last[: start + 1]
        shift, same = len(new) - (stop - start), 0
        while len(out) <= len(text):
            out = self.last_tokens(text[: len(out)], out)
            at = len(out) - 1
            old = at - shift
            same = same + 1 if at > start + len(new) and last[old] == out[at] else 0
            if same >= self.longest:
                return text, out + last[old + 1 :]
        return text, out


class TextEncoder:
    """Whole texts: each match of the pattern is a piece of its own; ids of chunks seen lately are kept."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        self.bpe = PrefixBpe(ranks)
        self.pieces = regex.compile(pattern)
        self.young: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def ids(self, text: str) -> list[int]:
        return [i for p in self.pieces.findall(text) for i in self.bpe.encode(p.encode())]

    def _entry(self, chunk: str) -> tuple[str, bytes]:
        ids = self.ids(chunk)
        return " ".join(map(str, ids)), b"".join(map(self.bpe.tokens.__getitem__, ids))

    def _after_space(self, chunk: str) -> tuple[str, bytes]:
        """The ids, as text, and the bytes they decode to, of a chunk with the space before it."""
        found = self.old.get(chunk) or self._entry(" " + chunk)
        if len(chunk) <= 64:
            if len(self.young) >= CHUNKS:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the bytes they decode to.

        A match of a pattern with an optional single space before a word never crosses from a non-space to
        a space, so a text without runs of spaces may be cut before each space and the chunks looked up.
        """
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            found = [self._entry(text)]
        elif text:
            first, *rest = text.split(" ")
            found = [self.young.get(c) or self._after_space(c) for c in rest]
            found.append(self._entry(first))
            found.insert(0, found.pop())
        else:
            found = []
        ids = " ".join([f[0] for f in found])
        return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([f[1] for f in found])).hexdigest()


def restart(pieces: list[str]) -> int:
    """How many leading pieces stay pieces whatever is appended: all that end three characters before the end."""
    rest = 0
    for k in range(len(pieces) - 1, -1, -1):
        if rest >= 3:
            return k + 1
        rest += len(pieces[k])
    return 0


_ENCODERS: dict = {}


def encoder(key: str, ranks: list[tuple[bytes, int]], pattern: str) -> TextEncoder:
    """One encoder for each worker and vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(ranks, pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every text; null is the empty text."""
    return _mapped(docs, ranks, pattern, doc_id, text, "ids array<int>", lambda e, t: (e.ids(t),))


def digests(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, without its ids leaving the task."""
    return _mapped(docs, ranks, pattern, doc_id, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda e, t: e.digest(t))


def _mapped(docs: DataFrame, ranks, pattern: str, doc_id: str, text: str, columns: str, of) -> DataFrame:
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    shared = slim.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: bounded
    key = hashlib.sha256(repr((pattern, len(ranks), ranks[:50], ranks[-50:])).encode()).hexdigest()
    names = ["doc_id", *[c.strip().split(" ")[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(key, shared.value, pattern)
        for batch in batches:
            made = [of(enc, t.as_py()) for t in batch.column("text")]
            columns_ = [list(c) for c in zip(*made)] or [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, type=f) for c, f in zip(columns_, kinds)]], names=names)

    kinds = [pa.list_(pa.int32())] if names[1] == "ids" else [pa.int64(), pa.string(), pa.string()]
    return slim.mapInArrow(run, f"doc_id {kind}, {columns}")


def decode(ids: DataFrame, ranks: list[tuple[bytes, int]], doc_id: str = "doc_id", column: str = "ids") -> DataFrame:
    """doc_id, bytes of the ids; null ids decode to nothing, an id outside the vocabulary is an error."""
    slim = ids.select(F.col(doc_id).alias("doc_id"), F.col(column).alias("ids"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    shared = slim.sparkSession.sparkContext.broadcast({n: t for t, n in ranks})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            made = [b"".join(tokens[i] for i in x.as_py() or ()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, type=pa.binary())], names=["doc_id", "bytes"])

    return slim.mapInArrow(run, f"doc_id {kind}, bytes binary")
