"""Homomorphic multiset fingerprints of documents. DataFrame functions only.

A text is a multiset of paragraphs (its lines). Each paragraph's SHA-256 is a vector of 8 words, added
modulo 2**32: equal multisets of lines, in any order, have equal sums, and lines are inserted or deleted by
adding or subtracting their vectors. For likeness, each line is cut into runs of words: a run ends after a word
with one of a few last characters, after 8 words at most, so that a word inserted or deleted changes only the runs up to
the next such word. The 128
bits of a run's MD5 are added lane by lane, modulo 2**32 (shown modulo 2**16). Read as +1 and -1, two such
vectors have as dot product, up to noise of about 1 / sqrt(128), the product of the two multisets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS, LANES = 8, 128
#: Last characters of the words that end a run.
ENDS = "AIMQUYaimquy159"
#: Words of one line up to one that ends a run, eight at most, each with the white space that follows it.
RUN = rf"(?:[^ \t\n\r\x0B\f]*[^ \t\n\r\x0B\f{ENDS}][ \t\r\x0B\f]+){{0,7}}[^ \t\n\r\x0B\f]+[ \t\r\x0B\f]*"
LOW_BITS = (1 << 32) | 1


def fingerprint(text: Column) -> Column:
    """array<bigint>: 8 sums of paragraph words, the number of runs, 64 sums of two lanes each.

    Null is the empty text; the empty text is one empty paragraph and no run.
    """
    whole = F.coalesce(text, F.lit(""))
    paragraphs = F.transform(F.split(whole, "\n"), lambda p: F.sha2(p, 256))
    runs = F.transform(F.regexp_extract_all(whole, F.lit(RUN), F.lit(0)), F.md5)

    args = F.struct(paragraphs.alias("p"), runs.alias("r"))
    return F.transform(F.array(args), lambda x: _vector(x["p"], x["r"]))[0]


def _word(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def _vector(paragraphs: Column, runs: Column) -> Column:
    zero = F.lit(0).cast("bigint")

    def equality(k: int) -> Column:
        return F.aggregate(paragraphs, zero, lambda a, d: (a + _word(d, k)) % F.lit(1 << 32))

    def lane_pair(words: Column, j: int) -> Column:
        return F.aggregate(words, zero, lambda a, w: a + F.shiftright(w, j).bitwiseAND(F.lit(LOW_BITS)))

    def lanes(k: int) -> Column:
        words = F.transform(runs, lambda d: _apart(_word(d, k)))
        return F.transform(F.array(words), lambda w: F.array(*[lane_pair(w, j) for j in range(16)]))[0]

    return F.concat(F.array(*[equality(k) for k in range(WORDS)]), F.array(F.size(runs).cast("bigint")), *[lanes(k) for k in range(LANES // 32)])


def _apart(word: Column) -> Column:
    """A 32-bit word with its upper half moved to bit 32, so that sums of two bits do not meet."""
    return word.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.shiftleft(F.shiftright(word, 16), 32))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together (lines of two texts, joined by a newline)."""
    return _lanewise(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of ``a``'s text after the paragraphs of ``b``'s are deleted from it."""
    return _lanewise(a, b, -1)


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.transform(both, lambda x, i: F.when(i < WORDS, F.pmod(x["a"] + sign * x["b"], F.lit(1 << 32))).otherwise(x["a"] + sign * x["b"]))


def as_text(vector: Column) -> Column:
    """Lower-case hex: 8 digits for each paragraph sum, then 4 for the runs and for each lane, modulo 2**16."""
    head = F.transform(F.slice(vector, 1, WORDS), lambda v: F.lpad(F.hex(v), 8, "0"))
    tail = F.transform(F.slice(vector, WORDS + 1, 1 + LANES // 2), lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(F.shiftright(v, 32).bitwiseAND(F.lit(0xFFFF)), 16)), 8, "0"))
    return F.lower(F.concat(F.array_join(head, ""), F.array_join(tail, "")))


def _signs(vector: Column) -> Column:
    """Each lane as (ones - zeros)."""
    runs = vector[WORDS]
    packed = F.slice(vector, WORDS + 2, LANES // 2)
    low = F.transform(packed, lambda v: 2 * v.bitwiseAND(F.lit(0xFFFFFFFF)) - runs)
    return F.concat(low, F.transform(packed, lambda v: 2 * F.shiftright(v, 32) - runs))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of two texts' multisets of runs, as their lanes tell. Equal fingerprints: 1."""

    def cosine(x: Column) -> Column:
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: (u * v).cast("double")), F.lit(0.0), lambda s, v: s + v)
        ab, aa, bb = dot(x["a"], x["b"]), dot(x["a"], x["a"]), dot(x["b"], x["b"])
        return F.when((aa == 0) | (bb == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ab / F.sqrt(aa * bb))))

    signs = F.array(F.struct(_signs(a).alias("a"), _signs(b).alias("b")))
    return F.when(a == b, 1.0).otherwise(F.transform(signs, cosine)[0])


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def slice_of(key: Column, edges: list[int]) -> Column:
    """How many of the ascending ``edges`` are at most ``key``, looked up in two levels; null: 0."""
    fan = max(1, math.isqrt(len(edges)))
    tops = edges[fan - 1 :: fan]
    groups = [edges[i * fan : (i + 1) * fan] for i in range(len(tops) + 1)]
    below = F.size(F.filter(_longs(tops), lambda e: e <= key))
    inner = F.split(F.element_at(F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";"), below + 1), ",")
    return F.when(key.isNull() | F.lit(not edges), 0).otherwise(below * fan + F.size(F.filter(inner, lambda e: (e != "") & (e.cast("bigint") <= key))))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_slice: int = 500, most_slices: int = 16_384) -> DataFrame:
    """doc_id, text, fingerprint ``own``, the next document's text ``next_text`` and fingerprint ``next_own``.

    Next is the next row by ascending id (null ids first, then by length and hash of the text); after the
    last row comes the first. Ids are cut into slices of about equal rows by edges from a sketch (at most
    ``most_slices``); texts are shuffled once, to their slice. Each slice also gets the first row of the next
    slice that has rows. Rows that share one id share a slice. Null texts count as empty; an empty table
    gives no rows.
    """
    ids = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"))
    rows = ids.count()
    want = max(1, min(most_slices, rows // rows_per_slice))
    edges: list[int] = []
    if want > 1:
        cuts = ids.agg(F.percentile_approx("doc_id", [i / want for i in range(1, want)], max(10_000, 10 * want))).first()[0]
        edges = sorted(set(cuts or []))
    heads = ids.withColumn("slice", slice_of(F.col("doc_id"), edges)).groupBy("slice").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("head"))
    # One row for each slice, most_slices at most: a single window and a broadcast are bounded.
    order = Window.orderBy("slice")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.coalesce(F.lag("slice").over(order), F.last("slice").over(whole)).alias("_x_to"), F.col("head.doc_id").alias("_x_head"))

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumns({"slice": slice_of(F.col("doc_id"), edges), "extra": F.lit(0)})
    more = own.join(F.broadcast(heads), own["doc_id"].eqNullSafe(heads["_x_head"])).select("doc_id", "text", F.col("_x_to").alias("slice"), F.lit(1).alias("extra"))
    both = own.unionByName(more).withColumn("own", fingerprint(F.col("text")))
    after = Window.partitionBy("slice").orderBy("extra", "doc_id", F.length("text"), F.xxhash64("text"))
    paired = both.withColumns({"next_text": F.lead("text").over(after), "next_own": F.lead("own").over(after)})
    return paired.filter(F.col("extra") == 0).drop("extra", "slice")


def edited(pairs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    chars = F.length("text")
    text = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    wide = pairs.select("doc_id", chars.cast("long").alias("n_chars"), "own", "next_own", text.alias("changed"))
    wide = wide.select("doc_id", "n_chars", "own", "next_own", F.sha2("changed", 256).alias("edited_sha256"), fingerprint(F.col("changed")).alias("new"))
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
