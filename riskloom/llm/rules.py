"""Quality rules: a threshold table compiled into one projection. DataFrame functions only.

Measures are whole numbers of a text. A rule bounds one of them by another: it passes where
``least * per <= 1000 * measure <= most * per``, with least and most in thousandths, so that no fraction is ever rounded.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "und", "von", "zu",
    "al", "con", "del", "el", "ella", "los", "las", "no", "por", "se", "su", "una", "y",
)


class Rule(NamedTuple):
    """``measure`` / ``per`` in thousandths; None leaves a side open."""

    name: str
    measure: str
    per: str
    least: int | None
    most: int | None


#: What a text must hold to be kept, besides the base.
THRESHOLDS = (
    Rule("word_length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("loud_marks", "n_marks", "n_words", None, 300),
    Rule("capitals", "n_capitals", "n_letters", None, 300),
    Rule("stop_words", "n_stop_words", "n_words", 50, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 300),
    Rule("list_lines", "n_list_lines", "n_lines", None, 900),
)
BASE_WORDS, BASE_REPEATS = 50, 50


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row of measures fails, in the order of the table."""
    failed = []
    for r in rules:
        value, per = F.col(r.measure) * 1000, F.col(r.per)
        sides = ([value < per * r.least] if r.least is not None else []) + ([value > per * r.most] if r.most is not None else [])
        for side in sides:
            failed.append(F.when(side, F.lit(r.name)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def _count(text: Column, characters: str) -> Column:
    """How many of ``characters`` a text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce((a["h"] == b["h"]) & (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"]), F.lit(False))


def _hashes(words: Column) -> Column:
    """A hash of every window of three words, in order."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _grams(words: Column, hashes: Column) -> Column:
    """All windows of three words with their places, ordered so that equal ones are neighbours; words are compared only where hashes agree."""

    def window(h: Column, i: Column) -> Column:
        parts = [F.get(words, i + k).alias(f"w{k}") for k in range(3)]
        return F.struct(h.alias("h"), *parts, i.alias("at"))

    return F.sort_array(F.transform(hashes, window))


def _covered(grams: Column) -> Column:
    """How many words stand in a window that is found more than once."""
    repeated = F.filter(grams, lambda g, k: _same(g, F.get(grams, k + 1)) | _same(g, F.get(grams, k - 1)))
    places = F.sort_array(F.transform(repeated, lambda g: g["at"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])


def _repeated(words: Column, hashes: Column) -> Column:
    """The same from the words. Texts whose windows all have hashes of their own, most by far, need no ordering."""
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    # A lambda variable is computed once; an expression in its place would be computed for every window.
    return F.when(some, F.transform(F.array(_grams(words, hashes)), _covered)[0]).otherwise(0)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the measures of every text (bigint), words being what stands between white space."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_x_text"))
    parts = whole.select(
        "*",
        F.regexp_extract_all("_x_text", F.lit(WORD), 0).alias("_x_words"),
        F.filter(F.split("_x_text", "\n"), lambda line: F.translate(line, SPACES, "") != "").alias("_x_lines"),
        F.regexp_replace("_x_text", r"[^\p{L}]+", "").alias("_x_letters"),
    )
    ready = parts.select("*", _hashes(F.col("_x_words")).alias("_x_hashes"), F.transform("_x_lines", lambda line: F.trim(line, F.lit(SPACES))).alias("_x_trimmed"))
    lines, trimmed = F.col("_x_lines"), F.col("_x_trimmed")
    counts = {
        "n_words": F.size("_x_words"),
        "word_chars": F.length(F.translate("_x_text", SPACES, "")),
        "n_symbols": _count(F.col("_x_text"), SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated(F.col("_x_words"), F.col("_x_hashes")),
        "n_lines": F.size(lines),
        "n_cut_lines": F.size(F.filter(trimmed, lambda x: x.endswith("...") | x.endswith("…"))),
        "n_list_lines": F.size(F.filter(trimmed, lambda x: x.startswith("•") | x.startswith("- ") | x.startswith("* "))),
        "n_marks": _count(F.col("_x_text"), "!?"),
        "n_letters": F.length("_x_letters"),
        "n_capitals": F.length(F.regexp_replace("_x_letters", r"[^\p{Lu}]+", "")),
        "n_stop_words": F.size(F.filter("_x_words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(*STOP_WORDS))),
    }
    return ready.select("doc_id", *[c.cast("bigint").alias(n) for n, c in counts.items()])


def judged(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules for every row.

    ``base_failed``: fewer than 50 words, or more than half of them in three-word windows found twice or more.
    ``kept``: base passed and no rule of the table failed; ``failed_rules`` names those that did. A null or empty text
    has no word and fails the base. Rows are judged one by one, so repeated rows, null ids and ties change nothing;
    an empty table gives an empty one, and other columns are not looked at.
    """
    base = (F.col("n_words") < BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_REPEATS)
    failed = measured(docs, doc_id, text).select("*", compiled(rules).alias("failed_rules"), base.alias("base_failed"))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return failed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "failed_rules")
