"""Spelling variants by pivotal grams: which words of a vocabulary are one edit apart, and the form each belongs to.

Every word's bigrams are ordered by how rare they are. One edit destroys at most two neighbouring bigrams, so the three
rarest (the prefix) hold two disjoint ones, and of two disjoint bigrams at least one survives. A dynamic program picks the
pair of disjoint prefix bigrams with the least total frequency: the pivots. Of two near words, a pivot of the one whose
prefix ends earlier in the order stands in the prefix of the other. Position limits: a bigram before the edit keeps its
distance from the start, one behind it keeps its distance from the end, so pivot, place and length form an equality key.
DataFrame functions only; each pair that meets is verified inside the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import staged

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noisy_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 199, least_chars: int = 6) -> DataFrame:
    """One row ``word`` for every run of letters of every text that is left with ``least_chars`` code points.

    Only A-Z are lower-cased. Where the crc32 h of ``<doc_id>:<run>`` is a multiple of ``every``, the run loses its code
    point h % length. A null id counts as the empty text there; null and empty texts have no runs.
    """
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    # Shorter runs cannot be left with enough code points.
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_x_id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), 0)).alias("_x_run"))
    runs = runs.filter(F.length("_x_run") >= least_chars)
    h = F.crc32(F.concat("_x_id", F.lit(":"), "_x_run").cast("binary"))
    marked = runs.select("_x_run", h.alias("_x_h"))
    cut = F.pmod(F.col("_x_h"), F.length("_x_run")).cast("int")
    noisy = F.concat(F.col("_x_run").substr(F.lit(1), cut), F.col("_x_run").substr(cut + 2, F.length("_x_run")))
    word = F.when(F.col("_x_h") % every == 0, noisy).otherwise(F.col("_x_run"))
    return marked.select(word.alias("word")).filter(F.length("word") >= least_chars)


def vocabulary(words: DataFrame, least: int = 5) -> DataFrame:
    """word and n, for words that occur ``least`` times; a hash aggregate, so a frequent word is one partial row per task."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _cheapest_pair(prefix: Column) -> Column:
    """Places of the two disjoint bigrams of least total frequency; ``prefix`` is ordered by place.

    The state is the cheapest pair so far; at each bigram it is compared with that bigram and the cheapest one that ends before it.
    """
    kind = "struct<cost:bigint,first:int,second:int>"
    none = F.lit(None)

    def step(acc: Column, i: Column) -> Column:
        g = F.get(prefix, i)
        # Bigrams before place - 1 do not touch this one.
        free = F.array_min(F.transform(F.filter(prefix, lambda o: o["at"] <= g["at"] - 2), lambda o: F.struct(o["df"].alias("df"), o["at"].alias("at"))))
        pair = F.when(free.isNotNull(), F.struct((free["df"] + g["df"]).alias("cost"), free["at"].alias("first"), g["at"].alias("second")))
        return F.array_min(F.array(acc, pair.cast(kind)))

    return F.aggregate(F.sequence(F.lit(0), F.size(prefix) - 1), none.cast(kind), step)


def _grams(words: DataFrame) -> DataFrame:
    """word, n, size and every bigram with its place and the number of words that have it."""
    size = F.length("word")
    places = words.select("word", "n", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 2)).alias("at"))
    grams = places.withColumn("gram", F.col("word").substr(F.col("at") + 1, F.lit(2)))
    # Bigrams of one alphabet, some 8,000 at most by construction: the alphabet has 90 letters.
    df = grams.groupBy("gram").agg(F.count_distinct("word").alias("df"))
    return grams.join(F.broadcast(df), "gram")


def prefixes(words: DataFrame) -> DataFrame:
    """word, n, size, ``prefix`` (the rarest bigrams: df, gram, at), its last in the order, and the places of the two pivots.

    The prefix holds the three rarest and whatever equals the third, so that equal bigrams never straddle its end.
    """
    entry = F.struct("df", "gram", "at")
    whole = _grams(words).groupBy("word", "n", "size").agg(F.sort_array(F.collect_list(entry)).alias("grams"))
    third = F.get("grams", F.lit(2))
    order = F.struct(third["df"].alias("df"), third["gram"].alias("gram"))
    whole = whole.withColumn("last", order)
    near = F.filter("grams", lambda g: F.struct(g["df"].alias("df"), g["gram"].alias("gram")) <= F.col("last"))
    # Three places hold two that are disjoint, so the pivots are sought among three, however many bigrams equal the third.
    rarest = F.array_sort(F.slice("grams", 1, 3), lambda a, b: a["at"] - b["at"])
    whole = whole.select("*", near.alias("prefix"), rarest.alias("rarest"))
    return whole.withColumn("pair", _cheapest_pair(F.col("rarest"))).drop("grams", "rarest")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b (a's near word) in both directions, each once: words one inserted, deleted or replaced code point apart.

    Words have at least five code points, so that each has three bigrams and more.
    """
    kept = staged(prefixes(words), "prefixes")
    order = ("word", "size", "last")
    pivots = kept.select(*[F.col(c).alias(f"p_{c}") for c in order], F.explode(F.filter("prefix", lambda g: (g["at"] == F.col("pair.first")) | (g["at"] == F.col("pair.second")))).alias("g"))
    # Where the pivot may stand in the other word: same length, same place; one longer or shorter, from the start or from the end.
    spots = [(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]
    places = F.array(*[F.struct((F.col("p_size") + more).alias("size"), (F.col("g.at") + shift).alias("at")) for more, shift in spots])
    asked = pivots.select("p_word", "p_last", F.col("g.gram").alias("p_gram"), F.explode(places).alias("spot"))
    there = kept.select(*order, F.explode("prefix").alias("g"))
    meets = (
        (F.col("p_gram") == F.col("g.gram"))
        & (F.col("spot.at") == F.col("g.at"))
        & (F.col("spot.size") == F.col("size"))
        & (F.col("p_last") <= F.col("last"))
        & (F.levenshtein("p_word", "word", 1) == 1)
    )
    once = asked.join(there, meets).select(F.least("p_word", "word").alias("a"), F.greatest("p_word", "word").alias("b")).distinct()
    return once.select("a", "b").union(once.select(F.col("b").alias("a"), F.col("a").alias("b")))


def rooted(forms: DataFrame) -> DataFrame:
    """word and root, from word and form (never null): forms followed to their end, each round doubling the steps taken.

    A form's count is at least five times its word's, so chains are short and never closed; rounds go on until nothing moves.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        further = reached.select(F.col("word").alias("_x_w"), F.col("root").alias("_x_r"))
        step = reached.join(further, F.col("root") == F.col("_x_w"), "left").select("word", F.coalesce("_x_r", "root").alias("root"), F.col("_x_r").isNotNull().alias("_x_moved"))
        step = staged(step, "roots")
        reached = step.select("word", "root")
        if step.filter("_x_moved").isEmpty():
            return reached


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 199, least_chars: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of ``least_chars`` code points that occurs ``least`` times.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that n is ``ratio`` times the word's;
    ``root`` follows forms to the last. Without near words: n_near 0, no form, the word as its root. Null ids and null or
    empty texts are allowed; repeated rows count again; an empty table gives an empty one; other columns are not looked at.
    """
    if least_chars < 5 or ratio < 2:
        raise ValueError("words need five code points, and forms twice the count of their words")
    words = staged(vocabulary(noisy_words(docs, doc_id, text, every, least_chars), least), "words")
    counted = near_pairs(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    # The struct with the least -n, then the least word, is the near word of largest n.
    best = counted.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    near = words.join(best, words["word"] == best["a"], "left")
    enough = -F.col("best.less") >= F.col("n") * ratio
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    near = staged(near, "forms")
    roots = rooted(near.filter(F.col("form").isNotNull()).select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
