"""The queries of this package, and their SQL texts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import anchors, chosen_path, extract, fingerprint, geometric, hash_tree, learned_ann, packing, pivots, prefix_bpe, quality, rules, separators
from riskloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

CONTEXT, BUCKETS, BUDGET = 4096, 16, 65_536
#: The vocabulary of the flat files, and an id that it leaves free.
FLAT_RANKS, END = "byte_bpe_multi_50k.tiktoken", 50_256
SHARDS = 16


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sequences with their bucket, batch and place."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), context=CONTEXT), BUCKETS, BUDGET, CONTEXT)


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat files made of them: doc_id and n_tokens."""
    ranks = prefix_bpe.read_ranks(spark, public_tokenizers.path(FLAT_RANKS))
    counts = separators.counted_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, END)
    return counts.select("doc_id", "n_tokens")


def op3_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learnt from the labels of two thirds of the ids."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint.edited(fingerprint.edited_pairs(table(spark, sf_dir, "documents")))


def op5_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract.extract(table(spark, sf_dir, "pages"))


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, as their count and digest, and the digest of what they decode to."""
    ranks = prefix_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return prefix_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return learned_ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_fixed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that a document with a smaller id has."""
    return anchors.without_repeats(table(spark, sf_dir, "documents"), window=13, block=7)


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are similar to 0.85."""
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, share=(85, 100))


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and slot for every document, and its shard with one more."""
    tree = hash_tree.even_tree(SHARDS)
    return hash_tree.place(table(spark, sf_dir, "documents"), tree, hash_tree.with_new_region(tree, SHARDS))


def op11_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest-scoring documents of every benchmark item."""
    return geometric.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, and whether the rules keep it."""
    return rules.judged(table(spark, sf_dir, "documents")).drop("failed_rules")


def op13_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all documents with every word's near words, form and root."""
    return pivots.variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_length_buckets, op2_separator_scan, op3_fourier_quality, op4_multiset_hash, op5_text_density, op6_prefix_bpe,
        op7_learned_partitions, op8_fixed_anchors, op9_chosen_path, op10_hash_tree,
        op11_geometric_blocks, op12_threshold_table, op13_pivotal_grams, pipeline,
    )
}

UNIT = "cast(('0x' || substr(md5({key}), 1, 13)) as bigint)::double / 4503599627370496.0"
SPACES = r"[^\x20\x09-\x0D]+"

OP1_SQL = f"""
with recursive words as (
  select doc_id, len(regexp_extract_all(coalesce(text, ''), '{SPACES}'))::bigint as w from documents
), seqs as (
  select doc_id, p as piece, p * {CONTEXT} as first_token, least({CONTEXT}, w - p * {CONTEXT}) as n_tokens
  from (select doc_id, w, unnest(range((w - 1) // {CONTEXT} + 1)) as p from words where w > 0)
), lengths as (
  select row_number() over (order by n_tokens) as i, n_tokens as n, sum(c) over (order by n_tokens) as rows_to, sum(c * n_tokens) over (order by n_tokens) as tokens_to
  from (select n_tokens, count(*) as c from seqs group by all)
), points as (
  select i, n, rows_to, tokens_to from lengths union all select 0, 0, 0, 0
), best as (
  select 1 as k, i as j, (n * rows_to - tokens_to)::double as cost, [n] as bounds from lengths
  union all
  select k + 1, j2, min(c), arg_min(b, c) from (
    select d.k, p.i as j2, d.cost + p.n * (p.rows_to - q.rows_to) - (p.tokens_to - q.tokens_to) as c, list_append(d.bounds, p.n) as b
    from best d join points q on q.i = d.j join points p on p.i > d.j where d.k < {BUCKETS}
  ) group by k, j2
), chosen as (
  select bounds from best where j = (select max(i) from lengths) order by cost, k limit 1
), placed as (
  select s.*, list_min(list_filter(bounds, lambda b: b >= n_tokens))::bigint as padded, list_position(bounds, list_min(list_filter(bounds, lambda b: b >= n_tokens)))::int as bucket
  from seqs s, chosen
), numbered as (
  select *, row_number() over (partition by bucket order by {UNIT.format(key="doc_id::varchar || ':' || piece::varchar")}, doc_id, piece) - 1 as r, greatest(1, {BUDGET} // padded) as per from placed
)
select doc_id, piece, first_token, n_tokens, padded, bucket, r // per as batch, (r % per)::int as place from numbered
"""

_RUN = fingerprint.RUN
_VECTOR = f"""
  select id, which, list(v order by lane) as lanes, any_value(n) as n from (
    select id, which, lane, n, coalesce(sum((cast('0x' || substr(m, 8 * (lane // 32) + 1, 8) as bigint) >> (lane % 32)) & 1), 0) as v
    from (select id, which, len(runs) as n, unnest(case when len(runs) = 0 then ['00000000000000000000000000000000'] else list_transform(runs, lambda r: md5(r)) end) as m
          from (select id, which, regexp_extract_all(t, '{_RUN}') as runs from texts)), (select unnest(range(128)) as lane) group by all
  ) group by id, which
"""
OP4_SQL = f"""
with d as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents
), e as (
  select doc_id, text, n, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as nxt,
    coalesce(lead(doc_id) over (order by doc_id), first_value(doc_id) over (order by doc_id)) as next_id from d
), f as (
  select doc_id, next_id, text, n, left(text, n - n // 2) || left(nxt, n // 2) as edited from e
), texts as (
  select doc_id as id, 'own' as which, text as t from f union all select doc_id, 'new', edited from f
), lanes as ({_VECTOR}
), sums as (
  select id, which, list(v order by k) as eq from (
    select id, which, k, sum(cast('0x' || substr(s, 8 * k + 1, 8) as bigint))::hugeint % 4294967296 as v
    from (select id, which, unnest(list_transform(string_split(t, chr(10)), lambda p: sha256(p))) as s from texts), (select unnest(range(8)) as k) group by all
  ) group by id, which
), whole as (
  select id, which, n, list_transform(lanes, lambda v: (2 * v - n)::double) as signs, eq, lanes,
    array_to_string(list_transform(eq, lambda v: format('{{:08x}}', v::bigint)), '') || format('{{:08x}}', n::bigint & 65535) ||
    array_to_string(list_transform(range(64), lambda i: format('{{:04x}}{{:04x}}', lanes[((i // 16) * 32 + 16 + i % 16 + 1)::bigint]::bigint & 65535, lanes[((i // 16) * 32 + i % 16 + 1)::bigint]::bigint & 65535)), '') as print
  from lanes join sums using (id, which)
), likely as (
  select a.id, a.which, b.id as other, b.which as other_which,
    case when a.eq = b.eq and a.n = b.n and a.lanes = b.lanes then 1.0
         when list_dot_product(a.signs, a.signs) = 0 or list_dot_product(b.signs, b.signs) = 0 then 0.0
         else greatest(0.0, least(1.0, list_dot_product(a.signs, b.signs) / sqrt(list_dot_product(a.signs, a.signs) * list_dot_product(b.signs, b.signs)))) end as near
  from f join whole a on a.id = f.doc_id and a.which = 'own' join whole b on (b.id = f.doc_id and b.which = 'new') or (b.id = f.next_id and b.which = 'own')
)
select f.doc_id, f.n::bigint as n_chars, sha256(edited) as edited_sha256, o.print as fingerprint, w.print as edited_fingerprint, x.near as near_edited, y.near as near_next
from f join whole o on o.id = f.doc_id and o.which = 'own' join whole w on w.id = f.doc_id and w.which = 'new'
join likely x on x.id = f.doc_id and x.other = f.doc_id and x.other_which = 'new' join likely y on y.id = f.doc_id and y.other = f.next_id and y.other_which = 'own'
"""

OP8_SQL = f"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{SPACES}') as ws from documents
), windows as (
  select doc_id, s, array_to_string(ws[s:s + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as s from w where len(ws) >= 13)
), firsts as (
  select doc_id, s, min(doc_id) over (partition by k) as least from windows
), gone as (
  select doc_id, list(distinct p) as ps from (select doc_id, unnest(range(s, s + 13)) as p from firsts where least < doc_id) group by doc_id
), kept as (
  select w.doc_id, ws, len(ws) as n, coalesce(list_sort(ps), []) as ps from w left join gone using (doc_id)
), marked as (
  select doc_id, n, len(ps) as g, list_filter(ws, lambda x, i: not list_contains(ps, i)) as ks from kept
)
select doc_id, n::bigint as n_words, g::bigint as n_removed, sha256(array_to_string(ks, ' ')) as kept_sha256 from marked
"""

OP9_SQL = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) end) as g from w
), n as (
  select doc_id, count(*) as c from s group by doc_id
), common as (
  select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), linked as (
  select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 85 * (p.c + q.c - i)
), sym as (
  select x, y from linked union all select y, x from linked
), reach(a, b) as (
  select doc_id, doc_id from documents union select r.a, e.y from reach r join sym e on e.x = r.b
), least as (
  select a, min(b) as m from reach group by a
)
select d.doc_id, coalesce(c, 0)::bigint as n_shingles, m as component_id, m = d.doc_id as kept from documents d left join n using (doc_id) join least on a = d.doc_id
"""


def _drawn(names: list[str], weights: list[float]) -> str:
    """SQL: of the children given, the one whose draw is least."""
    draws = [f"{{d: -ln({UNIT.format(key=f'k || {chr(39)}|{n}{chr(39)}')} + {0.5 / (1 << 52)!r}) / {w!r}, c: '{n}'}}" for n, w in zip(names, weights)]
    return f"list_min([{', '.join(draws)}]).c"


def _descent(tree: hash_tree.Tree) -> str:
    """SQL: nested choices of region, rack and shard."""
    regions = {r: sum(w for s in ks.values() for w in s.values()) for r, ks in tree.items()}
    racks = {k: (r, sum(s.values())) for r, ks in tree.items() for k, s in ks.items()}
    by_rack = " ".join(f"when '{k}' then {_drawn([f's{n}' for n in s], list(s.values()))}" for ks in tree.values() for k, s in ks.items())
    by_region = " ".join(f"when '{r}' then {_drawn(list(ks), [racks[k][1] for k in ks])}" for r, ks in tree.items())
    return f"""(select substr(case rack {by_rack} end, 2)::int from (select k, case region {by_region} end as rack from (select k, {_drawn(list(regions), list(regions.values()))} as region)))"""


_TREE = hash_tree.even_tree(SHARDS)
OP10_SQL = f"""
with crc_table as (
  select list_transform(range(256), lambda b: list_reduce(list_prepend(b::bigint, list_transform(range(8), lambda i: i::bigint)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab
), d as (
  select doc_id, coalesce(doc_id::varchar, '') as k, octet_length(encode(coalesce(text, '')))::bigint + 1 as size, hex(encode(coalesce(text, ''))) as h from documents
), c as (
  select doc_id, k, size, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(h, '..'), lambda b: cast('0x' || b as bigint))), lambda s, b: xor(tab[xor(s & 255, b) + 1], s >> 8))) as text_crc32
  from d, crc_table
), p as (
  select *, {_descent(_TREE)} as shard, {_descent(hash_tree.with_new_region(_TREE, SHARDS))} as grown_shard from c
)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by {UNIT.format(key="k")}, doc_id, size, text_crc32) - 1 as slot, grown_shard from p
"""

_LOWERED = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWERED}, '{geometric.TERM}')"
OP11_SQL = f"""
with q as (
  select distinct item_id, unnest({_TERMS.format(text="text")}) as term from benchmark
), d as (
  select row_number() over () as r, doc_id, {_TERMS.format(text="text")} as ts from documents
), whole as (
  select count(*) filter (len(ts) > 0) as docs, sum(len(ts))::bigint as total from d
), tf as (
  select r, term, count(*) as tf from (select r, unnest(ts) as term from d) where term in (select term from q) group by all
), w as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, whole group by term, docs
), scored as (
  select item_id, d.doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(ts) * docs) // total)))))::bigint as score
  from q join w using (term) join tf using (term) join d using (r), whole group by all
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _failed() -> str:
    """The threshold table as one condition."""
    sides = []
    for rule in rules.THRESHOLDS:
        sides += [f"1000 * {rule.measure} < {rule.least} * {rule.per}"] if rule.least is not None else []
        sides += [f"1000 * {rule.measure} > {rule.most} * {rule.per}"] if rule.most is not None else []
    return " or ".join(sides)


OP12_SQL = f"""
with d as (
  select row_number() over () as r, doc_id, t, regexp_extract_all(t, '{SPACES}') as ws, list_filter(list_transform(string_split(t, chr(10)), lambda x: {{w: x, s: trim(x, {_BLANKS})}}), lambda x: x.s <> '') as ls,
    regexp_replace(t, '[^\\p{{L}}]+', '', 'g') as letters
  from (select doc_id, coalesce(text, '') as t from documents)
), windows as (
  select r, s, count(*) over (partition by r, k) as c from (select r, s, array_to_string(ws[s:s + 2], ' ') as k from (select r, ws, unnest(range(1, len(ws) - 1)) as s from d where len(ws) >= 3))
), covered as (
  select r, count(distinct p) as n_repeat_words from (select r, unnest(range(s, s + 3)) as p from windows where c > 1) group by r
), m as (
  select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::bigint as word_chars, length(regexp_replace(t, '[^{rules.SYMBOLS}]+', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(list_transform(ls, lambda x: x.w))))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ls) as n_lines,
    len(list_filter(ls, lambda x: ends_with(x.s, '...') or ends_with(x.s, '…'))) as n_cut_lines, len(list_filter(ls, lambda x: starts_with(x.s, '•') or starts_with(x.s, '- ') or starts_with(x.s, '* '))) as n_list_lines,
    length(regexp_replace(t, '[^!?]+', '', 'g')) as n_marks, length(letters) as n_letters, length(regexp_replace(letters, '[^\\p{{Lu}}]+', '', 'g')) as n_capitals,
    len(list_filter(ws, lambda w: rtrim(lower(w), '.,;:!?') in ({", ".join(f"'{w}'" for w in rules.STOP_WORDS)}))) as n_stop_words
  from d left join covered using (r)
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({_failed()}) as kept from judged
"""

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: cast('0x' || b as bigint))), lambda s, b: xor(tab[xor(s & 255, b) + 1], s >> 8)))"""
OP13_SQL = f"""
with recursive crc_table as (
  select list_transform(range(256), lambda b: list_reduce(list_prepend(b::bigint, list_transform(range(8), lambda i: i::bigint)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab
), runs as (
  select coalesce(doc_id::varchar, '') as id, run, count(*) as c from (select doc_id, unnest(regexp_extract_all({_LOWERED.format(text="text")}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents) where length(run) >= 6 group by all
), hashed as (
  select run, c, {_CRC.format(text="id || ':' || run")} as h from runs, crc_table
), words as (
  select word, sum(c)::bigint as n from (select c, case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed) where length(word) >= 6 group by word having sum(c) >= 5
), lost as (
  select word, p, left(word, p) || substr(word, p + 2) as rest from (select word, unnest(range(length(word)))::int as p from words)
), near as (
  select a.word as a, b.word as b from lost a join lost b on a.p = b.p and a.rest = b.rest and a.word <> b.word
  union select lost.word, words.word from lost join words on rest = words.word union select words.word, lost.word from lost join words on rest = words.word
), best as (
  select a, count(*) as n_near, arg_min(b, (-w.n, b)) as form, max(w.n) as form_n from near join words w on w.word = b group by a
), formed as (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 5 * n then form end as form, case when form_n >= 5 * n then form_n end as form_n from words left join best on a = word
), path(word, root) as (
  select word, word from formed union all select path.word, f.form from path join formed f on f.word = path.root where f.form is not null
), ends as (
  select path.word, root from path join formed f on f.word = root where f.form is null
)
select word, form, root, n, n_near, form_n from formed join ends using (word)
"""

ORACLES: dict[str, str] = {
    "op1_length_buckets": OP1_SQL,
    "op4_multiset_hash": OP4_SQL,
    "op8_fixed_anchors": OP8_SQL,
    "op9_chosen_path": OP9_SQL,
    "op10_hash_tree": OP10_SQL,
    "op11_geometric_blocks": OP11_SQL,
    "op12_threshold_table": OP12_SQL,
    "op13_pivotal_grams": OP13_SQL,
}
