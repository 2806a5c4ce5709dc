"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn level by level.

At each level every child draws -ln(u) / weight, u in (0, 1) from the hash of the key and the child's
path; the smallest draw wins. A draw hangs on that child and its weight alone, so when a weight changes,
rows move only into or out of that child. A new subtree beside the others takes rows only into itself.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import gapless, spread_unit, staged

#: region -> rack -> shard number -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """Shards 0 .. shards-1 of weight 1, ``per_rack`` in a rack and ``racks`` in a region."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"r{rack // racks}", {}).setdefault(f"r{rack // racks}/k{rack}", {})[s] = 1.0
    return tree


def with_new_region(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one shard more, in a rack and region of its own: no present weight changes."""
    region = f"r{len(tree)}"
    while region in tree:
        region += "+"
    return {**tree, region: {f"{region}/k": {shard: weight}}}


def drawn(key: Column, children: Column) -> Column:
    """The name among ``children`` (array of struct name, weight) that draws least."""

    def draw(child: Column) -> Column:
        unit = spread_unit(F.concat(key, F.lit("|"), child["name"])) + F.lit(0.5 / (1 << 52))
        return F.struct((-F.log(unit) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def _children(names: dict[str, float]) -> Column:
    usable = {n: w for n, w in names.items() if w > 0}
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in usable.items()])


def descend(key: Column, tree: Tree) -> Column:
    """The shard (int) of ``key``: region, then rack in it, then shard in that, each by one draw.

    Subtrees of weight 0 take no rows. Weights of regions and racks are the sums of their shards'.
    """
    racks = {r: {k: sum(s.values()) for k, s in ks.items()} for r, ks in tree.items()}
    regions = {r: sum(ks.values()) for r, ks in racks.items()}
    if not any(w > 0 for w in regions.values()):
        raise ValueError("a tree needs a shard of positive weight")
    region = drawn(key, _children(regions))
    by_region = F.create_map(*[c for r, ks in racks.items() if regions[r] > 0 for c in (F.lit(r), _children(ks))])
    by_rack = F.create_map(*[c for r, ks in tree.items() for k, s in ks.items() if racks[r][k] > 0 for c in (F.lit(k), _children({f"s{n}": w for n, w in s.items()}))])

    def step(value: Column, then) -> Column:
        # A lambda variable is computed once, so deeper levels do not repeat the draws above them.
        return F.element_at(F.transform(F.array(value), then), 1)

    shard = step(region, lambda r: step(drawn(key, F.element_at(by_region, r)), lambda k: drawn(key, F.element_at(by_rack, k))))
    return F.substring(shard, 2, 10).cast("int")


def place(docs: DataFrame, tree: Tree, grown: Tree, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The key is the id as text (null: the empty key). A null text has size 1 and the checksum of the empty
    text. Rows with the same id share a shard. Slots follow the md5 order of the id; equal rows may swap.
    Only the short rows, never the texts, are shuffled.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_x_key"))
    drawn_rows = slim.withColumns({"shard": descend(F.col("_x_key"), tree), "grown_shard": descend(F.col("_x_key"), grown), "_x_unit": spread_unit(F.col("_x_key"))})
    rows = staged(drawn_rows.drop("_x_key"), "shards")
    numbered = gapless(rows, ["shard"], ["doc_id", "size", "text_crc32"], "_x_unit", "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
