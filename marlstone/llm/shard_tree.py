"""Sharding by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and shards, each with a weight. A document descends it: at
each level every child draws ``-ln(u) / weight`` with ``u`` a hash of the document's key and the
child's name, and the least draw wins (weighted rendezvous hashing). A changed weight moves only
documents into or out of that child, so movement stays inside the subtree above which weights
changed. ``grow`` puts one more shard into a region of its own: it takes documents only into itself.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int = 8, per_rack: int = 2, racks: int = 2) -> list[Shard]:
    """Equal shards. The first eight fill regions of ``racks`` racks; further ones get regions of their own."""
    base = min(shards, 8) // (per_rack * racks) * per_rack * racks
    out = [Shard(f"r{k // (per_rack * racks)}", f"k{k // per_rack}", k) for k in range(base)]
    while len(out) < shards:
        out = grow(out)
    return out


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    k = 1 + max((x.shard for x in tree), default=-1)
    return [*tree, Shard(f"r+{k}", f"k+{k}", k, weight)]


def _draw(key: Column, node: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / F.lit(float(weight))


def _descend(key: Column, tree: list[Shard], level: int, above: str) -> Column:
    if level == 2:
        children = {f"{above}/{x.shard}": ([x], F.lit(x.shard)) for x in tree}
    else:
        names = dict.fromkeys(x[level] for x in tree)
        children = {f"{above}/{n}": (own := [x for x in tree if x[level] == n], _descend(key, own, level + 1, f"{above}/{n}")) for n in names}
    if len(children) == 1:
        return next(iter(children.values()))[1]
    draws = [F.struct(_draw(key, n, sum(x.weight for x in own)).alias("d"), F.lit(k).alias("k")) for k, (n, (own, _)) in enumerate(children.items())]
    won = F.array_min(F.array(*draws))["k"]
    if level == 2:
        return F.element_at(F.array(*[c for _, c in children.values()]), (won + 1).cast("int"))
    below = [c for _, c in children.values()]
    return functools.reduce(lambda other, k: F.when(won == k, below[k]).otherwise(other), range(len(below) - 2, -1, -1), below[-1])


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key, as an int Column; a null key counts as the word null."""
    if not tree or any(x.weight <= 0 for x in tree):
        raise ValueError("a topology needs shards, with weights above 0")
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), tree, 0, "").cast("int")


def shard(docs: DataFrame, tree: list[Shard] | None = None, rows_per_block: int = 20_000) -> DataFrame:
    """Shard, gapless slot there, and the shard after one more shard has come.

    Slots count from 0 in each shard. A shard is numbered in blocks of about ``rows_per_block`` rows
    (by a hash of the key), whose first slots come from their counts, so that no task holds a whole
    shard. Null text: size 1, checksum of no bytes. Equal rows and repeated doc_ids get slots of
    their own, in the order of doc_id, size and checksum. An empty table gives no rows. Further
    columns of ``docs`` are not read, whatever their names.
    """
    tree = tree or topology()
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    key = docs["doc_id"]
    n = docs.select(F.count(F.lit(1))).first()[0]
    blocks = max(1, -(-n // (rows_per_block * len(tree))))
    block = F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null")), F.lit("block")), F.lit(blocks)).cast("int")
    place = [shard_of(key, tree).alias("shard"), block.alias("block")]
    counts = docs.select(*place).groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *place,
        shard_of(key, grow(tree)).alias("grown_shard"),
    )
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("at", F.row_number().over(within) - 1)
        .join(first, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at")).alias("slot"), "grown_shard")
    )
