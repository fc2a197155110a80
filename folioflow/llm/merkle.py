"""A Merkle manifest of a table by nested structs.

Rows get their rank within their group from sorted partitions and the counts
of these.  A rank is a block number and base-3 digits; blocks hold at most
3**7 rows.  Dealt out by block once, the digit columns are grouped away one
after the other, each grouping nesting the structs of up to three children
below their digest.  Block digests are the rows of the next, smaller tree, by
the same function, until a group is one block.  Last, each block's struct is
unfolded by nested transforms, which build every row's proof on the way down,
and one explode gives the rows.  Once ranks are given, no join meets a row per
document: rows per block take their path above the block, and that of their
group, by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, load, materialise

FAN = 3
#: Digits of a rank within its block: FAN ** DIGITS rows at most are one nested struct.
DIGITS = 7
STEP = "array<struct<left:string,right:string>>"


def encoded(name: str) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon, and the value."""
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[str]) -> Column:
    return F.sha2(F.concat(*(encoded(c) for c in columns)), 256)


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add rank (from 0 within the group) and size (of the group), nulls first; no group passes one task.

    Rows are sorted over all partitions and written with their place; a run (the rows of a group within a partition) tells
    how many came before it.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    placed = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33).alias("part")
    runs = placed.groupBy(*group, part).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*(F.col(c).alias(f"run_{c}") for c in group), F.col("part").alias("run_part"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start")).alias("shift"), F.sum("n").over(Window.partitionBy(*group)).alias("size"))
    on = F.shiftrightunsigned("at", 33) == F.col("run_part")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"run_{c}"))
    return placed.join(runs, on).select(*rows.columns, (F.col("at") + F.col("shift")).alias("rank"), "size")


def digits(largest: int) -> int:
    """Levels of a block when the largest group has so many rows."""
    return next(k for k in range(DIGITS + 1) if k == DIGITS or FAN**k >= largest)


def nested(rows: DataFrame, group: list[str], largest: int) -> DataFrame:
    """Blocks of the trees of all groups: group, size, block, node (nested struct), above (steps from the block to the group's top), top.

    rows: group, rank, size, h (digest), item (struct that the unfolded rows get back).  largest: rows of the largest group.
    """
    levels = digits(largest)
    marks = [f"d{j}" for j in range(levels)]
    block = F.floor(F.col("rank") / F.lit(FAN**levels)).cast("long") if levels == DIGITS else F.lit(0).cast("long")
    part = rows.select(*group, "size", block.alias("block"), *(F.expr(f"cast((rank div {FAN**j}) % {FAN} as int)").alias(d) for j, d in enumerate(marks)), F.struct("h", "item").alias("node")).repartition(*group, "block")
    for j, d in enumerate(marks):
        part = part.groupBy(*group, "size", "block", *marks[j + 1 :]).agg(F.sort_array(F.collect_list(F.struct(F.col(d).alias("digit"), "node"))).alias("kids"))
        kids = F.transform("kids", lambda k: k["node"])
        h = F.when(F.col("size") > FAN**j, F.sha2(F.array_join(F.transform("kids", lambda k: k["node"]["h"]), ""), 256)).otherwise(F.col("kids")[0]["node"]["h"])
        part = part.select(*group, "size", "block", *marks[j + 1 :], F.struct(h.alias("h"), kids.alias("kids")).alias("node"))
    part = part.select(*group, "size", "block", "node")
    if largest <= FAN**levels:
        return part.select(*part.columns, F.array().cast(STEP).alias("above"), F.col("node.h").alias("top"))
    part = materialise(part)
    few = F.expr(f"cast((size + {FAN**levels - 1}) div {FAN**levels} as bigint)").alias("size")
    smaller = part.select(*group, F.col("block").alias("rank"), few, F.col("node.h").alias("h"), F.struct("block").alias("item"))
    least = -(-largest // FAN**levels)
    paths = unfolded(nested(smaller, group, least), group, least).select(*(F.col(c).alias(f"path_{c}") for c in group), F.col("item.block").alias("path_block"), F.col("proof").alias("above"), "top")
    on = F.col("block") == F.col("path_block")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"path_{c}"))
    return part.join(paths, on).select(*part.columns, "above", "top")


def unfolded(blocks: DataFrame, group: list[str], largest: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row for each leaf of ``nested``: group, item, h, proof (left and right siblings of each step, leaf to top), top, extra."""

    def step(kids: Column, i: Column, level: int) -> Column:
        joined = lambda part: F.array_join(F.transform(part, lambda k: k["h"]), "")
        both = F.array(F.struct(joined(F.slice(kids, F.lit(1), i)).alias("left"), joined(F.slice(kids, i + F.lit(2), F.lit(FAN))).alias("right")))
        return F.when(F.col("size") > FAN**level, both).otherwise(F.array().cast(STEP))

    def leaves(node: Column, level: int, above: Column) -> Column:
        if not level:
            return F.array(F.struct(node["item"].alias("item"), node["h"].alias("h"), above.alias("proof")))
        return F.flatten(F.transform(node["kids"], lambda k, i: leaves(k, level - 1, F.concat(step(node["kids"], i, level - 1), above))))

    return blocks.select(*group, "top", *extra, F.explode(leaves(F.col("node"), digits(largest), F.col("above"))).alias("leaf")).select(*group, "leaf.item", "leaf.h", "leaf.proof", "top", *extra)


def _largest(rows: DataFrame) -> int:
    return rows.agg(F.max("size")).first()[0] or 0


def manifest(rows: DataFrame, columns: list[str], key: str, group: str, carry: list[str] | None = None) -> DataFrame:
    """A row for each row of ``rows``: key, group, carried columns, leaf, subroot, root, proof.

    Leaves hash ``columns`` (nulls too); those of a group ascend by key (nulls first; rows of one key by their leaf).  Groups'
    trees are joined by the tree of their tops in bytewise order of the group, null first.  proof: array of (left, right), the
    siblings from leaf to root.  Very long texts are hashed whole, where they are read; nothing but digests is shuffled.
    Other columns of any name are left out; an empty table gives no rows.
    """
    carry = carry or []
    digests = materialise(rows.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf(columns).alias("h"), F.struct(F.lit(0).alias("none"), *(F.col(c) for c in carry)).alias("carried")))
    placed = materialise(ranked(digests, ["grp"], ["key", "h"]).select("grp", "rank", "size", "h", F.struct("key", "carried").alias("item")))
    largest = _largest(placed)
    blocks = materialise(nested(placed, ["grp"], largest))
    tops = ranked(blocks.where("block = 0").select("grp", "top"), [], ["grp"]).select("rank", "size", F.col("top").alias("h"), F.struct("grp").alias("item"))
    tops = materialise(tops)
    groups = _largest(tops)
    roots = unfolded(nested(tops, [], groups), [], groups).select(F.col("item.grp").alias("root_grp"), F.col("proof").alias("to_root"), F.col("top").alias("root"))
    joined = blocks.join(roots, F.col("grp").eqNullSafe(F.col("root_grp")))
    joined = joined.select("grp", "size", "block", "node", F.concat("above", "to_root").alias("above"), "top", "root")
    discard(digests)
    return unfolded(joined, ["grp"], largest, ("root",)).select(F.col("item.key").alias(key), F.col("grp").alias(group), *(F.col(f"item.carried.{c}").alias(c) for c in carry), F.col("h").alias("leaf"), F.col("top").alias("subroot"), "root", "proof")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(proof, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    docs = load(spark, sf_dir, "documents", *columns)
    tampered = F.when(even, F.sha2(F.concat(*(encoded(c) for c in columns[:-1]), F.coalesce(F.concat(F.octet_length("bare").cast("string"), F.lit(":"), F.col("bare")), F.lit("-"))), 256))
    docs = docs.withColumn("bare", F.replace(F.col("text"), F.lit("\n"), F.lit(""))).withColumn("tampered", tampered)
    made = manifest(docs, columns, "doc_id", "source", ["tampered"]).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), "")
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
