"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

Shards own virtual nodes on a ring of 2**63 places; a document belongs to the
first node clockwise from its hash.  Shard capacities add up to the number of
documents and differ by one at most; documents that overflow a full shard go
on clockwise to the next node whose shard has room.  So counts are at most one
apart, and documents stay with their node unless it overflows.

The overflow is settled on counts per node (``shards * nodes`` rows, whatever
the corpus) by one SQL fold; documents then find their place by their rank
within the node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

SHARDS = 40
#: Virtual nodes of a shard.
NODES = 32
#: Hash cells of a node, in which ranks are counted.
CELLS = 16


def ring(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """(node, shard, low, high): the nodes in clockwise order and the places (low, high] that they own."""
    ids = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.col("id").alias("k"))
    placed = ids.withColumn("high", F.xxhash64(F.lit("node"), "shard", "k").bitwiseAND(F.lit((1 << 63) - 1)))
    order = Window.partitionBy(F.lit(0)).orderBy("high", "k")
    return placed.select("shard", "high", (F.row_number().over(order) - 1).cast("int").alias("node"), F.lag("high").over(order).alias("low"))


def _settle(loads: DataFrame, shards: int) -> DataFrame:
    """(node, shard, low rank, ranks): which ranks of each node's documents go to which shard.

    loads: node, shard, n.  Going round twice, each node hands what it carries to its shard as far as there is room; what
    is left goes on to the next.  After two rounds nothing is left, for then every shard has been asked by every carrier.
    """
    packed = loads.groupBy().agg(F.sort_array(F.collect_list(F.struct("node", "shard", "n"))).alias("a"), F.sum("n").alias("total"))
    return packed.selectExpr(
        f"""aggregate(
            concat(a, transform(a, x -> struct(x.node, x.shard, 0L as n))),
            named_struct(
                'room', transform(sequence(0, {shards - 1}), s -> cast(total div {shards} as bigint) + if(s < total % {shards}, 1L, 0L)),
                'carry', cast(array() as array<struct<node:int, low:bigint, n:bigint>>),
                'out', cast(array() as array<struct<node:int, shard:int, low:bigint, n:bigint>>)),
            (acc, x) -> transform(array(named_struct(
                'room', acc.room, 'out', acc.out, 'free', acc.room[x.shard], 'shard', x.shard,
                'queue', aggregate(filter(concat(acc.carry, array(named_struct('node', x.node, 'low', 0L, 'n', x.n))), q -> q.n > 0),
                    cast(array() as array<struct<node:int, low:bigint, n:bigint, before:bigint>>),
                    (s, q) -> concat(s, array(named_struct('node', q.node, 'low', q.low, 'n', q.n,
                        'before', if(size(s) = 0, 0L, element_at(s, -1).before + element_at(s, -1).n))))))),
                t -> named_struct(
                'room', transform(t.room, (r, i) -> if(i = t.shard, greatest(0L, r - if(size(t.queue) = 0, 0L, element_at(t.queue, -1).before + element_at(t.queue, -1).n)), r)),
                'carry', transform(filter(t.queue, q -> q.before + q.n > t.free),
                    q -> named_struct('node', q.node, 'low', q.low + greatest(0L, t.free - q.before), 'n', q.n - greatest(0L, t.free - q.before))),
                'out', concat(t.out, transform(filter(t.queue, q -> q.before < t.free),
                    q -> named_struct('node', q.node, 'shard', t.shard, 'low', q.low, 'n', least(q.n, t.free - q.before))))))[0],
            acc -> acc.out) as moves"""
    ).selectExpr("inline(moves)")


def bounded_ring(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, nodes: int = NODES, tie: str | None = None) -> DataFrame:
    """Add shard and slot (gapless from 0 in each shard) to every row of ``docs``.

    Rows that repeat a key share a node and are told apart by ``tie`` (a column with any order); a null key is a key like
    any other.  Columns named shard or slot are replaced; names that begin with two underscores are those of helpers and raise.  An
    empty table gives no rows.  Equal rows are not kept together: a third of all rows may be equal, and shards are level.
    """
    spark = docs.sparkSession
    if taken := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"rename columns {', '.join(taken)}")
    place = F.xxhash64(F.lit("key"), F.col(key)).bitwiseAND(F.lit((1 << 63) - 1))
    nodes_df = ring(spark, shards, nodes)
    # the ring as one sorted array of shards * nodes entries, a scalar subquery
    edges = nodes_df.groupBy().agg(F.sort_array(F.collect_list("high")).alias("__edges"))
    placed = docs.withColumn("__place", place).withColumn("__edges", edges.scalar())
    # binary search for the first edge >= place
    steps = max(1, (shards * nodes).bit_length())
    at = F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {shards * nodes}), (s, i) -> if(s.lo >= s.hi, s, "
        "if(__edges[(s.lo + s.hi) div 2] < __place, named_struct('lo', cast((s.lo + s.hi) div 2 + 1 as int), 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), "
        f"s -> s.lo % {shards * nodes})"
    )
    placed = placed.withColumn("__node", at.cast("int")).drop("__edges").withColumn("__cell", F.pmod(F.xxhash64(F.lit("cell"), F.col(key), F.col(tie or key)), F.lit(CELLS)).cast("int"))
    cells = placed.groupBy("__node", "__cell").agg(F.count(F.lit(1)).alias("n"))
    loads = nodes_df.select("node", "shard").join(F.broadcast(cells.groupBy("__node").agg(F.sum("n").alias("n"))), F.col("node") == F.col("__node"), "left").select("node", "shard", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    moves = _settle(loads, shards)
    moves = moves.withColumn("__base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("node", "low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    moves = moves.groupBy("node").agg(F.collect_list(F.struct("low", "n", "shard", "__base")).alias("__moves"))
    before = cells.withColumn("__before", F.coalesce(F.sum("n").over(Window.partitionBy("__node").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # at most shards * nodes * CELLS rows, each with the few moves of its node
    plan = before.join(moves, before["__node"] == moves["node"]).select("__node", "__cell", "__before", "__moves")
    order = [F.col("__place"), F.col(key)] + ([F.col(tie)] if tie else [])
    ranked = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("__node", "__cell").orderBy(*order)) - 1)
    out = ranked.join(F.broadcast(plan), ["__node", "__cell"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    out = out.withColumn("__move", F.expr("filter(__moves, m -> __rank >= m.low and __rank < m.low + m.n)[0]"))
    return out.withColumn("shard", F.col("__move.shard")).withColumn("slot", F.expr("__move.__base + __rank - __move.low")).drop("__node", "__cell", "__before", "__moves", "__rank", "__move", "__place")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return bounded_ring(docs, tie="text_crc32").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
