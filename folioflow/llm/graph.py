"""Connected components by alternating large-star and small-star steps, with links contracted within tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Links that a task contracts at a time.
CHUNK = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that these links join it with), without the smallest ones themselves."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            own = label != np.arange(len(ids))
            return ids[own], ids[label[own]]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def edges_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(np.asarray(u, np.int64), np.asarray(v, np.int64))], ["u", "v"])


def _contracted(pairs):
    """Pairs of arrays to batches of stars, a chunk at a time."""
    held, size = [], 0
    for u, v in pairs:
        held.append((u, v))
        size += len(u)
        if size > CHUNK:
            yield edges_batch(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield edges_batch(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _plain(batches):
    return _contracted((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches)


def _star(large: bool):
    """Rows (u, v) sorted by both: what u's neighbours are linked with instead."""

    def pairs(batches):
        last, low = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.ones(len(u), bool)
            new[1:] = u[1:] != u[:-1]
            head = np.flatnonzero(new)
            least = v[head].copy()
            if u[0] == last:
                least[0] = low
            last, low = u[-1], least[-1]
            least = least[np.cumsum(new) - 1]
            if large:
                keep = v > u
                yield v[keep], np.minimum(least, u)[keep]
            else:
                yield np.where(v == least, u, v), least

    return lambda batches: _contracted(pairs(batches))


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one link at most, and none leads to a node that has one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 or (out = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b: long) reaches.

    A round is two shuffles of the links; rounds grow with the logarithm of the longest path, less what tasks contract.  A
    node's links are read in a stream.  Self loops are fine; a node that has nothing but such is not returned.
    """
    dealt = lambda df, large: df.repartition("u").sortWithinPartitions("u", "v").mapInArrow(_star(large), "u long, v long")
    # links of a node come from many tasks; a small star over what these have contracted leaves about one for each node, however many tasks
    now = materialise(dealt(edges.select("a", "b").where("a != b").mapInArrow(_plain, "u long, v long"), False))
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        after = materialise(dealt(dealt(both, True), False))
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
