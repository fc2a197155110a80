"""Jaccard self-join of shingle sets with a count-vector R-tree.

A set's shingles are hashed into GROUPS groups; the group counts are a point.
The overlap of two sets is at most the sum of the coordinates' minima of their
points, and of a point and a box at most that with the box's upper corner.  An
R-tree over the points, packed by sorting, so gives all sets that may link
with a query; survivors are verified on the whole sets.

Trees are built over parts that no link leaves.  Sets that link share a shingle
among the first ones of each under any common order (their prefixes, one more
than can be missing from a partner).  The order here: a fixed share of the hash
range first, in it the shingles of fewest documents.  Document counts come from
one shuffle of those shingles alone, and a set with enough shingles of its own
links with nothing and goes no further.  Connected components of shared
prefixes are the parts; of equal sets one takes part.

A part within CELL_SETS sets and CELL_ITEMS shingles is one cell.  A larger one
is dealt out to cells by levels of size and by hash.  Each cell is joined by
itself; what it links is represented by one set, and the representatives are
joined the same way; then pairs of cells meet, but only the sets that are not
known to be linked, and only if the boxes of the cells allow a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, byte_view, discard, id_filter, kgram_hashes, load, lower_ascii, materialise, mix, passing, text_slices, word_bounds, word_hashes
from .graph import components, edges_batch

GROUPS = 256
#: The tree's boxes and first bound take so many neighbouring groups together.
COARSE = 4
#: Children of a node of the tree.
FAN = 32
#: Most sets, and shingles, of a cell (a longer single set is a cell of its own).
CELL_SETS = 1000
CELL_ITEMS = 1 << 18
_SLICE = 1 << 20


# --- sets ----------------------------------------------------------------------------------------------------------


def group_of(value: np.ndarray) -> np.ndarray:
    return ((value >> np.uint64(40)) % np.uint64(GROUPS)).astype(np.int64)


def _binary(values: np.ndarray, lo: np.ndarray) -> pa.Array:
    """values[lo[i]:lo[i + 1]] as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(lo) - 1, [None, pa.py_buffer((8 * lo).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _sets(k: int):
    """(doc_id, n, s1, s2, set): the distinct hashes of each text's runs of k words, ascending, and two sums that tell sets apart."""

    def run(batches):
        for piece, texts in text_slices(batches, limit=_SLICE):
            buf, offs = byte_view(texts)
            buf = lower_ascii(buf)
            starts, ends, first = word_bounds(buf, offs)
            h = word_hashes(buf, starts, ends)
            grams = kgram_hashes(h, k)
            words = np.diff(first)
            n_grams = np.where(words >= k, words - k + 1, np.minimum(words, 1))
            doc = np.repeat(np.arange(len(words)), n_grams)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams) + first[:-1][doc]
            value = np.zeros(len(doc), np.uint64)
            long = words[doc] >= k
            value[long] = grams[at[long]]
            for i in np.flatnonzero((words > 0) & (words < k)):  # the whole sequence is the one shingle
                with np.errstate(over="ignore"):
                    value[np.searchsorted(doc, i)] = mix(kgram_hashes(h[first[i] : first[i + 1]], int(words[i])) + np.uint64(words[i]))[0]
            order = np.lexsort((value, doc))
            doc, value = doc[order], value[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
            doc, value = doc[new], value[new]
            lo = np.searchsorted(doc, np.arange(len(words) + 1))
            sums = []
            with np.errstate(over="ignore"):
                for salt in (1, 2):
                    run_ = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt * 0x5851F42D4C957F2D)))))
                    sums.append(run_[lo[1:]] - run_[lo[:-1]])
            yield pa.RecordBatch.from_arrays([as_long(piece.column(0).to_numpy()), pa.array(np.diff(lo)), as_long(sums[0]), as_long(sums[1]), _binary(value, lo)], ["doc_id", "n", "s1", "s2", "set"])

    return run


SETS = "doc_id long, n long, s1 long, s2 long, set binary"


def _keys(k: int):
    """The sets' sizes and sums alone."""
    return lambda batches: (b.select([0, 1, 2, 3]) for b in _sets(k)(batches))


def _sets_of(k: int, bits: np.ndarray):
    """The sets of texts whose ids pass the filter."""
    return lambda batches: _sets(k)(passing(b, bits) for b in batches)


# --- parts ---------------------------------------------------------------------------------------------------------


def first_share(percent: int) -> int:
    """Sixteenths of the hash range that come first in the order: 2.5 times the share of a set that is its prefix."""
    return min(16, max(1, -(-5 * 16 * (100 - percent) // 200)))


def _ordered(k: int, percent: int):
    """(h, doc_id, need): each set's shingles of the first share of the range, and its next ones if its prefix is longer.

    need: length of the prefix, less the shingles in the share.
    """
    share = np.uint64(first_share(percent))

    def run(batches):
        for b in _sets(k)(batches):
            value, n = np.frombuffer(b.column(4).buffers()[2] or b"", np.uint64), b.column(1).to_numpy()
            doc = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            own = np.bincount(doc[(value >> np.uint64(60)) < share], minlength=len(n))
            prefix = n - -(-percent * n // 100) + 1
            keep = at < np.maximum(own, prefix)[doc]
            doc = doc[keep]
            yield pa.RecordBatch.from_arrays([as_long(value[keep]), as_long(b.column(0).to_numpy()[doc]), pa.array((prefix - own)[doc].astype(np.int32))], ["h", "doc_id", "need"])

    return run


def _shared(batches):
    """Of rows (h, doc_id, need) sorted by h, doc_id those whose h stands with two ids or more."""
    held, live = None, None  # rows of the last h while it has one id; the last h if it has more
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = None
        h, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(h)) - 1
        many = doc[head] != doc[last]
        many[0] |= h[0] == live
        tail = head[-1]
        live = h[-1] if many[-1] else None
        keep = np.repeat(many, last - head + 1)
        if not many[-1]:
            keep[tail:] = False
            held = b.slice(tail if len(h) - tail < 3 else len(h) - 1)  # rows that repeat an id are told apart by nothing else
        yield b.filter(pa.array(keep))


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(h, doc_id): the shingles of each set's prefix that another document shares."""
    rows = docs.mapInArrow(_ordered(k, percent), "h long, doc_id long, need int").repartition("h").sortWithinPartitions("h", "doc_id", "need")
    rows = materialise(rows.mapInArrow(_shared, "h long, doc_id long, need int"))
    spread = rows.groupBy("h").agg(F.count(F.lit(1)).alias("spread"))
    first = F.shiftrightunsigned("h", 60) < first_share(percent)
    mine = rows.join(spread, "h").groupBy("doc_id").agg(
        F.max("need").alias("need"), F.sort_array(F.collect_list(F.when(first, F.struct("spread", "h")))).alias("a"), F.collect_list(F.when(~first, F.col("h"))).alias("b"))
    # those that stand alone are the order's first
    held = F.expr("concat(transform(slice(a, 1, greatest(0, size(a) + need)), x -> x.h), b)")
    out = materialise(mine.select("doc_id", F.explode(held).alias("h")).select("h", "doc_id"))
    discard(rows)
    return out


# --- the tree ------------------------------------------------------------------------------------------------------


def coarse_of(points: np.ndarray) -> np.ndarray:
    return points.reshape(len(points), -1, COARSE).sum(2)


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), GROUPS), np.int32)
    for i, s in enumerate(sets):
        out[i] = np.bincount(group_of(s.view(np.uint64)), minlength=GROUPS)
    return out


class CountTree:
    """A packed R-tree over count vectors: FAN points a leaf in sorted order, FAN nodes a node, up to one root.

    A node has the upper corner of its box over sums of COARSE groups, and its least and largest size.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        coarse = coarse_of(points)
        spread = np.argsort(-coarse.var(0), kind="stable")[:3]
        self.order = np.lexsort((*(coarse[:, c] for c in spread[::-1]), sizes))
        self.points = points[self.order]
        high, least, most = coarse[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(high, least, most)]
        while len(high) > 1:
            at = np.arange(0, len(high), FAN)
            high, least, most = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((high, least, most))

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions (in the points' own order) of all sets whose bound on the overlap allows a link."""
        coarse = coarse_of(point[None])[0]
        at = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[depth]
            low = least[at]
            ok = (100 * most[at] >= percent * size) & (100 * size >= percent * low)
            # 100 i >= p (a + b - i)  <=>  (100 + p) i >= p (a + b)
            ok[ok] = (100 + percent) * np.minimum(high[at[ok]], coarse).sum(1) >= percent * (size + low[ok])
            at = at[ok]
            if depth:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        sizes = self.levels[0][1]
        at = at[(100 + percent) * np.minimum(self.points[at], point).sum(1) >= percent * (size + sizes[at])]
        return self.order[at]


def spanning_links(points: np.ndarray, sizes: np.ndarray, n: int, percent: int, verify: Callable[[int, int], bool], known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the sets into components: within all (n = their number), or between the first n and the rest.

    Candidates come from the tree, ``verify`` decides.  A pair is looked at only while its ends are apart, so a group of
    near copies costs about one check a set; sets of one label in ``known`` are together from the start.
    """
    parent = list(range(len(points)))
    if known is not None:
        _, first, label = np.unique(known, return_index=True, return_inverse=True)
        parent = first[label].tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    base = n if n < len(points) else 0
    tree = CountTree(points[base:], sizes[base:])
    roots, found = np.array(parent), []
    for i in range(n):
        near = tree.near(points[i], int(sizes[i]), percent) + base
        near = near[near > i]
        own = root(i)
        for j in near[roots[near] != own].tolist():
            other = root(j)
            if other != own and verify(i, j):
                parent[other] = own
                found.append((i, j))
            roots[j] = root(j)
    return found


# --- cells ---------------------------------------------------------------------------------------------------------


def _grouped(batches, keys: int) -> Iterator[pa.Table]:
    """Neighbouring rows that agree in the first ``keys`` columns (long)."""
    held, last = [], None
    for b in batches:
        cols = [b.column(c).to_numpy() for c in range(keys)]
        new = np.zeros(b.num_rows, bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        head = np.flatnonzero(new)
        for lo, hi in zip(head.tolist(), [*head[1:].tolist(), b.num_rows], strict=True):
            key = tuple(int(c[lo]) for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _arrays(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("set")]


def _solve(percent: int, keys: int):
    """Rows (keys, side, doc_id, n, label, set), sorted by keys and side, to links (a, b): within a cell, or between sides 0 and 1."""

    def run(batches):
        out: list[tuple[int, int]] = []
        for rows in _grouped(batches, keys):
            ids, n = _column(rows, "doc_id"), int((_column(rows, "side") == 0).sum())
            if n == 0 or len(ids) < 2:
                continue
            sets = _arrays(rows)

            def verify(i: int, j: int) -> bool:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))  # noqa: B023
                return 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)  # noqa: B023

            out += [(int(ids[i]), int(ids[j])) for i, j in spanning_links(count_vectors(sets), _column(rows, "n"), n, percent, verify, _column(rows, "label"))]
            if len(out) > 10_000:
                yield edges_batch(*zip(*out, strict=True))
                out = []
        if out:
            yield edges_batch(*zip(*out, strict=True))

    return run


def solved(rows: DataFrame, percent: int, *keys: str) -> DataFrame:
    dealt = rows.select(*(F.col(c).cast("long").alias(c) for c in keys), "side", "doc_id", "n", "label", "set").repartition(*keys)
    return dealt.sortWithinPartitions(*keys, "side", "doc_id").mapInArrow(_solve(percent, len(keys)), "u long, v long").toDF("a", "b")


def dealt_out(parts: DataFrame, percent: int) -> DataFrame:
    """Rows (component, doc_id, n) of parts of two sets or more, with level and cell (-1 and 0 in a part that is one cell).

    Sets that link differ by one level at most.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    size = parts.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("items")).where("sets > 1")
    rows = parts.join(size, "component").withColumn("level", F.when((F.col("sets") <= CELL_SETS) & (F.col("items") <= CELL_ITEMS), F.lit(-1)).otherwise(level))
    cells = rows.groupBy("component", "level").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CELL_SETS, F.sum("n") / CELL_ITEMS)).cast("int").alias("cells"))
    rows = rows.join(cells, ["component", "level"])
    own = F.when(F.col("level") < 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int"))
    return rows.select("component", "doc_id", "n", "level", own.alias("cell"))


def _boxes(batches):
    """Rows (component, level, cell, label, n, set) to boxes (component, level, cell, main, rest, high, least, most).

    main: the label of most sets of the cell, whose box stands apart (rest false) from that of the others (rest true).
    """
    names = ["component", "level", "cell", "main", "rest", "high", "least", "most"]
    for rows in _grouped(batches, 3):
        label, n = _column(rows, "label"), _column(rows, "n")
        points = coarse_of(count_vectors(_arrays(rows)))
        value, count = np.unique(label, return_counts=True)
        main, out = int(value[np.argmax(count)]), []
        for rest in (False, True):
            own = (label != main) == rest
            if own.any():
                out.append((*(int(rows.column(c)[0].as_py()) for c in names[:3]), main, rest, points[own].max(0).tolist(), int(n[own].min()), int(n[own].max())))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """Sets of large parts (component, level, cell, doc_id, n, label, set), once for each pair of boxes that may link over two labels: adds pair, side."""
    cells = rows.select("component", F.col("level").cast("long").alias("level"), F.col("cell").cast("long").alias("cell"), "label", "n", "set").repartition("component", "level", "cell")
    kinds = "component long, level long, cell long, main long, rest boolean, high array<int>, least long, most long"
    boxes = materialise(cells.sortWithinPartitions("component", "level", "cell").mapInArrow(_boxes, kinds))
    a = boxes.select("component", *(F.col(c).alias(f"{c}_a") for c in boxes.columns[1:]), F.explode(F.array("level", F.col("level") + 1)).alias("level"))
    b = boxes.select("component", *(F.col(c).alias(f"{c}_b") for c in boxes.columns[1:]), "level")
    later = F.expr("level_a < level_b or cell_a < cell_b")  # pairs within a cell are done
    sizes = (100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a"))
    bound = (100 + percent) * F.expr("aggregate(zip_with(high_a, high_b, (x, y) -> least(x, y)), 0L, (s, x) -> s + x)") >= percent * (F.col("least_a") + F.col("least_b"))
    pairs = a.join(b, ["component", "level"]).where(later & sizes & ~F.expr("not rest_a and not rest_b and main_a = main_b") & bound)
    pairs = materialise(pairs.withColumn("pair", F.monotonically_increasing_id()))
    side = lambda s, k: pairs.select("component", F.col(f"level_{s}").alias("level"), F.col(f"cell_{s}").alias("cell"), F.col(f"main_{s}").alias("main"), F.col(f"rest_{s}").alias("rest"), "pair", F.lit(k).alias("side"))
    return rows.join(side("a", 0).unionByName(side("b", 1)), ["component", "level", "cell"]).where((F.col("label") != F.col("main")) == F.col("rest")).select(*rows.columns, "pair", "side")


def links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the sets of each part into their components; rows: component, doc_id, n, set, level, cell."""
    found = materialise(solved(rows.withColumns({"side": F.lit(0), "label": F.col("doc_id")}), percent, "component", "level", "cell"))
    large = materialise(rows.where("level >= 0"))
    if large.isEmpty():
        return found
    labelled = lambda: materialise(large.join(components(found).select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    # one set of each that its cell links goes on
    heads = labelled().groupBy("component", "label").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("component", F.col("label").alias("doc_id"))
    heads = large.drop("level", "cell").join(heads, ["component", "doc_id"], "left_semi")
    heads = materialise(heads.join(dealt_out(heads.select("component", "doc_id", "n"), percent).drop("component", "n"), "doc_id"))
    if not heads.isEmpty():
        found = materialise(found.unionByName(links(heads, percent)))
    between = solved(meetings(labelled(), percent), percent, "pair")
    return found.unionByName(between)


def similar_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each distinct doc_id of ``docs`` (doc_id, text).

    Sets are the distinct runs of k words (ASCII lower-cased); a text of fewer words is one shingle, one of none (null and
    empty texts too) has the empty set and links with nothing.  Sets link if 100 * overlap >= percent * union; component_id
    is the smallest id reachable.  Rows that repeat an id are left as one row of its smallest set; rows without id are left
    out; other columns are ignored.  A very long text is handled whole in one task, with about 100 times its size there.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    keys = materialise(docs.mapInArrow(_keys(k), "doc_id long, n long, s1 long, s2 long").groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("s")).select("doc_id", "s.*"))
    same = keys.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    # of equal sets one goes on
    prefix = prefixes(docs, k, percent)
    firsts = materialise(prefix.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
    discard(prefix)
    shared = firsts.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "lo")
    parts = components(firsts.join(shared, "h").where("doc_id > lo").select(F.col("doc_id").alias("a"), F.col("lo").alias("b")))
    plan = materialise(dealt_out(parts.select(F.col("node").alias("doc_id"), "component").join(keys.select("doc_id", "n"), "doc_id"), percent))
    discard(firsts)
    bits = id_filter(plan.select("doc_id"))  # spares most texts' sets the shuffle
    sets = docs.mapInArrow(_sets_of(k, bits), SETS).join(keys.select("doc_id", "n", "s1", "s2"), ["doc_id", "n", "s1", "s2"]).select("doc_id", "set")
    linked = components(links(materialise(sets.join(plan, "doc_id")), percent))
    reach = same.join(linked, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = keys.join(reach, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(load(spark, sf_dir, "documents", "doc_id", "text"), 3, 90)
