"""Byte-level substring deduplication with suffix arrays of shards.

A shard is a concatenation of byte strings.  Its suffix array is made by
induced sorting: suffixes are classified by whether they are smaller or larger
than the next one, the substrings between leftmost-smaller suffixes are put in
order by inducing and named, the string of names is sorted recursively (by
doubling once there are more names than ALPHABET), and that order of the
leftmost-smaller suffixes induces the order of all, from the heads of the
buckets up and from their tails down.  Permuted common prefixes (by text
position, with the suffix before it in the array) then tell which positions
start a string of ``length`` bytes that starts elsewhere too.  All steps are
numpy operations, for inducing a bucket at a time.

Shards get together by content: each string of ``length`` bytes holds a
minimiser (the smallest hash of its ``gram``-byte runs), and equal strings hold
equal ones.  The stretches of text around minimisers that occur twice are dealt
out by minimiser, equal stretches are merged and counted first, and a shard
takes the stretches of some minimisers.

A minimiser whose stretches exceed a shard is dealt out anew: its strings are
grouped by how far from their start it stands, ``width`` distances at a time,
and by the bytes that all strings of these distances share around it.  Equal
strings agree in both.  Widths shrink to 1, where those bytes are the string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import anchors, as_long, byte_table, byte_view, discard, kgram_hashes, load, materialise, text_slices

LENGTH = 400
GRAM = 32
#: Bytes of a shard, and of one group's distinct stretches beyond which they are dealt out anew.
SHARD = 1 << 20
#: Distances that a group takes when it is dealt out anew, round by round.
WIDTHS = (92, 23, 5, 1)
_SLICE = 1 << 20


# --- suffix arrays -------------------------------------------------------------------------------------------------

#: Symbols up to which induced sorting goes bucket by bucket; names beyond are sorted by doubling.
ALPHABET = 1 << 9


def classify(x: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last is larger than the empty suffix: False)."""
    n = len(x)
    differs = np.flatnonzero(x[1:] != x[:-1])
    smaller = np.zeros(n, bool)
    if len(differs):
        rising = x[differs] < x[differs + 1]
        size = np.diff(np.concatenate(([-1], differs)))
        smaller[: differs[-1] + 1] = np.repeat(rising, size)
    return smaller


def _by_symbol(at: np.ndarray, symbol: np.ndarray, lists: list[list[np.ndarray]]) -> None:
    """Append positions to their symbols' lists, in order."""
    if not len(at):
        return
    order = np.argsort(symbol, kind="stable")
    at, symbol = at[order], symbol[order]
    head = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
    for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(at)], strict=True):
        lists[symbol[lo]].append(at[lo:hi])


def induce(x: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that leftmost-smaller suffixes in the order ``lms`` induce.

    Buckets go up for larger suffixes, from their heads, and down for smaller ones, from their tails; what a bucket holds
    places the suffixes one position before, a bucket at a time.
    """
    n, symbols = len(x), int(x.max()) + 1
    seeds: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _by_symbol(lms, x[lms], seeds)

    def before(at: np.ndarray, kind: bool) -> np.ndarray:
        """The positions before those of ``at``, if their suffixes are of that kind (smaller: True)."""
        at = at[at > 0] - 1
        return at[smaller[at] == kind]

    up: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    if not smaller[n - 1]:
        up[x[n - 1]].append(np.array([n - 1]))  # the empty suffix comes first
    larger: list[np.ndarray] = []
    for c in range(symbols):
        wave, done = np.concatenate(up[c]) if up[c] else np.zeros(0, np.int64), []
        while len(wave):  # runs of c place further suffixes of the same bucket
            done.append(wave)
            back = before(wave, False)
            same = x[back] == c
            wave = back[same]
            _by_symbol(back[~same], x[back[~same]], up)
        for seed in seeds[c]:
            back = before(seed, False)
            _by_symbol(back, x[back], up)
        larger.append(np.concatenate(done) if done else np.zeros(0, np.int64))
    # from the tails: every list is in falling order
    down: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        wave, done = np.concatenate(down[c]) if down[c] else np.zeros(0, np.int64), []
        while len(wave):
            done.append(wave)
            back = before(wave, True)
            same = x[back] == c
            wave = back[same]
            _by_symbol(back[~same], x[back[~same]], down)
        falling = larger[c][::-1]
        # a larger suffix has no smaller one of its own symbol before it
        back = before(falling, True)
        _by_symbol(back, x[back], down)
        out += [*done, falling]
    return np.concatenate(out)[::-1]


def _name(x: np.ndarray, smaller: np.ndarray, lms: np.ndarray, place: np.ndarray, apart: int) -> tuple[np.ndarray, int]:
    """Names from 1 on of leftmost-smaller substrings (``lms``, ascending; ``place``: which of them, in order), equal ones alike but for the first ``apart``, and how many there are."""
    code = 2 * x.astype(np.int16) + smaller  # symbol and kind; symbols are below ALPHABET
    size = (np.append(lms[1:], len(x) - 1) - lms + 1)[place]  # each runs to the next one's first symbol
    lms = lms[place]
    differs = np.ones(len(lms), bool)
    open_ = np.flatnonzero(size[1:] == size[:-1]) + 1  # neighbours that may be equal
    open_ = open_[open_ >= apart]
    differs[open_] = False
    depth = 0
    while len(open_):
        a, b = lms[open_] + depth, lms[open_ - 1] + depth
        unlike = code[a] != code[b]
        differs[open_[unlike]] = True
        depth += 1
        open_ = open_[~unlike & (size[open_] > depth)]
    return np.cumsum(differs), int(differs.sum())


def _doubled(x: np.ndarray) -> np.ndarray:
    """Suffix array of many symbols, by doubling the compared length of those that are still alike."""
    n, step = len(x), 1
    order = np.argsort(x)  # ties are told apart below
    new = np.ones(n, bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)  # the place of a suffix's group in the order
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            return order
        item = order[open_]
        after = item + step
        key = rank[item] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        sub = np.argsort(key)
        order[open_], key = item[sub], key[sub]  # groups keep their places
        new[open_[1:]] |= key[1:] != key[:-1]
        head = np.flatnonzero(new[open_])
        rank[order[open_]] = np.repeat(open_[head], np.diff(np.append(head, len(open_))))
        step *= 2


def suffix_array(x: np.ndarray, ends: bool = False) -> np.ndarray:
    """Suffix array of an array of non-negative integers by induced sorting; ends: each 0 is a symbol of its own, in their order.

    Leftmost-smaller substrings are put in order by inducing from their first symbols alone, named, and the string of
    names is sorted recursively; that order induces the whole array.
    """
    n = len(x)
    if n < 2:
        return np.arange(n)
    if int(x.max()) >= ALPHABET:
        return _doubled(x)
    smaller = classify(x)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        mask = np.zeros(n, bool)
        mask[lms] = True
        in_order = induce(x, smaller, lms)
        in_order = in_order[mask[in_order]]
        apart = int((x[lms] == 0).sum()) if ends else 0
        in_order[:apart].sort()
        of = np.empty(n, np.int64)
        of[lms] = np.arange(len(lms))
        place = of[in_order]
        name, names = _name(x, smaller, lms, place, apart)
        if names < len(lms):
            of_lms = np.empty(len(lms), np.int64)
            of_lms[place] = name
            in_order = lms[suffix_array(of_lms)]
        lms = in_order
    out = induce(x, smaller, lms)
    if ends:
        out[1 : int((x == 0).sum())].sort()  # the last one is the least
    return out


def permuted_common_prefixes(buf: np.ndarray, sa: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each byte the suffix before it in the array (-1: none), and how many bytes the two share, at most ``room`` of either.

    A byte whose left neighbour differs from that of the suffix before it, or has no room, is compared eight bytes at a
    time; any other shares one byte less than its left neighbour.
    """
    n = len(buf)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    left = np.maximum(before, 1) - 1
    open_ = np.ones(n, bool)
    open_[1:] = (before[1:] < 1) | (buf[:-1] != buf[left[1:]]) | (room[:-1] == 0) | (room[left[1:]] == 0)
    open_ = np.flatnonzero(open_)
    words = np.ndarray(n + 8, "<u8", np.concatenate((buf, np.zeros(16, np.uint8))), strides=(1,)).astype(np.uint64)  # eight bytes from each
    shared = np.zeros(n, np.int64)
    live = open_[before[open_] >= 0]
    most = np.minimum(room[live], room[before[live]])
    depth = 0
    while len(live):
        unlike = words[live + depth] ^ words[before[live] + depth]
        equal = np.bitwise_count(~unlike & (unlike - np.uint64(1))).astype(np.int64) >> 3  # zeros below the lowest bit that differs
        shared[live] = np.minimum(depth + equal, most)
        depth += 8
        going = (equal == 8) & (most > depth)
        live, most = live[going], most[going]
    at = np.arange(n)
    known = np.zeros(n, np.int64)
    known[open_] = open_
    known = np.maximum.accumulate(known)
    return before, np.maximum(shared[known] - (at - known), 0)


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part the positions whose next ``length`` bytes start at another position of some part too."""
    raw = b"\0".join(parts) + b"\0"
    buf = np.frombuffer(raw, np.uint8)
    x = buf.astype(np.int16) + np.int16(1)
    size = np.array([len(p) for p in parts], np.int64)
    offs = np.concatenate(([0], np.cumsum(size + 1)))
    x[offs[1:] - 1] = 0  # below every byte
    room = np.repeat(offs[1:] - 1, size + 1) - np.arange(len(buf))  # nothing runs past its part
    before, shared = permuted_common_prefixes(buf, suffix_array(x, ends=True), room)
    same = np.flatnonzero(shared >= length)
    flag = np.zeros(len(buf), bool)
    flag[same] = flag[before[same]] = True
    return [np.flatnonzero(flag[lo : lo + n]) for lo, n in zip(offs[:-1].tolist(), size.tolist(), strict=True)]


# --- Spark ---------------------------------------------------------------------------------------------------------


def _inside(offs: np.ndarray, length: int) -> np.ndarray:
    """Mask over byte positions: ``length`` bytes from there lie in one text (before its separator)."""
    n = int(offs[-1])
    left = np.repeat(offs[1:] - 1, np.diff(offs)) - np.arange(n)
    return (left >= length)[: max(0, n - length + 1)]


def _places(length: int, gram: int):
    """(h, doc_id) for each minimiser of each text."""

    def run(batches):
        for piece, texts in text_slices(batches, limit=_SLICE):
            buf, offs = byte_view(texts)
            grams = kgram_hashes(byte_table(3)[buf], gram)
            at, _ = anchors(grams, _inside(offs, length), length - gram + 1)
            doc = np.searchsorted(offs, at, side="right") - 1
            order = np.lexsort((grams[at], doc))
            h, doc = grams[at][order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            many = np.diff(np.append(np.flatnonzero(new), len(h)))
            yield pa.RecordBatch.from_arrays([as_long(h[new]), as_long(piece.column(0).to_numpy()[doc[new]]), pa.array(many)], ["h", "doc_id", "n"])

    return run


def _stretches(length: int, gram: int):
    """(h, part, doc_id, at, bytes): around each live minimiser, the text of all strings whose minimiser it is."""

    def run(batches):
        for piece, texts in text_slices(batches, limit=_SLICE):
            buf, offs = byte_view(texts)
            grams = kgram_hashes(byte_table(3)[buf], gram)
            inside = _inside(offs, length)
            at, low = anchors(grams, inside, length - gram + 1)
            if not len(at):
                continue
            doc = np.searchsorted(offs, at, side="right") - 1
            live = piece.column(piece.schema.get_field_index("live"))
            values, lo = live.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(live.value_lengths().to_numpy())))
            salt = lambda d: d.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
            with np.errstate(over="ignore"):
                own = np.isin(grams[at] ^ salt(doc), values ^ salt(np.repeat(np.arange(len(lo) - 1), np.diff(lo))))
            at, doc = at[own], doc[own]
            # windows whose smallest hash this is: a run of starts in which low stays the same value
            low = np.where(inside[: len(low)], low, np.uint64(0))
            cut = np.flatnonzero(low[1:] != low[:-1]) + 1
            head, tail = np.concatenate(([0], cut)), np.append(cut, len(low)) - 1
            run_of = np.flatnonzero(low[head] > 0)
            head, tail = head[run_of], tail[run_of]
            live_h = np.isin(low[head] ^ salt(np.searchsorted(offs, head, side="right") - 1), grams[at] ^ salt(doc))
            head, tail = head[live_h], tail[live_h]
            doc = np.searchsorted(offs, head, side="right") - 1
            raw = buf.tobytes()
            ids = piece.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([as_long(low[head]), pa.array([raw[a : b + length] for a, b in zip(head.tolist(), tail.tolist(), strict=True)], pa.binary()), as_long(ids[doc]), pa.array((head - offs[doc]).astype(np.int64)), pa.array((tail - head + length).astype(np.int64))], ["h", "part", "doc_id", "at", "bytes"])

    return run


def _cut(length: int, gram: int, width: int):
    """Rows (g, key, part, n, h) to (g, part, n, h, of_g, of_key, at, bytes): each stretch cut where the distance of its strings' minimiser enters another ``width``.

    The new g names that group of distances and the bytes that all its strings hold around the minimiser.
    """

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                out: list[tuple] = []
                for g, key, part, n, h in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns), strict=True):
                    grams = kgram_hashes(byte_table(3)[np.frombuffer(part, np.uint8)], gram)
                    place = np.flatnonzero(grams.view(np.int64) == h)
                    start = np.arange(len(part) - length + 1)
                    low = place[np.searchsorted(place, start)]
                    group = (low - start) // width
                    edge = np.flatnonzero((np.diff(low) != 0) | (np.diff(group) != 0)) + 1
                    for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(start)], strict=True):
                        near, p = int(group[a]) * width, int(low[a])
                        far = min(near + width - 1, length - gram)
                        core = b"%d %d " % (h, near) + part[p - near : p - far + length]
                        name = int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)
                        out.append((name, part[a : z - 1 + length], n, h, g, key, a, z - 1 + length - a))
                cols = zip(*out, strict=True)
                types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["g", "part", "n", "h", "of_g", "of_key", "at", "bytes"])

    return run


def _runs(starts: np.ndarray, length: int) -> list[dict]:
    """Covered stretches [lo, hi) of starts of strings."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    lo, hi = starts[np.concatenate(([0], cut))], starts[np.append(cut, len(starts)) - 1] + length
    return [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def _shards(length: int, cut: bool = False):
    """Rows (g, key, part, n) come sorted by g; each shard is some whole groups' stretches.

    cut: no stretch holds a string twice, since its minimiser stands at one place.
    """

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["g", "key", "runs"])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        """Strings of different groups differ, so groups may share a suffix array; a stretch that stands at several places is in it twice."""
        starts = repeated_starts([r[2] for r in rows] + [r[2] for r in rows if r[3] > 1], length)
        return batch([(r[0], r[1], _runs(at, length)) for r, at in zip(rows, starts[: len(rows)], strict=True) if len(at)])

    def run(batches):
        held: list[tuple] = []  # stretches for the next shard
        group: list[tuple] = []  # those of the group at hand
        size = 0

        def close() -> None:
            """A group of one stretch that was cut and stands at one place repeats nothing."""
            nonlocal size
            if len(group) != 1 or not cut or group[0][3] > 1:
                held.extend(group)
                size += sum(len(r[2]) * (1 + (r[3] > 1)) for r in group)
            group.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and row[0] != group[0][0]:
                    close()
                    if size > SHARD:
                        yield solve(held)
                        held, size = [], 0
                group.append(row)
        close()
        if held:
            yield solve(held)

    return run


def _remove(length: int):
    def run(batches):
        for piece, texts in text_slices(batches, limit=_SLICE):
            cols = [[], [], [], []]
            runs = piece.column(piece.schema.get_field_index("runs")).to_pylist()
            for raw, found in zip(texts.to_pylist(), runs, strict=True):
                kept, end, spans, gone = [], 0, 0, 0
                at = None  # end of the removed run so far
                for r in sorted((r["lo"], r["hi"]) for r in found or ()):
                    if at is None or r[0] > at:
                        kept.append(raw[end if at is None else at : r[0]])
                        spans, at = spans + 1, r[1]
                        gone += r[1] - r[0]
                    elif r[1] > at:
                        gone += r[1] - at
                        at = r[1]
                kept.append(raw[at or 0 :])
                text = b"".join(kept)
                for c, v in zip(cols, (gone, spans, hashlib.sha256(text).hexdigest(), text), strict=True):
                    c.append(v)
            n_bytes = [len(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n_bytes, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _moved():
    return F.transform("runs", lambda r: F.struct((r["lo"] + F.col("at")).alias("lo"), (r["hi"] + F.col("at")).alias("hi"))).alias("runs")


def deal(parts: DataFrame, length: int, gram: int, shard: int) -> list[tuple[DataFrame, list[DataFrame]]]:
    """Distinct stretches (g, key, part, n) in groups g of ``shard`` bytes at most, with the cuts that lead to each.

    The last width leaves one string to a group.  A group's number is broadcast if it exceeds ``shard``: eight bytes for so
    many bytes of stretches.
    """
    rows = parts.withColumn("g", F.col("h")).withColumn("n", F.lit(1).cast("long"))
    out, cuts = [], []
    for width in (*WIDTHS, None):
        large = None
        if width is not None:
            sizes = rows.groupBy("g", "key").agg(F.min("bytes").alias("bytes")).groupBy("g").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("keys"))
            large = materialise(sizes.where((F.col("bytes") > shard) & (F.col("keys") > 1)).select("g"))
        last = large is None or large.isEmpty()
        merge = lambda how: (rows if how is None else rows.join(F.broadcast(large), "g", how)).groupBy("g", "key").agg(F.min("part").alias("part"), F.sum("n").alias("n"), F.min("h").alias("h"))  # noqa: B023, E731
        out.append((merge(None if last else "left_anti").select("g", "key", "part", "n"), cuts))
        if last:
            break
        again = merge("left_semi").select("g", "key", "part", "n", "h")
        rows = materialise(again.mapInArrow(_cut(length, gram, width), "g long, part binary, n long, h long, of_g long, of_key binary, at long, bytes long").withColumn("key", F.unhex(F.md5("part"))))
        cuts = [*cuts, rows]
    return out


def stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, part, doc_id, at, bytes, key) around all minimisers that stand at two places or more."""
    places = materialise(docs.mapInArrow(_places(length, gram), "h long, doc_id long, n long"))
    twice = places.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    live = places.join(twice, "h").groupBy("doc_id").agg(F.collect_list("h").alias("live"))
    found = materialise(docs.join(live, "doc_id").mapInArrow(_stretches(length, gram), "h long, part binary, doc_id long, at long, bytes long").withColumn("key", F.unhex(F.md5("part"))))
    discard(places)
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of ``docs`` (doc_id, text).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text too.  Null and empty
    texts have no bytes; texts shorter than ``length`` keep all.  ids are taken to be distinct (rows that share one all lose
    what any of them loses at the same place); rows without id are left out; other columns are ignored.  A very long text is
    handled whole in one task, with about 100 times its size there.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    parts = stretches(docs, length, gram)
    found = None
    for groups, cuts in deal(parts, length, gram, shard):
        runs = groups.repartition("g").sortWithinPartitions("g", "key").mapInArrow(_shards(length, bool(cuts)), "g long, key binary, runs array<struct<lo:long,hi:long>>")
        for cut in reversed(cuts):
            runs = cut.select("g", "key", "of_g", "of_key", "at").join(runs, ["g", "key"]).select(F.col("of_g").alias("g"), F.col("of_key").alias("key"), _moved())
        found = runs if found is None else found.unionByName(runs)
    by_doc = parts.select(F.col("h").alias("g"), "key", "doc_id", "at").join(found, ["g", "key"]).select("doc_id", _moved())
    gone = by_doc.groupBy("doc_id").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return docs.join(gone, "doc_id", "left").mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")
