"""Benchmark decontamination by spaced seeds.

A mask names the word positions that count; the others may differ.  The hashes
of the benchmark's and the documents' words under each mask are joined, and
around each hit the two texts are laid side by side without gaps.  A document
overlaps an item if some SPAN aligned words (all words of a shorter item) agree
in at least PERCENT of their places.  The masks find every such stretch: for
any two differing places of 13 some mask placement has neither
(``covers`` checks it).

A filter of a fixed size, filled from the benchmark's hashes, keeps hopeless
document positions from being shuffled; what passes is decided by the join.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, byte_view, load, lower_ascii, mix, starts_inside, text_slices, word_bounds, word_hashes

SPAN = 13
PERCENT = 80
#: Words of a document kept on either side of a hit for the comparison.
CONTEXT = 40
#: Bits of the filter, a fixed size.
FILTER_BITS = 1 << 24
_SLICE = 1 << 20
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))


def covers(masks, span: int = SPAN, misses: int = SPAN - -(-PERCENT * SPAN // 100)) -> list[tuple[int, ...]]:
    """Sets of differing places in a span that no mask placement avoids (empty: every such overlap has a hit)."""
    placed = [{o + m for m in mask} for mask in masks for o in range(span - mask[-1])]
    return [bad for bad in combinations(range(span), misses) if not any(not p & set(bad) for p in placed)]


_WORD = np.full(256, 32, np.uint8)
_KEEP = [*range(48, 58), *range(97, 123), *range(128, 256)]
_WORD[_KEEP] = _KEEP


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII letters lower-cased, other ASCII marks as blanks) and each text's first (n + 1)."""
    buf, offs = byte_view(texts)
    buf = _WORD[lower_ascii(buf)]
    starts, ends, first = word_bounds(buf, offs)
    return word_hashes(buf, starts, ends), first


def masked_hashes(h: np.ndarray, first: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each place where the whole mask lies in one text."""
    span = mask[-1] + 1
    at = np.flatnonzero(starts_inside(first, len(h), span))
    out = np.full(len(at), np.uint64(len(mask) * 1000003 + sum(1 << m for m in mask) % 1000003), np.uint64)
    with np.errstate(over="ignore"):
        for m in mask:
            out = (out ^ h[at + m]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return at, mix(out)


def _item_seeds(masks):
    def run(batches):
        for piece, texts in text_slices(batches, limit=_SLICE):
            h, first = _words(texts)
            ids, n = piece.column(0).to_numpy(), np.diff(first)
            for mask in masks:
                at, value = masked_hashes(h, first, mask)
                doc = np.searchsorted(first, at, side="right") - 1
                if mask[-1] + 1 == len(mask):  # without gaps: for short items, whole
                    own = n[doc] == len(mask)
                    at, value, doc = at[own], value[own], doc[own]
                yield pa.RecordBatch.from_arrays([as_long(value), as_long(ids[doc]), pa.array((at - first[doc]).astype(np.int32))], ["h", "item_id", "item_at"])

    return run


def _item_words(batches):
    for piece, texts in text_slices(batches, limit=_SLICE):
        h, first = _words(texts)
        yield pa.RecordBatch.from_arrays([as_long(piece.column(0).to_numpy()), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), as_long(h))], ["item_id", "item_words"])


def _doc_hits(masks, bits: np.ndarray):
    """(doc_id, lo, words, seeds): stretches of each text around the places whose masked hash passes the filter."""

    def run(batches):
        for piece, texts in text_slices(batches, limit=_SLICE):
            h, first = _words(texts)
            ids = piece.column(0).to_numpy()
            ats, values = [], []
            for mask in masks:
                at, value = masked_hashes(h, first, mask)
                slot = (value % np.uint64(FILTER_BITS)).astype(np.int64)
                ok = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                ats.append(at[ok])
                values.append(value[ok])
            at, value = np.concatenate(ats), np.concatenate(values)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, value = at[order], value[order]
            doc = np.searchsorted(first, at, side="right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) > 2 * CONTEXT) | (np.diff(doc) != 0)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(at)) - 1
            lo, hi = np.maximum(at[head] - CONTEXT, first[doc[head]]), np.minimum(at[tail] + CONTEXT + SPAN, first[doc[head] + 1])
            flat = np.concatenate([h[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(hi - lo))).astype(np.int32)), as_long(flat))
            seg = np.cumsum(new) - 1
            seeds = pa.StructArray.from_arrays([as_long(value), pa.array((at - lo[seg]).astype(np.int32))], ["h", "at"])
            seeds = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)).astype(np.int32)), seeds)
            yield pa.RecordBatch.from_arrays([as_long(ids[doc[head]]), pa.array((lo - first[doc[head]]).astype(np.int64)), words, seeds], ["doc_id", "lo", "words", "seeds"])

    return run


def best_stretch(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(matches in the best SPAN aligned words, that span, all matches) with item word 0 at doc word ``shift``."""
    lo, hi = max(shift, 0), min(shift + len(item), len(doc))
    span = min(SPAN, len(item))
    if hi - lo < span:
        return 0, span, 0
    same = doc[lo:hi] == item[lo - shift : hi - shift]
    run = np.concatenate(([0], np.cumsum(same)))
    return int((run[span:] - run[:-span]).max()), span, int(run[-1])


def _verify(batches):
    for b in batches:
        words, item = b.column(b.schema.get_field_index("words")), b.column(b.schema.get_field_index("item_words"))
        got = [best_stretch(words[i].values.to_numpy(), item[i].values.to_numpy(), s) for i, s in enumerate(b.column(b.schema.get_field_index("shift")).to_pylist())]
        keep = [i for i, (m, span, _) in enumerate(got) if span and (100 * m >= PERCENT * span if span == SPAN else m == span)]
        take = lambda c: b.column(b.schema.get_field_index(c)).take(pa.array(keep, pa.int64()))
        start = [lo + max(s, 0) for lo, s in zip(take("lo").to_pylist(), take("shift").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([take("doc_id"), take("item_id"), pa.array(start, pa.int64()), pa.array([got[i][2] for i in keep], pa.int64()), pa.array([len(item[i]) for i in keep], pa.int64())], ["doc_id", "item_id", "start", "matched", "item_words"])


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, matched, item_words): the best overlap of each document with each benchmark item it holds.

    start: the document's first aligned word.  Null, empty and mark-only texts and items overlap nothing; rows without id
    are left out; rows that repeat an id count as one; other columns are ignored.  Items of fewer than SPAN words must be
    held whole and unchanged.  Of a very long text only stretches around hits leave its task.
    """
    docs, items = (x.select(F.col(i).alias(i), "text").where(f"{i} is not null") for x, i in ((docs, "doc_id"), (items, "item_id")))
    words = items.mapInArrow(_item_words, "item_id long, item_words array<long>").where("size(item_words) > 0")
    short = [r[0] for r in words.where(F.size("item_words") < SPAN).select(F.size("item_words")).distinct().collect()]  # under SPAN values
    masks = (*MASKS, *(tuple(range(n)) for n in sorted(short)))
    seeds = items.mapInArrow(_item_seeds(masks), "h long, item_id long, item_at int")
    slot = F.pmod(F.conv(F.hex("h"), 16, 10).cast("decimal(20,0)"), F.lit(FILTER_BITS)).cast("int")
    filled = seeds.select(slot.alias("s")).groupBy((F.col("s") / 8).cast("int").alias("byte")).agg(F.expr("bit_or(shiftleft(1, s % 8))").alias("bits"))
    bits = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in filled.toArrow().to_batches():  # FILTER_BITS / 8 rows at most
        bits[r.column(0).to_numpy()] = r.column(1).to_numpy()
    places = docs.mapInArrow(_doc_hits(masks, bits), "doc_id long, lo long, words array<long>, seeds array<struct<h:long,at:int>>")
    hits = places.select("doc_id", "lo", "words", F.explode("seeds").alias("seed")).select("doc_id", "lo", "words", "seed.h", "seed.at")
    hit = hits.drop("words").join(seeds, "h").select("doc_id", "lo", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    lined = hit.join(places.select("doc_id", "lo", "words"), ["doc_id", "lo"]).join(words, "item_id")
    found = lined.mapInArrow(_verify, "doc_id long, item_id long, start long, matched long, item_words long")
    best = F.max(F.struct("matched", (-F.col("start")).alias("start"), "item_words")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.start")).alias("start"), "m.matched", "m.item_words")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))
