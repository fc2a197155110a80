"""Substring deduplication by relative Lempel-Ziv parsing over word windows.

The reference of a document is every document with a smaller id.  It is held as
an index of seeds: each run of ``window`` words, by hash, with the first
document that has it and its first place there; shards of that index are the
reference blocks.  A document is factored greedily from the left: a factor
starts at a seed that the index holds and goes on while the next seeds lie one
word further in the same source; at its end (the factor boundary) the next seed
is looked up anew.  Every factor is at least a window long, and the words of the
factors are those that go.

Only seeds that can repeat are looked up.  Each seed holds a minimiser (the
smallest hash of its runs of ``gram`` words), equal seeds hold equal ones, and
a minimiser that no second document has rules its seeds out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import anchors, as_long, byte_view, kgram_hashes, load, materialise, starts_inside, text_slices, word_bounds, word_hashes

WINDOW = 50
GRAM = 18
_SLICE = 1 << 20


def _marks(window: int, gram: int):
    """(h, doc_id): the minimisers of each text, once a slice and text."""

    def run(batches):
        for piece, texts in text_slices(batches, limit=_SLICE):
            buf, offs = byte_view(texts)
            starts, ends, first = word_bounds(buf, offs)
            grams = kgram_hashes(word_hashes(buf, starts, ends), gram)
            at, _ = anchors(grams, starts_inside(first, len(starts), window), window - gram + 1)
            if not len(at):
                continue
            doc = np.searchsorted(first, at, side="right") - 1
            order = np.lexsort((grams[at], doc))
            h, doc = grams[at][order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([as_long(h[new]), as_long(piece.column(0).to_numpy()[doc[new]])], ["h", "doc_id"])

    return run


def _seeds(window: int, gram: int, role: str):
    """(a, b, doc_id, at): two hashes of the distinct windows of each text whose minimiser is in its list of that role, and their first places; at is of use to givers alone."""

    def run(batches):
        for piece, texts in text_slices(batches, limit=_SLICE):
            buf, offs = byte_view(texts)
            starts, ends, first = word_bounds(buf, offs)
            h = word_hashes(buf, starts, ends)
            inside = starts_inside(first, len(starts), window)
            if not inside.any():
                continue
            _, low = anchors(kgram_hashes(h, gram), inside, window - gram + 1)
            at = np.flatnonzero(inside)
            doc = np.searchsorted(first, at, side="right") - 1
            live = piece.column(piece.schema.get_field_index(role))
            values, lo = live.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(live.value_lengths().to_numpy())))
            with np.errstate(over="ignore"):  # membership by text: the text's number is mixed into the hash
                salt = lambda d: d.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
                own = np.isin(low[at] ^ salt(doc), values ^ salt(np.repeat(np.arange(len(lo) - 1), np.diff(lo))))
            at, doc = at[own], doc[own]
            a = kgram_hashes(h, window)[at]
            order = np.lexsort((a, doc))  # stable: the first place leads
            new = np.ones(len(order), bool)
            new[1:] = (a[order[1:]] != a[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
            order = np.sort(order[new])
            at, doc, a = at[order], doc[order], a[order]
            b = (kgram_hashes(word_hashes(buf, starts, ends, 2), window)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([as_long(a), pa.array(b), as_long(piece.column(0).to_numpy()[doc]), pa.array((at - first[doc]).astype(np.int32))], ["a", "b", "doc_id", "at"])

    return run


def seeds_with_source(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(texts dealt out by doc_id, a row for each distinct window whose words start in a smaller id's text: doc_id, a, source, place)."""
    marks = materialise(docs.mapInArrow(_marks(window, gram), "h long, doc_id long"))
    shared = marks.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    # only a minimiser's later texts ask the index, and only its earlier ones are in it
    pick = lambda cond: F.collect_list(F.when(cond, F.col("h")))
    live = marks.join(shared, "h").groupBy("doc_id").agg(pick(F.col("doc_id") > F.col("lo")).alias("asks"), pick(F.col("doc_id") < F.col("hi")).alias("gives"))
    seeds = lambda role: docs.join(live, "doc_id").mapInArrow(_seeds(window, gram, role), "a long, b int, doc_id long, at int")
    index = seeds("gives").groupBy("a", "b").agg(F.min(F.struct("doc_id", "at")).alias("first")).select("a", "b", F.col("first.doc_id").alias("source"), F.col("first.at").alias("place"))
    return docs, seeds("asks").join(index, ["a", "b"]).where("source < doc_id").select("doc_id", "a", "source", "place")


def greedy_factors(at: np.ndarray, source: np.ndarray, place: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(first word, words, source, first word there): maximal runs of seeds that go on word by word in one source, from the left."""
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(place) != 1)) + 1
    lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
    return list(zip(at[lo].tolist(), (at[hi] - at[lo] + window).tolist(), source[lo].tolist(), place[lo].tolist(), strict=True))


def spread_seeds(h: np.ndarray, seeds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All places of a text (word hashes h) where windows with the hashes ``seeds`` stand, ascending, and which seed each is."""
    grams = kgram_hashes(h, window)
    order = np.argsort(seeds, kind="stable")
    value = seeds[order]
    near = np.minimum(np.searchsorted(value, grams), len(value) - 1)
    every = np.flatnonzero(value[near] == grams)
    return every, order[near[every]]


FACTORED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, factors array<struct<start:long, words:long, source:long, place:long>>"


def _factor(window: int, carries: bool):
    def run(batches):
        for piece, texts in text_slices(batches, limit=_SLICE):
            buf, offs = byte_view(texts)
            starts, ends, first = word_bounds(buf, offs)
            raw, n = buf.tobytes(), len(offs) - 1
            seeds = piece.column(piece.schema.get_field_index("seeds"))
            counts = np.nan_to_num(seeds.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = seeds.flatten()
            lo = np.concatenate(([0], np.cumsum(counts)))
            seed_all, source_all, place_all = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)) if len(flat) else (np.zeros(0, np.int64),) * 3
            h = word_hashes(buf, starts, ends) if len(flat) else None
            words = np.diff(first)
            removed, kept, digest, factors = np.zeros(n, np.int64), [], [], []
            for i in range(n):
                s, e = starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist()
                found = []
                stay = np.ones(len(s), bool)
                if lo[i] < lo[i + 1]:
                    at, which = spread_seeds(h[first[i] : first[i + 1]], seed_all[lo[i] : lo[i + 1]].view(np.uint64), window)
                    found = greedy_factors(at, source_all[lo[i] + which], place_all[lo[i] + which], window)
                    for a, size, *_ in found:
                        stay[a : a + size] = False
                    removed[i] = len(s) - stay.sum()
                factors.append(found)
                left = b" ".join([raw[x:y] for x, y, z in zip(s, e, stay.tolist(), strict=True) if z])
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left if removed[i] else raw[offs[i] : offs[i + 1] - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.column(0).to_numpy(zero_copy_only=False)), pa.array(words), pa.array(removed), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([[dict(zip(("start", "words", "source", "place"), x, strict=True)) for x in f] for f in factors], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "words", "source", "place")])))] + [piece.column(piece.schema.get_field_index("carried"))] * carries,
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "factors"] + ["carried"] * carries,
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, factors) of every row of ``docs`` (doc_id, text), and ``carried``: a struct of the columns named.

    A word goes if a window of ``window`` words over it also starts in a text of a smaller id.  Words are runs of bytes
    other than ASCII white space, unchanged; kept words are joined by one blank (``kept`` is the text itself if none goes).  Null and empty texts have no words; texts
    shorter than a window keep all.  Rows that repeat an id are one source, and all lose what a smaller id holds.  Rows
    without id are left out; other columns are ignored.  A very long text is handled whole in one task, with about 100 times
    its size there.
    """
    docs = docs.select("doc_id", "text", *([F.struct(*carry).alias("carried")] if carry else [])).where("doc_id is not null")
    _, hits = seeds_with_source(docs.select("doc_id", "text"), window, gram)
    found = hits.groupBy("doc_id").agg(F.collect_list(F.struct("a", "source", "place")).alias("seeds"))
    schema = FACTORED + (f", carried {docs.schema['carried'].dataType.simpleString()}" if carry else "")
    return docs.join(found, "doc_id", "left").mapInArrow(_factor(window, bool(carry)), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(load(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("factors").alias("n_factors"))
