"""Document fingerprints by locally consistent parsing.

Each level cuts the text's symbols into phrases by deterministic coin tossing
and names every phrase by its content: runs of a symbol become one symbol,
neighbours then differ, each symbol is labelled by the lowest bit in which its
name differs from its left neighbour's (a few rounds bring the labels below
eight), and phrases start at local maxima of the labels.  A cut depends on a
few symbols around it, so equal substrings get equal phrases inside, wherever
they stand.

A fingerprint is the name of the whole text, and the smallest hashes among the
names of its phrases; likeness of two is the overlap of those.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_table, byte_view, load, mix, span_hashes, text_slices

LEVELS = 4
#: Levels whose names are sketched: phrases of about 12 and 40 bytes.
SKETCHED = (1, 2)
KEEP = 64
#: Ranges of ids that the order is cut into: one for so many rows, within these bounds.
ROWS_PER_RANGE = 4096
RANGES = 1000
MOST_RANGES = 20_000
_SLICE = 1 << 20
_M = np.uint64(0xFF51AFD7ED558CCD)


def _runs(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collapse runs of one symbol within a text; returns symbols and first positions (n + 1)."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[first[:-1][first[:-1] < len(x)]] = True
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(x)))
    with np.errstate(over="ignore"):
        out = np.where(size > 1, mix(x[at] + size.astype(np.uint64) * _M), x[at])
    return out, np.searchsorted(at, first)


def _low_bit(x: np.ndarray) -> np.ndarray:
    low = x & (~x + np.uint64(1))
    return np.where(x == 0, 0, np.log2(low.astype(np.float64), where=low > 0, out=np.zeros(len(x)))).astype(np.int64)


def coin_labels(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels below 8 in which neighbours of a text differ; head: mask of the texts' first symbols."""
    with np.errstate(over="ignore"):
        diff = x.copy()
        diff[1:] ^= x[:-1]
        bit = _low_bit(np.where(head, x, diff))
        lab = 2 * bit + ((x >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.int64)
    table = np.array([(a & -a).bit_length() - 1 if a else 0 for a in range(128)], np.int8)
    for _ in range(3):
        lab8 = lab.astype(np.uint8)
        prev = np.concatenate(([0], lab8[:-1])).astype(np.uint8)
        bit8 = table[np.where(head, lab8, lab8 ^ prev)]
        lab = 2 * bit8.astype(np.int64) + ((lab8 >> bit8.astype(np.uint8)) & 1)
    return lab


def parse(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases, and each text's first phrase (n + 1)."""
    if not len(x):
        return x, first
    x, first = _runs(x, first)
    head = np.zeros(len(x), bool)
    head[first[:-1][np.diff(first) > 0]] = True
    lab = coin_labels(x, head)
    left, right = np.concatenate(([-1], lab[:-1])), np.concatenate((lab[1:], [-1]))
    right[:-1][head[1:]] = -1  # a text's cuts never depend on the next one
    begin = head | ((lab > left) & (lab > right))
    begin[1:] &= ~head[:-1] | head[1:]  # no phrase of one symbol at a text's start
    at = np.flatnonzero(begin)
    ends = np.append(at[1:], len(x))
    with np.errstate(over="ignore"):
        names = mix(span_hashes(x, at, ends) + (ends - at).astype(np.uint64) * _M)
    return names, np.searchsorted(at, first)


def sketches(texts: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """The fingerprint of each text, and its sketch as ascending 32-bit numbers."""
    buf, offs = byte_view(texts)
    body = np.ones(len(buf), bool)
    body[offs[1:] - 1] = False
    x, first = byte_table(11)[buf[body]], offs - np.arange(len(offs))
    n = len(texts)
    doc_of, names_of = [], []
    with np.errstate(over="ignore"):
        for level in range(LEVELS):
            x, first = parse(x, first)
            if level in SKETCHED:
                doc_of.append(np.repeat(np.arange(n), np.diff(first)))
                names_of.append(mix(x + np.uint64(level + 1) * _M) >> np.uint64(32))
        root = mix(span_hashes(x, first[:-1], first[1:]) + np.diff(offs).astype(np.uint64) * _M)
    key = np.unique((np.concatenate(doc_of).astype(np.uint64) << np.uint64(32)) | np.concatenate(names_of))
    doc, low = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lo = np.searchsorted(doc, np.arange(n + 1))
    parts = [low[lo[i] : min(lo[i] + KEEP, lo[i + 1])] for i in range(n)]
    return [f"{r:016x}:{p.astype('>u4').tobytes().hex()}" for r, p in zip(root.tolist(), parts, strict=True)], parts


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard overlap of two sketches (exact where both hold all names); 1 for two without names."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    if len(a) < KEEP and len(b) < KEEP:
        return len(both) / (len(a) + len(b) - len(both))
    top = np.union1d(a, b)[:KEEP]
    return float(np.isin(both, top).sum()) / len(top)


def edited(text: str, after: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _with_next(batches):
    """Rows come by (bucket, halo, id descending); a bucket's last row is its halo, the next range's first document."""
    carry: list[tuple] = []

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (bucket, halo, doc_id, text); every row but the last has its next one behind it."""
        texts = [r[3] for r in rows]
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        prints, parts = sketches(pa.array([t.encode() for t in texts], pa.large_binary()))
        changed = [edited(texts[i], texts[i + 1]).encode() for i in own]
        prints2, parts2 = sketches(pa.array(changed, pa.large_binary())) if own else ([], [])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array([prints[i] for i in own], pa.string()), pa.array(prints2, pa.string()), pa.array([likeness(parts[i], p) for i, p in zip(own, parts2, strict=True)], pa.float64()),
                pa.array([likeness(parts[i], parts[i + 1]) for i in own], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for piece, texts in text_slices(batches, limit=_SLICE):
        rows = carry + list(zip(*(piece.column(c).to_pylist() for c in range(3)), (t.decode() for t in texts.to_pylist()), strict=True))
        carry = rows[-1:]
        if len(rows) > 1:
            yield emit(rows)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text), see the module's text; next: the row of the next smaller doc_id, or after
    the last the first.

    Null texts are empty.  Rows that repeat an id follow each other in the order of their texts; rows without id are left
    out; other columns are ignored.  A table of one row is its own next.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    n = min(MOST_RANGES, max(RANGES, docs.count() // ROWS_PER_RANGE))
    cuts = docs.agg(F.percentile_approx("doc_id", F.lit((np.arange(1, n) / n).tolist()), F.lit(20 * n)).alias("c")).first()["c"] or []
    edges = np.array(sorted(set(cuts)), np.int64)

    def ranges(batches):
        for b in batches:
            at = np.searchsorted(edges, b.column(0).to_numpy(), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns], ["bucket", *b.schema.names])

    tops = {r["bucket"]: r["top"] for r in docs.select("doc_id").mapInArrow(ranges, "bucket int, doc_id long").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}  # MOST_RANGES rows at most
    order = sorted(tops)
    halo_of = {tops[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}  # a range's first document also ends the range above; the very first ends the lowest

    def deal(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            at = np.searchsorted(edges, ids, side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(ids), np.int32)), *b.columns], ["bucket", "halo", *b.schema.names])
            first = [i for i, d in enumerate(ids.tolist()) if d in halo_of]
            if first:
                extra = b.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array([halo_of[d] for d in ids[first].tolist()], pa.int32()), pa.array(np.ones(len(first), np.int32)), *extra.columns], ["bucket", "halo", *b.schema.names])

    dealt = docs.mapInArrow(deal, "bucket int, halo int, doc_id long, text string").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "halo", F.desc("doc_id"), "text").mapInArrow(_with_next, _OUT)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents", "doc_id", "text"))
