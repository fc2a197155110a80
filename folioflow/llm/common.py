"""Helpers shared by the corpus operators.

Everything here works on one Arrow record batch at a time and is vectorised
over the bytes of the batch, so the cost per document is numpy/Arrow time, not
interpreter time.  Nothing here collects a table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
SLICE_BYTES = 1 << 20
U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15 | 1)


def load(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; that is set here only in local mode (tests, a single machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folioflow-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialised intermediate that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def id_mod(col: str, n: int):
    """crc32 of the id written as text, modulo n."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 15) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut record batches so that each piece holds about ``limit`` bytes of text and ``rows`` rows at most; null texts become empty.

    Yields (piece of the batch, its texts as a LargeBinary array).
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()), b"")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, base + limit, side="right"))))
            yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)
            lo = hi


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by one line feed, and where each text starts (n + 1 offsets)."""
    raw = texts.to_pylist()
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=offs[1:])
    return buf, offs


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (n + 1 offsets)."""
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space.view(np.int8)))
    edge += 1
    if len(buf) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, offs)


_tables: dict[tuple, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    key = ("pow", inverse)
    have = _tables.get(key)
    if have is None or len(have) < n:
        m = pow(int(_MULT), -1, 1 << 64) if inverse else int(_MULT)
        out = np.full(max(n, 1 << 20), m, U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(out)
        if len(have) <= SLICE_BYTES * 2:
            _tables[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def byte_table(seed: int) -> np.ndarray:
    key = ("bytes", seed)
    if key not in _tables:
        _tables[key] = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
    return _tables[key]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end] for many spans at once (prefix sums modulo 2**64)."""
    n = len(values)
    pre = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values * _powers(n), out=pre[1:])
        return (pre[ends] - pre[starts]) * _powers(n + 1, True)[starts]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    h = span_hashes(byte_table(seed)[buf], starts, ends)
    with np.errstate(over="ignore"):
        return mix(h + (ends - starts).astype(U64) * _MULT)


def kgram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive items, one per start; positions whose gram crosses a text are masked by the caller."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    at = np.arange(n)
    return mix(span_hashes(h, at, at + k))


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over every window of w items, by doubling."""
    if len(x) < w:
        return x[:0]
    done = 1
    while done * 2 <= w:
        x = op(x[: len(x) - done], x[done:])
        done *= 2
    return x if done == w else op(x[: len(x) - (w - done)], x[w - done :])


def starts_inside(first: np.ndarray, n_items: int, k: int) -> np.ndarray:
    """Mask over item positions 0..n_items-k: the k items from there lie in one text (first: n + 1 offsets of items)."""
    if n_items < k:
        return np.zeros(0, bool)
    ok = np.ones(n_items - k + 1, bool)
    for j in range(1, k):  # a start less than k before a text's end crosses it
        at = first[1:-1] - j
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def anchors(grams: np.ndarray, inside: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers: of each window of w grams that starts where ``inside``, the smallest gram hash.

    Returns (positions of all grams that are the smallest of some window, smallest hash per window).
    """
    low = sliding(np.minimum, grams, w)[: len(inside)]
    held = np.where(inside[: len(low)], low, U64(0))
    padded = np.concatenate((np.zeros(w - 1, U64), held, np.zeros(w - 1, U64)))
    best = sliding(np.maximum, padded, w)[: len(grams)]
    return np.flatnonzero((best == grams[: len(best)]) & (best > 0)), low


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64, copy=False), pa.int64())


def long_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), as_long(values))


def compact_strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first_byte: tuple[np.ndarray, int] | None = None) -> pa.Array:
    """The byte spans as one LargeBinary array, without a Python loop; first_byte: (mask of spans, what their first byte becomes)."""
    lens = ends - starts
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    data = np.empty(offs[-1], np.uint8)
    for lo in range(0, len(lens), 1 << 18):  # positions take eight times the bytes they point at
        hi = min(len(lens), lo + (1 << 18))
        a, b = offs[lo], offs[hi]
        data[a:b] = buf[np.arange(a, b) + np.repeat(starts[lo:hi] - offs[lo:hi], lens[lo:hi])]
    if first_byte:
        data[offs[:-1][first_byte[0]]] = first_byte[1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offs), pa.py_buffer(data)])


#: Bits of the filter that keeps rows from a shuffle they would not survive; a fixed size, whatever the tables.
FILTER_BITS = 1 << 24


def _slots(ids: pa.Array) -> np.ndarray:
    return (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(U64)) % U64(FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the ids in the one column of ``ids``: FILTER_BITS / 8 bytes at most reach the driver."""

    def run(batches):
        for b in batches:
            slot = _slots(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> 3).astype(np.int32)), pa.array(np.left_shift(1, slot & 7).astype(np.int32))], ["byte", "bits"])

    bits = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in ids.mapInArrow(run, "byte int, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        bits[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return bits


def passing(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """Rows whose first column may be among the filter's ids (all that are, and few others)."""
    slot = _slots(batch.column(0))
    return batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))


def block_id(ids: pa.Array) -> int:
    """A number for a slice of texts with these ids: the same wherever the slice is read again.

    Slices of the same ids share it; their n-th texts have the same id then, so sums by (block, n) still belong to it.
    """
    digest = hashlib.blake2b(np.ascontiguousarray(ids.to_numpy(zero_copy_only=False)).tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def postings(keys: pa.Array, doc_of_key: np.ndarray, block: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Invert the keys of one slice: each distinct key, the slice's number, and its texts' numbers within the slice.

    A text that holds a key several times is listed as often, in a row, which compresses to nothing.
    """
    coded = keys if pa.types.is_dictionary(keys.type) else keys.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    at = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    docs = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(doc_of_key[order].astype(np.int16)))
    n = len(coded.dictionary)
    return coded.dictionary.cast(pa.binary()).cast(pa.string()), pa.array(np.full(n, block, np.int64)), docs


def singles(n: int) -> pa.Array:
    """Lists [0], [1], ... [n - 1] of text numbers, for rows about one text each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int16)))


POSTING_SCHEMA = "key string, block long, docs array<smallint>"
