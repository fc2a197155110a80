"""Sequence packing by shortest-pack-first over the length histogram.

Documents become token ids; one longer than a sequence is cut into full
sequences and a rest.  Only the histogram of piece lengths (at most ``limit``
rows, whatever the corpus) reaches the driver, where packing patterns with
counts are made.  Pieces find their place by their rank among the pieces of
the same length, which is counted in hash buckets, so no length's pieces meet
in one task.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_view, compact_strings, load, lower_ascii, materialise, text_slices, word_bounds

LIMIT = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Hash buckets in which ranks are counted; the histogram table has at most BUCKETS * LIMIT rows.
BUCKETS = 512
_BLOCK = 4 << 20
_CACHE = 300_000
_tokenizers: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    """The tokenizer, ids of chunks met before, and, for byte pairs with an ending, one that cuts at white space alone, and which ids end a word."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer, models, pre_tokenizers

        tok = Tokenizer.from_file(path)
        plain, ends, suffix = None, None, isinstance(tok.model, models.BPE) and tok.model.end_of_word_suffix
        if suffix:
            plain = Tokenizer(tok.model)
            plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = tok.get_vocab(with_added_tokens=False)
            ends = np.zeros(max(vocab.values()) + 1, bool)
            ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        _tokenizers[path] = (tok, {}, plain, ends)
    return _tokenizers[path]


#: Lower-case letters of one code point that no normalisation changes: a run of them is one word, whatever stands around it.
_WORD = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _encoded(chunks: list[str], path: str) -> list[bytes]:
    """Ids of each chunk, alone.

    Chunks of plain letters are encoded in one call, without the patterns that cut and normalise others; an id that ends a
    word ends the chunk.
    """
    tok, _, plain, ends = _tokenizer(path)
    odd = [plain is None or not _WORD(c) for c in chunks]
    others = iter([array("I", e.ids).tobytes() for e in tok.encode_batch_fast([c for c, x in zip(chunks, odd, strict=True) if x], add_special_tokens=False)])
    runs = [c for c, x in zip(chunks, odd, strict=True) if not x]
    if not runs:
        return list(others)
    flat = np.array(plain.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
    hi = (4 * (np.flatnonzero(ends[flat]) + 1)).tolist()
    if len(hi) != len(runs) or hi[-1] != 4 * len(flat):
        raise RuntimeError("the tokenizer does not end each word")
    of_runs = map(flat.tobytes().__getitem__, map(slice, [0, *hi[:-1]], hi))
    return [next(others if x else of_runs) for x in odd]


def _chunk_ids(chunks: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks in one array and their number for each chunk.

    The tokenizer cuts at ASCII white space and between an ASCII letter and a mark, so a chunk's ids never depend on its
    neighbours.  Chunks met before come from a bounded store.
    """
    store = _tokenizer(path)[1]
    words = chunks.cast(pa.large_string()).to_pylist()
    new = [c for c in words if c not in store]
    if len(store) > _CACHE:  # what this slice holds stays
        held = {c: store[c] for c in words if c in store}
        store.clear()
        store.update(held)
    for at in range(0, len(new), 10_000):
        part = new[at : at + 10_000]
        store.update(zip(part, _encoded(part, path), strict=True))
    got = [store[c] for c in words]
    return np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) >> 2


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True


def encode_texts(texts: pa.Array, path: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and each text's start there (n + 1 offsets)."""
    buf, offs = byte_view(texts)
    if b"<|" not in buf.tobytes():  # the tokenizer lowers letters itself, but not those of its special strings
        buf = lower_ascii(buf)
    starts, ends, _ = word_bounds(buf, offs)
    cut = np.flatnonzero(_LETTER[buf[:-1]] & _MARK[buf[1:]]) + 1
    starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    first = np.searchsorted(starts, offs)
    coded = compact_strings(buf, starts, ends).dictionary_encode()
    flat, lens = _chunk_ids(coded.dictionary, path)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if end_id is not None:
        flat, lens = np.append(flat, np.uint32(end_id)), np.append(lens, 1)
        code = np.insert(code, first[1:], len(lens) - 1)
        first = first + np.arange(len(texts) + 1)
    base = np.concatenate(([0], np.cumsum(lens)))
    size = lens[code]
    at = np.concatenate(([0], np.cumsum(size)))
    return flat[np.arange(at[-1]) + np.repeat(base[code] - at[:-1], size)], at[first]


def _pieces(path: str, limit: int):
    def run(batches):
        for piece, texts in text_slices(batches, limit=_BLOCK):
            doc_ids = piece.column(0).to_numpy(zero_copy_only=False)
            ids, offs = encode_texts(texts, path)
            ids = ids.astype("<u4", copy=False)
            rows: list[tuple] = []
            for d, a, b in zip(doc_ids.tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                for at in range(a, b, limit):
                    to = min(b, at + limit)
                    rows.append((d, at - a, to - at, zlib.crc32(ids[at:to]), b - a))
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def shortest_pack_first(hist: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, count) from a histogram {length: count}.

    Lengths go longest first, each into the packs with the most room left (the shortest packs) that can still take one;
    packs without room enough start anew.  Work follows the number of distinct lengths and patterns, not of pieces.
    """
    open_: dict[int, list] = {}  # room -> [[pattern, count]]; a pattern is a tuple of (length, times)
    rooms: list[int] = []  # rooms that have packs, ascending
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if not room:
            done.append((pattern, n))
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([pattern, n])

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop()
                times = min(room // length, -(-left // n))
                full = min(n, left // times)
                if n > full:
                    put(room, pattern, n - full)
            else:
                room, pattern = limit, ()
                times = min(limit // length, left)
                full = left // times
            put(room - times * length, pattern + (length,) * times, full)
            left -= full * times
    return done + [(p, n) for packs in open_.values() for p, n in packs]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, times per sequence, offset) for each length of each pattern."""
    out, used, sequence = [], {}, 0
    for pattern, n in patterns:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            times = pattern.count(length)
            out.append((length, used.get(length, 0), n * times, sequence, times, at))
            used[length] = used.get(length, 0) + n * times
            at += length * times
        sequence += n
    return sorted(out)


def _place(table: np.ndarray):
    """Rank within a length -> sequence and offset; the table has a row for each length of each pattern."""
    key = table[:, 0] * (1 << 50) + table[:, 1]

    def run(batches):
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            row = table[np.searchsorted(key, length * (1 << 50) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 4], row[:, 5] + nth % row[:, 4] * length
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...); ``pieces`` is read twice."""
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(BUCKETS)).cast("int"))
    counts = pieces.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    table = np.array(slots(shortest_pack_first(hist, limit)), np.int64).reshape(-1, 6)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "start"))
    ranked = pieces.withColumn("own", own).join(before.select("bucket", "length", "before"), ["bucket", "length"])
    ranked = ranked.withColumn("rank", (F.col("own") - 1 + F.coalesce("before", F.lit(0))).cast("long")).drop("own", "before", "bucket")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(table), schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts hold the end id alone.  Rows without id are left out; other columns are ignored.  Rows that
    repeat an id are packed one by one; ties of (length, id, start) are interchangeable.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    pieces = docs.mapInArrow(_pieces(path or tokenizer_path(), limit), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    return pack(materialise(pieces), limit).withColumnRenamed("doc_id", id_col)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents", "doc_id", "text"))
