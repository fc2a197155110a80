"""Token counts from distinct pre-tokens.

Where two neighbouring bytes stand side by side in no piece of the vocabulary,
no merge can cross (a blank after a letter, around a line feed, before most
punctuation).  Cutting there gives pre-tokens, and a text's token count is the
sum over its pre-tokens.  Each distinct
pre-token is counted once, and the counts are joined to the pre-tokens'
frequencies in the documents; ids of whole texts are never made.  Pre-tokens
that are pieces of the vocabulary (a fixed number) are joined within the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import POSTING_SCHEMA, block_id, byte_view, compact_strings, load, postings, singles, text_slices

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
_BLOCK = 20 << 20
_models: dict = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def joints(path: str) -> np.ndarray:
    """256 x 256: whether the two bytes stand side by side in some piece, or may belong to one character."""
    key = ("joints", path)
    if key not in _models:
        model, table = _model(path), np.zeros((256, 256), bool)
        table[:, 128:192] = True  # inside a character
        table[0x81, :] = True  # U+2581, the blank's own sign
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                b = np.frombuffer(model.id_to_piece(i).replace("\u2581", " ").encode(), np.uint8)
                table[b[:-1], b[1:]] = True
        table[:, 0xE2] |= table[:, 32]
        _models[key] = table
    return _models[key]


def pre_tokens(texts: pa.Array, path: str) -> tuple[pa.Array, np.ndarray]:
    """The keys of all texts' pre-tokens, and the text of each.

    A key is the pre-token without one leading blank, which the library puts before any text.  A pre-token inside a text
    that has no leading blank gets a line feed in front, as a sign that the blank's piece and that feed's don't count (a
    feed alone is a text's first byte, for feeds are always cut off).
    """
    buf, offs = byte_view(texts)
    begin = np.ones(len(buf), bool)
    begin[1:] = ~joints(path).ravel()[(buf[:-1].astype(np.uint16) << 8) | buf[1:]]
    begin[offs[:-1]] = begin[offs[1:] - 1] = True  # a text's first byte, and the separator after it
    edge = np.append(np.flatnonzero(begin), len(buf))
    starts, ends = edge[:-1], edge[1:]
    doc = np.searchsorted(offs, starts, side="right") - 1
    own = starts != offs[doc + 1] - 1  # not a separator
    starts, ends, doc = starts[own], ends[own], doc[own]
    inner = starts != offs[doc]
    blank = buf[starts] == 32
    bare = inner & ~blank
    starts = starts + (inner & blank) - bare
    return compact_strings(buf, starts, ends, (bare, 10)), doc


def count_keys(keys: list[str], path: str) -> np.ndarray:
    """Pieces of each key."""
    n = np.fromiter(map(len, _model(path).encode(keys, num_threads=1)), np.int64, len(keys))
    bare = np.fromiter((len(k) > 1 and k[0] == "\n" for k in keys), bool, len(keys))
    lone = np.fromiter((not k for k in keys), bool, len(keys))  # the key of a lone blank is empty
    return np.where(lone, 1, n - 2 * bare)


def piece_table(path: str) -> tuple[pa.Array, np.ndarray]:
    """Keys of the pre-tokens that look like a piece of the vocabulary, and their counts."""
    if ("pieces", path) not in _models:
        model = _model(path)
        pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        texts = [p.replace("\u2581", " ") for p in pieces]
        keys = sorted({t[1:] if t[0] == " " else "\n" + t for t in texts if t} | {"\n\n"})
        _models["pieces", path] = pa.array([k.encode() for k in keys], pa.large_binary()), count_keys(keys, path)
    return _models["pieces", path]


def _cut(path: str):
    """Postings of each slice's pre-tokens, and a row without key for each text with its id, bytes and pieces counted so far."""

    def run(batches):
        known, pieces = piece_table(path)
        names = ["key", "block", "docs", "doc_id", "n_bytes", "n"]
        for piece, texts in text_slices(batches, limit=_BLOCK):
            keys, doc = pre_tokens(texts, path)
            coded = keys.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
            of_key = np.where(at >= 0, pieces[at], 0)
            k = len(texts)
            done = np.bincount(doc, of_key[code], k).astype(np.int64)
            rest = np.flatnonzero(at < 0)
            new = np.full(len(at), -1)
            new[rest] = np.arange(len(rest))
            open_ = new[code] >= 0
            left = pa.DictionaryArray.from_arrays(pa.array(new[code[open_]].astype(np.int32)), coded.dictionary.take(pa.array(rest)))
            block = block_id(piece.column(0))
            words, blocks, docs = postings(left, doc[open_], block)
            zero = pa.array(np.zeros(len(words), np.int64))
            yield pa.RecordBatch.from_arrays([words, blocks, docs, zero, zero, zero], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.string()), pa.array(np.full(k, block, np.int64)), singles(k), piece.column(0).cast(pa.int64()), pc.binary_length(texts).cast(pa.int64()), pa.array(done)], names)

    return run


def _distinct(path: str):
    """The distinct keys of each block; a pre-token that repeats within a block leaves the task once."""

    def run(batches):
        known, _ = piece_table(path)
        for _, texts in text_slices(batches, limit=_BLOCK):
            keys = pre_tokens(texts, path)[0].unique()
            keys = keys.filter(pc.invert(pc.is_in(keys, value_set=known)))
            yield pa.RecordBatch.from_arrays([keys.cast(pa.binary()).cast(pa.string())], ["key"])

    return run


#: Postings that a task adds up before it hands their sums on.
_HELD = 1 << 21


def _summed(batches):
    """Rows (block, docs, n) to (block, docs, counts): the pieces of each text of a block, summed over the rows of a task."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush():
        block, doc, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((doc, block))
        block, doc, n = block[order], doc[order], n[order]
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        block, doc, n = block[at], doc[at], np.add.reduceat(n, at)
        head = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        offsets = pa.array(np.append(head, len(block)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(block[head]), pa.ListArray.from_arrays(offsets, pa.array(doc)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))], ["block", "docs", "counts"])

    for b in batches:
        if not b.num_rows:
            continue
        lens = b.column(1).value_lengths().to_numpy().astype(np.int64)
        held.append((np.repeat(b.column(0).to_numpy(), lens), b.column(1).flatten().to_numpy(), np.repeat(b.column(2).to_numpy(), lens)))
        size += int(lens.sum())
        if size >= _HELD:
            yield flush()
            size = 0
    if size:
        yield flush()


def _totals(batches):
    """Rows (block, docs, counts, doc_id, n_bytes) in order of the block to a row for each text; rows with an id are about one text each."""

    def total(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        lens = b.column(1).value_lengths().to_numpy().astype(np.int64)
        doc = b.column(1).flatten().to_numpy().astype(np.int64)
        own = np.repeat(b.column(3).is_valid().to_numpy(zero_copy_only=False), lens)
        k = int(doc.max()) + 1
        n = np.bincount(doc, b.column(2).flatten().to_numpy(), k)
        size = np.bincount(doc[own], np.repeat(b.column(4).to_numpy(), lens)[own], k)
        ids = np.zeros(k, np.int64)
        ids[doc[own]] = np.repeat(pc.fill_null(b.column(3), 0).to_numpy(), lens)[own]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size.astype(np.int64)), pa.array(n.astype(np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column(0).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != block[lo]:
                yield total(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield total(held)


def piece_counter(path: str):
    @F.pandas_udf("long")
    def count(keys: pd.Series) -> pd.Series:
        return pd.Series(count_keys(keys.tolist(), path))

    return count


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    Null and empty texts have 0 tokens.  Rows that repeat an id are summed under it, rows without id are left out;
    other columns are ignored.  A text longer than a slice is a slice of its own.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    path = path or model_path()
    counts = docs.mapInArrow(_distinct(path), "key string").distinct().select("key", piece_counter(path)("key").alias("n"))
    rows = docs.mapInArrow(_cut(path), f"{POSTING_SCHEMA}, doc_id long, n_bytes long, n long")
    zero = F.lit(0).cast("long")
    known = rows.where("key is not null").select("key", "block", "docs").join(counts, "key").select("block", "docs", "n").mapInArrow(_summed, "block long, docs array<smallint>, counts array<int>")
    known = known.select("block", "docs", "counts", F.lit(None).cast("long").alias("doc_id"), zero.alias("n_bytes"))
    own = rows.where("key is null").select("block", "docs", F.array(F.col("n").cast("int")).alias("counts"), "doc_id", "n_bytes")
    # sums are sent a block's texts at a time, and a block, of a fixed size, is dealt to one task
    by_text = known.unionByName(own).repartition("block").sortWithinPartitions("block").mapInArrow(_totals, "doc_id long, n_bytes long, n_tokens long")
    total = by_text.groupBy("doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return total.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents", "doc_id", "text"))
