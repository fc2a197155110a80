"""Quality scores from preference pairs (Bradley-Terry).

Each preferred document beats each other one with probability
sigmoid(score difference); scores are linear in features of the text, fitted by
logistic loss on feature differences.  The fit sees a bounded sample of
labelled rows; scoring covers every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, id_mod, load, lower_ascii, text_slices, word_bounds, word_hashes

#: Most labelled rows the fit sees, those of the smallest hash of their id; a sample, since the model has few weights.
MAX_ROWS = 20_000
PAIRS = 60_000
PREDICT_AT = 0.3
#: Hash groups of word shapes beside the plain measures.
GROUPS = 64
_BLOCK = 1 << 20


def _members(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = True
    return out


_KINDS = [
    _members(range(97, 123)), _members(range(65, 91)), _members("0123456789"), _members(range(128, 256)), _members(".,;:!?"), _members("#$%&*"),
    _members("|"), _members("-_=+~^"), _members("()[]{}<>"), _members("\"'`"), _members("/\\@"), _members("\n"), _members("\t\r\x0b\x0c"), _members(range(0, 9)),
]
N_FEATURES = 12 + len(_KINDS) + GROUPS


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of measures for each text: shares of kinds of characters, lengths, repetition, and hashed word shapes."""
    buf, offs = byte_view(texts)
    n = np.maximum(np.diff(offs) - 1, 0)
    out = np.zeros((len(n), N_FEATURES))
    for k, member in enumerate(_KINDS):
        run = np.concatenate(([0], np.cumsum(member[buf])))
        out[:, k] = np.sqrt(np.maximum(run[offs[1:]] - run[offs[:-1]] - (k == 11), 0) / np.maximum(n, 1))
    low = lower_ascii(buf)
    starts, ends, first = word_bounds(low, offs)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(n)), words)
    lens = (ends - starts).astype(float)
    sums = lambda x: np.bincount(doc, x, len(n))
    at = len(_KINDS)
    w = np.maximum(words, 1)
    mean = sums(lens) / w
    h = word_hashes(low, starts, ends)
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (np.diff(doc[order]) == 0) & (h[order][1:] == h[order][:-1])
    distinct = words - np.bincount(doc[order], same, len(n))
    pair = np.zeros(len(h), bool)
    pair[1:] = (h[1:] == h[:-1]) & (np.diff(doc) == 0)
    lines = np.add.reduceat((buf == 10).astype(np.int64), offs[:-1])
    odd = ~((low[starts] >= 97) & (low[starts] <= 122) | (low[starts] >= 128))
    tail = low[np.maximum(ends - 1, 0)]
    out[:, at : at + 12] = np.stack([
        np.log1p(n), np.log1p(words), mean / 10, np.sqrt(np.maximum(sums(lens * lens) / w - mean * mean, 0)) / 10, distinct / w, np.log1p(distinct),
        sums(pair) / w, np.log1p(words / lines), lines / w, sums(odd) / w, sums((tail == 46).astype(float)) / w, sums((lens > 25).astype(float)) / w,
    ], 1)
    size = np.minimum(lens, 15).astype(np.int64)
    group = (size * 1000003 + tail.astype(np.int64) * 7919 + low[starts].astype(np.int64) // 16 * 104729) % GROUPS if len(starts) else np.zeros(0, np.int64)
    np.add.at(out, (doc, at + 12 + group), 1.0 / w[doc])
    out[:, at + 12 :] = np.sqrt(out[:, at + 12 :])
    return out


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 7) -> dict:
    """Bradley-Terry weights from rows and 0/1 labels, with a calibration of scores to probabilities (both by Newton)."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if len(good) and len(bad):
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        for _ in range(12):  # maximise sum log sigmoid(d w)
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ p - ridge * w)
            w += step
            if np.abs(step).max() < 1e-5:
                break
    s = z @ w
    a, b = 1.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    design = np.stack([s, np.ones(len(s))], 1)
    for _ in range(30 if len(good) and len(bad) else 0):
        p = 1 / (1 + np.exp(-np.clip(design @ [a, b], -30, 30)))
        v = (p * (1 - p))[:, None]
        step = np.linalg.solve((design * v).T @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * np.array([a, b]))
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return {"mean": mean, "scale": scale, "w": w, "a": a, "b": b}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    s = np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(model["a"] * s + model["b"], -30, 30)))


def _features(batches):
    for piece, texts in text_slices(batches, limit=_BLOCK):
        x = text_features(texts)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("label")).cast(pa.int32()), rows], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> dict:
    """Fit on at most ``max_rows`` labelled documents (doc_id, text; doc_id, label).

    A document with several labels has their majority (ties: 1); null labels don't count.  Without both kinds of labels all
    texts get the labels' smoothed mean.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # max_rows ids bound what is broadcast below
    rows = docs.select("doc_id", "text").join(F.broadcast(one), "doc_id").select("text", "label")
    got = rows.mapInArrow(_features, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").combine_chunks().flatten().to_numpy()).reshape(-1, N_FEATURES) if got.num_rows else np.zeros((1, N_FEATURES))
    y = got.column("label").to_numpy() if got.num_rows else np.array([1])
    order = np.lexsort(np.concatenate((x.T[:8], y[None])))  # rows come in any order; the fit shall not depend on it
    return fit_pairs(x[order], y[order].astype(float))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Add ``score`` (0 to 1, higher is better) to every row; null and empty texts are texts of no words.

    A column named score is replaced; an empty table stays empty.
    """
    docs = docs.drop("score")

    def run(batches):
        for piece, texts in text_slices(batches, limit=_BLOCK):
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(predict(model, text_features(texts)))], [*piece.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double"
    return docs.mapInArrow(run, schema)


def keep_above_quantile(scored: DataFrame, share: float) -> DataFrame:
    """Rows whose score is at least the given quantile of all scores (0 keeps all)."""
    cut = scored.agg(F.percentile_approx("score", share, 100_000).alias("c")).first()["c"]
    return scored.where(F.col("score") >= cut) if cut is not None and share > 0 else scored


def learned_model(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> dict:
    """The model of op7: learnt only from rows whose crc32(doc_id) mod 5 is not 0."""
    return train(docs, labels.where(id_mod("doc_id", 5) != 0), label_col)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs, learned_model(docs, load(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", (id_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
