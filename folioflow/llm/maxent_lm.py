"""Hashed maximum-entropy language model with a class-factored softmax.

log P(text) = sum over tokens of log P(class | history) + log P(word | class).
A word's class follows from its characters, or is its own if the word is among
the most frequent ones.

P(class | history) is a maximum-entropy model.  Its features are hashed n-grams
and skips of the classes before (few, trained first by distributed gradient
steps on the counts of all training tokens' histories), and the words before:
the last one (n-gram) and the one before that (skip).  The words' weights are a
table dealt out by word that grows with the corpus.  Each block of training
texts sends, for each of its words, how often it stood before which history
and class; their sums over all blocks give both sides of the gradient, observed
and expected counts, exactly, and the update is made where the word was dealt
to.  So weights and scores don't depend on how the texts are cut into blocks.
To score, a block's words are joined to the table, and the weights that come
back are added to the logits and normalised over all classes, a few thousand
tokens at a time.

P(word | class) is a softmax with one weight a word, whose optimum is the
smoothed count; a slot for unseen words in each class makes the model sum to
one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, compact_strings, discard, id_mod, load, lower_ascii, materialise, mix, text_slices, word_bounds

#: Classes: 0 is the end, then the most frequent words, then 32 shapes.
TOP = 31
#: Words that each block sends when the most frequent ones are sought.
OF_BLOCK = 512
CLASSES = 1 + TOP + 32
#: Hashed features of a history.
FEATURES = 1 << 13
STEPS = 12
#: Tasks of a training step; the counts they read have a fixed bound.
TASKS = 8
#: Bytes of text in a block, and tokens whose logits are held at a time.
_BLOCK = 16 << 20
_TOKENS = 1 << 14
#: Rows of word counts that are taken apart at a time.
_ROWS = 1 << 11
END = ""
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_ALPHA = _HIGH.copy()
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouy"]] = True


def shape(words: pa.Array) -> np.ndarray:
    """One of 32 shapes of each word, from its length, last byte and bytes beyond ASCII."""
    offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    buf = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
    lens = np.diff(offs)
    total = np.concatenate(([0], np.cumsum(_HIGH[buf]))) if len(buf) else np.zeros(1, np.int64)
    high = (total[offs[1:]] - total[offs[:-1]]) > 0 if len(buf) else np.zeros(len(words), bool)
    last = buf[np.maximum(offs[1:] - 1, 0)] if len(buf) else np.zeros(len(words), np.uint8)
    tail = np.where(_ALPHA[last], np.where(_VOWEL[last], 0, 1), np.where((last == 46) | (last == 44), 2, 3))
    return (tail * 8 + high * 4 + np.digitize(lens, [4, 7, 11])).astype(np.int64)


def classes(words: pa.Array, top: list[str]) -> np.ndarray:
    own = pa.array([END.encode(), *(w.encode() for w in top)], pa.large_binary())
    at = pa.compute.index_in(words, value_set=own)
    at = pa.compute.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(at >= 0, at, 1 + TOP + shape(words)).astype(np.uint8)


def tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words, each text's followed by one end, as a dictionary array, and each text's first token (n + 1).

    Words are cut in slices, since their bounds take several times the bytes of the texts.
    """
    parts, firsts, n = [], [np.zeros(1, np.int64)], 0
    for _, piece in text_slices([pa.RecordBatch.from_arrays([texts], ["text"])]):
        buf, offs = byte_view(piece)
        buf = lower_ascii(buf)
        starts, ends, first = word_bounds(buf, offs)
        narrow = np.int32 if len(buf) < 1 << 31 else np.int64
        starts, ends = (np.insert(x.astype(narrow), first[1:], 0) for x in (starts, ends))
        parts.append(compact_strings(buf, starts, ends))
        firsts.append(first[1:] + np.arange(1, len(first)) + n)
        n += len(starts)
    return pa.concat_arrays(parts or [pa.array([], pa.large_binary())]).dictionary_encode(), np.concatenate(firsts)


def _depth(first: np.ndarray, n: int) -> np.ndarray:
    """How many tokens stand before each one in its text, 3 at most."""
    out = np.full(n, 3, np.uint8)
    for back in (0, 1, 2):
        at = first[:-1] + back
        out[at[at < first[1:]]] = back
    return out


def history(cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(class before, the one before that, a group of the third) as one number for each token; 0 where a text begins."""
    out, depth = np.zeros(len(cls), np.uint16), _depth(first, len(cls))
    for back, factor in ((1, CLASSES * 16), (2, 16), (3, 1)):
        prev = np.zeros(len(cls), np.uint16)
        prev[back:] = cls[:-back] if back < 3 else cls[:-back] % 16
        prev[depth < back] = 0
        out += prev * np.uint16(factor)
    return out


HISTORIES = CLASSES * CLASSES * 16


def features(hist: np.ndarray) -> np.ndarray:
    """Hashed features of histories: bias, bigram, trigram, two skips and a skip bigram; shape (n, 6)."""
    hist = hist.astype(np.int64)
    one, two, three = hist // (CLASSES * 16), hist // 16 % CLASSES, hist % 16
    raw = [np.zeros_like(hist), 1 + one, (1 << 12) + one * CLASSES + two, (1 << 20) + two, (1 << 21) + three, (1 << 22) + one * 16 + three]
    return np.stack([(mix(r.astype(np.uint64)) % np.uint64(FEATURES)).astype(np.int64) for r in raw], 1)


def log_probs(weights: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Natural log P(class | history), a row for each history."""
    z = weights[features(hist)].sum(1)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _frequent(limit: int | None):
    """The most frequent words of each block with their counts there (all for no limit); a null word has the most that another may count."""

    def run(batches):
        for _, texts in text_slices(batches, limit=_BLOCK):
            coded, _ = tokens(texts)
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
            most = np.argsort(-n, kind="stable")[:limit]
            rest = int(n[most[-1]]) if len(most) < len(n) else 0
            keys = pa.concat_arrays([coded.dictionary.take(pa.array(most)).cast(pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.append(n[most], rest))], ["key", "n"])

    return run


def frequent_words(texts: DataFrame, k: int = TOP, of_block: int = OF_BLOCK) -> list[str]:
    """The k most frequent words (ties by word) by their counts in all texts.

    Each block sends its most frequent words and a bound for the others.  Counts of words that every block sent are exact.
    If one of the k is not exact, or a word that is not exact could still count as much as the last of the k, all words are
    counted.  ``of_block`` words reach the driver.
    """

    def counted(limit: int | None) -> DataFrame:
        rows = texts.mapInArrow(_frequent(limit), "key string, n long").where(F.col("key").isNull() | (F.col("key") != END))
        return rows.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))

    most = max(k + 1, of_block)
    first = counted(of_block).orderBy(F.col("key").isNull().desc(), F.desc("n"), "key").limit(1 + most).collect()
    bound, blocks = (first[0]["n"], first[0]["blocks"]) if first else (0, 0)
    words = first[1:]
    if not _sure([(r["n"], r["blocks"] == blocks) for r in words], k, bound, most):
        words = counted(None).where("key is not null").orderBy(F.desc("n"), "key").limit(k).collect()
    return [r["key"] for r in words[:k]]


def _sure(words: list[tuple[int, bool]], k: int, bound: int, most: int) -> bool:
    """Whether the first k of ``words`` (count so far, exact), by falling count, are the most frequent of all; ``most``: of how many at least these are the first."""
    if bound == 0:
        return True
    if len(words) <= k or not all(exact for _, exact in words[:k]):
        return False
    # words that come after these, or that no block sent, have the last one's count at most
    rest = [n for n, exact in words[k:] if not exact] + [words[-1][0] if len(words) >= most else 0]
    return max(rest) + bound < words[k - 1][0]


def _class_counts(top: list[str]):
    def run(batches):
        for _, texts in text_slices(batches, limit=_BLOCK):
            coded, first = tokens(texts)
            cls = classes(coded.dictionary, top)[coded.indices.to_numpy()]
            n = np.bincount(history(cls, first).astype(np.int32) * CLASSES + cls)
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell].astype(np.int64))], ["cell", "n"])

    return run


def _gradient(weights: np.ndarray):
    """Gradient and curvature by feature over the histories of one task; the row of feature -1 has the loss."""

    def run(batches):
        grad, curve = np.zeros((FEATURES, CLASSES), np.float32), np.zeros((FEATURES, CLASSES), np.float32)
        loss = 0.0
        for b in batches:
            cell, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(float)
            order = np.argsort(cell, kind="stable")
            cell, n = cell[order], n[order]
            hist, start = np.unique(cell // CLASSES, return_index=True)
            start = np.append(start, len(cell))
            for lo in range(0, len(hist), 2048):
                h = hist[lo : lo + 2048]
                part = slice(start[lo], start[lo + len(h)])
                seen = np.zeros((len(h), CLASSES))
                np.add.at(seen, (np.searchsorted(h, cell[part] // CLASSES), cell[part] % CLASSES), n[part])
                lp = log_probs(weights, h)
                p, total = np.exp(lp), seen.sum(1, keepdims=True)
                loss -= float((seen * lp).sum())
                g, c = seen - total * p, total * p * (1 - p)
                for f in features(h).T:
                    order = np.argsort(f, kind="stable")
                    used, at = np.unique(f[order], return_index=True)
                    grad[used] += np.add.reduceat(g[order], at)
                    curve[used] += np.add.reduceat(c[order], at)
        used = np.flatnonzero(curve.any(1))
        rows = [[-1, np.float32(loss).tobytes(), b""]] + [[int(f), grad[f].tobytes(), curve[f].tobytes()] for f in used]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["feature", "g", "h"])

    return run


def train(stats: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Weights (FEATURES, CLASSES) by distributed gradient steps, scaled by the curvature's diagonal.

    stats: (cell, n), at most HISTORIES * CLASSES rows in TASKS partitions, whatever the corpus; each task hands the driver at
    most FEATURES rows a step.  A step that raises the loss is taken back and the rate halved.
    """
    weights = np.zeros((FEATURES, CLASSES))
    best, best_loss, rate = weights, np.inf, 0.5
    for _ in range(steps + 1):
        g, h, loss = np.zeros((FEATURES, CLASSES)), np.zeros((FEATURES, CLASSES)), 0.0
        for r in stats.mapInArrow(_gradient(weights), "feature long, g binary, h binary").toArrow().to_pylist():
            if r["feature"] < 0:
                loss += float(np.frombuffer(r["g"], np.float32)[0])
            else:
                g[r["feature"]] += np.frombuffer(r["g"], np.float32)
                h[r["feature"]] += np.frombuffer(r["h"], np.float32)
        if loss < best_loss:
            best, best_loss, kept = weights, loss, (g, h)
        else:
            rate /= 2
        g, h = kept
        weights = best + np.clip(rate * (g - 0.05 * best) / (h + 2.0), -1.0, 1.0)
    return best


_tables: dict[bytes, np.ndarray] = {}


def _base_table(weights: np.ndarray) -> np.ndarray:
    """log P(class | history) of the class features for every history; kept while a worker lives."""
    key = hashlib.blake2b(weights.tobytes(), digest_size=16).digest()
    if key not in _tables:
        _tables.clear()
        _tables[key] = np.concatenate([log_probs(weights, np.arange(lo, lo + 8192)).astype(np.float32) for lo in range(0, HISTORIES, 8192)])
    return _tables[key]


def word_sides(code: np.ndarray, first: np.ndarray, end: int) -> Iterator[np.ndarray]:
    """The words that a token's class depends on: the one before (n-gram) and the one before that (skip); ``end`` where a text begins."""
    depth = _depth(first, len(code))
    for back in (1, 2):
        side = np.roll(code, back)
        side[depth < back] = end
        yield side


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal items begins."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def _end_code(words: pa.Array) -> int:
    return pa.compute.index(words, pa.scalar(END.encode(), pa.large_binary())).as_py()


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Items offsets[i]:offsets[i + 1] of ``values`` as the bytes of row i."""
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column in a row, and how many each row has (null: none)."""
    column = pa.compute.fill_null(column, b"").cast(pa.large_binary())
    lens = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(dtype).itemsize
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(dtype) if data and len(offs) > 1 and offs[-1] > offs[0] else np.zeros(0, dtype), lens


#: n: a word's tokens in the block.  once, twice: how many codes of the first and of the second feature stand once there.
#: codes: these codes, then the others with their counts, in two bytes each.
WORD_STATS = "key string, n long, once int, twice int, codes binary"
#: A word feature's class (64 times the feature's kind plus the class) and its weight in steps of 1 / STEP.
_WEIGHTS = np.dtype([("code", "u1"), ("weight", "i1")])
_OFTEN = np.dtype([("code", "<u4"), ("n", "<u4")])
STEP = 32
_THIRDS = 16


def rest_of_history(hist: np.ndarray, kind: int) -> np.ndarray:
    """What a history holds besides the class of the word that feature ``kind`` (0: the word before, 1: the one before that) is about."""
    return hist % (CLASSES * _THIRDS) if kind == 0 else hist // (CLASSES * _THIRDS) * _THIRDS + hist % _THIRDS


def whole_history(rest: np.ndarray, kind: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The history again, from its rest and the word's class."""
    return np.where(kind == 0, cls * (CLASSES * _THIRDS) + rest, rest // _THIRDS * (CLASSES * _THIRDS) + cls * _THIRDS + rest % _THIRDS)


def _word_stats(top: list[str]):
    """How often each word of a block of training texts stood before each history and class: a row for each of its words.

    A code is 64 times the rest of the history plus the class of the token that follows; two bytes.
    """

    def run(batches):
        for _, texts in text_slices(batches, limit=_BLOCK):
            coded, first = tokens(texts)
            code, n_words = coded.indices.to_numpy(), len(coded.dictionary)
            cls = classes(coded.dictionary, top)[code]
            hist = history(cls, first)
            parts = []  # of each feature: codes that stand once, then the others, by word
            for kind, f in enumerate(word_sides(code, first, _end_code(coded.dictionary))):
                f = f.astype(np.int64) << 16
                f |= rest_of_history(hist, kind).astype(np.int64) * CLASSES + cls
                f.sort()
                at = _starts(f)
                n = np.diff(np.append(at, len(f))).astype(np.uint32)
                f = f[at]
                rare = n == 1
                parts.append((f[rare], None))
                often = np.empty(len(f) - len(parts[-1][0]), _OFTEN)
                often["code"], often["n"] = (f[~rare] & 0xFFFF) | kind << 16, n[~rare]
                parts.append(((f >> 16)[~rare], often))
                del f, at, n, rare
            # a word's row has its codes that stand once, by feature, then the others; in units of two bytes
            parts = [parts[0], parts[2], parts[1], parts[3]]
            sizes = [np.bincount(x >> 16 if often is None else x, minlength=n_words) * (1 if often is None else 4) for x, often in parts]
            size, (once, twice) = sum(sizes), (x.astype(np.int32) for x in sizes[:2])
            flat, place = np.empty(int(size.sum()), np.uint16), np.cumsum(size) - size
            for (x, often), n in zip(parts, sizes, strict=True):
                units = 1 if often is None else 4
                word = x >> 16 if often is None else x
                to = np.arange(len(word)) * units + np.repeat(place - np.cumsum(n) + n, n // units)
                if often is None:
                    flat[to] = x & 0xFFFF
                else:
                    for k, column in enumerate(often.view(np.uint16).reshape(-1, 4).T):
                        flat[to + k] = column
                place = place + n
            del parts
            count = np.bincount(code, minlength=n_words).astype(np.int64)
            keys = coded.dictionary.cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.array(count), pa.array(once), pa.array(twice), _packed(flat, np.concatenate(([0], np.cumsum(size))))], ["key", "n", "once", "twice", "codes"])

    return run


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, kind << 16 | code, and count of every item of rows of WORD_STATS."""
    flat, size = _flat(b.column(4), np.uint16)
    once, twice = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
    rows, start = np.arange(b.num_rows), np.cumsum(size) - size
    rare, often = once + twice, (size - once - twice) // 4
    within = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    nth = within(rare)
    singles = flat[np.repeat(start, rare) + nth].astype(np.int64) | ((nth >= np.repeat(once, rare)).astype(np.int64) << 16)
    at = np.repeat(start + rare, often) + 4 * within(often)
    more = flat[(at[:, None] + np.arange(4)).ravel()].view(_OFTEN) if len(at) else np.zeros(0, _OFTEN)
    return np.concatenate((np.repeat(rows, rare), np.repeat(rows, often))), np.concatenate((singles, more["code"].astype(np.int64))), np.concatenate((np.ones(len(singles), np.int64), more["n"].astype(np.int64)))


def step(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Half a scaled gradient step of iterative scaling (two word features are active at a time), drawn to zero by one count on either side."""
    return 0.5 * np.log((seen + 1.0) / (expected + 1.0))


def _sum_by(ident: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers (below 2 ** 32) in order, and the sums of what belongs to each (below 2 ** 31)."""
    both = ident << 31 | n
    both.sort()
    ident, n = both >> 31, both & 0x7FFFFFFF
    at = _starts(ident)
    return ident[at], np.add.reduceat(n, at) if len(at) else n[:0]


def _expected(prob: np.ndarray, hist: np.ndarray, times: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Sums of the probabilities after each history, so many times: a row for each of the runs that begin at ``head``."""
    rows = np.take(prob, hist, 0)
    rows *= times.astype(np.float32)[:, None]
    return np.add.reduceat(rows, head) if len(head) else np.zeros((0, CLASSES), np.float32)


def _word_weights(weights: np.ndarray, top: list[str]):
    """Rows of _word_stats sorted by key to one row a word: its count, and its weights by class, without those that round to zero.

    Counts of all blocks are added before anything is computed from them, and a feature's histories are added up in order,
    so that the sums are the same to the last bit however rows come.
    """

    def weighed(prob, keys, n, ident, seen):
        """ident: word << 17 | kind << 16 | rest of the history and class, in order."""
        own = classes(pa.array(keys, pa.string()).cast(pa.binary()).cast(pa.large_binary()), top).astype(np.int64)
        new = _starts(ident >> 16)  # features: a word and a kind
        feature = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(ident))))
        side = ident[new] >> 16
        cell = feature * CLASSES + ident % CLASSES
        total = np.bincount(cell, seen, len(new) * CLASSES)  # observed counts by feature and class
        at = _starts(ident // CLASSES)
        times, before = np.add.reduceat(seen, at), ident[at] // CLASSES  # by feature and rest of the history
        of = feature[at]
        hist = whole_history(before & 1023, (before >> 10) & 1, own[before >> 11])
        head = _starts(of)
        edge = np.append(head, len(of))
        expected, lo = np.empty((len(new), CLASSES), np.float32), 0
        while lo < len(new):  # whole features, about so many histories at a time
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + _TOKENS, side="right")) - 1)
            part = slice(edge[lo], edge[hi])
            expected[lo:hi] = _expected(prob, hist[part], times[part], head[lo:hi] - edge[lo])
            lo = hi
        pair = np.flatnonzero(total)
        w = np.clip(np.rint(step(total[pair], expected.ravel()[pair].astype(float)) * STEP), -127, 127).astype(np.int8)
        pair, w = pair[w != 0], w[w != 0]
        items = np.empty(len(w), _WEIGHTS)
        of_pair = side[pair // CLASSES]
        items["code"], items["weight"] = (of_pair & 1) * CLASSES + pair % CLASSES, w
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64()), _packed(items, np.searchsorted(of_pair >> 1, np.arange(len(keys) + 1)))], ["key", "n", "weights"])

    def run(batches):
        prob = np.exp(_base_table(weights))
        held = None  # the last word so far: key, count, its items and their counts
        for b in (b.slice(lo, _ROWS) for b in batches for lo in range(0, b.num_rows, _ROWS)):  # items take about 20 times the bytes of their codes
            keys = b.column(0)
            new = np.ones(b.num_rows, bool)
            new[1:] = pa.compute.not_equal(keys.slice(1), keys.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            head = np.flatnonzero(new)
            names = keys.take(pa.array(head)).to_pylist()
            row, code, seen = _unpacked(b)
            ident = (np.cumsum(new) - 1)[row] << 17 | code
            n = np.add.reduceat(b.column(1).to_numpy(), head)
            if held and held[0] == names[0]:
                ident, seen = np.concatenate((held[2], ident)), np.concatenate((held[3], seen))
                n[0] += held[1]
            elif held:
                yield weighed(prob, [held[0]], [held[1]], held[2], held[3])
            ident, seen = _sum_by(ident, seen)
            last = len(head) - 1
            cut = np.searchsorted(ident, last << 17)
            if last:
                yield weighed(prob, names[:-1], n[:-1], ident[:cut], seen[:cut])
            held = (names[-1], int(n[-1]), ident[cut:] - (last << 17), seen[cut:])
        if held:
            yield weighed(prob, [held[0]], [held[1]], held[2], held[3])

    return run


BLOCKS = "block long, at int, key string, data binary"


def _blocks(top: list[str]):
    """Each block of texts as one row of word numbers (at: minus the number of its words) and a row for each of its words.

    Words are numbered by falling frequency and their numbers' bytes kept apart, so that most of them are zero.
    """

    def run(batches):
        for piece, texts in text_slices(batches, limit=_BLOCK):
            coded, first = tokens(texts)
            n = len(coded.dictionary)
            order = np.argsort(-np.bincount(coded.indices.to_numpy(), minlength=n), kind="stable")
            rank = np.empty(n, np.uint32)
            rank[order] = np.arange(n, dtype=np.uint32)
            code, words, ids = rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order)), piece.column(0).to_numpy().astype(np.int64)
            planes = np.ascontiguousarray(code.view(np.uint8).reshape(-1, 4).T)
            sizes = np.array([len(ids), len(code), n, _end_code(words)], np.int64)
            data = b"".join(x.tobytes() for x in (sizes, ids, first.astype(np.int64), planes, classes(words, top).astype(np.uint8)))
            digest = hashlib.blake2b(data, digest_size=8)
            for x in words.buffers()[1:]:
                digest.update(x or b"")
            block = int.from_bytes(digest.digest(), "little", signed=True)
            names = ["block", "at", "key", "data"]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-n], pa.int32()), pa.nulls(1, pa.string()), pa.array([data], pa.binary())], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), words.cast(pa.binary()).cast(pa.string()), pa.nulls(n, pa.binary())], names)

    return run


def _unblocked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids, first tokens (n + 1), word numbers, words' classes and the end's number of a block's row."""
    n, n_tokens, n_words, end = np.frombuffer(data, np.int64, 4).tolist()
    ids, first = np.frombuffer(data, np.int64, n, 32), np.frombuffer(data, np.int64, n + 1, 32 + 8 * n)
    planes = np.frombuffer(data, np.uint8, 4 * n_tokens, 40 + 16 * n).reshape(4, -1)
    of_word = np.frombuffer(data, np.uint8, n_words, 40 + 16 * n + 4 * n_tokens)
    return ids, first, np.ascontiguousarray(planes.T).view(np.int32).ravel(), of_word, end


def _whole_blocks(batches):
    """Groups the rows of sorted batches by block."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column(0).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != block[lo]:
                whole, held = pa.Table.from_batches(held).combine_chunks().to_batches()[0], []
                yield whole
            held.append(b.slice(lo, hi - lo))
    if held:
        whole, held = pa.Table.from_batches(held).combine_chunks().to_batches()[0], []
        yield whole


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(weights: np.ndarray, room: np.ndarray, n_all: int, v_all: int):
    """Scores blocks: rows of _blocks (block, at, count, data or weights), sorted by block and place."""

    def run(batches):
        for b in _whole_blocks(batches):
            table, (room_z, room_more) = _base_table(weights), np.empty((2, _TOKENS, CLASSES), np.float32)
            at = b.column(1).to_numpy()
            heads = np.flatnonzero(at < 0)
            b_words = b.slice(len(heads))
            place, keep = np.unique(b_words.column(1).to_numpy(), return_index=True)  # a block that occurs twice has each word twice
            if len(keep) < b_words.num_rows:
                b_words = b_words.take(pa.array(keep))
            if -at[heads[0]] != len(place):
                raise RuntimeError("a block's words are not those it was cut into")
            ids, first, code, of_word, end = _unblocked(b.column(3)[int(heads[0])].as_py())
            count = pa.compute.fill_null(b_words.column(2), 0).to_numpy(zero_copy_only=False).astype(float)
            base, own = np.log10((count + 0.5) / (n_all + 0.5 * (v_all + 1))), np.log10((count + 0.5) / room[of_word])
            items, lens = _flat(b_words.column(3), _WEIGHTS)
            start = np.concatenate(([0], np.cumsum(lens)))

            def added(used, kind):
                """Weights of the words ``used`` as rows of all classes."""
                n = lens[used]
                item = np.arange(n.sum()) + np.repeat(start[used] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                row, c, w = np.repeat(np.arange(len(used)), n), items["code"][item], items["weight"][item]
                mine = c // CLASSES == kind
                out = np.zeros((len(used), CLASSES), np.float32)
                out[row[mine], c[mine] % CLASSES] = w[mine] / np.float32(STEP)
                return out

            cls = of_word[code]
            hist, sides = history(cls, first), list(word_sides(code, first, end))
            order, local = np.argsort(sides[0]), np.zeros(len(code))
            for lo in range(0, len(order), _TOKENS):
                part = order[lo : lo + _TOKENS]
                before = sides[0][part]  # in order
                head = _starts(before)
                used, back = np.unique(sides[1][part], return_inverse=True)
                z, more = room_z[: len(part)], room_more[: len(part)]
                np.take(table, hist[part], 0, z, "clip")
                z += np.take(added(before[head], 0), np.repeat(np.arange(len(head)), np.diff(np.append(head, len(part)))), 0, more, "clip")
                z += np.take(added(used, 1), back, 0, more, "clip")
                own_class = z[np.arange(len(part)), cls[part]]
                local[part] = own_class - np.log(np.exp(z, z).sum(1))
            del order, hist, sides, cls
            local /= np.log(10)
            local += own[code]
            n_known = np.add.reduceat((count > 0).astype(np.uint8)[code], first[:-1], dtype=np.int64)
            sums = [n_known, np.add.reduceat(base[code], first[:-1]), np.add.reduceat(local, first[:-1])]
            for _ in heads:  # equal blocks
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, np.diff(first), *sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def fit_and_score(docs: DataFrame, training, steps: int = STEPS) -> DataFrame:
    """Train on the rows where the Column ``training`` (over doc_id and text) holds, score every row.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score.  Null and empty texts are one end token.  Without
    training rows every word is unknown and every class as likely.  Rows without id are left out, rows that repeat an
    id are summed under it; other columns are ignored.  A text longer than a block is a block of its own.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    learn = docs.where(training)
    top = frequent_words(learn)
    counted = learn.mapInArrow(_class_counts(top), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # in order, so that sums of floats are the same however the texts were dealt out
    stats = materialise(counted.repartition(TASKS, (F.col("cell") / (CLASSES * CLASSES * 16)).cast("int")).sortWithinPartitions("cell"))
    weights = train(stats, steps)
    discard(stats)
    sided = learn.mapInArrow(_word_stats(top), WORD_STATS).repartition("key").sortWithinPartitions("key")
    table = materialise(sided.mapInArrow(_word_weights(weights, top), "key string, n long, weights binary"))

    def add_class(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(classes(b.column(0).cast(pa.binary()).cast(pa.large_binary()), top).astype(np.int32))], ["n", "class"])

    by_class = {r["class"]: (r["n"], r["v"]) for r in table.select("key", "n").mapInArrow(add_class, "n long, class int").groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n_all, v_all = (sum(x[i] for x in by_class.values()) for i in (0, 1))
    room = np.array([n + 0.5 * (v + 1) for n, v in (by_class.get(c, (0, 0)) for c in range(CLASSES))])
    rows = docs.mapInArrow(_blocks(top), BLOCKS)
    words = rows.where("key is not null").join(table, "key", "left").select("block", "at", "n", F.col("weights").alias("data"))
    whole = rows.where("key is null").select("block", "at", F.lit(None).cast("long").alias("n"), "data")
    blocks = words.unionByName(whole).repartition("block").sortWithinPartitions("block", "at")
    scored = blocks.mapInArrow(_score(weights, room, n_all, v_all), SCORES)
    sums = scored.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fit_and_score(load(spark, sf_dir, "documents", "doc_id", "text"), id_mod("doc_id", 5) != 1)
    return scored.select("doc_id", (id_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
