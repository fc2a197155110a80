import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import maxent_lm, packing, quality, token_counts

from .helpers import LOWER, frame, passage, words

EDGES = ["", "\n", " ", "a", " a", "a ", "\na", "\n  a", " \n a", "▁", "a▁ b", "\n▁a", None, "é ﬁ\t\t x", "<s> a </s>", "x\r\n y\r\n\nz", "it's, well: done.", "<|endoftext|> A.B <|ENDOFTEXT|>", "ΑΣ. İI é́", "x" * 5000]


def test_token_counts_equal_the_library(spark):
    model = token_counts._model(token_counts.model_path())
    rows = [*enumerate(EDGES), (None, "left out"), (100, "same id"), (100, "same id twice")]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(frame(spark, rows), limit=3).collect()}
    want = {i: (len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 3) for i, t in enumerate(EDGES)}
    n = len(model.encode("same id")) + len(model.encode("same id twice"))
    assert got == want | {100: (20, n, n > 3)}
    assert token_counts.count_tokens(frame(spark, [])).collect() == []


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = [*enumerate(EDGES), (50, passage(1, 3000)), (51, passage(1, 3000)), *((60 + i, passage(i, 40)) for i in range(30))]
    got = packing.pack_documents(frame(spark, rows)).toPandas()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(ids[at : at + p.length].tobytes()), len(ids))
            at += p.length
        assert at == len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 4096 + 1
    assert packing.pack_documents(frame(spark, [])).collect() == []


def test_chunks_encoded_together_have_their_own_ids(monkeypatch):
    path = packing.tokenizer_path()
    tok = packing._tokenizer(path)[0]
    chunks = ["enchou", "straße", "ciónesllción", "it's", "'s", "a", "ÿø", "ἀρχή", "e\u0301a", "x1y", "<|endoftext|>", "<", "İ", "...", "das", "ﬁ", "a÷b", "n" * 3000]
    want = [np.array(tok.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in chunks]
    assert packing._encoded(chunks, path) == want and packing._encoded(chunks[7:14], path) == want[7:14]
    assert [bool(packing._WORD(c)) for c in chunks] == [c in {"enchou", "straße", "ciónesllción", "a", "ÿø", "das", "n" * 3000} for c in chunks]
    held, store = pa.array([c.encode() for c in chunks[:6]], pa.large_binary()), packing._tokenizer(path)[1]
    monkeypatch.setattr(packing, "_CACHE", 4)
    for _ in range(2):  # what a slice holds is not encoded anew when the store is emptied
        assert packing._chunk_ids(held, path)[0].tobytes() == b"".join(want[:6])
    monkeypatch.setattr(packing, "_encoded", lambda part, path: [] if not part else pytest.fail("encoded anew"))
    packing._chunk_ids(held, path)
    assert set(store) == set(chunks[:6])


def test_shortest_pack_first_counts_every_length():
    hist = {4096: 3, 4000: 5, 3000: 7, 1000: 11, 96: 40, 5: 1000, 1: 3}
    placed = Counter()
    for pattern, n in packing.shortest_pack_first(hist):
        assert sum(pattern) <= 4096 and n > 0
        for x in pattern:
            placed[x] += n
    assert placed == hist


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_language_model_counts_and_gain(spark):
    r = np.random.default_rng(1)
    text = lambda: " ".join(x for _ in range(60) for x in ("red." if r.random() < 0.5 else "blue", "Fox" if r.random() < 0.9 else "cat"))
    docs = [(i, text()) for i in range(60)] + [(100, None), (101, ""), (102, "unseen words only"), (103, "x" * 3000)]
    got = maxent_lm.fit_and_score(frame(spark, docs), F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1, steps=6).collect()
    tokens = {i: [w.decode() for w in words((t or "").translate(LOWER))] + [""] for i, t in docs}
    count = Counter(w for i, ws in tokens.items() if not held_out(i) for w in ws)
    total, distinct = sum(count.values()), len(count)
    assert {x.doc_id for x in got} == set(tokens)
    for x in got:
        ws = tokens[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert x.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws))
        assert x.score < 0
    fresh = [x for x in got if held_out(x.doc_id) and x.doc_id < 60]
    assert sum(x.score for x in fresh) > sum(x.base_score for x in fresh)


def learns():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1


def test_language_model_score_equals_plain_python(spark):
    r = np.random.default_rng(3)
    docs = [(i, " ".join(r.choice(["red.", "blue", "Fox", "cat,", "Ärger", "x1", "quietly", "o", "cat"], 30, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]))) for i in range(50)]
    docs += [(100, None), (101, ""), (102, "never seen before red. blue"), (103, docs[0][1]), (104, docs[1][1])]
    got = {x.doc_id: x.score for x in maxent_lm.fit_and_score(frame(spark, docs).repartition(7), learns(), steps=4).collect()}  # several blocks

    toks = {i: [*((w.decode()) for w in words((t or "").translate(LOWER))), ""] for i, t in docs}
    train = [i for i in toks if not held_out(i)]
    count = Counter(w for i in train for w in toks[i])
    top = sorted((w for w in count if w), key=lambda w: (-count[w], w))[: maxent_lm.TOP]
    vocab = sorted({w for ws in toks.values() for w in ws})
    cls = dict(zip(vocab, maxent_lm.classes(pa.array([w.encode() for w in vocab], pa.large_binary()), top).tolist(), strict=True))

    def events(i):
        """(history, class, words before, word) of each token."""
        for k, w in enumerate(toks[i]):
            back = [cls[toks[i][k - j]] if k >= j else 0 for j in (1, 2, 3)]
            yield (back[0] * maxent_lm.CLASSES + back[1]) * 16 + back[2] % 16, cls[w], [(j, toks[i][k - j] if k >= j else "") for j in (1, 2)], w

    cells = Counter(h * maxent_lm.CLASSES + c for i in train for h, c, _, _ in events(i))
    weights = maxent_lm.train(spark.createDataFrame([(a, n) for a, n in cells.items()], "cell long, n long"), 4)
    log_p = lambda h: maxent_lm.log_probs(weights, np.array([h]))[0]
    seen, expected = Counter(), {}
    for i in train:
        for h, c, sides, _ in events(i):
            for f in sides:
                seen[f, c] += 1
                expected[f] = expected.get(f, 0) + np.exp(log_p(h))
    extra = {(f, c): round(16 * math.log((n + 1) / (expected[f][c] + 1))) / 32 for (f, c), n in seen.items()}
    room = {c: sum(n + 0.5 for w, n in count.items() if cls[w] == c) + 0.5 for c in range(maxent_lm.CLASSES)}
    for i in toks:
        want = 0.0
        for h, c, sides, w in events(i):
            z = log_p(h) + [sum(extra.get((f, k), 0.0) for f in sides) for k in range(maxent_lm.CLASSES)]
            want += (z[c] - math.log(np.exp(z).sum())) / math.log(10) + math.log10((count[w] + 0.5) / room[c])
        assert got[i] == pytest.approx(want, rel=1e-4), i


def test_language_model_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(4)
    vocabulary = [passage(i, 1) for i in range(400)]
    docs = [(i, " ".join(r.choice(vocabulary, r.integers(1, 200), p=(w := 1 / np.arange(1, 401)) / w.sum()))) for i in range(200)]
    one, *others = ({x.doc_id: (x.score, x.base_score) for x in maxent_lm.fit_and_score(frame(spark, docs).repartition(n), learns(), steps=3).collect()} for n in (1, 4, 16))
    for other in others:
        assert other.keys() == one.keys() and all(other[i] == pytest.approx(one[i], rel=1e-6) for i in one)


def word_rows(texts, top):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    return list(maxent_lm._word_stats(top)([batch]))


def test_language_model_counts_of_blocks_add_up(spark):
    """A word's histories and classes come back from its rows, and weights are those of all texts in one block, however rows are batched."""
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(["the", "a", "rare", "x.", "odd,", "Größe"], 400, p=[0.5, 0.3, 0.1, 0.05, 0.03, 0.02])) for _ in range(6)]
    top = ["the", "a"]
    (whole,) = word_rows(texts, top)
    want = Counter()
    cls = lambda w: int(maxent_lm.classes(pa.array([w.encode()], pa.large_binary()), top)[0])
    for t in texts:
        ws = [w.decode() for w in words(t.translate(LOWER))] + [""]
        for k, w in enumerate(ws):
            back = [cls(ws[k - j]) if k >= j else 0 for j in (1, 2, 3)]
            hist = (back[0] * maxent_lm.CLASSES + back[1]) * 16 + back[2] % 16
            for kind in (0, 1):
                want[ws[k - kind - 1] if k > kind else "", kind, hist, cls(w)] += 1
    keys = whole.column(0).to_pylist()
    row, code, n = maxent_lm._unpacked(whole)
    got = Counter()
    for a, b, c in zip(row.tolist(), code.tolist(), n.tolist(), strict=True):
        kind, rest = np.int64(b >> 16), np.int64((b & 0xFFFF) >> 6)
        got[keys[a], int(kind), int(maxent_lm.whole_history(rest, kind, np.int64(cls(keys[a])))), b & 63] += c
    assert got == want
    weights = np.random.default_rng(6).normal(size=(maxent_lm.FEATURES, maxent_lm.CLASSES))

    def weighed(batches):
        return {r["key"]: (r["n"], r["weights"]) for b in maxent_lm._word_weights(weights, top)(batches) for r in b.to_pylist()}

    def in_order(batches):
        table = pa.Table.from_batches(batches)
        return table.sort_by("key").combine_chunks().to_batches()[0]

    one = weighed([in_order([whole])])
    many = in_order([x for t in texts for x in word_rows([t], top)])
    assert one == weighed([many]) == weighed([many.slice(i, 1) for i in range(many.num_rows)]) == weighed([many.slice(0, 7), many.slice(7)])
    assert sum(n for n, _ in one.values()) == sum(len(words(t)) + 1 for t in texts)


def test_frequent_words_are_those_of_all_texts(spark):
    r = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{i % 4}x{k}" for k in r.integers(0, 30, 100)) + " all all") for i in range(40)]
    count = Counter(w.decode() for _, t in rows for w in words(t))
    want = sorted(count, key=lambda w: (-count[w], w))[:9]
    df = frame(spark, rows).select("doc_id", "text").repartition(4, F.col("doc_id") % 4)
    assert maxent_lm.frequent_words(df, 9, 5) == want == maxent_lm.frequent_words(df, 9, 1000)
    assert maxent_lm.frequent_words(df.limit(0), 9) == [] and maxent_lm.frequent_words(df, 1, 2) == ["all"]


def test_frequent_words_with_exact_counts_need_no_count_of_all_words(spark, monkeypatch):
    """Two words whose counts are close, both sent by every block, are told apart by the first pass; one that a block did not send is not."""
    limits, passes = [], maxent_lm._frequent
    monkeypatch.setattr(maxent_lm, "_frequent", lambda limit: limits.append(limit) or passes(limit))
    rows = [(i, "a " * (50 + i) + "b " * 50 + " ".join(f"rare{i}x{k}" for k in range(20))) for i in range(2)]
    df = frame(spark, rows).select("doc_id", "text").repartition(2, "doc_id")
    assert maxent_lm.frequent_words(df, 1, 4) == ["a"] and limits == [4]
    assert maxent_lm._sure([(101, True), (100, True), (60, False)], 1, 3, 8)
    assert not maxent_lm._sure([(101, True), (100, True), (99, False)], 1, 3, 8)  # may count 102
    assert not maxent_lm._sure([(101, True), (100, True), (99, True)], 1, 3, 3)  # so may one that comes after these
    assert not maxent_lm._sure([(101, False), (60, True)], 1, 3, 8)


def test_tokens_do_not_depend_on_slices(monkeypatch):
    texts = pa.array([b"", b" ", b"A b\n", b"c a", b"", b"b"], pa.large_binary())
    whole, first = maxent_lm.tokens(texts)
    sizes, cut = [], maxent_lm.text_slices
    monkeypatch.setattr(maxent_lm, "text_slices", lambda batches: (sizes.append(len(x[1])) or x for x in cut(batches, limit=4)))
    got, at = maxent_lm.tokens(texts)
    assert len(sizes) > 2 and got.equals(whole) and at.tolist() == first.tolist() == [0, 1, 2, 5, 8, 9, 11]
    assert [x.as_py() for x in got] == [b"", b"", b"a", b"b", b"", b"c", b"a", b"", b"", b"b", b""]


def test_language_model_repeated_ids_and_blocks(spark):
    """Equal blocks (same ids and texts) are each scored; sums go to the id."""
    one = maxent_lm.fit_and_score(frame(spark, [(1, "a b a")]), F.lit(False), steps=1).first()
    two = maxent_lm.fit_and_score(frame(spark, [(1, "a b a"), (1, "a b a"), (None, "c")]).repartition(3), F.lit(False), steps=1).first()
    assert (two.n_tokens, two.n_known) == (8, 0) and two.score == pytest.approx(2 * one.score)


def test_language_model_class_probabilities_sum_to_one():
    w = np.random.default_rng(2).normal(size=(maxent_lm.FEATURES, maxent_lm.CLASSES))
    assert np.allclose(np.exp(maxent_lm.log_probs(w, np.array([0, 5, 4000, maxent_lm.HISTORIES - 1]))).sum(1), 1)


def test_language_model_of_no_texts(spark):
    assert maxent_lm.fit_and_score(frame(spark, []), F.lit(True), steps=1).collect() == []


def test_quality_ranks_held_out_texts(spark):
    good = [(2 * i, passage(i, 80)) for i in range(120)]
    bad = [(2 * i + 1, " $$$ ".join(passage(i, 40).split()) + " ### ###") for i in range(120)]
    docs = frame(spark, [*good, *bad, (900, None), (901, ""), (902, "x" * 9000)])
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None), (7, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), quality.learned_model(docs, labels)).collect()}
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i, _ in good) > max(got[i] for i, _ in bad)
    assert quality.keep_above_quantile(spark.createDataFrame([(i, i / 10) for i in range(10)], "doc_id long, score double"), 0.5).count() in (5, 6)


def test_quality_without_labels_scores_all_alike(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert len({r.score for r in quality.score(docs, model).collect()}) == 1


def test_pair_model_needs_both_kinds():
    assert quality.predict(quality.fit_pairs(np.zeros((3, 2)), np.ones(3)), np.zeros((1, 2)))[0] > 0.5


def test_pre_tokens_cover_the_text():
    keys, doc = token_counts.pre_tokens(pa.array([b"", b"a b\nc", b" x"], pa.large_binary()), token_counts.model_path())
    assert len(keys) == len(doc) and set(doc.tolist()) == {1, 2}
