"""Operators against plain versions, and texts of megabytes through each of them."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import common, decontaminate, fingerprints, jaccard_join, packing, quality, rlz_dedup, sharding, suffix_dedup, token_counts

from .helpers import frame, passage, words
from .test_contracts import DATA


def test_overlaps_equal_all_alignments(spark):
    r = random.Random(11)
    vocabulary = [passage(i, 1) for i in range(6)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, text(r.choice([3, 9, 13, 14, 25]))) for i in range(25)]
    docs = []
    for i in range(60):
        t = text(r.randrange(0, 60))
        if r.random() < 0.7:
            item = list(r.choice(items)[1])
            for k in r.sample(range(len(item)), min(len(item), r.randrange(0, 4))):
                item[k] = "changed"
            at = r.randrange(len(t) + 1)
            t[at:at] = item
        docs.append((i, t))
    want = set()
    for i, t in docs:
        for j, u in items:
            n = min(13, len(u))
            need = 11 if len(u) >= 13 else n
            if any(sum(t[a + k] == u[b + k] for k in range(n)) >= need for b in range(len(u) - n + 1) for a in range(len(t) - n + 1)):
                want.add((i, j))
    bench = spark.createDataFrame([(j, " ".join(u)) for j, u in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(frame(spark, [(i, " ".join(t)) for i, t in docs]), bench).collect()}
    assert got == want and 20 < len(want) < len(docs) * len(items)


def plain_labels(symbols):
    """Deterministic coin tossing, symbol by symbol: twice the place of the lowest bit that differs from the one before, and that bit."""
    low = lambda x: (x & -x).bit_length() - 1 if x else 0
    lab = []
    for k, x in enumerate(symbols):
        bit = low(x if k == 0 else x ^ symbols[k - 1])
        lab.append(2 * bit + (x >> bit & 1))
    for _ in range(3):
        lab = [2 * (bit := low(x if k == 0 else x ^ lab[k - 1])) + (x >> bit & 1) for k, x in enumerate(lab)]
    return lab


def plain_cuts(symbols):
    """Where phrases of one text begin: at labels higher than both neighbours', never one symbol after the start."""
    lab = plain_labels(symbols)
    return [k for k in range(len(lab)) if k == 0 or (k > 1 and lab[k] > lab[k - 1] and (k + 1 == len(lab) or lab[k] > lab[k + 1]))]


def test_phrases_equal_those_found_symbol_by_symbol():
    r = random.Random(12)
    texts = []
    for _ in range(200):
        t = [r.getrandbits(64) | 1 for _ in range(r.randrange(1, 40))]
        texts.append([x for k, x in enumerate(t) if k == 0 or x != t[k - 1]])
    flat = np.array([x for t in texts for x in t], np.uint64)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    names, at = fingerprints.parse(flat, first)
    want = []
    with np.errstate(over="ignore"):
        for t, lo in zip(texts, first[:-1], strict=True):
            cuts = [*plain_cuts(t), len(t)]
            want.append(len(cuts) - 1)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                name = common.mix(common.span_hashes(flat, np.array([lo + a]), np.array([lo + b])) + np.uint64(b - a) * fingerprints._M)
                assert name[0] == names[at[len(want) - 1] + cuts.index(a)]
    assert np.diff(at).tolist() == want


def test_equal_stretches_share_phrases_wherever_they_stand():
    shared = passage(20, 400).encode()
    for level in range(fingerprints.LEVELS):
        found = []
        for seed in range(6):
            text = passage(30 + seed, 5 + 7 * seed).encode() + shared + passage(40 + seed, 30).encode()
            x, first = common.byte_table(11)[np.frombuffer(text, np.uint8)], np.array([0, len(text)])
            for _ in range(level + 1):
                x, first = fingerprints.parse(x, first)
            found.append(Counter(x.tolist()))
        common_names = sum(min(found[0][n], *(f[n] for f in found[1:])) for n in found[0])
        assert common_names >= 0.8 * len(shared) / 3 ** (level + 1) / 3, level


def test_rings_equal_a_walk_node_by_node(spark):
    """Shards by a plain walk: each node offers what it carries to its shard, what doesn't fit goes on clockwise."""
    n_shards, n_nodes = 5, 4
    rows = [(i % 37 if i % 9 == 0 else 1000 + i, f"t{i}") for i in range(333)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.bounded_ring(df, shards=n_shards, nodes=n_nodes, tie="text").collect()
    ring = sorted((x.high, x.shard) for x in sharding.ring(spark, n_shards, n_nodes).collect())
    place = {(x.doc_id, x.text): (x.c, x.p) for x in df.select("doc_id", "text", F.xxhash64(F.lit("key"), "doc_id").bitwiseAND(F.lit((1 << 63) - 1)).alias("p"), F.pmod(F.xxhash64(F.lit("cell"), "doc_id", "text"), F.lit(sharding.CELLS)).alias("c")).collect()}
    queues = [[] for _ in ring]
    for (doc, text), (cell, p) in place.items():
        node = next((k for k, (high, _) in enumerate(ring) if high >= p), 0)
        queues[node].append((cell, p, doc, text))
    room = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    carried, want = [], {}
    for k, (_, shard) in enumerate(ring + ring):
        carried += sorted(queues[k]) if k < len(ring) else []
        take, carried = carried[: room[shard]], carried[room[shard] :]
        room[shard] -= len(take)
        want |= {(doc, text): shard for _, _, doc, text in take}
    assert not carried and {(x.doc_id, x.text): x.shard for x in got} == want
    sizes = Counter(want.values())
    assert {(x.shard, x.slot) for x in got} == {(s, k) for s, n in sizes.items() for k in range(n)}


def test_rings_refuse_names_of_their_own(spark):
    for name in ("__place", "__edges"):
        with pytest.raises(ValueError, match=name):
            sharding.bounded_ring(spark.range(3).selectExpr("id as doc_id", f"1 as `{name}`"))


def test_quality_tells_held_out_documents_apart(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    scored = [(r.score, labels[r.doc_id]) for r in quality.op7_quality(spark, DATA).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in scored if y == 1], [s for s, y in scored if y == 0]
    assert good and bad and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9


def test_texts_of_megabytes(spark):
    """One text of about two megabytes, its copy, a part of it and a short one: each operator takes them whole."""
    big = passage(50, 320_000)
    item = passage(51, 30)
    part = big[1_000_000:1_100_000].split(" ", 1)[1]
    docs = frame(spark, [(1, big), (2, big), (3, part + " " + item), (4, "short")])
    assert len(big) > 1_500_000
    n = len(words(big))
    bench = spark.createDataFrame([(1, item), (2, " ".join(big.split()[200_000:200_040]))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()} == {(1, 2), (2, 2), (3, 1)}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in rlz_dedup.remove_repeats(docs).collect()}
    inner = len(words(part))
    assert cut[1] == (n, 0) and cut[2] == (n, n) and cut[4] == (1, 0) and inner - 2 <= cut[3][1] <= inner
    model = token_counts._model(token_counts.model_path())
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()} == {i: len(model.encode(t)) for i, t in ((1, big), (2, big), (3, part + " " + item), (4, "short"))}
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs, 3, 90).collect()}
    w = big.split()
    assert groups[1] == groups[2] == (len({tuple(w[i : i + 3]) for i in range(n - 2)}), 1) and groups[3][1] == 3
    prints = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert prints[1].fingerprint == prints[2].fingerprint != prints[3].fingerprint and prints[1].n_chars == len(big) and prints[2].near_next == 1.0
    kept = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert kept[1] == kept[2] == (len(big), len(big)) and kept[4] == (5, 0) and kept[3][1] >= len(part)
    packed = packing.pack_documents(docs).collect()
    assert sum(r.length for r in packed if r.doc_id == 1) == next(r.doc_tokens for r in packed if r.doc_id == 1) and {r.doc_id for r in packed} == {1, 2, 3, 4}
    scored = quality.score(docs, quality.train(docs, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int"))).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored)
    ring = sharding.bounded_ring(docs.select("doc_id", "text"), shards=2, nodes=4).collect()
    assert Counter(r.shard for r in ring) == {0: 2, 1: 2} and zlib.crc32(next(r.text for r in ring if r.doc_id == 1).encode()) == zlib.crc32(big.encode())
