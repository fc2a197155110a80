"""Each query's columns and types, and a row for each document."""

import os

import pytest

from folioflow.llm.registry import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WANT = {
    "op1_decontamination": "doc_id bigint, item_id bigint",
    "op2_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op11_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op13_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_query_keeps_its_contract(spark, name):
    assert set(QUERIES) == set(WANT)
    df = QUERIES[name](spark, DATA)
    have = dict(df.dtypes)
    assert {c: have.get(c) for c in (x.split()[0] for x in WANT[name].split(", "))} == dict(x.split() for x in WANT[name].split(", "))
    rows = df.collect()
    table, key = {"op11_conversation_repair": ("conversations", "conv_id"), "op13_warc": ("pages", "page_id")}.get(name, ("documents", "doc_id"))
    docs = {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
    found = {r[key] for r in rows}
    assert found <= docs if name == "op1_decontamination" else found == docs
    if name not in ("op1_decontamination", "op9_packing"):
        assert len(rows) == len(docs)
    if "score" in have:
        assert all(r.score is not None for r in rows)
    if name == "op7_quality":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    if name.startswith(("op6", "op10")):
        assert all(0 <= x <= 1 for r in rows for x in ((r.near_edited, r.near_next) if name.startswith("op6") else (0,)))
