"""Every registered corpus query over a small table: column names, types, one row a document, held-out rows."""

import zlib

import pytest

from flowaudit.llm import queries

FOLDER = "/root/testdata/sf0.001"
LONG = "bigint"
COLUMNS = {
    "op2_token_ids": {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG},
    "op4_toxicity": {"doc_id": LONG, "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_vector_dedup": {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": "boolean"},
    "op6_pii": {"doc_id": LONG, "n_email": LONG, "n_ip": LONG, "n_card": LONG, "n_phone": LONG, "base_sha256": "string", "spans": "string"},
    "op7_ngram_jaccard": {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG},
    "op8_language_id": {"doc_id": LONG, "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_best_fit_packing": {"doc_id": LONG, "piece": "int", "start": LONG, "length": LONG, "ids_crc32": LONG, "sequence_id": LONG, "offset": LONG},
    "op10_substring_dedup": {"doc_id": LONG, "n_words": LONG, "n_removed": LONG, "kept_sha256": "string"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, name):
    pytest.importorskip("public_tokenizers")
    got = queries.QUERIES[name](spark, FOLDER)
    types = dict(got.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = got.collect()
    source = "embeddings" if name.startswith("op5") else "documents"
    key = "vec_id" if source == "embeddings" else "doc_id"
    ids = [r[0] for r in spark.read.parquet(f"{FOLDER}/{source}.parquet").select(key).collect()]
    assert sorted({r[key] for r in rows}) == sorted(ids)
    if name != "op9_best_fit_packing":
        assert len(rows) == len(ids)
    if "held_out" in types:
        fold = {"op4_toxicity": (5, 0), "op8_language_id": (3, 1)}[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in rows)
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "op4_toxicity":
        assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    if name == "op2_token_ids":
        at = 0
        for r in sorted(rows):
            assert r.start == at
            at += r.n_tokens
    if name == "op9_best_fit_packing":
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in places.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
