"""The registered queries on the smallest tables: contract columns, digests against plain Python, and the SQL of those that have it."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from assaykit.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        duck.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = duck.sql(ORACLE_SQL[name])
    made = QUERIES[name](spark, sf)
    assert sorted(made.columns) == sorted(want.columns)
    assert sorted(map(tuple, made.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_quality(spark, sf, texts):
    rows = QUERIES["op1_compression_quality"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_media(spark, sf, texts):
    rows = QUERIES["op2_ogg_media"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), None)
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64 and r.feature


def test_search(spark, sf):
    rows = QUERIES["op3_permutation_index"](spark, sf).collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    queries = [i for i in vectors if i % 20 == 0]
    assert len(rows) == 20 * len(queries) and {r.query_id for r in rows} == set(queries)
    for r in rows:
        assert r.vec_id != r.query_id and abs(r.score - float((vectors[r.query_id] * vectors[r.vec_id]).sum())) < 1e-12


def test_packing(spark, sf, texts):
    rows = QUERIES["op4_packing"](spark, sf).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    covered, sequences = {}, {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for group, total in [(covered, {i: len(x) for i, x in ids.items()}), (sequences, None)]:
        for key, parts in group.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == total[key] if total else at <= 4096
    assert set(covered) == set(texts)


def test_licences_and_entities(spark, sf, texts):
    rows = {r.doc_id: r for r in QUERIES["op5_licence_scan"](spark, sf).collect()}
    assert set(rows) == set(texts) and all(r.n_confirmed <= r.n_predicted for r in rows.values()) and any(r.families for r in rows.values())
    rows = {r.doc_id: r for r in QUERIES["op6_pii_surrogates"](spark, sf).collect()}
    assert set(rows) == set(texts) and all((r.text == texts[i]) == (r.n_entities == 0) for i, r in rows.items())


def test_pieces(spark, sf, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in QUERIES["op8_piece_scan"](spark, sf).collect()}
    assert set(rows) == set(texts) and all(r.round_trip and r.n_pieces == len(library.encode(texts[i])) for i, r in rows.items())
