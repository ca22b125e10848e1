"""The columns of the queries that SQL does not express, next to plain versions, row by row."""

from __future__ import annotations

import hashlib
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library
from tokenizers import Tokenizer

from aulario.llm.queries import corpus_queries, table
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no generated tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}


def run(spark, name):
    found = corpus_queries()[name](spark, SF_DIR).collect()
    return found, {r.doc_id: r for r in found}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(
    "name,by,rest,least", [("op3_toxicity", 3, 1, 0.7), ("op10_quality_classifier", 5, 0, 0.3)], ids=["op3", "op10"]
)
def test_classifier_columns(spark, docs, name, by, rest, least):
    found, by_id = run(spark, name)
    assert set(by_id) == set(docs) and len(found) == len(docs)
    for i, r in by_id.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % by == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)


def test_simhash_columns(spark, docs):
    found, by_id = run(spark, "op5_simhash_near_dedup")
    place = brute.near_groups(list(docs.items()), 4, 4)
    assert len(found) == len(docs)
    for i, text in docs.items():
        assert by_id[i].fingerprint == f"{brute.fingerprint(text, 4):016x}"
        assert by_id[i].component_id == place[i]


def test_sharding_columns(spark, docs):
    found, by_id = run(spark, "op6_sharding")
    assert len(found) == len(docs) and {r.law for r in found} == {"bytes"}
    for i, text in docs.items():
        data = (text or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert by_id[i].grown_shard is None
    total, largest = sum(r.size for r in found), max(r.size for r in found)
    for shard in range(8):
        own = [r for r in found if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= 2 * max(0.005 * total / 8, largest / 2) + 1
    groups = {}
    for r in found:
        groups.setdefault(docs[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 7


def test_sentencepiece_columns(spark, docs):
    other = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found, by_id = run(spark, "op9_sentencepiece")
    assert len(found) == len(docs)
    for i, text in docs.items():
        ids = other.encode(text or "", add_eos=True)
        want = (len(ids), sha(" ".join(map(str, ids))), sha(other.decode(ids)))
        assert (by_id[i].n_tokens, by_id[i].ids_sha256, by_id[i].decoded_sha256) == want


def test_token_file_columns(spark, docs):
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    found, by_id = run(spark, "op13_token_files")
    assert len(found) == len(docs)
    start = 0
    for i in sorted(docs):
        ids = [*other.encode(docs[i] or "", add_special_tokens=False).ids, 0]
        want = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert (by_id[i].start, by_id[i].n_tokens, by_id[i].ids_crc32) == want
        start += len(ids)
