"""Exact top-k search, components and near-duplicate fingerprints against plain versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from aulario.llm import components, simhash, topk
from tests.conftest import frame, rows
from tests.llm import brute

NAN, INF = float("nan"), float("inf")


def clipped(score):
    return max(-(1 << 63), min(score, (1 << 63) - 1))


def expected_top(vectors, k):
    sound = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in vectors
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for q, v in {q: v for q, v in sound if q % 100 == 0}.items():
        scored = [(clipped(sum(a * b for a, b in zip(v, w))), i) for i, w in sound if i != q and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        found += [(q, n, i, s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(found)


def top(spark, vectors, k):
    df = frame(spark, vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    ready = topk.integer_vectors(df)
    return sorted(rows(topk.top_k(ready.where("vec_id % 100 = 0"), ready, k)))


def test_top_k_matches_brute_force_with_ties_and_unsound_vectors(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(0, 900, 3)]
    vectors += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(1000, 1040)]  # a third of the best are ties
    vectors += [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0]), (2003, [NAN] * 4), (2004, [INF] * 4)]
    vectors += [(None, [1.0] * 4), (2100, [1.0, 2.0]), (2101, [3.0, 1.0]), (-300, [-1.0] * 4)]
    monkeypatch.setattr(topk, "BINS", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 11)
    assert top(spark, vectors, 10) == expected_top(vectors, 10)


def test_top_k_of_huge_components_stays_exact(spark):
    vectors = [(0, [1e6, 1e7]), (1, [1e7, 3.0]), (2, [1e200, 1.0]), (3, [-1e200, 1.0]), (4, [1e7, 2.0])]
    assert top(spark, vectors, 3) == expected_top(vectors, 3)


def test_top_k_with_repeated_rows_and_few_candidates(spark):
    vectors = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])]
    assert top(spark, vectors, 10) == [(0, 1, 1, 2048 * 1024), (0, 2, 1, 2048 * 1024)]
    assert top(spark, [], 10) == []


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (None, 5), (7, 3)]
    found = dict(rows(components.components(frame(spark, links, "a long, b long"))))
    assert set(found) == set(range(61)) | set(range(100, 140))
    assert len({found[i] for i in range(61)}) == 1 and len({found[i] for i in range(100, 140)}) == 1
    assert found[0] != found[100]
    assert rows(components.components(frame(spark, [], "a long, b long"))) == []


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_near_links_find_all_pairs(spark, segments):
    rng = random.Random(segments)
    marks = {rng.getrandbits(64) for _ in range(60)}
    for mark in list(marks):
        for flips in range(1, 7):
            for bit in rng.sample(range(64), flips):
                mark ^= 1 << bit
            marks.add(mark)
    signed = sorted(m - (1 << 64) if m >> 63 else m for m in marks)
    want = {
        (a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4
    }
    df = frame(spark, [(m,) for m in signed], "fingerprint long")
    assert set(rows(simhash.near_links(df, 4, segments))) == want and want


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(120)) for _ in range(6)]
    docs = [(i, t) for i, t in enumerate(base)]
    for n in range(60):
        own = rng.choice(base).split(" ")
        own[rng.randrange(120)] = rng.choice("klmn")
        docs.append((100 + n, " ".join(own)))
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, "One two"), (204, "one\vtwo"), (205, "É é"), (206, "x " * 70000)]
    df = frame(spark, [(*d, "k", 1) for d in docs], "doc_id long, text string, fingerprint string, component_id int")
    found = rows(simhash.near_duplicates(df))
    assert {i: c for i, _, c in found} == brute.near_groups(docs, 4, 4)
    assert {i: m % (1 << 64) for i, m, _ in found} == {i: brute.fingerprint(t, 4) for i, t in docs}


def test_near_duplicates_of_repeated_unnamed_and_no_rows(spark):
    docs = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "quite another text than that")]
    found = sorted(rows(simhash.near_duplicates(frame(spark, docs, "doc_id long, text string"))), key=str)
    assert sorted((str(i), str(c)) for i, _, c in found) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert rows(simhash.near_duplicates(frame(spark, [], "doc_id long, text string"))) == []
