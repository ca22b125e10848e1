"""Operators on passages, lines, benchmark items and tokens against plain versions."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import pyarrow as pa
import sentencepiece as library
from pyspark.sql import functions as F

from aulario.llm import decontamination, lines, sentencepiece, substrings, texts
from tests.conftest import frame, rows
from tests.llm import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture
def small_batches(spark, monkeypatch):
    """Few rows a batch, so that what is carried between batches is used."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield monkeypatch
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["É", "ß.", "a\x0bb"]
    runs = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    docs = []
    for i in rng.sample(range(-50, 400), 90):
        own = [w for _ in range(rng.randint(0, 4)) for w in rng.choice(runs)]
        for _ in range(rng.randint(0, 2)):
            if own:
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(own)))
    return docs + [(900, None), (901, ""), (902, "same " * 3000), (903, "same " * 40), (904, "a " * 12), (905, "a " * 13)]


@pytest.mark.parametrize("window", [13, 6])
def test_repeated_passages(spark, small_batches, window):
    small_batches.setattr(substrings, "_AT_ONCE", 200)
    docs = passages(window)
    df = frame(spark, [(*d, 1, "k") for d in docs], "doc_id long, text string, first int, kept string").repartition(4)
    found = {r[0]: tuple(r[1:]) for r in rows(substrings.remove_repeated_passages(df, window))}
    want = brute.kept_words(docs, window)
    assert found == want and any(n for _, n, _ in want.values())


def test_repeated_passages_of_repeated_unnamed_and_no_rows(spark):
    text = " ".join(f"v{i}" for i in range(20))
    docs = [(1, text), (1, text), (2, text), (None, text)]
    found = sorted(rows(substrings.remove_repeated_passages(frame(spark, docs, "doc_id long, text string"))), key=str)
    assert [(r[0], r[2]) for r in found] == [(1, 0), (1, 0), (2, 20), (None, 0)]
    assert rows(substrings.remove_repeated_passages(frame(spark, [], "doc_id long, text string"))) == []


def test_crowded_anchors_are_spread(spark, monkeypatch):
    """A line that most documents share, with other words around it, is no group of one task."""
    monkeypatch.setattr(substrings, "_SAMPLED", 1)
    rng = random.Random(3)
    line = [f"l{i}" for i in range(15)]
    docs = []
    for i in range(400):
        before, after = ([f"{w}{rng.randrange(10**6)}" for _ in range(20)] for w in "ba")
        docs.append((i, " ".join(before + line[: rng.choice([6, 15])] + after)))
    docs = [*docs, *((i + 1000, text) for i, text in docs[:40])]
    df = frame(spark, docs, "doc_id long, text string").repartition(4)
    largest = []
    factors = substrings._crowded_spans
    monkeypatch.setattr(substrings, "_crowded_spans", lambda p, w: largest.append(p) or factors(p, w))
    monkeypatch.setattr(substrings, "_CROWDED", (100, 200))
    found = {r[0]: tuple(r[1:]) for r in rows(substrings.remove_repeated_passages(df, 13))}
    assert found == brute.kept_words(docs, 13)
    (places,) = largest
    assert places.count() > 1000 and places.select("anchor").distinct().count() < 20
    assert places.groupBy("print").count().where("count > 400").count() == 0


def test_stretches_of_a_block_and_places_of_a_window_are_one_row(spark, monkeypatch):
    rng = random.Random(5)
    line = [f"l{i}" for i in range(15)]
    texts_of = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(300)] + line) for _ in range(300)]
    held = substrings._Stretches(13)
    made = pa.array(texts_of)
    held.add(np.arange(300), *texts.text_bytes(made))
    stretches = held.held
    batch = held.rows()
    assert stretches > 14_000 and batch.num_rows < 12_000 and sum(map(len, batch.column("sizes").to_pylist())) < stretches
    held.add(np.arange(300), *texts.text_bytes(made))
    batch = held.windows()
    # a window of the line is in 300 texts: a row for 256 places
    assert max(len(p) for p in batch.column("places").to_pylist()) == 256 * 12
    assert batch.num_rows <= 300 * 303 - 3 * 300 + 3 * 2


def test_places_found_are_gathered_by_document():
    places = np.array([(d, f) for f in range(50) for d in range(2000)], dtype=substrings._ENTRY)
    batch = substrings._by_document(places)
    assert batch.num_rows <= 1 << 10
    found = [substrings._spans_of(np.frombuffer(p, substrings._ENTRY), 13) for p in batch.column("places").to_pylist()]
    spans = [r for b in found for r in b.to_pylist()]
    assert sorted(r["doc_id"] for r in spans) == list(range(2000))
    assert {(r["first"], r["until"]) for r in spans} == {(0, 62)}
    assert substrings._spans_of(places[:0], 13).num_rows == substrings._by_document(places[:0]).num_rows == 0


def test_repeated_passages_of_far_ids_and_places(spark, small_batches):
    rng = random.Random(6)
    line = [f"l{i}" for i in range(20)]
    long = [f"w{rng.randrange(10**6)}" for _ in range(70_000)]
    docs = [(-5, " ".join(line)), ((1 << 40) + 3, " ".join([*long, *line])), (1 << 40, " ".join(["x", *line])), (7, " ".join(long))]
    found = rows(substrings.remove_repeated_passages(frame(spark, docs, "doc_id long, text string").repartition(3)))
    assert {r[0]: tuple(r[1:]) for r in found} == brute.kept_words(docs, 13)


def test_windows_that_share_half_a_hash_are_told_apart(spark):
    head = [f"h{i}" for i in range(12)]
    n = 400_000
    made = " ".join(head + [f"x{i}" for i in range(n)]).encode()
    starts, ends, _ = texts.words(np.frombuffer(made, np.uint8), np.array([0, len(made)]), texts.NOT_SPACE)
    hashes = texts.word_hashes(np.frombuffer(made, np.uint8), starts, ends)
    up, _ = texts.powers(13)
    whole = texts.mix((hashes[:12] * up[:12]).sum(dtype=np.uint64) + hashes[12:] * up[12])
    tails = texts.mix((hashes[8:12] * up[:4]).sum(dtype=np.uint64) + hashes[12:] * up[4])
    usable = np.flatnonzero(tails > texts.run_hashes(hashes[:12], 5).min())  # the anchor is in the common words
    half = whole[usable] >> np.uint64(32)
    order = np.argsort(half, kind="stable")
    pairs = np.flatnonzero(half[order][1:] == half[order][:-1])
    assert len(pairs)
    docs = []
    for k, at in enumerate(pairs.tolist()):
        for j in (0, 1):
            docs.append((2 * k + j, " ".join(head + [f"x{usable[order[at + j]]}"])))
    docs = docs[:2] + [(9, docs[1][1])]
    found = {r[0]: r[2] for r in rows(substrings.remove_repeated_passages(frame(spark, docs, "doc_id long, text string")))}
    assert found == {0: 0, 1: 0, 9: 13}


def items():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))) for _ in range(12)]
    texts += ["Solo", "the Der", None, "", "?!", texts[0]]
    return [(i * 7, t) for i, t in enumerate(texts)]


def contaminated_docs():
    rng = random.Random(2)
    docs = []
    for i in range(60):
        own = [rng.choice("abcdefghxyz") for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            own[5:5] = (rng.choice(items())[1] or "").upper().split(" ")
        docs.append((i, rng.choice([" ", ", ", "\n-"]).join(own)))
    return docs + [(70, None), (71, ""), (72, "solo"), (73, "so-lo SOLO?"), (74, "the\x00der"), (75, "a b " * 3000)]


@pytest.mark.parametrize("slack", [0, 3])
def test_benchmark_items(spark, small_batches, slack):
    small_batches.setattr(decontamination, "_WORDS_AT_ONCE", 100)
    docs = contaminated_docs()[: 66 - slack * 2]
    df = frame(spark, [(*d, 3, "k") for d in docs], "doc_id long, text string, n_words int, items string")
    asked = frame(spark, items(), "item_id long, text string")
    want = {i: (n, len(p), named) for i, (n, p, named) in brute.hits(docs, items(), 10, slack).items()}
    for block in (1 << 20, 60):  # in one block, and in several
        small_batches.setattr(decontamination, "ITEM_BYTES", block)
        found = rows(decontamination.find_items(decontamination.positional_index(df), asked, 10, slack))
        assert {r[0]: (r[1], r[2], r[4]) for r in found} == want
    assert any(x[1] for x in want.values())


def test_decontaminated_keeps_columns_and_rows(spark):
    docs = [(1, "x one two y", "k"), (1, "x one two y", "k"), (2, "one", "k"), (None, "one two", "k"), (3, None, None)]
    df = frame(spark, docs, "doc_id long, text string, hit_id string")
    asked = frame(spark, [(1, "One two"), (None, "one")], "item_id long, text string")
    found = decontamination.decontaminated(df, asked)
    assert found.columns == df.columns
    assert sorted(rows(found), key=str) == sorted(docs[2:], key=str)
    assert decontamination.decontaminated(df, asked.limit(0)).count() == 5
    assert decontamination.decontaminated(df.limit(0), asked).count() == 0


def line_docs():
    rng = random.Random(4)
    common = ["All rights reserved.", " padded  ", "on nine sites", "on ten sites", "", "x"]
    docs = []
    for i in range(120):
        own = [rng.choice(common[:2] + common[4:] + [f"line {rng.randrange(40)}"]) for _ in range(rng.randint(1, 12))]
        docs.append((i, rng.choice([*(f"s{j}" for j in range(14)), None]), "\n".join(own)))
    docs += [(200 + j, f"s{j % 9}", "on nine sites\nown") for j in range(30)]
    docs += [(300 + j, f"s{j % 10}", "on ten sites\non ten sites ") for j in range(30)]
    return docs + [(400, "s1", None), (401, "s1", ""), (402, "s1", "x\n" * 30000), (403, None, "All rights reserved.\n")]


def test_boilerplate_lines(spark):
    docs = line_docs()
    df = frame(spark, [(*d, 7, "k") for d in docs], "doc_id long, source string, text string, n_lines int, owner string")
    found = lines.remove_boilerplate(df, min_sites=10)
    assert found.columns == ["doc_id", "source", "text", "owner", "n_lines", "n_removed"]
    want = brute.cleaned(docs, 10)
    assert {r[0]: (r[2], r[5]) for r in rows(found)} == want
    sizes = {i: (t.count("\n") + 1 if t is not None else 0) for i, _, t in docs}
    assert {r[0]: r[4] for r in rows(found)} == sizes
    stage = lines.without_boilerplate(df.withColumn("n_chars", F.char_length("text").cast("long")))
    assert {r.doc_id: (r.text, r.n_chars) for r in stage.collect()} == {
        i: (t, len(t) if t is not None else None) for i, (t, _) in want.items()
    }


def test_boilerplate_lines_of_repeated_unnamed_and_no_rows(spark):
    docs = [(1, "a", "x\ny"), (1, "a", "x\ny"), (2, "b", "x"), (None, "c", "x")]
    df = frame(spark, docs, "doc_id long, source string, text string")
    found = sorted(rows(lines.remove_boilerplate(df, min_sites=2)), key=str)
    assert [(r[0], r[2]) for r in found] == [(1, "x\ny"), (1, "x\ny"), (2, ""), (None, "x")]
    assert lines.remove_boilerplate(df.limit(0)).count() == 0


def odd_texts():
    rng = random.Random(11)
    bits = [" ", "  ", "\n", "a", "the", "ing", "é", "ß", "中", "文", "😀", "12", ".", ",,", "!!", "\t", "▁", "</s>", "<0x0A>"]
    bits += ["\r", "न", "\x00", "\u200b", "e\u0301", "\ufeff", "\xa0", "aaaa", "\u3000", "Erheit", "achlich"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]


def each(ids, bounds):
    return [ids[s:e].tolist() for s, e in zip(bounds, bounds[1:])]


@pytest.mark.parametrize("at_once", [50, 8 << 20])
def test_encoding_equals_the_library(monkeypatch, at_once):
    monkeypatch.setattr(sentencepiece, "AT_ONCE", at_once)
    own = sentencepiece.MergeCodec(sentencepiece.model_bytes(MODEL))
    other = library.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts() + ["", " ", "x" * 3000 + "中" * 2000, " " * 999, "ab" * 9000]
    texts = texts[:400] + texts[-5:] if at_once < 100 else texts
    ids, bounds = own.encode(pa.array([*texts, None]))
    want = [other.encode(text, add_eos=True) for text in [*texts, ""]]
    assert each(ids, bounds) == want
    assert own.decode(ids, bounds) == [other.decode(x) for x in want]
    assert [len(x) for x in own.encode(pa.array([], pa.string()))] == [0, 1]


def test_search_steps_back_where_the_longest_pieces_do_not_fit():
    own = sentencepiece.MergeCodec(sentencepiece.model_bytes(MODEL))
    for text in ("▁thhahati", "▁enßheitheit", "▁unwhable", "abababa", "▁aaaaaaa"):
        assert own.searched(text) == [own.ids[p] for p in own.merged(text)]


def test_bounded_memory_of_chunks_changes_nothing(monkeypatch):
    own = sentencepiece.MergeCodec(sentencepiece.model_bytes(MODEL))
    small = sentencepiece.MergeCodec(sentencepiece.model_bytes(MODEL))
    small.distinct.most = small.inner.most = small.compatible.most = 3
    texts = pa.array(odd_texts()[:300])
    for _ in range(2):
        assert each(*own.encode(texts)) == each(*small.encode(texts))


def test_round_trip_rows(spark):
    docs = [(1, "Ab c", "k"), (1, "Ab c", "k"), (2, None, None), (None, "", "k"), (3, "z " * 40000, "k")]
    df = frame(spark, docs, "doc_id long, text string, ids string")
    found = rows(sentencepiece.round_trip(df, MODEL))
    other = library.SentencePieceProcessor(model_file=MODEL)
    assert sorted(found, key=str) == sorted(
        [(i, other.encode(t or "", add_eos=True), t or "") for i, t, _ in docs], key=str
    )
    assert rows(sentencepiece.round_trip(df.limit(0), MODEL)) == []
