"""Prefix tries, filter audits and token files next to plain versions."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from aulario.llm import bytelevel, chunks, filteraudit, prefixtrie, tokenfiles
from tests.conftest import frame, rows
from tests.llm.brute import words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string, node string, place string, block int, t0 string"


def sequences(turns):
    """{conv_id: [(role, text)]} in order."""
    found = {}
    order = lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for t in sorted((t for t in turns if t[0] is not None), key=order):
        found.setdefault(t[0], []).append((t[2] or "", t[3] or ""))
    return found


def rebuilt(convs):
    found = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        found[c] = convs.get(base, [])[:h] + own[h:]
    return found


def plain_trie(convs):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)}."""
    members = {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        inside = [path]
        for child in children.get(path, []):
            inside += below(child)
        return inside

    found = {}
    for path, own in members.items():
        inside = below(path)
        found[min(own), len(path)] = (
            min(members[path[:-1]]) if path else None,
            len(own),
            len(children.get(path, [])),
            sum(p not in children for p in inside),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in inside if p),
            hashlib.sha256(",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path)).encode()).hexdigest(),
        )
    return found


def found_trie(trie):
    nodes = trie.with_parents().join(prefixtrie.end_digests(trie.ends), "node", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_chars", "ends_sha256"]
    out = rows(nodes.select(*columns))
    none = hashlib.sha256(b"").hexdigest()
    found = {r[:2]: (*r[2:7], r[7] or none) for r in out}
    assert len(found) == len(out)
    return found


def random_turns(seed):
    rng = random.Random(seed)
    turns = []
    for c in [*range(0, 260, 7), 100, 101, 200, 300, -5, -107]:
        n = rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 30])
        for t in range(n):
            said = rng.choice(["a", "é😀", "", None]) if t % 5 else "start"
            turns.append((c, t, rng.choice(["user", "user", None]), said, "x", "x", 1, "x"))
    turns += [(500, t, "user", "same", "x", "x", 1, "x") for t in range(40)]
    turns += [(501, t, "user", "same", "x", "x", 1, "x") for t in range(33)]
    turns += [(502, t, "user", "same", "x", "x", 1, "x") for t in range(40)]
    turns += [(503, 0, "user", "same", "x", "x", 1, "x")] * 20  # repeated rows
    turns += [(504, None, "user", "first", "x", "x", 1, "x"), (504, 0, "user", "b", None, None, None, None)]
    turns += [(504, 0, "user", "a", None, None, None, None), (None, 0, "user", "x", "x", "x", 1, "x")]
    turns += [(505, 0, "user", "long " * 50000, "x", "x", 1, "x"), (507, 0, "us", "er", "", "", 0, "")]
    turns += [(508, 0, "u", "ser", "", "", 0, ""), (506, 0, "user", "same", "x", "x", 1, "x")]
    turns += [(c, 0, "user", "alone", "x", "x", 1, "x") for c in range(610, 620)]
    rng.shuffle(turns)
    return turns


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, seed):
    turns = random_turns(seed)
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    assert found_trie(prefixtrie.prefix_trie(df)) == plain_trie(sequences(turns))


def test_prefix_trie_of_rebuilt_conversations(spark):
    turns = random_turns(3)
    own = prefixtrie.numbered_turns(spark.createDataFrame(turns, TURNS).repartition(3))
    want = rebuilt(sequences(turns))
    assert any(not path for path in want.values())  # some are left without turns
    assert found_trie(prefixtrie.build_trie(*prefixtrie.with_shared_starts(*own))) == plain_trie(want)


def test_prefix_trie_of_few_rows(spark):
    assert found_trie(prefixtrie.prefix_trie(frame(spark, [], TURNS))) == {}
    one = frame(spark, [(3, None, None, None, None, None, None, None)], TURNS)
    assert found_trie(prefixtrie.prefix_trie(one)) == plain_trie({3: [("", "")]})
    assert found_trie(prefixtrie.prefix_trie(one.where("conv_id is null"))) == {}


def test_a_conversation_in_many_partitions_is_numbered_through(spark):
    data = spark.range(20000).selectExpr(
        "if(id % 3 = 0, 1, id) as conv_id", "id as turn", "'user' as role", "cast(id % 7 as string) as text"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns, convs = prefixtrie.numbered_turns(data)
        own = rows(turns.where("conv_id = 1").orderBy("place").select("place", "chars"))
        assert [r[0] for r in own] == list(range(6668))  # every third row, and row 1
        sizes = data.repartitionByRange("conv_id", "turn").where("conv_id = 1").groupBy(F.spark_partition_id()).count()
        assert sizes.count() > 1
        assert rows(convs.where("conv_id = 1").select("n_turns")) == [(6668,)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_gray_walk_reaches_every_subset_by_one_filter_at_a_time():
    last, seen = 0, {0}
    for toggled, subset in filteraudit.gray_walk(5):
        assert last ^ subset == 1 << toggled
        seen.add(subset)
        last = subset
    assert seen == set(range(32))


def test_survivors_are_the_documents_that_fail_no_active_filter():
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 9, size=(3, 32, 3))
    states = filteraudit.survivors(cells)
    for subset in range(32):
        left = [m for m in range(32) if not m & subset]
        assert (states[:, subset] == cells[:, left].sum(axis=1)).all()


AUDITED = "doc_id long, text string, lang string, part string, mask string, good string, cell int, rows int"


def plain_audit(docs, labels):
    """{(part, order, step): columns}, applying the filters one after the other."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    judged = []
    for i, text, lang in docs:
        text = text or ""
        own = words(text)
        copy = i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs)
        fails = {"A": len(own) < 200, "B": 100 * len(set(own)) < 50 * len(own)}
        fails["C"] = 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)
        fails |= {"D": any(c in "#$%&*|" for c in text), "E": copy}
        judged.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    found = {}
    for part in {x[0] for x in judged}:
        own = [x for x in judged if x[0] == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left_now = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in own)
                only = sum(x[1] == {f} for x in own)
                lost = sum(x[2] for x in gone), sum(x[3] for x in gone)
                found[part, "".join(order), step] = [len(left_now), len(gone), failing - len(gone), only, *lost]
                totals[f] += len(gone)
                left = left_now
        for (p, order, step), x in found.items():
            if p == part:
                x.append(totals[order[step - 1]])
    return {k: tuple(x) for k, x in found.items()}


def test_filter_audit(spark):
    rng = random.Random(5)
    texts = ["w " * 250, "", None, "Short One", " ".join(f"w{i}" for i in range(220)), "A" * 900, "a | b " * 300]
    texts += [" ".join(f"{'X' if i % 20 == 0 else 'x'}{i}\t" for i in range(300)), " x " * 40000, "é" * 40 + "B"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [docs[3]] * 3 + [(None, texts[0], "en"), (None, texts[0], "en"), (7, texts[4], "fr"), (7, texts[4], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)]
    labels += [(0, 1, 0), (0, 1, 1), (None, 1, 1), (99999, 1, 1)]
    df = frame(spark, [(*d, "k", "k", "k", 1, 1) for d in docs], AUDITED)
    marks = frame(spark, labels, "doc_id long, quality int, toxic int")
    found = filteraudit.audit_filters(df, marks)
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in found.collect()}
    assert got == plain_audit(docs, labels) and found.count() == len(got)


def test_filter_audit_without_rows(spark):
    df, marks = frame(spark, [], AUDITED), frame(spark, [], "doc_id long, quality int, toxic int")
    assert filteraudit.audit_filters(df, marks).count() == 0
    one = frame(spark, [(None, None, None, "k", "k", "k", 1, 1)], AUDITED)
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filteraudit.audit_filters(one, marks).collect()}
    assert got == plain_audit([(None, None, None)], [])


def test_packed_values_are_read_back():
    rng = np.random.default_rng(1)
    edges = np.array([0, 1, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], dtype=np.uint32)
    for n in [0, 1, 2, 3, 4, 5, 1000]:
        values = rng.choice(edges, size=n)
        control, data = tokenfiles.pack(values)
        assert (tokenfiles.unpack(control, data, n) == values).all()
        assert len(control) == -(-n // 4) and len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)


ODD_TEXTS = ["", None, " ", "\n\n", "a\n\nB", "a \nb", "don't 's'", "x  y", "é　\nz", "<|endoftext|>", "\u0085\ńa", "á.", "ab12 3\t\n "]


@pytest.mark.parametrize("window", [16, 8 << 20])
def test_chunks_give_the_ids_of_whole_texts(monkeypatch, window):
    monkeypatch.setattr(chunks, "WINDOW", window)
    rng = random.Random(9)
    signs = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "a", "The", "'s", "é", "12", "½", "_", "!!", "😀", "́", "\x1c", " "]
    texts = ODD_TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["x" * 3000]
    coder = bytelevel.Encoder(TOKENIZER)
    ids, at = coder.encode(pa.array(texts))
    want = coder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert coder.cut and [ids[s:e].tolist() for s, e in zip(at, at[1:])] == [x.ids for x in want]
    coder.cut = False
    assert (coder.encode(pa.array(texts))[0] == ids).all()
    assert len(coder.encode(pa.array([], pa.string()))[1]) == 1


DOCS = "doc_id long, text string, ids string, start string, shard int, n int, rank int"


def test_token_files(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    docs = [(rng.randint(-50, 500), rng.choice(ODD_TEXTS + ["w " * rng.randint(1, 400)])) for _ in range(300)]
    docs += [(None, "no id"), (None, None), (9, "again"), (9, "again"), (9, "other"), (700, "long text, " * 150000)]
    df = spark.createDataFrame([(*d, "k", "k", 1, 1, 1) for d in docs], DOCS).repartition(6)
    path = str(tmp_path / "files")
    tokenfiles.write_token_files(df, TOKENIZER, 0, path)
    coder = bytelevel.Encoder(TOKENIZER).library
    want = [(d[0], [*coder.encode(d[1] or "", add_special_tokens=False).ids, 0]) for d in docs]
    found = sorted(rows(tokenfiles.read_token_files(spark, path)), key=lambda r: r[1])
    assert [r[1] for r in found] == np.cumsum([0] + [r[2] for r in found])[:-1].tolist()
    assert [r[0] for r in found] == sorted((d[0] for d in docs), key=lambda i: (i is not None, i or 0))
    assert sorted(map(repr, ((r[0], list(r[3])) for r in found))) == sorted(map(repr, want))
    assert all(len(r[3]) == r[2] for r in found)
    counts = np.bincount([i for _, ids in want for i in ids])
    ranks = rows(spark.read.parquet(f"{path}/ranks").orderBy("rank"))
    assert [(r[1], r[2]) for r in ranks] == sorted(((i, c) for i, c in enumerate(counts.tolist()) if c), key=lambda x: (-x[1], x[0]))
    digests = {r[0]: (r[2], r[3]) for r in rows(tokenfiles.token_digests(df.where("doc_id = 700"), TOKENIZER))}
    long_ids = next(ids for i, ids in want if i == 700)
    assert digests == {700: (len(long_ids), zlib.crc32(np.array(long_ids, dtype="<u4").tobytes()))}


def test_token_files_without_rows(spark):
    assert tokenfiles.token_digests(frame(spark, [], DOCS), TOKENIZER).count() == 0
    one = frame(spark, [(1, None, "k", "k", 1, 1, 1)], DOCS)
    assert rows(tokenfiles.token_digests(one, TOKENIZER)) == [(1, 0, 1, zlib.crc32(b"\0\0\0\0"))]


def test_cuts_are_found_in_blocks_with_little_memory(monkeypatch):
    random = np.random.default_rng(3)
    letters = np.frombuffer("ab 1.\n\tÀ×ÿ".encode(), dtype=np.uint8)
    data, edges = random.choice(letters, 5_000), np.unique(random.integers(1, 5_000, 400))
    whole = bytelevel.cuts(data, edges)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(bytelevel, "BLOCK", size)
        assert np.array_equal(bytelevel.cuts(data, edges), whole)
    monkeypatch.undo()
    data = random.choice(letters, 8 << 20)
    tracemalloc.start()
    bytelevel.cuts(data, np.zeros(0, dtype=np.int64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * len(data)
