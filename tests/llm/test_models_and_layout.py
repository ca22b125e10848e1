"""Classifiers on held-out texts, chat formatting and shards."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from aulario.llm import chat, quality, sharding, toxicity
from tests.conftest import frame, rows

DOCS = "doc_id long, text string, score string, label string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def toxic_rows(n, start):
    rng = random.Random(start)
    out = []
    for i in range(start, start + n):
        own, bad = prose(rng, rng.randint(20, 200)).split(" "), int(rng.random() < 0.4)
        if bad:
            for _ in range(1 + len(own) // 50):
                own.insert(rng.randrange(len(own)), rng.choice(["idiot", "Worthless", "scum"]))
        out.append((i, " ".join(own), bad))
    return out


ODD = [(90001, None), (90002, ""), (90003, " "), (90004, "idiot"), (90005, "th er " * 30000)]


def test_toxicity_on_held_out_texts(spark):
    learned, asked = toxic_rows(400, 0), toxic_rows(200, 5000)
    docs = frame(spark, [(i, t, "k", "k") for i, t, _ in learned + asked] + [(*d, "k", "k") for d in ODD + ODD[:1]], DOCS)
    labels = frame(spark, [(i, y) for i, _, y in learned] + [(None, 1), (7, None), (8, 5)], "doc_id long, label int")
    model = toxicity.train(docs, labels, per_class=100)
    found = {r[0]: r[1] for r in rows(toxicity.score(docs, model))}
    right = sum((found[i] >= 0.7) == bool(y) for i, _, y in asked)
    assert right >= 0.95 * len(asked)
    assert all(0 <= x <= 1 for x in found.values()) and found[90001] == found[90002] and found[90004] > 0.7
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        r.doc_id for r in docs.collect() if found[r.doc_id] < 0.7
    )


def test_toxicity_without_one_class_or_rows(spark):
    docs = frame(spark, [(1, "a", "k", "k"), (None, None, None, None)], DOCS)
    none = frame(spark, [], "doc_id long, label int")
    assert {r[1] for r in rows(toxicity.score(docs, toxicity.train(docs, none)))} == {0.5}
    one = frame(spark, [(1, 1)], "doc_id long, label int")
    assert all(r[1] > 0.5 for r in rows(toxicity.score(docs, toxicity.train(docs, one))))
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


def quality_rows(n, start):
    rng = random.Random(start)
    out = []
    for i in range(start, start + n):
        text, good = prose(rng, rng.randint(20, 150)), int(rng.random() < 0.8)
        if not good:
            text = rng.choice(
                [" ".join(w for w in text.split(" ") for _ in range(9)), text.replace(" ", " | "), text.upper().replace(" ", "!! ")]
            )
        out.append((i, text, good))
    return out


def test_quality_on_held_out_texts(spark):
    learned, asked = quality_rows(400, 0), quality_rows(200, 5000)
    docs = frame(spark, [(i, t, "k", "k") for i, t, _ in learned + asked] + [(*d, "k", "k") for d in ODD + ODD[:1]], DOCS)
    labels = frame(spark, [(i, y) for i, _, y in learned] + [(None, 1), (7, None)], "doc_id long, label int")
    model = quality.train(docs, labels, most_positive=150)
    found = {r[0]: r[1] for r in rows(quality.score(docs, model))}
    right = sum((found[i] >= 0.3) == bool(y) for i, _, y in asked)
    assert right >= 0.95 * len(asked)
    assert all(0 <= x <= 1 for x in found.values()) and found[90001] == found[90002]


def test_quality_without_labels_or_rows(spark):
    docs = frame(spark, [(1, "a", "k", "k"), (None, None, None, None)], DOCS)
    none = frame(spark, [], "doc_id long, label int")
    assert {r[1] for r in rows(quality.score(docs, quality.train(docs, none)))} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), none)).count() == 0


def test_repeated_documents_and_labels_count_once(spark):
    learned = toxic_rows(60, 0)
    docs = [(i, t, "k", "k") for i, t, _ in learned]
    plain = frame(spark, docs, DOCS)
    repeated = spark.createDataFrame(docs + docs[:5] * 40, DOCS).repartition(7)
    once = frame(spark, [(i, y) for i, _, y in learned], "doc_id long, label int")
    often = spark.createDataFrame([(i, y) for i, _, y in learned for _ in range(1 + i % 4)], "doc_id long, label int")
    sample, counts = toxicity.labelled_sample(repeated, often, 10)
    assert sample.count() == 20 and counts == toxicity.labelled_sample(plain, once, 10)[1]
    assert sorted(rows(sample)) == sorted(rows(toxicity.labelled_sample(plain, once, 10)[0]))
    a, b = (quality._positives(d, m.where("label = 1").select("doc_id"), 15) for d, m in ((plain, once), (repeated, often)))
    assert a.shape == b.shape and (a == b).all()
    marks = frame(spark, [(1, 0), (1, 1)], "doc_id long, label int")
    assert rows(toxicity.labelled_sample(plain, marks, 10)[0].select("label")) == [(1,)]


def test_a_step_below_zero_of_the_bad_risk_is_taken_back():
    import numpy as np

    rng = np.random.default_rng(0)
    same = rng.normal(size=(300, quality.WIDTH))
    v = quality.fit(same, lambda at: quality.sums(same, at), 0.99)  # no negatives at all: nothing to tell apart
    g = quality.with_one(same) @ v
    assert np.isfinite(v).all() and np.logaddexp(0, g).mean() - 0.99 * np.logaddexp(0, g).mean() >= 0


def test_prior_is_the_share_of_positives():
    import numpy as np

    rng = np.random.default_rng(1)
    bounds = np.linspace(-6, 6, quality.BINS - 1)
    counts = lambda x: np.bincount(np.searchsorted(bounds, x), minlength=quality.BINS)
    positive = counts(rng.normal(2, 1, 4000))
    for share in (0.2, 0.5, 0.9):
        web = np.concatenate([rng.normal(2, 1, int(20000 * share)), rng.normal(-2, 1, int(20000 * (1 - share)))])
        assert abs(quality.estimated_prior(positive, counts(web)) - share) < 0.05


TEXTS = ["", "\\", "\\\\l", "<turn>", "</turn>\n", "\\</turn>", "<|says|>", "<|", "\\l|x", "a\nb<turn", "é😀<|image|>", None]


def test_chats_are_read_back(spark):
    rng = random.Random(1)
    turns = [
        (c, t, rng.choice(["user", "assistant", "sys<|tem", None]), rng.choice(TEXTS), "k")
        for c in range(20)
        for t in range(rng.randint(1, 9))
    ]
    turns += [(30, 0, "assistant", "same", "k")] * 2 + [(30, None, "user", "first", "k"), (None, 0, "user", "x", "k")]
    turns += [(31, 0, "assistant", "long </turn> " * 20000, "k")]
    df = frame(spark, turns, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(df.withColumn("parts", chat.text_parts(F.col("text"))))
    read = chat.read_turns(F.col("formatted"))
    texts = F.transform(read, lambda t: F.struct(t["role"], chat.unescape(t["content"])))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    found = {r[0]: (r[1], [tuple(x) for x in r[2]], r[3]) for r in rows(made.select("conv_id", "n_turns", texts, loss))}
    want = {}
    for c in {t[0] for t in turns} - {None}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = [(t[2] or "", t[3] or "") for t in own]
        want[c] = (len(said), said, "".join(x for r, x in said if r == "assistant"))
    assert found == want


def test_attachments_have_places_and_tokens(spark):
    parts = [
        ("text", "see <|image|>", None, None), ("image", None, "a.png", 9), ("odd", "x", None, None),
        ("audio", None, "b.wav", 2), None, ("document", None, None, None),
    ]
    df = frame(spark, [(1, 1, "user", parts), (1, 0, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    (row,) = chat.format_chats(df).collect()
    assert row.formatted == "<turn>user<|says|></turn>\n<turn>user<|says|>see \\l|image|><|image|>x<|audio|><|document|></turn>\n"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in row.attachments] == [
        (1, "image", "a.png", 9), (1, "audio", "b.wav", 50), (1, "document", None, 0)
    ]
    assert all(row.formatted[a.at :].startswith(f"<|{a.type}|>") for a in row.attachments)
    assert row.attachment_tokens == 59 and row.loss_spans == []
    assert chat.format_chats(df.limit(0)).count() == 0


def shards_of(spark, docs, **options):
    df = frame(spark, [(*d, "k", 1) for d in docs], "doc_id long, text string, shard string, h int").repartition(3)
    found = sharding.shard_documents(df, **options)
    assert found.columns == ["doc_id", "text", "h", "size", "shard", "slot"]
    return [(r.doc_id, r.text, r.size, r.shard, r.slot) for r in found.collect()]


def test_shards_have_near_equal_bytes_and_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 50)
    rng = random.Random(8)
    docs = [(i, "é" * rng.randint(0, 60)) for i in range(-500, 1500)] + [(9000 + i, "copy " * 8) for i in range(1000)]
    docs += [(None, "x"), (None, None), (7, "twice"), (7, "twice")]
    found = shards_of(spark, docs, shards=8, tolerance=0.01)
    assert sorted((i, t) for i, t, *_ in found if i is not None) == sorted((i, t) for i, t in docs if i is not None)
    assert all(size == len((t or "").encode()) + 1 for _, t, size, *_ in found)
    sums = [sum(r[2] for r in found if r[3] == s) for s in range(8)]
    mean = sum(sums) / 8
    assert max(sums) - min(sums) <= 0.05 * mean
    for s in range(8):
        assert sorted(r[4] for r in found if r[3] == s) == list(range(sum(r[3] == s for r in found)))


def test_equal_texts_stay_together_where_bytes_allow(spark):
    docs = [(i, f"text {i // 3}" * 5) for i in range(3000)]
    found = shards_of(spark, docs, shards=4)
    places = {}
    for _, text, _, shard, _ in found:
        places.setdefault(text, set()).add(shard)
    assert sum(len(p) > 1 for p in places.values()) == 0


def test_one_text_or_few_rows_are_sharded_too(spark):
    found = shards_of(spark, [(i, "all the same") for i in range(1, 801)], shards=8)
    assert [sum(r[3] == s for r in found) for s in range(8)] == [100] * 8
    assert sorted(r[4] for r in shards_of(spark, [(1, "a")] * 3, shards=8)) == [0, 1, 2]
    assert shards_of(spark, [], shards=8) == []
    assert {r[3] for r in shards_of(spark, [(-(1 << 63), "a"), ((1 << 63) - 1, "a")], shards=2)} == {0, 1}
