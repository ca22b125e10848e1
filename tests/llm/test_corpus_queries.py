"""Registered corpus queries next to their SQL, and the pipeline next to plain versions of its stages."""

from __future__ import annotations

from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import sentencepiece as library

import corpus_pipeline
from aulario.llm import toxicity
from aulario.llm.oracle import corpus_sql
from aulario.llm.queries import corpus_queries, learned_labels, table
from aulario.llm.work import written
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no generated tables here")


def as_set(columns, data):
    return sorted(repr(tuple(r[c] for c in sorted(columns))) for r in data)


@pytest.mark.parametrize("name", list(corpus_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = corpus_queries()[name](spark, SF_DIR)
    want = con.execute(corpus_sql()[name]).to_arrow_table().to_pylist()
    assert sorted(found.columns) == sorted(want[0])
    assert as_set(found.columns, [r.asDict() for r in found.collect()]) == as_set(found.columns, want)


@pytest.mark.parametrize("name", sorted(set(corpus_queries()) - set(corpus_sql())))
def test_query_without_sql_covers_all_documents(spark, name):
    found = corpus_queries()[name](spark, SF_DIR).collect()
    docs = table(spark, SF_DIR, "documents")
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, kept = docs.columns, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = written(stage(spark, docs, SF_DIR))
        after = {r.doc_id: r for r in out.collect()}
        kept[name] = before, after
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        else:
            last = out.count()
        if name == "toxicity":
            model = toxicity.train(docs, learned_labels(table(spark, SF_DIR, "labels"), "toxic", 1, 3))
            scores = {r[0]: r[1] for r in toxicity.score(docs, model).collect()}
            assert set(after) == {i for i in before if scores[i] < 0.7} and len(after) < len(before)
        docs = out
    before, after = kept["line_dedup"]
    want = brute.cleaned([(i, r.source, r.text) for i, r in before.items()], corpus_pipeline.BOILERPLATE_SITES)
    assert {i: r.text for i, r in after.items()} == {i: t for i, (t, _) in want.items()}
    before, after = kept["simhash_near_dedup"]
    place = brute.near_groups([(i, r.text) for i, r in before.items()], 4, 4)
    assert set(after) == set(place.values()) and len(after) < len(before)
    before, after = kept["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    hit = brute.hits([(i, r.text) for i, r in before.items()], items, 10)
    assert set(after) == {i for i, (_, p, _) in hit.items() if not p}
    before, after = kept["sentencepiece"]
    other = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {i: (r.ids, r.decoded) for i, r in after.items()} == {
        i: (other.encode(r.text, add_eos=True), r.text) for i, r in before.items()
    }
    assert corpus_pipeline.run(spark, SF_DIR).count() == last


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "one two three four five six seven eight nine ten eleven"
BASE = [
    (1, "clean words here and there", "en", "a", 26),
    (2, f"before {ITEM} after", "en", "b", 60),
    (3, "stupid idiot scum " * 9, "en", "c", 160),
    (4, "long " * 60000, "en", None, 300000),
    (5, "clean words here and there", None, "d", 26),
]
ODD = [(6, None, None, None, None), (7, "", "en", "a", 0), (None, "no id at all", None, None, None), (8, " \n ", "en", "a", 3)]


@pytest.mark.parametrize(
    "rows_,labelled",
    [([], True), (BASE, False), (BASE + ODD, True), (BASE * 3 + ODD * 2, True)],
    ids=["empty", "no labels", "nulls", "repeated"],
)
def test_pipeline_of_odd_tables(spark, tmp_path, rows_, labelled):
    tables = {
        "documents": (rows_, DOCS),
        "labels": ([(3, 0, 1), (1, 1, 0), (None, None, None)] if labelled else [], "doc_id long, quality int, toxic int"),
        "benchmark": ([("i1", ITEM), ("i2", None), ("i3", "")], "item_id string, text string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    if not rows_:
        assert found == []
        return
    times = 3 if len(rows_) > len(BASE + ODD) else 1
    assert 2 not in found and found.count(1) == times and found.count(4) == times  # a leak goes, clean ones stay
    assert 5 not in found  # a copy of 1
    if ODD[0] in rows_:
        assert None in found and 6 in found and 7 not in found and 8 not in found  # texts without words are copies
