"""The pipeline and the registered corpus queries."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest
from test_corpus_operators import near_dup_truth, words_of

import __spark_entry__ as contract
from terraced.llm import queries, secret_layers

FOLDER = "/root/testdata/sf0.001"


def test_all_eleven_are_registered():
    names = set(contract.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {re.match(r"op\d+|", n)[0] for n in names} and "pipeline" in names


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.pin(stage(spark, docs, FOLDER), name)
        assert docs.columns == before.columns, name
        rows, old = docs.collect(), {r["doc_id"]: r for r in before.collect()}
        if name == "toxicity":
            assert 0.8 * len(old) < len(rows) <= len(old)
        if name == "near_dedup":
            truth = near_dup_truth([(r["doc_id"], r["text"]) for r in old.values()])
            assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _, c in truth if d == c)
        if name == "secrets":
            assert {r["doc_id"] for r in rows} == set(old)
            assert all(not secret_layers.findings(r["text"])[0] and r["n_chars"] == len(r["text"]) for r in rows)
        if name == "mixing":
            size = lambda rs: sum(len(words_of(r["text"])) for r in rs)
            assert abs(size(rows) - 1.5 * size(old.values())) < 0.02 * size(old.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.count() == docs.count()


def test_stages_bear_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(80)) + " password=abcdef123"
    rows = [(1, text, None, "x"), (1, text, None, "x"), (2, None, "s", "x"), (3, "", "s", "x"), (None, text, None, "x"), (None, "alone here", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, FOLDER)
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.pack_batches(spark, table, FOLDER).count() == table.count()
    kept = corpus_pipeline.keep_one_of_each(spark, docs, FOLDER).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 2, 3]
    mixed = corpus_pipeline.mix_sources(spark, docs.filter("doc_id = 1"), FOLDER)
    assert mixed.count() == 3


def test_different_texts_under_one_id_stay(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(1, one, "s"), (1, two, "s"), (1, two + " more", "s"), (2, one, "s"), (None, two, "s"), (None, "third text", "s"), (None, "third text", "t"), (3, "", "s"), (3, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = []
    for table in (docs, docs.repartition(5)):
        kept = corpus_pipeline.keep_one_of_each(spark, table, FOLDER).collect()
        found.append(sorted(r["text"] for r in kept))
        assert {r["doc_id"] for r in kept if r["text"] == one or r["text"].startswith(two)} == {1}
    texts = found[0]
    assert texts == found[1] and len(texts) == 5
    assert texts[:2] == ["", ""] and one in texts and "third text" in texts and sum(t.startswith(two) for t in texts) == 1


def test_mixing_deals_copies_to_repeated_rows(spark):
    rows = [(1, "same words here", "s")] * 500 + [(i, f"text {i} of its own", "s") for i in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = sum(len(words_of(t)) for _, t, _ in rows)
    mixed = corpus_pipeline.mix_sources(spark, docs, FOLDER).collect()
    assert abs(sum(len(words_of(r["text"])) for r in mixed) - 1.5 * before) < 10


def test_mixing_has_no_python(spark):
    df = queries.QUERIES["op1_pareto_mixing"](spark, FOLDER)
    assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(contract.oracle_sql().keys() & queries.QUERIES.keys()))
def test_equals_sql(spark, name):
    from compare import differences, duck

    assert differences(name, spark, duck(FOLDER), FOLDER) is None


def test_held_out_marks(spark):
    import zlib

    for name, folds, fold in (("op3_neighbour_quality", 4, 2), ("op10_toxicity_grammar", 3, 1)):
        rows = queries.QUERIES[name](spark, FOLDER).collect()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
        assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
