"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from panelnet.llm import cotraining, imatch, licenses, near_dup, packing, quality_rules, sentence_pieces, surrogates, token_records, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score string, label string, rep long, a int, b int, t long, x string, row binary, set_key string, held_out string, blob string, part string, role string"


def _words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "river", "stone", "light", "über", "日本", "green"]) + r.choice(["", "s", "ing", ","]) for _ in range(n))


LONG = _words(60_000, 1)
SAME = _words(80, 2)
ROWS = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, SAME), (5, SAME), (None, SAME), (7, SAME), (None, None), (9, "word"), (10, _words(70, 3)), (11, "x" * 100_000)]


def _table(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None, True, "s", "l", 1, 2, 3, 4, "x", b"r", "k", "h", "b", "p", "r") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return _table(spark, ROWS).repartition(3)


def _labels(spark, column):
    return spark.createDataFrame([(4, 1), (5, 0), (10, 1), (None, 1), (7, None), (99, 0)], f"doc_id long, {column} int")


def _per_row(spark):
    return {
        "imatch": imatch.fingerprint_pairs,
        "surrogates": lambda d: surrogates.surrogates(d, b"k"),
        "licenses": licenses.scan,
        "cotraining": lambda d: cotraining.scores(d, cotraining.train(d, _labels(spark, "quality"), cotraining.metadata(d))),
        "toxicity": lambda d: toxicity.scores(d, toxicity.train(d, _labels(spark, "toxic"))),
        "pieces": sentence_pieces.encode_digest,
        "records": lambda d: token_records.read_records(*token_records.write_records(d)),
        "rules": quality_rules.quality_rules,
        "near": near_dup.near_duplicates,
    }


@pytest.mark.parametrize("name", ["imatch", "surrogates", "licenses", "cotraining", "toxicity", "pieces", "records", "rules", "near"])
def test_a_row_for_a_row(spark, docs, name):
    got = _per_row(spark)[name](docs).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((d for d, _ in ROWS), key=str)
    by = [r.asDict() for r in got if r.doc_id == 5]
    by = [{k: v for k, v in r.items() if k not in ("start", "near_edited", "near_next", "edited_sha256", "edited_fingerprint")} for r in by]
    assert by[0] == by[1]


@pytest.mark.parametrize("name", ["imatch", "surrogates", "licenses", "cotraining", "toxicity", "pieces", "records", "rules", "near"])
def test_empty_table(spark, name):
    assert _per_row(spark)[name](_table(spark, [])).collect() == []


def test_filters_keep_columns_and_rows(spark, docs):
    weights = toxicity.train(docs, _labels(spark, "toxic"))
    for out in (quality_rules.kept_rows(docs), toxicity.not_toxic(docs, weights), near_dup.one_of_each(docs), surrogates.anonymous(docs, b"k")):
        assert out.schema.simpleString() == docs.schema.simpleString()
    assert surrogates.anonymous(docs, b"k").count() == len(ROWS)
    kept = {r.doc_id for r in near_dup.one_of_each(docs).collect()}
    assert 5 in kept and 7 not in kept and {1, 2, 3, 4, 9, 10, 11} <= kept
    assert {r.doc_id for r in quality_rules.kept_rows(docs).collect()} <= {4, 5, 7, 10, None}
    empty = _table(spark, [])
    for f in (quality_rules.kept_rows, lambda d: toxicity.not_toxic(d, weights), near_dup.one_of_each, lambda d: surrogates.anonymous(d, b"k"), packing.pack):
        assert f(empty).count() == 0


def test_defined_results(spark, docs):
    near = {r.doc_id: r for r in near_dup.near_duplicates(docs).where("doc_id is not null").collect()}
    assert near[1].n_shingles == near[2].n_shingles == near[3].n_shingles == 0
    assert [near[i].component_id for i in (1, 2, 3, 7, 9)] == [1, 2, 3, 5, 9] and near[9].n_shingles == 1
    none = [r for r in near_dup.near_duplicates(docs).where("doc_id is null").collect()]
    assert sorted((r.component_id, r.kept) for r in none if r.n_shingles) == [(5, False)]
    assert [r.kept for r in none if not r.n_shingles] == [True]
    pieces = {r.doc_id: r.n_tokens for r in sentence_pieces.encode_digest(docs).collect()}
    assert pieces[1] == pieces[2] == 0 and pieces[3] > 0
    records = sorted(token_records.read_records(*token_records.write_records(docs)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in records] == [None, None, 1, 2, 3, 4, 5, 5, 7, 9, 10, 11]
    assert [r.n_tokens for r in records if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    text = {r.doc_id: r.text for r in surrogates.surrogates(docs, b"k").collect()}
    assert text[1] is None and text[2] == "" and text[4] == LONG


def test_packing_covers_everything(spark, docs):
    got = packing.pack(docs).collect()
    assert {r.doc_id for r in got} == {d for d, _ in ROWS} and sum(r.start == 0 for r in got) == len(ROWS)
    total = sum(r.length for r in got)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
    records = token_records.read_records(*token_records.write_records(docs)).collect()
    assert total == sum(r.n_tokens for r in records)
