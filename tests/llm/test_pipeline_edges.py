"""The whole pipeline on nulls, repeated and missing ids, a clashing column, and an empty table."""

import corpus_pipeline
from tests.llm.test_edges import ROWS, _words


def _folder(spark, tmp_path, rows):
    docs = [(d, t, "en", "s", len(t or ""), True) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept boolean").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 0), (None, 1), (7, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_odd_rows(spark, tmp_path):
    near = _words(200, 8)
    rows = [*ROWS, (20, near), (21, near), (None, near + " end"), (22, None)]
    got = corpus_pipeline.run(spark, _folder(spark, tmp_path, rows)).collect()
    ids = {r.doc_id for r in got}
    assert 21 not in ids and ids <= {d for d, _ in rows} and 20 in ids
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path, [])).collect() == []
