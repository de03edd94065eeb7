"""Configuration, the command line's steps, and the streaming memory against the batch one."""

import json

import pytest

from panelnet import config
from panelnet.operators import graph
from panelnet.plans import pipeline
from panelnet.streaming.memory import stream_memory

D = "/root/testdata/sf0.001"


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"knn": 7, "months": ["1999-01", "1999-12"]}))
    c = config.load(p)
    assert c.knn == 7 and c.months == ("1999-01", "1999-12") and c.k == config.Config().k and set(c.block_weights) == {"level", "structure", "seasonality"}
    p.write_text('{"nope": 1}')
    with pytest.raises(ValueError, match="nope"):
        config.load(p)


def test_unknown_names(spark):
    x = pipeline.features(spark, D, config.Config())
    with pytest.raises(ValueError, match="unknown rule"):
        pipeline.month_graph(spark, D, config.Config(), x, "none", 3)
    with pytest.raises(ValueError, match="unknown method"):
        pipeline.static_labels("none", x, x, 3, config.Config())


def test_rules_and_final_model(spark):
    cfg = config.Config(knn=4, k=3)
    x = pipeline.features(spark, D, cfg)
    for rule in pipeline.RULES:
        e = {(r.src, r.dst): r.w for r in pipeline.month_graph(spark, D, cfg, x, rule, 5).collect()}
        assert e and all(a != b and abs(e[b, a] - w) < 1e-9 for (a, b), w in e.items())
    final = pipeline.final_labels(spark, D, cfg, 3).collect()
    assert len(final) == 30 and {r.t for r in final} == {0, 1, 2}


def test_streaming_memory(spark, tmp_path):
    rows = [(t, 1, 2, 1.0 + t) for t in range(4)] + [(0, 2, 3, 5.0), (3, 2, 3, 1.0), (2, 4, 5, 2.0)]
    schema = "t int, src long, dst long, w double"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[0] // 2 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_memory(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in")), 0.5)
    q = stream.writeStream.format("memory").queryName("mem").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.t, r.src): round(r.w, 9) for r in spark.table("mem").collect()}
    batch = {(r.t, r.src): round(r.w, 9) for r in graph.memory(spark.createDataFrame(rows, schema), 4, 0.5).collect()}
    assert got == {k: batch[k] for k in got} and len(got) == len(rows)
