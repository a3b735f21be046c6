"""The partitioned log source in batch and as a stream, and the table function."""

from __future__ import annotations

import pytest

from logweave.functions import layers
from logweave.operators import detail
from logweave.sources import topics
from test_catalog import SF


def test_a_stream_continues_from_its_offsets(spark, tmp_path):
    topics.register(spark)
    root, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows = lambda a, b, part: spark.range(a, b).selectExpr("'raw.x' as topic", f"{part} as part", "id as ord", "concat('line ', id) as value")
    run = lambda: spark.readStream.format(topics.FORMAT).load(root).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.format(topics.FORMAT).load(root).collect() == []
    topics.write_topics(rows(0, 25, 0), root, lines=10).collect()
    run()
    topics.write_topics(rows(25, 40, 0).unionByName(rows(0, 3, 1)), root, begin={"raw.x/0": 25}, lines=10).collect()
    run()
    run()
    got = sorted((r["partition"], r["offset"], r["value"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, i, f"line {i}") for i in range(40)] + [(1, i, f"line {i}") for i in range(3)]
    assert spark.read.format(topics.FORMAT).option("topics", "raw.y").load(root).count() == 0


def test_push_events_rows(spark):
    topics.register(spark)
    bodies = [(1, '{"event":"x","time":"7","index":3,"k":[1]}{"a":{"z":1,"b":2}} [3]'), (2, '{"event":1,"time":"soon"}'), (3, None), (4, " "), (5, "[" * 100_000)]
    spark.createDataFrame(bodies, "k int, body string").createOrReplaceTempView("bodies")
    got = sorted(tuple(r) for r in spark.sql("select k, n, event, time, e.index, extras, coalesce(reject, '') from bodies, lateral push_events(body) e").collect())
    assert got == [(1, 0, "x", 7.0, "3", {"k": "[1]"}, ""), (1, 1, '{"a":{"b":2,"z":1}}', None, None, {}, ""), (1, 2, "[3]", None, None, {}, ""), (2, 0, None, None, None, {}, "malformed"), (5, 0, None, None, None, {}, "malformed")]
    assert "extras" not in spark.sql("select e.* from bodies, lateral push_events(body, false) e").columns
    with pytest.raises(Exception, match="texts"):
        spark.sql("select * from bodies, lateral push_events(k)").collect()


def test_event_parts_take_one_exchange(spark):
    plan = detail.event_detail(detail.detail_tables(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lines_without_contract(spark):
    lines = [None, "", "{", '{"m":"a\\"b"}', '{"k":"1"} tail=1', "<1>x", "a;b;c;d", "CEF:0|a"]
    got = layers.peel_auto(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")).orderBy("n").collect()
    assert [r["parse_path"] for r in got] == ["auto:text", "auto:text", "auto:text", "auto:json", "auto:json", "auto:text", "auto:delimited", "auto:text"]
    assert got[4]["fields"] == {"json.k": "1", "json.__rest": "tail=1", "kv.tail": "1"} and lines[4][got[4]["spans"]["kv.tail"]["start"]] == "1"
