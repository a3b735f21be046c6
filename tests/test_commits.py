"""Commit log, isolated failures, jumps over cuts, mergeable quantiles."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.operators import jumps
from logweave.plans import rollup
from logweave.streaming import commits, jobs
from test_catalog import SF


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "t"))
    rows = lambda n: spark.range(n).toDF("id")
    log.write("offsets 0-9", {"a": rows(3), "b": rows(4)})
    rows(5).write.parquet(f"{log.path}/a/token={log.token('a', 'offsets 10-19')}")  # dies before b
    assert (log.read("a").count(), log.read("b").count()) == (3, 4)
    for _ in range(2):  # sent again, twice
        log.write("offsets 10-19", {"a": rows(5), "b": rows(6)})
    assert (log.read("a").count(), log.read("b").count()) == (8, 10)


def test_index_stream_that_dies_lands_once(spark):
    plain = sorted(map(tuple, commits.load_index_stream(spark, SF).collect()))
    assert sorted(map(tuple, commits.load_index_stream(spark, SF, fail_at=(1, "dlq_events")).collect())) == plain


def test_bad_records_are_isolated(spark):
    def parse(batch):
        values = batch.column("x").to_pylist()
        if any(v is not None and v % 7 == 0 for v in values):
            raise ZeroDivisionError("seven")
        return pa.RecordBatch.from_arrays([pa.array([None if v is None else 2 * v for v in values], pa.int64())], ["y"])

    got = commits.isolated(spark.range(0, 1000, 1, 3).selectExpr("id as at", "case when id = 5 then null else id end as x"), parse, "y long", ["at"]).collect()
    assert sorted((r["at"], r["y"], r["reason"]) for r in got if r["at"] != 5) == [(i, None if i % 7 == 0 else 2 * i, "ZeroDivisionError: seven" if i % 7 == 0 else None) for i in range(1000) if i != 5]
    assert commits.isolated(spark.range(0).selectExpr("id as at", "id as x"), parse, "y long", ["at"]).collect() == []


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart, so one key lies in several."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def greedy(records, most_bytes, most_records, most_seconds):
    out, first, size, n, since, latest = [], None, 0, 0, 0, None
    for pos, (b, t) in enumerate(records):
        latest = t if latest is None else max(latest, t)
        if first is None or n >= most_records or size + b > most_bytes or latest - since >= most_seconds:
            if first is not None:
                out.append((first, n, size))
            first, size, n, since = pos, 0, 0, latest
        size, n = size + b, n + 1
    return out + ([(first, n, size)] if first is not None else [])


def test_segments_against_a_walk(spark, many_ranges):
    rng = random.Random(7)
    keys = {"hot": 400, "b": 37, "one": 1, None: 5}
    data = {k: [(rng.choice([0, 3, 50, 999]), 10 * i + rng.randrange(-40, 300)) for i in range(n)] for k, n in keys.items()}
    rows = [(k, i, *r) for k, rs in data.items() for i, r in enumerate(rs)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, i long, b long, t long").repartition(7)
    for limits in ((200, 10, 100), (5000, 1, 10**6), (10**9, 10**6, 10**9), (0, 10**6, 10**6)):
        got = jumps.limited_segments(frame, "k", ["i"], F.col("b"), F.col("t"), *limits).collect()
        assert sorted((str(r["k"]), r["first_pos"], r["n"], r["bytes"]) for r in got) == sorted((str(k), *s) for k, rs in data.items() for s in greedy(rs, *limits)), limits
    assert jumps.limited_segments(frame.limit(0), "k", ["i"], F.col("b"), F.col("t"), 1, 1, 1).collect() == []


def test_no_whole_key_lies_in_one_task(spark, many_ranges):
    frame = spark.range(1000).selectExpr("'one' as k", "id as i", "id as t").repartition(4)
    ranked = jumps.ranked(frame, "k", ["i"], F.lit(1), F.col("t"))
    assert ranked.select(F.col("i") == F.col("__pos"), F.col("__upto") == F.col("i") + 1).distinct().collect() == [(True, True)]
    assert frame.select("k", "i").transform(lambda x: jumps.dealt(x, F.col("k"), F.col("i"))).select("__part").distinct().count() > 1


def test_bursts_equal_the_stream(spark, many_ranges):
    assert sorted(map(tuple, jobs.burst_alert_stream(spark, SF).collect())) == sorted(map(tuple, jumps.QUERIES["burst_alerts"](spark, SF).collect()))


@pytest.mark.parametrize("shape", ["even", "hot", "ties"])
def test_merged_quantiles_keep_their_bound(spark, shape):
    skew = {"even": "id % 10007", "hot": "case when id % 3 = 0 then 7 else id end", "ties": "cast(pow(id % 100, 3) as bigint)"}[shape]
    rows = spark.range(60_000).selectExpr("'t' as tenant_id", "cast(id % 3 as string) as source_id", "timestamp_seconds(id) as received_time", f"case when id % 50 = 0 then null else {skew} end as skew_ms")
    for r in rollup.skew_health(rows, rollup.skew_sketches(rows)).collect():
        assert r["rank_error"] <= 0.03 and r["least"] <= r["p50"] <= r["most"]
    exact = rows.groupBy("source_id").agg(F.percentile("skew_ms", F.lit(0.5)).alias("p"), F.count("skew_ms").alias("n"))
    assert {(r["source_id"], r["n"]) for r in exact.collect()} == {(r["source_id"], r["n"]) for r in rollup.merged_skew(rollup.skew_sketches(rows), ["source_id"]).collect()}
    assert rollup.merged_skew(rollup.skew_sketches(rows.limit(0)), ["source_id"]).collect() == []
