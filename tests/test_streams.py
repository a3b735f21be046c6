"""How streams read what is there: the number of micro-batches doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.session import shared_path
from logweave.streaming import jobs


def batches_of(spark, files: int) -> tuple[int, int]:
    path, seen = shared_path(spark, "batches"), []
    stream = jobs.file_stream(spark.range(files * 3).withColumn("k", F.col("id") % 5).repartition(files), "many-files")
    jobs.run_once(stream, lambda batch, n: seen.append(batch.count()), path)
    return len(seen), sum(seen)


def test_batches_dont_grow_with_the_table(spark):
    assert batches_of(spark, 8) == (4, 24)
    n, rows = batches_of(spark, 60)
    assert n <= jobs.BATCHES and rows == 180


def test_rollup_writes_a_day_once_a_batch(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(jobs, "shared_path", lambda s, tag: paths.append(shared_path(s, tag)) or paths[-1])
    got = jobs.minute_rollup_stream(spark, "/root/testdata/sf0.001")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    files = spark.read.parquet(f"{[p for p in paths if '/rollup-' in p and 'days' not in p][0]}/data").select(F.input_file_name().alias("f"), "day").distinct()
    assert files.groupBy("day").count().agg(F.max("count")).first()[0] == 1
