"""Small files of a topic share tasks."""

from __future__ import annotations

from logweave.session import shared_path
from logweave.sources import topics


def test_small_files_share_a_task(spark):
    topics.register(spark)
    root = shared_path(spark, "small-files")
    rows = spark.range(500).selectExpr("'raw.x' as topic", "cast(id % 2 as int) as part", "id as ord", "concat('line ', id) as value")
    assert topics.write_topics(rows, root, lines=10).count() == 50
    got = spark.read.format(topics.FORMAT).load(root)
    assert got.rdd.getNumPartitions() == 2
    assert sorted((r["partition"], r["offset"], r["value"]) for r in got.collect()) == sorted((i % 2, i // 2, f"line {i}") for i in range(500))
