"""Steps that every line passes: where pieces begin, and tokens with their line's shape in one shuffle without a join."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions import drift
from logweave.functions.layers import starts


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pieces_begin_where_they_do(spark):
    frame = spark.range(1, 200).select(F.transform(F.sequence(F.lit(1), "id"), lambda x: F.repeat(F.lit("é"), (x % 4).cast("int"))).alias("p"))
    for gap in (0, 3):
        got = frame.select("p", starts(F.col("p"), gap).alias("s"))
        assert all(r["s"] == [sum(map(len, r["p"][:i])) + i * gap for i in range(len(r["p"]))] for r in got.collect())


def test_shapes_come_without_a_join(spark):
    tokens = spark.createDataFrame([("a", 0, "word", "x"), ("a", 1, "int", "1"), ("b", 0, "word", "x"), ("b", 1, "int", "1"), ("c", 0, "word", "y")], "k string, ord int, kind string, value string")
    positions = drift.variable_positions(drift.shaped_tokens(tokens, "k"))
    assert "Join" not in plan_of(positions)
    assert sorted(map(tuple, positions.collect())) == [("x <int>", 0, False, "x"), ("x <int>", 1, True, "1"), ("y", 0, False, "y")]
