"""Cuts that depend on the cut before, without one task per key (W7 with all limits, W9 with reset).

A segment ends where a limit is reached counting from its own start, so where it ends depends on where
it began. Instead of walking a key's records in one task, every record gets the start that would follow
if it were one, by a range lookup; the starts that really occur are then found by jumps of 1, 2, 4 and so
on. Ranges of records are dealt over all tasks, also those of one key; only counts per range meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.bindings import LOG, log_view
from logweave.session import stored


def dealt(rows: DataFrame, *order: Column) -> DataFrame:
    """rows in ranges of the order, a range a task, with its number as __part; stored, so numbers stay as they are."""
    return stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def ranked(rows: DataFrame, key: str, order: list[str], size: Column, second: Column) -> DataFrame:
    """rows with __pos (0-based place in its key), __upto (running sum of size, its own included), __latest (greatest second so far) and __n (rows of its key).

    Running values of a range start at what the ranges before hold for the key, a few numbers per range.
    """
    parts = dealt(rows.withColumns({"__size": size.cast("long"), "__at": second.cast("long")}), *[F.col(c) for c in (key, *order)])
    sums = parts.groupBy("__part", key).agg(F.count("*").alias("n"), F.sum("__size").alias("size"), F.max("__at").alias("at"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select("__part", F.col(key).alias("__k"), F.coalesce(F.sum("n").over(before), zero).alias("n0"), F.coalesce(F.sum("size").over(before), zero).alias("s0"), F.max("at").over(before).alias("a0"), F.sum("n").over(Window.partitionBy(key)).alias("__n"))
    own = Window.partitionBy("__part", key).orderBy(*order)
    here = own.rowsBetween(Window.unboundedPreceding, 0)
    inside = parts.withColumns({"__pos": F.row_number().over(own) - 1, "__upto": F.sum("__size").over(here), "__latest": F.max("__at").over(here)}).withColumnRenamed("__part", "__p")
    joined = inside.join(sums, (F.col("__p") == F.col("__part")) & F.col(key).eqNullSafe(F.col("__k")))
    return joined.withColumns({"__pos": F.col("__pos") + F.col("n0"), "__upto": F.col("__upto") + F.col("s0"), "__latest": F.greatest("__latest", "a0")}).drop("__p", "__part", "__k", "n0", "s0", "a0")


def following(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (k, id, v) the row (k, v, pos) of its key with the smallest v not below its own, of equal v the smallest pos: (k, id, pos), null if there is none."""
    none = F.lit(None).cast("long")
    both = rows.select("k", "v", F.lit(1).alias("kind"), "pos", none.alias("id")).unionByName(probes.select("k", "v", F.lit(0).alias("kind"), none.alias("pos"), "id"))
    parts = dealt(both, F.col("k"), F.col("v"), F.col("kind"))
    back = Window.partitionBy("__part", "k").orderBy(F.desc("v"), F.desc("kind"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    inside = parts.withColumn("hit", F.last("pos", ignorenulls=True).over(back)).where("kind = 0")
    firsts = parts.where("kind = 1").groupBy("__part", "k").agg(F.min(F.struct("v", "pos")).alias("least"))
    every = parts.select("__part", "k").distinct().join(firsts.withColumnRenamed("k", "k1").withColumnRenamed("__part", "p1"), (F.col("__part") == F.col("p1")) & F.col("k").eqNullSafe(F.col("k1")), "left")
    later = Window.partitionBy("k").orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(F.col("__part").alias("p2"), F.col("k").alias("k2"), F.last("least", ignorenulls=True).over(later)["pos"].alias("beyond"))
    return inside.join(every, (F.col("__part") == F.col("p2")) & F.col("k").eqNullSafe(F.col("k2"))).select("k", "id", F.coalesce("hit", "beyond").alias("pos"))


def orbit(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """All places (k, at) reached from the starts by the jumps (k, at, to), to being greater than at. After r rounds the first 2^r of each key are there."""
    reached, jumps = starts.select("k", "at"), stored(jumps.where(F.col("to").isNotNull()), "jumps")
    same = lambda a, b: F.col(f"{a}.k").eqNullSafe(F.col(f"{b}.k"))
    while True:
        more = stored(reached.alias("r").join(jumps.alias("j"), same("r", "j") & (F.col("r.at") == F.col("j.at"))).select("r.k", F.col("j.to").alias("at")), "reached")
        if more.isEmpty():
            return reached
        reached = stored(reached.unionByName(more), "reached")
        jumps = stored(jumps.alias("a").join(jumps.alias("b"), same("a", "b") & (F.col("a.to") == F.col("b.at"))).select("a.k", "a.at", "b.to"), "jumps")


def limited_segments(records: DataFrame, key: str, order: list[str], size: Column, second: Column, most_bytes: int, most_records: int, most_seconds: int) -> DataFrame:
    """Segments (key, segment_idx, first_pos, n, bytes) of each key's records in order, cut on any limit.

    A record begins a new segment if the open one holds most_records, or would hold more than most_bytes with it
    (one record alone may be larger), or began most_seconds or more before it. Time never runs backwards: a record
    counts as at the greatest second so far. A null size counts 0, null keys are one key. Ties of the order fall
    as Spark sorts them, so the order should be a full one. No records: no segments.
    """
    base = stored(ranked(records.select(key, *[c for c in order if c != key], F.coalesce(size, F.lit(0)).alias("__size0"), second.alias("__at0")), key, order, F.col("__size0"), F.col("__at0")).select(F.col(key).alias("k"), F.col("__pos").cast("long").alias("pos"), F.col("__upto").alias("upto"), F.col("__size").alias("size"), F.col("__latest").alias("at"), F.col("__n").alias("n")), "ranked")
    by_bytes = following(base.select("k", F.col("upto").alias("v"), "pos"), base.select("k", F.col("pos").alias("id"), (F.col("upto") - F.col("size") + most_bytes + 1).alias("v"))).select("k", "id", F.when(F.col("pos").isNotNull(), F.greatest(F.col("pos"), F.col("id") + 1)).alias("b"))
    by_age = following(base.select("k", F.col("at").alias("v"), "pos"), base.select("k", F.col("pos").alias("id"), (F.col("at") + most_seconds).alias("v"))).select(F.col("k").alias("k_"), F.col("id").alias("id_"), F.col("pos").alias("a"))
    lengths = base.groupBy("k").agg(F.max("n").alias("n")).withColumnRenamed("k", "kn")
    next_ = by_bytes.join(by_age, F.col("k").eqNullSafe(F.col("k_")) & (F.col("id") == F.col("id_"))).join(lengths, F.col("k").eqNullSafe(F.col("kn")))
    to = F.least("b", "a", F.col("id") + most_records)
    next_ = stored(next_.select("k", F.col("id").alias("at"), F.when(to < F.col("n"), to).alias("to"), "n"), "next")
    cuts = orbit(next_.where("at = 0"), next_.select("k", "at", "to"))
    held = cuts.alias("c").join(next_.alias("s"), F.col("c.k").eqNullSafe(F.col("s.k")) & (F.col("c.at") == F.col("s.at"))).select("s.k", F.col("s.at").alias("first_pos"), (F.coalesce("s.to", "s.n") - F.col("s.at")).alias("n"))
    sums = base.select(F.col("k").alias("kb"), "pos", "upto", "size")
    first = held.join(sums, F.col("k").eqNullSafe(F.col("kb")) & (F.col("first_pos") == F.col("pos"))).select("k", "first_pos", "n", (F.col("upto") - F.col("size")).alias("__before"))
    last = first.join(sums, F.col("k").eqNullSafe(F.col("kb")) & (F.col("first_pos") + F.col("n") - 1 == F.col("pos"))).select("k", "first_pos", "n", (F.col("upto") - F.col("__before")).alias("bytes"))
    return last.withColumnRenamed("k", key)


def bursts(events: DataFrame, key: str, order: list[str], second: Column, times: int, seconds: int, event: str) -> DataFrame:
    """The events (key, event) at which a key has `times` events within `seconds`, after which counting begins anew; equal to the stream that keeps them in state.

    An event is good if the times - 1 events before it lie within the span; after an alert the next one is the first good
    event with times - 1 events behind that alert. Only good events are jumped over.
    """
    base = ranked(events.select(key, *[c for c in dict.fromkeys((*order, event)) if c != key], second.alias("__s")), key, list(dict.fromkeys(order)), F.lit(0), F.col("__s"))
    base = stored(base.select(F.col(key).alias("k"), F.col("__pos").cast("long").alias("pos"), F.col("__s").alias("s"), F.col(event).alias("event")), "events")
    back = base.select(F.col("k").alias("kb"), (F.col("pos") + times - 1).alias("pb"), F.col("s").alias("sb"))
    good = base.join(back, F.col("k").eqNullSafe(F.col("kb")) & (F.col("pos") == F.col("pb"))).where(F.col("s") - F.col("sb") <= seconds).select("k", "pos", "event")
    good = stored(good, "good")
    jumps = following(good.select("k", F.col("pos").alias("v"), "pos"), good.select("k", F.col("pos").alias("id"), (F.col("pos") + times).alias("v"))).select("k", F.col("id").alias("at"), F.col("pos").alias("to"))
    alerts = orbit(good.groupBy("k").agg(F.min("pos").alias("at")), jumps)
    return good.join(alerts.withColumnRenamed("k", "ka"), F.col("k").eqNullSafe(F.col("ka")) & (F.col("pos") == F.col("at"))).select(F.col("k").alias(key), F.col("event").alias(event))


_FAILURES = "user_id, event_uid, unix_seconds(cast(received_time as timestamp)) as second"
BYTES, RECORDS, SECONDS = 4000, 40, 86400 * 2
QUERIES = {
    "limited_segments": lambda s, d: limited_segments(log_view(s, d).selectExpr("source_id", "event_id", "octet_length(line) as size", "unix_seconds(cast(received_time as timestamp)) as second"), "source_id", ["event_id"], F.col("size"), F.col("second"), BYTES, RECORDS, SECONDS).select("source_id", "first_pos", "n", "bytes"),
    "burst_alerts": lambda s, d: bursts(log_view(s, d).where("source_id = 'error'").selectExpr(*_FAILURES.split(", ")), "user_id", ["second", "event_uid"], F.col("second"), 3, 86400, "event_uid"),
}
ORACLES = {
    "limited_segments": f"""{LOG.replace("with log", "with recursive log")}, r as materialized (select source_id as k, row_number() over w - 1 as pos, sum(strlen(line)) over w as upto, strlen(line) as size, max(epoch(date_trunc('second', received_time))::bigint) over w as at from log window w as (partition by source_id order by event_id)),
 c as (select k, 0::bigint as first_pos from r where pos = 0 union all select c.k, min(r.pos) from c join r as f on f.k = c.k and f.pos = c.first_pos join r on r.k = c.k and r.pos > c.first_pos and r.pos <= c.first_pos + {RECORDS}
  and (r.pos - c.first_pos >= {RECORDS} or r.upto - (f.upto - f.size) > {BYTES} or r.at - f.at >= {SECONDS}) group by c.k, c.first_pos),
 g as (select k, first_pos, lead(first_pos) over (partition by k order by first_pos) as next_pos from c)
 select k as source_id, first_pos, count(*) as n, sum(size)::bigint as bytes from g join r using (k) where pos >= first_pos and pos < coalesce(next_pos, pos + 1) group by all""",
    "burst_alerts": f"""{LOG.replace("with log", "with recursive log")}, e as materialized (select user_id, event_uid, epoch(date_trunc('second', received_time))::bigint as second, row_number() over (partition by user_id order by epoch(date_trunc('second', received_time))::bigint, event_uid) as n from log where source_id = 'error'),
 s as (select user_id, event_uid, n, [second] as held, false as fired from e where n = 1
  union all select e.user_id, e.event_uid, e.n, case when len(h) >= 3 then [] else h end, len(h) >= 3 from (select s.user_id, s.n, s.held, e.event_uid as uid, list_append(list_filter(s.held, lambda x: x >= e.second - 86400), e.second) as h from s join e on e.user_id = s.user_id and e.n = s.n + 1) q join e on e.user_id = q.user_id and e.n = q.n + 1)
 select user_id, event_uid from s where fired""",
}
ORACLES["burst_alerts"] = ORACLES["burst_alerts"].replace("s.held, e.event_uid as uid,", "")
