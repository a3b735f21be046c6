"""Streaming jobs on file sources, run until all input is read; each equals its batch operator."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logweave.bindings import LOG, log_view
from logweave.functions.contracts import normalized
from logweave.functions.layers import CONTRACTS, LINES_SQL, sent
from logweave.operators import jumps
from logweave.plans.rollup import text_time
from logweave.session import shared_path, stored


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None, path: str, mode: str = "append") -> None:
    """Read all input that is there; the checkpoint lies beside the output, so a rerun continues."""
    writer = stream.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True)
    if sink is not None:
        writer.foreachBatch(sink).outputMode(mode).start().awaitTermination()
    else:
        writer.format("parquet").option("path", f"{path}/data").outputMode(mode).start().awaitTermination()


BATCHES = 8  # micro-batches in which a stream reads what is there when it starts


def file_stream(rows: DataFrame, tag: str, by: str | None = None, one_batch: bool = False) -> DataFrame:
    """A table as a stream of Parquet files of at most 50,000 rows, in as many parts as Spark chooses; `by`: each file holds a range of it.

    A batch reads two files, more only if there are more than 2 * BATCHES of them: each batch plans the query again and
    commits the state of every partition, so their number must not grow with the table. one_batch: all that is there is one batch.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, tag)
    (rows if by is None else rows.repartitionByRange(F.col(by)).sortWithinPartitions(by)).write.option("maxRecordsPerFile", 50_000).parquet(path)
    reader = spark.readStream.schema(rows.schema)
    if not one_batch:
        files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
        reader = reader.option("maxFilesPerTrigger", max(2, -(-files // BATCHES)))
    return reader.parquet(path)


def log_stream(spark: SparkSession, d: str) -> DataFrame:
    return file_stream(log_view(spark, d).repartition("event_uid"), "log-stream")


def upsert(path: str, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that merges each batch into a table: versions are whole folders, the newest is read.

    A batch that is sent again writes the version of its own number again, from the one before it.
    """

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        out = batch if n == 0 else merge(spark.read.parquet(f"{path}/v{n - 1}"), batch)
        out.write.mode("overwrite").parquet(f"{path}/v{n}")

    return sink


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return spark.read.parquet(f"{path}/v{max(int(x[1:]) for x in names if x[1:].isdigit())}")


def minute_rollup_stream(s: SparkSession, d: str) -> DataFrame:
    """Per-minute counts kept up to date. Update mode gives the newest count of each changed minute; a batch rewrites the days it touches, no others."""
    path = shared_path(s, "rollup")
    stream = log_stream(s, d).withColumn("t", F.col("received_time").cast("timestamp"))
    counts = stream.withWatermark("t", "40 days").groupBy("source_id", F.window("t", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    flat = counts.select("source_id", F.col("w.start").alias("minute"), "n", F.to_date("w.start").alias("day"))

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        days = [str(r["day"]) for r in batch.select("day").distinct().collect()]  # of one batch
        if not days:
            return
        new = batch
        if n:
            old = spark.read.parquet(f"{path}/data").where(F.col("day").cast("string").isin(days))
            new = stored(old.join(batch, ["source_id", "minute"], "left_anti").select(*batch.columns).unionByName(batch), "rollup-days")
        new.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/data")  # a day is one file

    run_once(flat, sink, path, "update")
    return s.read.parquet(f"{path}/data").select("source_id", text_time("minute").alias("minute"), "n")


def normalize_stream(s: SparkSession, d: str) -> DataFrame:
    """Lines under several contracts to tiers, one table per batch of files; the checkpoint makes a batch land once."""
    path = shared_path(s, "normalize")
    stream = file_stream(sent(s, d), "sent-stream")
    run_once(normalized(stream, CONTRACTS).select("event_uid", "contract", "template", "got_tier", "reason"), None, path)
    return s.read.parquet(f"{path}/data")


def in_order(rows, columns: list[str]):
    """The rows of one key in one micro-batch, sorted: Spark may hand them over in several frames of any order. Triggers bound a batch."""
    return sorted(row for frame in rows for row in zip(*(frame[c] for c in columns)))


LAG = "1 hour"


def window_roots_stream(s: SparkSession, d: str) -> DataFrame:
    """Sealed segments in hourly windows. A window closes when the watermark, LAG behind the newest segment, has passed its end.

    Closed windows are final: append mode gives each once, and its Merkle root goes to the ledger. Open ones aren't shown.
    """
    from logweave.plans.evidence import blobs, merkle_roots, records

    path = shared_path(s, "windows")
    seg = blobs(records(s, d)).select(F.concat_ws("-", "topic", "part", "segment_no").alias("segment_id"), "blob_sha", "sealed_at")
    stream = file_stream(seg, "segments", "sealed_at", True)
    held = stream.withWatermark("sealed_at", LAG).groupBy(F.window("sealed_at", "1 hour").alias("w")).agg(F.sort_array(F.collect_list(F.struct("sealed_at", "segment_id", "blob_sha"))).alias("s"))

    def sink(batch: DataFrame, n: int) -> None:
        closed = stored(batch.select(F.col("w.start").alias("window"), F.size("s").alias("leaf_count"), "s"), "closed")
        if closed.isEmpty():
            return
        leaves = closed.select("window", F.posexplode("s").alias("idx", "x")).select("window", F.col("idx").cast("long").alias("idx"), F.col("x.blob_sha").alias("leaf"))
        roots = merkle_roots(leaves, closed.agg(F.max("leaf_count")).first()[0])
        closed.drop("s").join(roots, "window").write.mode("overwrite").parquet(f"{path}/ledger/batch={n}")

    s.createDataFrame([], "window timestamp, leaf_count int, root string").write.parquet(f"{path}/ledger/batch=-1")  # if none closes
    run_once(held, sink, path)
    return s.read.parquet(f"{path}/ledger").select(text_time("window").alias("hour"), "leaf_count", "root")


def late_data(s: SparkSession, d: str, lag_ms: int = 50_000) -> DataFrame:
    """No row is dropped for being late: its minute is that of arrival, the lateness shows as skew, and rows over the lag are listed beside."""
    path = shared_path(s, "late")
    rows = log_stream(s, d).select("event_uid", F.date_trunc("minute", F.col("received_time").cast("timestamp")).alias("minute"), "skew_ms")

    def sink(batch: DataFrame, n: int) -> None:
        kept = stored(batch, "late-batch")  # both tables come from the same rows
        kept.write.mode("overwrite").parquet(f"{path}/norm/batch={n}")
        kept.where(F.col("skew_ms") > lag_ms).write.mode("overwrite").parquet(f"{path}/late/batch={n}")

    run_once(rows, sink, path)
    late = s.read.parquet(f"{path}/late").groupBy("minute").agg(F.count("*").alias("late"), F.max("skew_ms").alias("worst"))
    out = s.read.parquet(f"{path}/norm").groupBy("minute").agg(F.count("*").alias("n")).join(late, "minute", "left")
    return out.select(text_time("minute").alias("minute"), "n", F.coalesce("late", F.lit(0).cast("long")).alias("late"), "worst")


class Runs(StatefulProcessor):
    """Joins a peer's continuation lines to the line before them; a run ends with the next line of its own or half a second after its last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "text string, parts int, at long")

    def handleInputRows(self, key, rows, timerValues):
        text, parts, at = self.open.get() if self.open.exists() else (None, 0, 0)
        out = []
        for _, line, ms in in_order(rows, ["n", "line", "ms"]):
            if text is not None and ms - at <= 500 and (line[:1] in (" ", "\t") or line.startswith("at ")):
                text, parts = f"{text}\n{line}", parts + 1
            else:
                if text is not None:
                    out.append((key[0], text, parts))
                text, parts = line, 1
            at = int(ms)
        yield pd.DataFrame(out, columns=["peer", "text", "parts"])
        if text is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.open.update((text, parts, at))
            self.handle.registerTimer(at + 500)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.open.exists():
            text, parts, _ = self.open.get()
            self.open.clear()
            yield pd.DataFrame([(key[0], text, parts)], columns=["peer", "text", "parts"])

    def close(self) -> None:
        pass


def multiline_stream(s: SparkSession, d: str) -> DataFrame:
    """Lines of a peer joined as they come; rows of a batch lie in order of arrival, the flush is an event-time timer."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = shared_path(s, "multiline")
    rows = log_view(s, d).selectExpr("cast(user_id % 50 as string) as peer", "event_id as n", "concat(case when event_id % 3 = 0 then '  at frame ' when event_id % 7 = 0 then 'at frame ' else 'line ' end, event_id) as line", "event_id * 10 + 1000 as ms")
    last = rows.groupBy("peer").agg(F.max("n").alias("n")).crossJoin(rows.agg(F.max("ms").alias("ms"))).select("peer", (F.col("n") + 1).alias("n"), F.lit("end").alias("line"), (F.col("ms") + 60_000).alias("ms"))
    stream = file_stream(rows.unionByName(last).withColumn("t", F.timestamp_millis("ms")), "lines", "n", True).withWatermark("t", "0 seconds")
    joined = stream.groupBy("peer").transformWithStateInPandas(Runs(), "peer string, text string, parts int", "append", "EventTime")
    run_once(joined, None, path)
    return s.read.parquet(f"{path}/data").where("text <> 'end'")


def receipts_stream(s: SparkSession, d: str) -> DataFrame:
    """One receipt per event and route, also for what a route doesn't take."""
    from logweave.operators.relational import fan_out

    path = shared_path(s, "receipts")
    run_once(fan_out(log_stream(s, d)), None, path)
    return s.read.parquet(f"{path}/data").groupBy("route_id", "status").agg(F.count("*").alias("n"))


LEAST = 5  # events of a group before it is told


def unknown_groups(stream: DataFrame) -> DataFrame:
    """Running counts of unknown shapes per source, with first and last event and a sample; update mode tells those that grew."""
    return stream.where("tier = 3").groupBy("source_id", "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.min("line").alias("sample"))


def drift_stream(s: SparkSession, d: str) -> DataFrame:
    """Groups are told once they have LEAST events, and again only when they have grown; all that was told is kept."""
    path = shared_path(s, "drift-told")
    run_once(unknown_groups(log_stream(s, d)), lambda b, n: b.where(F.col("n") >= LEAST).write.mode("overwrite").parquet(f"{path}/told/batch={n}"), path, "update")
    told = s.read.parquet(f"{path}/told")
    return told.groupBy("source_id", "user_id").agg(F.max("n").alias("n"), (F.count_distinct("n") == F.count("*")).alias("each_grew"))


def merge_drift(old: DataFrame, new: DataFrame, covered: Column) -> DataFrame:
    """Absolute counts are set, first and last kept; a person's state stays, else a covered sample resolves a group."""
    key = ["source_id", "user_id"]
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, key, "full_outer")
    state = F.when(F.col("a.state").isin("ignored", "acknowledged"), F.col("a.state")).when(F.coalesce(covered, F.lit(False)), "resolved").otherwise("open")
    return both.select(
        *key, F.coalesce("b.n", "a.n").alias("n"), F.least("a.first", "b.first").alias("first"), F.greatest("a.last", "b.last").alias("last"), F.coalesce("b.sample", "a.sample").alias("sample"), state.alias("state")
    )


def drift_upsert(s: SparkSession, d: str) -> DataFrame:
    """The table of groups as a stream brings it up to date; some groups were ignored by a person before."""
    path = shared_path(s, "drift")
    start = log_view(s, d).where("tier = 3").groupBy("source_id", "user_id").agg(F.lit(0).cast("long").alias("n"), F.min("event_id").alias("first"), F.min("event_id").alias("last"), F.min("line").alias("sample"))
    start.where("user_id % 4 = 1").withColumn("state", F.lit("ignored")).write.parquet(f"{path}/v0")
    covered = F.coalesce(F.col("b.sample"), F.col("a.sample")).rlike(" FAILED login ")

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        merge_drift(spark.read.parquet(f"{path}/v{n}"), batch, covered).write.mode("overwrite").parquet(f"{path}/v{n + 1}")

    run_once(unknown_groups(log_stream(s, d)), sink, path, "update")
    return newest_version(s, path).drop("sample")


def overview_stream(s: SparkSession, d: str) -> DataFrame:
    """Totals by tier and the windows' roots, both as they come in one stream; a root that was seen before changes nothing.

    One small table holds a row per tier and per window with the batch that brought it; each batch writes its next
    version from the one before it, so a batch that is sent again counts once.
    """
    path = shared_path(s, "overview")
    log = log_view(s, d)
    windows = log.groupBy(F.date_trunc("day", F.col("received_time").cast("timestamp")).cast("string").alias("window")).agg(F.lit("root").alias("metric"))
    sent_twice = windows.withColumn("copy", F.explode(F.array(F.lit("a"), F.lit("b")))).select("metric", "window", F.concat("window", "copy").alias("k"))
    records = log.select(F.concat(F.lit("tier_"), "tier").alias("metric"), F.lit("").alias("window"), F.col("event_uid").alias("k")).unionByName(sent_twice)
    stream = file_stream(records.repartition(8, "k"), "overview-records")

    def sink(batch: DataFrame, n: int) -> None:
        known = batch.groupBy("metric", "window").agg(F.count("*").alias("n")).withColumn("since", F.lit(n).cast("long"))
        if n:
            both = known.unionByName(batch.sparkSession.read.parquet(f"{path}/v{n - 1}"))
            known = both.groupBy("metric", "window").agg(F.sum("n").alias("n"), F.min("since").alias("since"))
        known.write.mode("overwrite").parquet(f"{path}/v{n}")

    run_once(stream, sink, path)
    newest = newest_version(s, path)
    tiers = newest.where("metric <> 'root'").select("metric", "n")
    roots = newest.where("metric = 'root'").agg(F.count("*").alias("roots"), F.sum("n").alias("roots_sent"), F.when(F.count_distinct("since") > 1, 1).otherwise(0).cast("long").alias("roots_as_they_came"))
    return tiers.unionByName(roots.select(F.expr("stack(3, 'roots', roots, 'roots_sent', roots_sent, 'roots_as_they_came', roots_as_they_came) as (metric, n)")))


class Bucket(StatefulProcessor):
    """Token bucket: capacity and rate are the quota; a request larger than the capacity passes only when it is full."""

    def __init__(self, quota: float):
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "level double, at double")

    def handleInputRows(self, key, rows, timerValues):
        level, at = self.state.get() if self.state.exists() else (self.quota, None)
        out = []
        for second, uid, cost in in_order(rows, ["second", "event_uid", "cost"]):
            level = min(self.quota, level + max(0.0, second - (second if at is None else at)) * self.quota)
            passes = level >= min(cost, self.quota)
            level -= cost if passes else 0.0
            at = second if at is None else max(at, second)
            out.append((key[0], uid, bool(passes)))
        self.state.update((float(level), float(at)))
        yield pd.DataFrame(out, columns=["source_id", "event_uid", "admitted"])

    def close(self) -> None:
        pass


def quota_stream(s: SparkSession, d: str, quota: float = 3.0) -> DataFrame:
    """Requests per source against its token bucket, in order of time within a batch."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = shared_path(s, "quota")
    stream = file_stream(log_view(s, d).selectExpr("source_id", "event_uid", "cast(unix_seconds(cast(received_time as timestamp)) as double) as second", "cast(1 + event_id % 5 as double) as cost"), "requests", "second", True)
    admitted = stream.groupBy("source_id").transformWithStateInPandas(Bucket(quota), "source_id string, event_uid string, admitted boolean", "append", "None")
    run_once(admitted, None, path)
    return s.read.parquet(f"{path}/data").groupBy("source_id", "admitted").agg(F.count("*").alias("n"))


class Burst(StatefulProcessor):
    """Fires on the n-th failure within the span, then counts anew."""

    def __init__(self, times: int, seconds: int):
        self.times, self.seconds = times, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "second long")

    def handleInputRows(self, key, rows, timerValues):
        held = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        out = []
        for second, uid in in_order(rows, ["second", "event_uid"]):
            held = [x for x in held if x >= second - self.seconds] + [int(second)]
            if len(held) >= self.times:
                out.append((key[0], uid))
                held = []
        yield pd.DataFrame(out, columns=["user_id", "event_uid"])
        self.recent.put([(x,) for x in held]) if held else self.recent.clear()

    def close(self) -> None:
        pass


def burst_alert_stream(s: SparkSession, d: str, times: int = 3, seconds: int = 86400) -> DataFrame:
    """Alerts per user; the reset after an alert needs state."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = shared_path(s, "burst")
    stream = file_stream(log_view(s, d).where("source_id = 'error'").selectExpr("user_id", "event_uid", "unix_seconds(cast(received_time as timestamp)) as second"), "failures", "second", True)
    run_once(stream.groupBy("user_id").transformWithStateInPandas(Burst(times, seconds), "user_id long, event_uid string", "append", "None"), None, path)
    return s.read.parquet(f"{path}/data")


QUERIES = {f.__name__: f for f in (minute_rollup_stream, normalize_stream, window_roots_stream, late_data, multiline_stream, drift_stream, overview_stream, receipts_stream, drift_upsert, quota_stream, burst_alert_stream)}

_UP = "select w, idx // 2 as idx, case when count(*) = 2 then sha256(unhex('01') || unhex(arg_min(h, idx)) || unhex(arg_max(h, idx))) else min(h) end as h from {0} group by w, idx // 2"
ORACLES = {
    "burst_alert_stream": jumps.ORACLES["burst_alerts"],
    "quota_stream": f"""{LOG.replace("with log", "with recursive log")}, e as materialized (select source_id, epoch(date_trunc('second', received_time))::double as second, (1 + event_id % 5)::double as cost, row_number() over (partition by source_id order by epoch(date_trunc('second', received_time)), event_uid) as n from log),
 b as (select source_id, n, second as at, 3.0::double - case when 3.0 >= least(cost, 3.0) then cost else 0 end as level, true as admitted from e where n = 1
  union all select q.source_id, q.n, q.second, q.level - case when q.level >= least(q.cost, 3.0) then q.cost else 0 end, q.level >= least(q.cost, 3.0)
  from (select e.source_id, e.n, e.second, e.cost, least(3.0::double, b.level + (e.second - b.at) * 3.0) as level from b join e on e.source_id = b.source_id and e.n = b.n + 1) q)
 select source_id, admitted, count(*) as n from b group by 1, 2""",
    "minute_rollup_stream": f"{LOG} select source_id, strftime(date_trunc('minute', received_time), '%Y-%m-%d %H:%M:%S') as minute, count(*) as n from log group by 1, date_trunc('minute', received_time)",
    "normalize_stream": f"""{LINES_SQL}, r as (select *, case when k = 5 then 'empty' when k = 2 then 'no_contract' when t is null then 'no_template_match' when t = 'failed' then 'required_missing' when t = 'json' and (event_id % 2 = 0 or event_id % 3 = 0) then 'schema_invalid' end as reason from m)
 select event_uid, contract, t as template, (case when reason = 'empty' then 4 when reason in ('no_contract', 'no_template_match') then 3 when reason is not null then 2 else 1 end)::int as got_tier, reason from r""",
    "window_roots_stream": f"""{LOG}, seg as (select concat(source_id, '-', user_id % 3, '-', segment_no) as id, max(received_time) as sealed, sha256(string_agg(sha256(line), '' order by event_id)) as blob from log group by source_id, user_id % 3, segment_no),
 n as (select date_trunc('hour', sealed) as w, row_number() over (partition by date_trunc('hour', sealed) order by sealed, id) - 1 as idx, sha256(unhex('00') || unhex(blob)) as h from seg), """
    + ", ".join(f"l{i + 1} as ({_UP.format(f'l{i}' if i else 'n')})" for i in range(8))
    + """ select strftime(l8.w, '%Y-%m-%d %H:%M:%S') as hour, c.k::int as leaf_count, l8.h as root from l8 join (select w, count(*) as k from n group by 1) c on c.w = l8.w where l8.w + interval 1 hour <= (select max(sealed) from seg) - interval 1 hour""",
    "late_data": f"""{LOG} select strftime(date_trunc('minute', received_time), '%Y-%m-%d %H:%M:%S') as minute, count(*) as n, count(*) filter (skew_ms > 50000) as late, max(skew_ms) filter (skew_ms > 50000) as worst from log group by 1""",
    "multiline_stream": f"""{LOG}, l as (select (user_id % 50)::varchar as peer, event_id as n, concat(case when event_id % 3 = 0 then '  at frame ' when event_id % 7 = 0 then 'at frame ' else 'line ' end, event_id) as line, (event_id % 3 = 0 or event_id % 7 = 0) and event_id - lag(event_id) over (partition by user_id % 50 order by event_id) <= 50 as more from log),
 g as (select *, sum(case when coalesce(more, false) then 0 else 1 end) over (partition by peer order by n) as run from l) select peer, string_agg(line, chr(10) order by n) as text, count(*)::int as parts from g where run > 0 group by peer, run
 union all select peer, string_agg(line, chr(10) order by n), count(*)::int from g where run = 0 group by peer""",
    "drift_stream": f"{LOG} select source_id, user_id, count(*) as n, true as each_grew from log where tier = 3 group by 1, 2 having count(*) >= 5",
    "overview_stream": f"{LOG} select concat('tier_', tier) as metric, count(*) as n from log group by 1 union all select unnest(['roots', 'roots_sent', 'roots_as_they_came']), unnest([r, 2 * r, 1]) from (select count(distinct date_trunc('day', received_time)) as r from log)",
    "receipts_stream": f"""{LOG}, x as (select 'soc' as route_id, tier in (1, 2) as ok from log union all select 'errors', source_id = 'error' and tenant_id in ('t0', 't1') from log)
 select route_id, case when ok then 'delivered' else 'filtered' end as status, count(*) as n from x group by all""",
    "drift_upsert": f"""{LOG} select source_id, user_id, count(*) as n, min(event_id) as "first", max(event_id) as "last", case when user_id % 4 = 1 then 'ignored' when min(line) like '% FAILED login %' then 'resolved' else 'open' end as state from log where tier = 3 group by 1, 2""",
}
