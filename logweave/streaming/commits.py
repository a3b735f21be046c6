"""Streams that survive bad records, late versions and half-written batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.bindings import LOG, log_view
from logweave.functions.contracts import CANDIDATE, LOGIN, normalized
from logweave.functions.layers import Contract
from logweave.session import shared_path


def run_steps(rows: DataFrame, chunk: str, steps: int, path: str, sink: Callable[[DataFrame, int], None], prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """rows as a stream that arrives in steps: those of each chunk are added to the input folder, then one batch reads what is new and goes on from the checkpoint."""
    spark = rows.sparkSession
    for i in range(steps):
        rows.where(F.col(chunk) == i).write.mode("append").parquet(f"{path}/input")
        stream = prepare(spark.readStream.schema(rows.schema).parquet(f"{path}/input"))
        stream.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


# --- tables that belong together


class CommitLog:
    """A batch of several tables that readers see as a whole or not at all.

    Each table's rows lie in a folder named after a token, the hash of the table and of what the batch read; the same
    batch sent again writes the same folders. Only the last step, one small record of all tokens, makes them visible.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def token(table: str, source: str) -> str:
        return hashlib.sha256(f"{table}\x1f{source}".encode()).hexdigest()

    def write(self, source: str, tables: dict[str, DataFrame]) -> None:
        """source: what the batch read, such as its offset ranges or the batch's number in its checkpoint."""
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/token={self.token(name, source)}")
        record = [(self.token("", source), name, self.token(name, source)) for name in tables]
        self.spark.createDataFrame(record, "batch string, name string, token string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_commits/batch={self.token('', source)}")

    def read(self, table: str) -> DataFrame:
        """The table's rows of all committed batches; folders of others are never opened. No commit yet: an error of the reader."""
        tokens = [r["token"] for r in self.spark.read.schema("name string, token string, batch string").parquet(f"{self.path}/_commits").where(F.col("name") == table).select("token").collect()]  # one a batch
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/token={t}" for t in tokens])


def index_tables(batch: DataFrame) -> dict[str, DataFrame]:
    """The seven index tables of a batch of envelopes, each with the stream position (topic, part, offset)."""
    at = [F.col(c) for c in ("topic", "part", "offset", "event_uid")]
    some = lambda keep, *columns: batch.where(keep).select(*at, *columns)
    return {
        "raw_events": some("true", "source_id", F.sha2("line", 256).alias("raw_sha256"), F.octet_length("line").alias("bytes")), "norm_lineage": some("true", "source_id", "tier", "contract_ref"),
        "norm_events": some("tier < 4", "class_uid", "skew_ms"), "dlq_events": some("tier >= 2", "source_id", F.substring("line", 1, 2048).alias("text")), "receipts": some("tier <= 2", F.col("source_id").alias("route_id")),
        "shadow_diffs": some("candidate_tier <> tier", "tier", "candidate_tier"), "audit_log": some("event_id % 50 = 0", F.lit("sealed").alias("action")),
    }


def positioned(s: SparkSession, d: str, steps: int) -> DataFrame:
    """The log with a topic, partition and offset for each line, arriving in steps by its number."""
    rows = log_view(s, d)
    last = rows.agg(F.max("event_id").alias("last"))
    chunk = F.floor(F.col("event_id") * steps / (F.col("last") + 1)).cast("int").alias("chunk")
    return rows.crossJoin(F.broadcast(last)).select(*rows.columns, F.concat(F.lit("raw."), "source_id").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part"), F.col("event_id").alias("offset"), chunk)


class Died(Exception):
    pass


def load_index_stream(s: SparkSession, d: str, fail_at: tuple[int, str] | None = None) -> DataFrame:
    """A batch of all seven tables lands once. fail_at (for tests): in that batch the job dies before that table, then starts again; what it had written isn't seen, and the batch sent again isn't doubled."""
    path = shared_path(s, "index")
    log = CommitLog(s, f"{path}/tables")
    died: list[int] = []

    def sink(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            tables = index_tables(batch)
            if fail_at is not None and n == fail_at[0] and not died:
                died.append(n)
                before = dict(list(tables.items())[: list(tables).index(fail_at[1])])
                for name, rows in before.items():  # what write() would have done until it died
                    rows.write.mode("overwrite").parquet(f"{log.path}/{name}/token={log.token(name, f'{path} {n}')}")
                raise Died
            log.write(f"{path} {n}", tables)
        finally:
            batch.unpersist()

    rows = positioned(s, d, 3)
    try:
        run_steps(rows, "chunk", 3, path, sink)
    except Exception:
        if not died:
            raise
        run_steps(rows.where("chunk > 1"), "chunk", 3, path, sink)
    parts = [log.read(t).groupBy(F.lit(t).alias("target")).agg(F.count("*").alias("n"), F.count_distinct("event_uid").alias("events"), F.max("offset").alias("last")) for t in ("raw_events", "norm_lineage", "norm_events", "dlq_events", "receipts", "shadow_diffs", "audit_log")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- records that fail


def isolated(rows: DataFrame, parse: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, coordinates: list[str]) -> DataFrame:
    """Coordinates, the columns that parse gives and reason. Where parse raises, the batch is halved until one record is left; that one has nulls and the reason.

    parse gets and gives record batches of as many rows. A good record never suffers for a bad one; k bad
    records of n cost about k log2(n) further calls.
    """
    kept = [rows.schema[c] for c in coordinates]
    parsed = T.StructType.fromDDL(schema)
    out = T.StructType([*kept, *parsed.fields, T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            waiting = [whole]
            while waiting:
                part = waiting.pop()
                own = [part.column(c) for c in coordinates]
                try:
                    made = parse(part)
                    columns, reason = made.columns, pa.nulls(part.num_rows, pa.string())
                except Exception as e:  # noqa: BLE001  any failure of a parser is the record's
                    if part.num_rows > 1:
                        half = part.num_rows // 2
                        waiting += part.slice(half), part.slice(0, half)
                        continue
                    columns, reason = None, pa.array([f"{type(e).__name__}: {e}"[:300]])
                if columns is None:
                    from pyspark.sql.pandas.types import to_arrow_type

                    columns = [pa.nulls(1, to_arrow_type(f.dataType)) for f in parsed.fields]
                yield pa.RecordBatch.from_arrays([*own, *columns, reason], out.names)

    return rows.mapInArrow(run, out)


def _numbers(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A parser that raises on what isn't a number, for all records it is given."""
    return pa.RecordBatch.from_arrays([pc.cast(batch.column("number"), pa.int64())], ["value"])


def poison_quarantine(s: SparkSession, d: str) -> DataFrame:
    """Records that make the parser raise become dead letters with their coordinates and reason; all others of their batch go on."""
    path = shared_path(s, "poison")
    log = CommitLog(s, f"{path}/tables")

    def sink(batch: DataFrame, n: int) -> None:
        got = isolated(batch, _numbers, "value long", ["topic", "part", "offset"]).persist()
        log.write(f"{path} {n}", {"good": got.where("reason is null").drop("reason"), "dead": got.where("reason is not null").select("topic", "part", "offset", F.substring_index("reason", ":", 1).alias("reason"))})
        got.unpersist()

    run_steps(positioned(s, d, 2).withColumn("number", F.expr("case when event_id % 41 = 0 then concat('x', event_id) else cast(event_id as string) end")), "chunk", 2, path, sink)
    good = log.read("good").groupBy("topic").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))
    dead = log.read("dead").groupBy("topic", "reason").agg(F.count("*").alias("n"), F.sum("offset").cast("long").alias("total"))
    return good.select("topic", F.lit("ok").alias("outcome"), "n", "total").unionByName(dead.select("topic", F.col("reason").alias("outcome"), "n", "total"))


# --- versions


def renamed(contract: Contract, id: str) -> Contract:
    return Contract(id, contract.layers, contract.templates, contract.rows, contract.tz, contract.formats)


#: Versions of a contract with the event from which each is valid; a replay names a contract and a time.
VERSIONS = ((0, renamed(LOGIN, "login@1")), (400, renamed(CANDIDATE, "login@2")))


def replay_stream(s: SparkSession, d: str) -> DataFrame:
    """X11: replayed lines are normalized again under the version valid at the time they name (as-of), each (event, revision) once however often it is sent. Revision and tier as sent and found."""
    path = shared_path(s, "replay")
    sent = positioned(s, d, 2).withColumn("t", F.col("received_time").cast("timestamp")).withColumn("revision", F.explode(F.expr("if(event_id % 3 = 0, array(1, 2, 2), array(1))")))
    named = F.lit(None).cast("string")
    at = F.when(F.col("revision") == 1, 0).otherwise(F.col("event_id"))  # first-time lines name the beginning, replays their own place
    for valid_from, contract in VERSIONS:
        named = F.when(at >= valid_from, contract.id).otherwise(named)
    columns = sent.select("event_uid", "event_id", "revision", "t", "line", "received_time", "chunk", named.alias("contract"))

    def sink(batch: DataFrame, n: int) -> None:
        normalized(batch, tuple(c for _, c in VERSIONS)).select("event_uid", "revision", "contract", "got_tier").write.mode("overwrite").parquet(f"{path}/data/batch={n}")

    run_steps(columns, "chunk", 2, path, sink, lambda x: x.withWatermark("t", "60 days").dropDuplicatesWithinWatermark(["event_uid", "revision"]))
    rows = s.read.schema("event_uid string, revision int, contract string, got_tier int, batch int").parquet(f"{path}/data")
    by_event = rows.groupBy("event_uid").agg(F.max_by("got_tier", "revision").alias("last_tier"), F.min_by("got_tier", "revision").alias("first_tier"), F.max("revision").alias("revision"), F.max_by("contract", "revision").alias("contract"), F.count("*").alias("sent"))
    return by_event.groupBy("revision", "contract", "first_tier", "last_tier").agg(F.count("*").alias("events"), F.sum("sent").cast("long").alias("rows"))


def control_stream(s: SparkSession, d: str) -> DataFrame:
    """Changes of contract versions come in the same stream as the events and take effect between batches.

    State is a small table, a version of it per batch (so a batch sent again makes the same one), begun from a full
    snapshot of version 0 before the first batch. A batch's events see the state left by the batch before; its
    changes, of which the last of a key counts and a null deletes, make the next one.
    """
    path = shared_path(s, "control")
    steps = 4
    rows = positioned(s, d, steps)
    changed = F.expr("user_id % 7 = 0")
    stream = rows.select("chunk", "event_id", "event_uid", "source_id", changed.alias("is_change"), F.expr("case when event_id % 5 = 0 then null else event_id end").alias("version"))
    state = lambda n: f"{path}/state/after={n}"
    rows.select("source_id").distinct().withColumn("version", F.lit(0).cast("long")).write.parquet(state(-1))

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        now = spark.read.parquet(state(n - 1))
        last = batch.where("is_change").groupBy("source_id").agg(F.max_by(F.struct("version"), "event_id").alias("c")).select("source_id", F.col("c.version").alias("version"))
        now.join(last, "source_id", "left_anti").unionByName(last.where("version is not null")).coalesce(1).write.mode("overwrite").parquet(state(n))
        batch.where("not is_change").select("event_uid", "source_id").join(now, "source_id", "left").write.mode("overwrite").parquet(f"{path}/data/batch={n}")

    run_steps(stream, "chunk", steps, path, sink)
    return s.read.schema("event_uid string, source_id string, version long, batch int").parquet(f"{path}/data").groupBy("batch", "source_id", "version").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (load_index_stream, poison_quarantine, replay_stream, control_stream)}
_C = f"{LOG}, c as (select *, floor(event_id * {{0}} / ((select max(event_id) from log) + 1))::int as chunk from log)"
_M = "case when event_id % 4 = 2 then 'failed' when event_id % 5 <= 3 then 'ok' else 'any' end"
ORACLES = {
    "load_index_stream": f"""{LOG}, x as (select unnest(list_filter(['raw_events', 'norm_lineage', case when tier < 4 then 'norm_events' end, case when tier >= 2 then 'dlq_events' end, case when tier <= 2 then 'receipts' end, case when candidate_tier <> tier then 'shadow_diffs' end, case when event_id % 50 = 0 then 'audit_log' end], lambda t: t is not null)) as target, event_uid, event_id from log)
 select target, count(*) as n, count(distinct event_uid) as events, max(event_id) as last from x group by 1""",
    "poison_quarantine": f"{LOG} select concat('raw.', source_id) as topic, case when event_id % 41 = 0 then 'ArrowInvalid' else 'ok' end as outcome, count(*) as n, sum(event_id)::bigint as total from log group by 1, 2",
    "replay_stream": f"""{LOG}, m as (select *, (case when {_M} = 'any' then 2 else 1 end)::int as t1, (case when event_id % 4 = 2 then case when event_id % 5 <= 2 then 1 else 2 end when event_id % 5 <= 3 then 1 else 2 end)::int as t2, event_id % 3 = 0 as again from log)
 select (case when again then 2 else 1 end)::int as revision, case when again and event_id >= 400 then 'login@2' else 'login@1' end as contract, t1 as first_tier, case when again and event_id >= 400 then t2 else t1 end as last_tier, count(*) as events, sum(case when again then 2 else 1 end)::bigint as "rows" from m group by all""",
    "control_stream": f"""{_C.format(4)}, k as (select source_id, chunk, arg_max(event_id, event_id) as e from c where user_id % 7 = 0 group by 1, 2),
 u as (select c.*, (select max(k.e) from k where k.source_id = c.source_id and k.chunk < c.chunk) as e from c where user_id % 7 <> 0)
 select chunk as batch, source_id, case when e is null then 0 when e % 5 = 0 then null else e end as version, count(*) as n from u group by all""",
}
