"""Reading, sealing, checking and writing records."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.bindings import LOG, log_view
from logweave.session import shared_path, table

ENVELOPE = T.StructType([
    T.StructField("v", T.IntegerType()), T.StructField("event_uid", T.StringType()), T.StructField("tenant_id", T.StringType()), T.StructField("source_id", T.StringType()),
    T.StructField("received_time", T.StringType()), T.StructField("raw_sha256", T.StringType()), T.StructField("raw_len", T.LongType()), T.StructField("raw_b64", T.StringType()),
    T.StructField("framing", T.StructType([T.StructField("method", T.StringType()), T.StructField("truncated", T.BooleanType()), T.StructField("parts", T.LongType())])),
    T.StructField("replay", T.StructType([T.StructField("job_id", T.StringType()), T.StructField("revision", T.IntegerType())])),
    T.StructField("_bad", T.StringType()),
])
MAX_BYTES = 65_536
CATEGORIES = {3001: "iam", 3002: "iam", 4001: "network", 4002: "network", 1007: "system", 0: "uncategorized"}


def read_raw(spark: SparkSession, path: str | None = None, servers: str | None = None, pattern: str = r"raw\..*") -> DataFrame:
    """A stream of envelopes from all topics of a pattern, or from a folder of JSON lines. Same columns either way."""
    if servers:
        stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", pattern).load()
        return stream.select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp")
    return spark.readStream.schema("value string").text(path).select("value", F.lit("raw.file").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"), F.current_timestamp().alias("timestamp"))


def parse_envelope(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad) envelopes. A malformed replay block makes a first-time event; a bad envelope becomes a tier-4 row."""
    parsed = df.select("*", F.from_json(column, ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    ok = F.col("e._bad").isNull() & F.col("e.event_uid").isNotNull() & F.coalesce(F.col("e.raw_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    good = parsed.where(ok).select("e.*").drop("_bad").withColumn("replay", F.when(F.col("replay.revision") >= 2, F.col("replay")))
    bad = parsed.where(~ok).select(F.lit("00000000-0000-0000-0000-000000000000").alias("event_uid"), F.lit(4).alias("tier"), F.lit("schema_invalid").alias("reason_code"), F.sha2(column, 256).alias("record_sha"))
    return good, bad


def current_state(changes: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """S3: the last value of each key of a change log; a null payload deletes it."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(F.col(payload)), order).alias("last"))
    return last.select(key, F.col(f"last.{payload}").alias(payload)).where(F.col(payload).isNotNull())


def stamp(lines: DataFrame, line: str, cap: int = MAX_BYTES, place: list[str] | None = None) -> DataFrame:
    """Seal lines before anything is parsed: hash and length of the stored bytes, base64, cap and flag.

    `place`: columns that name a line's origin (file and position); with them come sealed_uid, the same on
    every run, and defaults for lines whose source or tenant isn't registered.
    """
    raw = F.col(line).cast("binary")
    kept = F.substring(raw, 1, cap)
    out = lines.withColumns({"raw_sha256": F.sha2(kept, 256), "raw_len": F.octet_length(kept).cast("long"), "truncated": F.octet_length(raw) > cap, "raw_b64": F.base64(kept)})
    if place is None:
        return out
    defaults = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in (("source_id", "unregistered"), ("tenant_id", "unassigned")) if c in lines.columns}
    return out.withColumns({"sealed_uid": F.substring(F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in place], F.col("raw_sha256")), 256), 1, 32), **defaults})


def size_cap(lines: DataFrame, line: str, cap: int) -> DataFrame:
    """P10: the part that parsers see; the whole stays beside it."""
    return lines.withColumn("parse_bytes", F.substring(F.col(line).cast("binary"), 1, cap))


def explode_push_batches(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """Bodies of JSON objects that follow each other without a separator: one row per object, or one reject row.

    Objects are written again with sorted keys. What stands before an error counts.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decoder = json.JSONDecoder()
        for batch in batches:
            rows = []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("body").to_pylist()):
                at, n, text = 0, 0, text or ""
                while at < len(text):
                    if text[at].isspace():
                        at += 1
                        continue
                    try:
                        value, at = decoder.raw_decode(text, at)
                        rows.append((k, n, json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")), None))
                    except ValueError:
                        rows.append((k, n, None, "malformed"))
                        break
                    n += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["k", "n", "event", "reject"])

    return bodies.select(F.col(key).cast("long").alias("k"), F.col(body).alias("body")).mapInArrow(run, "k long, n int, event string, reject string").withColumnRenamed("k", key)


def file_manifest(spark: SparkSession, path: str, place: Column | None = None) -> DataFrame:
    """Size, hash and number of lines of every uploaded file's exact bytes, and the uids of its first and last line.

    Uids are those that stamp() gives lines by (place, number of the line); place names the file, its last path part by
    default. A last line without an end counts; Spark's reader lists no empty files. A file is one row, so it must fit a task.
    """
    files = spark.read.format("binaryFile").load(path).withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    text = F.col("content").cast("string")
    closed = F.when(F.endswith(text, F.lit("\n")), F.substring("content", F.lit(1), F.octet_length("content") - 1).cast("string")).otherwise(text)
    breaks = F.octet_length("content") - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    counted = files.withColumns({"body": closed, "events": (breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")})
    uid = lambda n, line: F.substring(F.sha2(F.concat_ws("\x1f", F.col("file") if place is None else place, n.cast("string"), F.sha2(line, 256)), 256), 1, 32)
    first, last = F.substring_index("body", "\n", 1), F.substring_index("body", "\n", -1)
    return counted.select("path", "file", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "events", uid(F.lit(1), first).alias("first_uid"), uid(F.col("events"), last).alias("last_uid"), F.lit("post_hoc").alias("custody"))


def load_dimension(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """A lookup table from CSV files with a header, or from JSON lines or documents. Rows that don't fit the schema fail the load."""
    if kind not in ("csv", "json"):
        raise ValueError(f"a dimension is csv or json, not {kind}")
    reader = spark.read.option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema else reader
    return reader.option("header", True).csv(path) if kind == "csv" else reader.option("multiLine", False).json(path)


def fetch_raw(refs: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) envelopes by topic, partition and offset."""
    at = ["topic", "partition", "offset"]
    return refs.join(raw, at), refs.join(raw.select(*at), at, "left_anti")


def rules(spec: dict[str, tuple[str, object]]) -> list[tuple[str, Column]]:
    """Boolean checks from a schema table: column -> (kind, argument)."""
    made = []
    for name, (kind, arg) in spec.items():
        c = F.col(name)
        made.append((f"{name}:{kind}", {"required": lambda c=c: c.isNotNull(), "enum": lambda c=c, a=arg: c.isin(*a), "range": lambda c=c, a=arg: c.between(*a), "hex": lambda c=c, a=arg: c.rlike(f"^[0-9a-f]{{{a}}}$")}[kind]()))
    return made


def validate_rows(df: DataFrame, spec: dict[str, tuple[str, object]]) -> tuple[DataFrame, DataFrame]:
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules(spec)]))
    checked = df.withColumn("reasons", reasons)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def retain(df: DataFrame, column: str, asof: str, days: int) -> DataFrame:
    """Rows that aren't older than the retention."""
    return df.where(F.col(column) > F.expr(f"timestamp_ntz '{asof}' - interval {days} days"))


def raw_index(envelopes: DataFrame) -> DataFrame:
    """Index rows: a preview from only as many bytes as it needs, arrival in ns without loss, counts within 32 bits."""
    preview = F.substring(F.make_valid_utf8(F.unbase64(F.substring("raw_b64", 1, 1368)).cast("string")), 1, 256)
    seconds = F.unix_seconds(F.try_to_timestamp(F.regexp_replace("received_time", r"\.\d+(?=Z)", "")))
    fraction = F.rpad(F.coalesce(F.regexp_extract("received_time", r"\.(\d+)Z", 1), F.lit("")), 9, "0").cast("long")
    return envelopes.select("event_uid", F.nullif("tenant_id", F.lit("")).alias("tenant_id"), preview.alias("preview"), (seconds * 1_000_000_000 + fraction).alias("received_ns"), F.greatest(F.lit(0), F.least(F.lit(4294967295), F.col("framing.parts"))).alias("parts"))


def norm_index(events: DataFrame, body: str = "body") -> DataFrame:
    """P5: index rows of normalized events: revision 1 unless told, arrival in ns, skew, and the event's text as it came. Null times stay null."""
    revision = F.coalesce("revision", F.lit(1)) if "revision" in events.columns else F.lit(1)
    arrival = F.unix_micros(F.col("received_time").cast("timestamp")) * 1000
    return events.select("event_uid", revision.cast("int").alias("revision"), F.nullif("tenant_id", F.lit("")).alias("tenant_id"), "source_id", "class_uid", "tier", arrival.alias("received_ns"), "skew_ms", F.col(body).alias("body"))


def write_norm(df: DataFrame, path: str) -> None:
    """One output partition per category."""
    lookup = F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))])
    df.withColumn("category", F.coalesce(lookup[F.col("class_uid")], F.lit("uncategorized"))).write.mode("overwrite").partitionBy("category").parquet(path)


def write_route(df: DataFrame, path: str) -> None:
    """One folder of compact JSON lines per route."""
    df.select("route_id", F.to_json(F.struct(*[c for c in df.columns if c != "route_id"])).alias("value")).write.partitionBy("route_id").option("maxRecordsPerFile", 1_000_000).text(path)


def write_index(df: DataFrame, path: str, batch: int) -> None:
    """A batch lands whole and once: it overwrites its own partition when it is sent again."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def split_outputs(events: DataFrame) -> dict[str, DataFrame]:
    """What one normalized batch becomes: events, lineage, dead letters and shadow records."""
    return {
        "norm": events.select("event_uid", "class_uid"), "lineage": events.select("event_uid", "tier", "contract_ref"),
        "dlq": events.where("tier >= 2").select("event_uid", "tier"), "shadow": events.where("tier <> candidate_tier").select("event_uid", "tier", "candidate_tier"),
    }


def side_index(records: DataFrame) -> dict[str, DataFrame]:
    """Rows by topic; the vault index is split by kind."""
    return {k: records.where(test) for k, test in {"lineage": "topic = 'lineage'", "vault_event": "topic = 'vault' and kind = 'event'", "vault_segment": "topic = 'vault' and kind = 'segment'", "receipts": "topic = 'receipts'"}.items()}


def envelopes(s: SparkSession, d: str) -> DataFrame:
    """The log view as JSON envelopes; one in 97 is cut short, one in 89 has a bad hash."""
    e = stamp(log_view(s, d), "line")
    body = F.to_json(F.struct(F.lit(1).alias("v"), "event_uid", "tenant_id", "source_id", F.concat(F.date_format("received_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("event_id") % 1000000000).cast("string"), 9, "0"), F.lit("Z")).alias("received_time"),
        F.expr("case when event_id % 89 = 5 then 'nothex' else raw_sha256 end").alias("raw_sha256"), "raw_len", "raw_b64", F.struct(F.lit("lf").alias("method"), F.lit(False).alias("truncated"), (F.col("event_id") * 1000000).alias("parts")).alias("framing"),
        F.when(F.col("event_id") % 3 == 0, F.struct(F.lit("job").alias("job_id"), (F.col("event_id") % 4).cast("int").alias("revision"))).alias("replay")))
    return e.select("event_id", F.when(F.col("event_id") % 97 == 3, F.substring(body, 1, 40)).otherwise(body).alias("value"))


def _files(s: SparkSession, d: str) -> DataFrame:
    """Uploads of 1,000 pages each, a line a page in order of their ids."""
    path = shared_path(s, "uploads")
    lines = table(s, d, "pages").select(F.concat(F.lit("p"), F.floor(F.col("page_id") / 1000)).alias("part"), "page_id", F.replace(F.coalesce("html", F.lit("")), F.lit("\n"), F.lit(" ")).alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "page_id").select("part", "value").write.partitionBy("part").text(path)
    part = F.regexp_extract("path", "part=([^/]+)", 1)
    return file_manifest(s, f"{path}/*/*.txt", part).select(part.alias("part"), "bytes", "sha256", "events", "first_uid", "last_uid", "custody")


def _dimension(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "dimensions")
    table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(f"{path}/nation")
    table(s, d, "region").select("r_regionkey", "r_name").write.json(f"{path}/region")
    nations = load_dimension(s, f"{path}/nation", "csv", "n_nationkey int, n_name string, n_regionkey int")
    return nations.join(load_dimension(s, f"{path}/region", "json", "r_regionkey int, r_name string"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


def _norm(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "norm")
    write_norm(log_view(s, d), path)
    return s.read.parquet(path).groupBy("category").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _route(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "routes")
    write_route(log_view(s, d).select(F.col("source_id").alias("route_id"), "event_uid", "tier"), path)
    return s.read.text(path).groupBy("route_id").agg(F.count("*").alias("n"), F.min("value").alias("first"))


def _index(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "index")
    for batch in (0, 1, 1):
        write_index(log_view(s, d).where(f"event_id % 2 = {batch}").select("event_uid", "tier"), path, batch)
    return s.read.parquet(path).groupBy("batch", "tier").agg(F.count("*").alias("n"))


def _outputs(s: SparkSession, d: str) -> DataFrame:
    parts = split_outputs(log_view(s, d))
    counts = [df.agg(F.count("*").alias("n")).withColumn("output", F.lit(k)) for k, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def _side(s: SparkSession, d: str) -> DataFrame:
    r = log_view(s, d).selectExpr("case event_id % 3 when 0 then 'lineage' when 1 then 'vault' else 'receipts' end as topic", "case when event_id % 2 = 0 then 'event' else 'segment' end as kind", "event_id")
    counts = [df.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).withColumn("target", F.lit(k)) for k, df in side_index(r).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_SPEC = {"tier": ("range", (1, 3)), "source_id": ("enum", ("click", "view", "error")), "contract_ref": ("required", None), "raw_sha256": ("hex", 64)}


QUERIES = {
    "parse_envelope": lambda s, d: parse_envelope(envelopes(s, d))[0].select("event_uid", "raw_len", "framing.parts", "replay.revision"),
    "parse_envelope_rejects": lambda s, d: parse_envelope(envelopes(s, d))[1].groupBy("reason_code", "tier").agg(F.count("*").alias("n")),
    "current_state": lambda s, d: current_state(log_view(s, d).selectExpr("user_id", "event_id", "case when value < 5 then null else value end as payload"), "user_id", "event_id", "payload"),
    "load_dimension": _dimension,
    "stamp": lambda s, d: stamp(log_view(s, d).withColumn("source_id", F.expr("case when event_id % 5 = 0 then '' when event_id % 7 = 0 then null else source_id end")), "line", 60, ["event_id"]).select("event_uid", "source_id", "raw_sha256", "raw_len", "truncated", "sealed_uid"),
    "size_cap": lambda s, d: size_cap(log_view(s, d), "line", 33).select("event_uid", F.sha2("parse_bytes", 256).alias("sha"), F.octet_length("line").alias("full")),
    "explode_push_batches": lambda s, d: explode_push_batches(log_view(s, d).selectExpr("event_id", "concat(props, case when event_id % 5 = 0 then ' ' else '' end, '{\"b\": 1, \"a\": \"x\"}', case when event_id % 13 = 0 then '{oops' else '' end) as body"), "event_id", "body"),
    "file_manifest": _files,
    "fetch_raw": lambda s, d: fetch_raw(log_view(s, d).selectExpr("source_id as topic", "cast(event_id * 2 % 4 as int) as partition", "event_id * 2 as offset", "event_uid as ref"), log_view(s, d).selectExpr("source_id as topic", "cast(event_id % 4 as int) as partition", "event_id as offset", "line"))[0].select("ref", F.sha2("line", 256).alias("sha")),
    "fetch_raw_missing": lambda s, d: fetch_raw(log_view(s, d).selectExpr("source_id as topic", "cast(event_id * 2 % 4 as int) as partition", "event_id * 2 as offset", "event_uid as ref"), log_view(s, d).selectExpr("source_id as topic", "cast(event_id % 4 as int) as partition", "event_id as offset", "line"))[1].select("ref"),
    "validate_rows": lambda s, d: validate_rows(stamp(log_view(s, d), "line"), _SPEC)[1].select("event_uid", F.array_join("reasons", ",").alias("reasons")),
    "retain": lambda s, d: retain(log_view(s, d), "received_time", "2024-01-30 00:00:00", 9).groupBy("source_id").agg(F.count("*").alias("n")),
    "raw_index": lambda s, d: raw_index(parse_envelope(envelopes(s, d))[0]),
    "norm_index": lambda s, d: norm_index(log_view(s, d).selectExpr("*", "case when event_id % 3 = 0 then 2 when event_id % 5 = 0 then null else 1 end as revision"), "props"),
    "side_index": _side,
    "write_norm": _norm,
    "write_route": _route,
    "write_index": _index,
    "split_outputs": _outputs,
}

_OK = "event_id % 97 <> 3 and event_id % 89 <> 5"
_REASONS = "concat_ws(',', case when tier = 4 then 'tier:range' end, case when source_id not in ('click', 'view', 'error') then 'source_id:enum' end)"
ORACLES = {
    "parse_envelope": f"{LOG} select event_uid, strlen(line)::bigint as raw_len, event_id * 1000000 as parts, case when event_id % 3 = 0 and event_id % 4 >= 2 then (event_id % 4)::int end as revision from log where {_OK}",
    "parse_envelope_rejects": f"{LOG} select 'schema_invalid' as reason_code, 4::int as tier, count(*) as n from log where not ({_OK})",
    "current_state": f"{LOG} select user_id, payload from (select user_id, arg_max(event_id, event_id) as last, (max(struct_pack(e := event_id, v := value))).v as payload from log group by 1) where payload >= 5",
    "load_dimension": "select n_name, r_name from nation join region on n_regionkey = r_regionkey",
    "stamp": f"{LOG} select event_uid, case when event_id % 5 = 0 or event_id % 7 = 0 then 'unregistered' else source_id end as source_id, substring(sha256(concat(event_id, chr(31), sha256(line[1:60]))), 1, 32) as sealed_uid, sha256(line[1:60]) as raw_sha256, least(60, strlen(line))::bigint as raw_len, strlen(line) > 60 as truncated from log",
    "size_cap": f"{LOG} select event_uid, sha256(line[1:33]) as sha, strlen(line)::int as \"full\" from log",
    "explode_push_batches": f"""{LOG}, x as (select event_id, 0::int as n, replace(props, ': ', ':') as event, null::varchar as reject from log union all select event_id, 1, '{{"a":"x","b":1}}', null from log
 union all select event_id, 2, null, 'malformed' from log where event_id % 13 = 0) select * from x""",
    "file_manifest": """with l as (select concat('p', page_id // 1000) as part, page_id, replace(coalesce(html, ''), chr(10), ' ') as line, row_number() over (partition by page_id // 1000 order by page_id) as n from pages),
 u as (select *, substring(sha256(concat(part, chr(31), n, chr(31), sha256(line))), 1, 32) as uid from l)
 select part, (sum(strlen(line)) + count(*))::bigint as bytes, sha256(string_agg(line || chr(10), '' order by n)) as sha256, count(*) as events, arg_min(uid, n) as first_uid, arg_max(uid, n) as last_uid, 'post_hoc' as custody from u group by part""",
    "fetch_raw": f"{LOG} select a.event_uid as ref, sha256(b.line) as sha from log a join log b on a.source_id = b.source_id and b.event_id = a.event_id * 2",
    "fetch_raw_missing": f"{LOG} select a.event_uid as ref from log a where not exists (select 1 from log b where a.source_id = b.source_id and b.event_id = a.event_id * 2)",
    "validate_rows": f"{LOG} select event_uid, {_REASONS} as reasons from log where {_REASONS} <> ''",
    "retain": f"{LOG} select source_id, count(*) as n from log where received_time > timestamp '2024-01-30' - interval 9 days group by 1",
    "raw_index": f"{LOG} select event_uid, tenant_id, line as preview, epoch(date_trunc('second', received_time))::bigint * 1000000000 + event_id as received_ns, least(4294967295, event_id * 1000000) as parts from log where {_OK}",
    "norm_index": f"{LOG} select event_uid, (case when event_id % 3 = 0 then 2 else 1 end)::int as revision, tenant_id, source_id, class_uid, tier, epoch_us(received_time) * 1000 as received_ns, skew_ms, props as body from log",
    "side_index": f"""{LOG} select case event_id % 3 when 0 then 'lineage' when 2 then 'receipts' else case when event_id % 2 = 0 then 'vault_event' else 'vault_segment' end end as target, count(*) as n, sum(event_id)::bigint as ids from log group by 1""",
    "write_norm": f"{LOG} select case when class_uid = 3002 then 'iam' when class_uid = 4001 then 'network' else 'uncategorized' end as category, count(*) as n, sum(event_id)::bigint as ids from log group by 1",
    "write_route": f"""{LOG} select source_id as route_id, count(*) as n, min(concat('{{"event_uid":"', event_uid, '","tier":', tier, '}}')) as "first" from log group by 1""",
    "write_index": f"{LOG} select (event_id % 2)::int as batch, tier, count(*) as n from log group by 1, 2",
    "split_outputs": f"""{LOG} select 'norm' as output, count(*) as n from log union all select 'lineage', count(*) from log union all select 'dlq', count(*) from log where tier >= 2 union all select 'shadow', count(*) from log where tier <> candidate_tier""",
}
