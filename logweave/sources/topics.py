"""A partitioned log as a data source, and push batches as a table function."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from logweave.bindings import LOG, log_view
from logweave.operators.jumps import ranked
from logweave.session import shared_path, table

FORMAT = "topic_folder"
SCHEMA = "topic string, partition int, offset long, value string"
FILE_LINES = 10_000


TASK_LINES = 200_000  # lines that a task reads, of as many files as hold them


@dataclass
class Pieces(InputPartition):
    """Lines of files of one topic and partition: of each file its first offset, the one behind its last, and the offsets [first, last) to read."""

    folder: str
    topic: str
    part: int
    files: list[tuple[int, int, int, int]]


def _pack(files: list[tuple[str, str, int, int, int, int, int]]) -> list[Pieces]:
    """Tasks from (folder, topic, partition, first offset, offset behind the last, first and last to read), so that small files don't make a task each."""
    out: list[Pieces] = []
    lines = 0
    for folder, topic, part, a, b, first, last in files:
        if not out or (out[-1].folder, out[-1].topic, out[-1].part) != (folder, topic, part) or lines + last - first > TASK_LINES:
            out.append(Pieces(folder, topic, part, []))
            lines = 0
        out[-1].files.append((a, b, first, last))
        lines += last - first
    return out


def _name(first: int, last: int) -> str:
    return f"{first:020d}-{last:020d}.log"


def _files(root: str) -> list[tuple[str, str, int, int, int]]:
    """(folder, topic, partition, first offset, offset behind the last) of all files; names tell the offsets, so none is opened."""
    system, path = fs.FileSystem.from_uri(root)
    out = []
    for info in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        parts = info.path.split("/")
        if info.is_file and parts[-1].endswith(".log"):
            first, _, last = parts[-1].removesuffix(".log").partition("-")
            out.append(("/".join(parts[:-1]), parts[-3], int(parts[-2]), int(first), int(last)))
    return sorted(out, key=lambda f: f[1:])


def _lines(root: str, pieces: Pieces | None) -> Iterator[tuple]:
    if pieces is None:  # no file at all
        return
    system, _ = fs.FileSystem.from_uri(root)
    for a, b, first, last in pieces.files:
        with system.open_input_stream(f"{pieces.folder}/{_name(a, b)}") as stream:
            lines = stream.read().decode("utf-8", "replace").split("\n")
        for n in range(first - a, last - a):
            yield pieces.topic, pieces.part, a + n, lines[n]


class _Batch(DataSourceReader):
    def __init__(self, root: str, topics: set[str] | None):
        self.root, self.topics = root, topics

    def partitions(self) -> list[Pieces]:
        return _pack([(p, t, n, a, b, a, b) for p, t, n, a, b in _files(self.root) if self.topics is None or t in self.topics])

    def read(self, partition: Pieces) -> Iterator[tuple]:
        return _lines(self.root, partition)


class _Stream(DataSourceStreamReader):
    """Offsets are the next one of each topic and partition, so a restarted query goes on where its checkpoint says."""

    def __init__(self, root: str, topics: set[str] | None):
        self.root, self.topics = root, topics

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        upto: dict[str, int] = {}
        for _, topic, part, _, last in _files(self.root):
            if self.topics is None or topic in self.topics:
                upto[f"{topic}/{part}"] = max(last, upto.get(f"{topic}/{part}", 0))
        return upto

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        out = []
        for path, topic, part, a, b in _files(self.root):
            key = f"{topic}/{part}"
            first, last = max(a, start.get(key, 0)), min(b, end.get(key, 0))
            if first < last:
                out.append((path, topic, part, a, b, first, last))
        return _pack(out)

    def read(self, partition: Pieces) -> Iterator[tuple]:
        return _lines(self.root, partition)


class TopicFolder(DataSource):
    """Folders <root>/<topic>/<partition>/ of files <first offset>-<offset behind the last>.log, a line a record.

    Batch and stream give topic, partition, offset and value. Options: path (any store that Arrow opens), and
    topics, a list with commas (all if not given). A task reads files of about TASK_LINES lines; a missing or empty root gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, set[str] | None]:
        root, topics = self.options["path"], self.options.get("topics")
        return root if "://" in root or root.startswith("/") else root.replace("file:", "file://", 1), None if topics is None else set(topics.split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(*self._given())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(*self._given())


def write_topics(rows: DataFrame, root: str, begin: dict[str, int] | None = None, lines: int = FILE_LINES) -> DataFrame:
    """Rows (topic, part, ord, value) appended to a folder of TopicFolder, in order per topic and partition from the offset that `begin` names (0 if none); the files written.

    Offsets come from ranges of rows, so no partition of a topic lies in one task; a task writes files of at most `lines`
    lines. A file's name follows from its lines, so a task that runs again writes the same file.
    """
    keyed = rows.select(F.concat_ws("/", "topic", F.col("part").cast("string")).alias("k"), "ord", F.regexp_replace(F.coalesce("value", F.lit("")), "\n", " ").alias("value"))
    placed = ranked(keyed, "k", ["ord"], F.lit(0), F.lit(0))
    start = F.coalesce(F.create_map(*[F.lit(x) for pair in begin.items() for x in pair])[F.col("k")], F.lit(0)) if begin else F.lit(0)
    blocks = max(1, TASK_LINES // lines)  # files that one call writes
    numbered = placed.select("k", (F.col("__pos") + start).cast("long").alias("offset"), F.floor(F.col("__pos") / lines).alias("block"), "value").withColumn("run", F.floor(F.col("block") / blocks))

    def write(part: pa.Table) -> pa.Table:
        part = part.sort_by("offset")
        system, path = fs.FileSystem.from_uri(root)
        k, offsets, at, values = part.column("k")[0].as_py(), part.column("offset").to_pylist(), part.column("block").to_pylist(), part.column("value").to_pylist()
        system.create_dir(f"{path}/{k}", recursive=True)
        names, sizes, begin = [], [], 0
        while begin < len(at):
            end = bisect_right(at, at[begin], begin)
            name = f"{path}/{k}/{_name(offsets[begin], offsets[end - 1] + 1)}"
            with system.open_output_stream(f"{name}.part") as out:
                out.write("\n".join(values[begin:end]).encode())
            system.move(f"{name}.part", name)
            names.append(name)
            sizes.append(end - begin)
            begin = end
        return pa.table({"file": names, "n": pa.array(sizes, pa.int64())})

    return numbered.groupBy("k", "run").applyInArrow(write, "file string, n long")


# --- push batches

META = ("host", "source", "sourcetype", "index")


@F.udtf
class PushEvents:
    """One row per event of a push body, JSON objects that follow each other without a separator.

    The body's own members time, host, source, sourcetype and index are columns, other members go to extras as JSON texts; an
    object without `event` is an event itself. Object events are written again with sorted keys. What stands before an
    error counts; the error is a row with reject. A null or blank body gives none. extras can be left out by a second
    argument of false.
    """

    @staticmethod
    def analyze(body: AnalyzeArgument, extras: AnalyzeArgument | None = None) -> AnalyzeResult:
        if body.dataType.simpleString() != "string":
            raise TypeError("push_events takes a column of texts")
        wide = extras is None or extras.value is not False
        out = StructType().add("n", IntegerType()).add("event", StringType()).add("time", DoubleType())
        for name in META:
            out = out.add(name, StringType())
        if wide:
            out = out.add("extras", MapType(StringType(), StringType()))
        return AnalyzeResult(out.add("reject", StringType()))

    def eval(self, body: str | None, extras: bool = True) -> Iterator[tuple]:
        text, at, n = body or "", 0, 0
        decoder = json.JSONDecoder()
        tidy = lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        row = lambda event, own, reject: (n, event, own.pop("time", None), *[own.pop(m, None) for m in META], *([{k: tidy(v) for k, v in own.items()}] if extras is not False else []), reject)
        while at < len(text):
            if text[at].isspace():
                at += 1
                continue
            try:
                value, at = decoder.raw_decode(text, at)
                own = dict(value) if isinstance(value, dict) and "event" in value else {}
                event = own.pop("event") if own else value
                if own.get("time") is not None:
                    own["time"] = float(own["time"])
                own |= {m: tidy(own[m]) for m in META if own.get(m) is not None}
            except (ValueError, TypeError, RecursionError):
                yield row(None, {}, "malformed")
                return
            yield row(tidy(event), own, None)
            n += 1


def register(spark: SparkSession) -> None:
    """The data source and the table function under their names, for this session."""
    spark.dataSource.register(TopicFolder)
    spark.udtf.register("push_events", PushEvents)


def topic_lines(s: SparkSession, d: str) -> DataFrame:
    """The log written as a partitioned log and read back with its positions."""
    register(s)
    root = shared_path(s, "topics")
    write_topics(log_view(s, d).selectExpr("concat('raw.', source_id) as topic", "user_id % 3 as part", "event_id as ord", "line as value"), root, lines=100).write.format("noop").mode("overwrite").save()
    return s.read.format(FORMAT).load(root).groupBy("topic", "partition").agg(F.count("*").alias("n"), F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.sum(F.octet_length("value")).alias("bytes"))


def push_events(s: SparkSession, d: str) -> DataFrame:
    """Conversations pushed as bodies of several events each, read by the table function from SQL."""
    register(s)
    one = F.concat(F.lit('{"event":{"t":'), F.col("turn").cast("string"), F.lit(',"a":1},"time":'), F.col("turn").cast("string"), F.lit('.5,"host":"h'), (F.col("conv_id") % 3).cast("string"), F.lit('","fields":{"role":"'), "role", F.lit('"}}'))
    bodies = table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("body"))
    bodies.withColumn("body", F.expr("case when conv_id % 5 = 0 then concat(body, '{oops') else body end")).createOrReplaceTempView("push_bodies")
    return s.sql("select conv_id, e.event, e.time, e.host, e.index, e.extras['fields'] as fields, e.reject from push_bodies, lateral push_events(body) e")


QUERIES = {"topic_lines": topic_lines, "push_events": push_events}
ORACLES = {
    "topic_lines": f"{LOG} select concat('raw.', source_id) as topic, (user_id % 3)::int as partition, count(*) as n, 0::bigint as lo, count(*) - 1 as hi, sum(strlen(line))::bigint as bytes from log group by 1, 2",
    "push_events": """select conv_id, concat('{"a":1,"t":', turn, '}') as event, turn + 0.5::double as time, concat('h', conv_id % 3) as host, null::varchar as index, concat('{"role":"', role, '"}') as fields, null::varchar as reject from conversations
 union all select distinct conv_id, null, null, null, null, null, 'malformed' from conversations where conv_id % 5 = 0""",
}
