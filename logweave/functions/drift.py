"""Unknown shapes: tokens, groups, mined templates, drafts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.bindings import LOG, log_view
from logweave.functions.normalize import BAD_WORDS, NOT_USERS, USER_KEYS, class_hint, detect_layers, event_time, parsed, severity_words, template_signature
from logweave.session import stored

HEX = "[0-9A-Fa-f]"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
DIGESTS = (64, 40, 32)  # hexadecimal digits of SHA-256, SHA-1 and MD5
UUID_PARTS = (8, 4, 4, 4, 12)


def _alone(pattern: str) -> str:
    """Not a part of a longer word."""
    return rf"(?<!\w)(?:{pattern})(?!\w)"


def _shapes() -> dict[str, str]:
    """What ids, addresses and times look like, put together from their parts."""
    octet, label = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)", r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
    year, month, day = r"[12]\d{3}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
    clock = r"(?:[01]\d|2[0-4]):[0-5]\d:[0-6]\d"
    dates = [f"{year}-{month}-{day}", *[sep.join((day, month, year)) for sep in ("-", "/")]]
    full = rf"(?:{'|'.join(dates)})[T ]{clock}(?:[.,]\d{{1,9}})?(?:Z|[+\-]\d\d:?\d\d)?"
    piece = f"{HEX}{{1,4}}"
    six = f"(?={HEX}*:)(?=[0-9A-Fa-f:]*::|(?:{piece}:){{7}}{piece})(?![0-9A-Fa-f:]*:::)(?!(?:{HEX}|:(?!:))*::(?:{HEX}|:(?!:))*::)(?:{piece})?(?::(?:{piece})?){{2,8}}"
    return {
        "uuid": _alone("-".join(f"{HEX}{{{n}}}" for n in UUID_PARTS)),
        "url": r"(?<![\w+.\-])[A-Za-z][\w+.\-]*://[\w\-.~:/?#\[\]@!$&()*+,;=%]+",
        "email": rf"(?<![\w.%+\-])[\w%+\-]+(?:\.[\w%+\-]+)*@(?:{label}\.)+[A-Za-z]{{2,}}(?![\w\-])",
        "timestamp": _alone(full) + "|" + _alone(rf"(?:{'|'.join(MONTHS)})\s+[0-3]?\d\s+{clock}"),
        "ip": rf"(?<![\w.])(?:{octet}\.){{3}}{octet}(?!\w|\.\d)",
        "ipv6": rf"(?<![\w:]){six}(?![\w:])",
        "hash": _alone("|".join(f"{HEX}{{{n}}}" for n in DIGESTS)),
    }


SHAPES = _shapes()
SHAPED = re.compile("|".join(f"(?:{x})" for x in SHAPES.values()), re.A)
STRING = r"\"[^\"\n]*\"|'[^'\n]*'"
NAME = r"[^\W\d][\w.\-]*"
LEAD = r"(?:for|by)\s+(?:invalid\s+)?(?:user|account)|(?:invalid\s+)?(?:user|account)|for|by"
_FIRST = (
    rf"(?<!\w)(?P<user_key>(?i:{'|'.join(USER_KEYS)}))\s*[=:]\s*(?P<user>{STRING}|[^\s,;]+)"
    rf"|(?<!\w)(?P<told>(?i:{LEAD}))\s+(?P<who>(?!(?i:{'|'.join(map(re.escape, NOT_USERS))})(?!\w))[^\W\d][\w.\-]*\w)"
    + "".join(f"|(?P<{kind}>{pattern})" + r"(?::(?P<ip_port>\d{1,5})(?!\w))?" * (kind == "ip") for kind, pattern in SHAPES.items())
    + r"|(?P<quoted>\"[^\"\n]*\")"
)
_PAIRS = rf"|(?<!\w)(?P<kv_key>{NAME})\s*=\s*(?P<kv>{STRING}|[^\s,;]+)|(?<!\w)(?P<ckv_key>{NAME}):\s*(?P<ckv>\"[^\"\n]*\"|[^\s,;:]+)"
_LAST = r"|(?<!\w)port\s+(?P<port>\d{1,5})(?!\w)|(?<!\w)(?P<hostname>[A-Za-z][\w\-]*(?:\.[A-Za-z][\w\-]*)+)(?!\w)|(?P<int>-?(?<!\w)\d+)(?!\w)|(?<!\w)(?P<word>[A-Za-z](?:[\w.\-]*\w)?)"
#: One alternation: of tokens that could begin at a place the first kind wins, of others the one that begins first.
TOKEN = re.compile(_FIRST + _PAIRS + _LAST, re.A)
NO_PAIR = re.compile(_FIRST + _LAST, re.A)
RUN = re.compile(r"[^\s,;]*")
_WORD = re.compile(r"\S+")
_KEYS = {"user": "user_key", "kv": "kv_key", "ckv": "ckv_key"}


def matches_of(text: str) -> Iterator[re.Match]:
    """TOKEN's matches. A pair whose value holds one of SHAPES isn't a pair: its key and what it holds are tokens of their own."""
    at, shape = 0, SHAPED.search(text)
    while m := TOKEN.search(text, at):
        if m.lastgroup in ("kv", "ckv"):
            begin = m.start(m.lastgroup)
            if shape is not None and shape.start() < begin:
                shape = SHAPED.search(text, begin)
            if shape is not None and shape.start() < RUN.match(text, begin).end() and text[begin] not in "\"'":
                m = NO_PAIR.match(text, m.start()) or m
        yield m
        at = m.end()


def tokens_of(text: str) -> list[tuple[str, str, str, int, int]]:
    """(kind, key, value, start, end) of a line's tokens in order; quotes around values don't count."""
    out = []
    for m in matches_of(text):
        kind = m.lastgroup
        if kind == "who":
            for w in _WORD.finditer(text, m.start("told"), m.end("told")):
                out.append(("word", "", w[0], w.start(), w.end()))
            kind = "user"
            value, at = m["who"], m.start("who")
        else:
            if kind == "ip_port":
                out.append(("ip", "", m["ip"], *m.span("ip")))
                kind, value, at = "port", m["ip_port"], m.start("ip_port")
            else:
                value, at = m[kind], m.start(kind)
        if kind in _KEYS or kind == "quoted":
            inside = value[0] in "\"'" and len(value) > 1 and value[-1] == value[0]
            value, at = (value[1:-1], at + 1) if inside else (value, at)
        out.append((kind, m[_KEYS[kind]] or "" if kind in _KEYS else "", value, at, at + len(value)))
    return out


def token_table(lines: DataFrame, key: str, line: str, most_tokens: int | None = None, most_chars: int | None = None) -> DataFrame:
    """One row per token. most_tokens and most_chars look at the first ones of a line only; `truncated` says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            rows = []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("line").to_pylist()):
                text = text or ""
                found = tokens_of(text if most_chars is None else text[:most_chars])
                cut = most_chars is not None and len(text) > most_chars or most_tokens is not None and len(found) > most_tokens
                rows += [(k, n, *t, cut) for n, t in enumerate(found[:most_tokens])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["k", "ord", "kind", "name", "value", "start", "end", "truncated"])

    got = lines.select(F.col(key).cast("string").alias("k"), F.col(line).alias("line")).mapInArrow(run, "k string, ord int, kind string, name string, value string, start int, end int, truncated boolean")
    return got.withColumnRenamed("k", key)


OBSERVED = {"ip": "ip", "ipv6": "ip", "user": "user", "hostname": "host", "email": "email", "url": "url", "uuid": "uuid", "hash": "hash"}


def generic_extract(tokens: DataFrame, key: str) -> DataFrame:
    """Numbered observables of lines without a template, each value once per line (the first user is `user`), and pairs as unmapped.<key>."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in OBSERVED.items() for x in kv]), F.col("kind"))
    base = tokens.where(F.col("kind").isin(*OBSERVED)).groupBy(key, named.alias("base"), "value").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy(key, "base").orderBy("ord"))
    seen = base.withColumn("n", place).select(key, F.when((F.col("base") == "user") & (F.col("n") == 1), "user").otherwise(F.concat("base", F.lit("_"), "n")).alias("name"), "value")
    pairs = tokens.where(F.col("kind").isin("kv", "ckv")).groupBy(key, F.concat(F.lit("unmapped."), "name").alias("name")).agg(F.max_by("value", "ord").alias("value"))
    return seen.unionByName(pairs)


def tier3_events(lines: DataFrame, key: str, line: str, received: str) -> DataFrame:
    """What is known of a line without a template: parse path, time, severity and a class hint; class_uid stays 0 and no endpoint is named."""
    stamp = F.regexp_extract(line, SHAPES["timestamp"], 0)
    timed = event_time(class_hint(severity_words(detect_layers(lines, line), line), line).withColumn("__stamp", F.nullif(stamp, F.lit(""))), "__stamp", received)
    return timed.select(key, F.lit(0).alias("class_uid"), "parse_path", "event_time", "time_source", F.col("word_severity").alias("severity_id"), "hint", "confidence")


def drift_groups(dlq: DataFrame, samples: int = 5) -> DataFrame:
    """Unknown shapes per source: count, first and last event, up to five distinct samples; unregistered sources don't count."""
    known = dlq.where(F.col("source_id") != "unregistered")
    groups = known.groupBy("source_id", "sig").agg(F.count("*").alias("n"), F.min("event_uid").alias("first_uid"), F.max("event_uid").alias("last_uid"))
    distinct = known.groupBy("source_id", "sig", "sample").agg(F.min("event_uid").alias("uid"))
    place = F.row_number().over(Window.partitionBy("source_id", "sig").orderBy("uid"))
    kept = distinct.withColumn("p", place).where(F.col("p") <= samples).groupBy("source_id", "sig").agg(F.array_join(F.sort_array(F.collect_list("uid")), ",").alias("sample_uids"))
    return groups.join(kept, ["source_id", "sig"])


def shaped_tokens(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens with the shape of their line (kinds, and the text of words), the value of the token before and whether the token is the line's first. One shuffle gathers a line's tokens."""
    part = lambda x: F.when(x["kind"] == "word", x["value"]).otherwise(F.concat(F.lit("<"), x["kind"], F.lit(">")))
    lines = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "kind", "value"))).alias("__t"))
    listed = F.transform("__t", lambda x, i: F.struct(x["ord"].alias("ord"), x["kind"].alias("kind"), x["value"].alias("value"), F.get("__t", i - 1)["value"].alias("before"), (i == 0).alias("first")))
    return lines.select(key, F.array_join(F.transform("__t", part), " ").alias("shape"), F.inline(listed))


def sample_shape_groups(shaped: DataFrame, key: str) -> DataFrame:
    """Lines by the shape of their tokens."""
    return shaped.where("first").select(key, "shape")


def variable_positions(shaped: DataFrame) -> DataFrame:
    """Which token positions vary within a group of one shape; values always do."""
    return shaped.groupBy("shape", "ord").agg((F.bool_or(F.col("kind") != "word") | (F.min("value") != F.max("value"))).alias("varies"), F.min("value").alias("value"))


def display_template(positions: DataFrame) -> DataFrame:
    """One template text per group."""
    text = F.when(F.col("varies"), "<*>").otherwise(F.col("value"))
    return positions.groupBy("shape").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"]), " ").alias("template"))


def suggest_fields(shaped: DataFrame) -> DataFrame:
    """What a token probably is, from the word before it."""
    before = F.lower("before")
    path = (
        F.when((F.col("kind") == "ip") & before.isin("from", "src"), "src_endpoint.ip").when((F.col("kind") == "ip") & before.isin("to", "dst", "via"), "dst_endpoint.ip")
        .when(F.col("kind") == "user", "user.name").when(F.col("kind") == "port", "src_endpoint.port")
        .when((F.col("kind") == "word") & F.lower("value").isin(*BAD_WORDS), "status_id:2").when((F.col("kind") == "word") & F.lower("value").isin("ok", "success", "accepted", "succeeded"), "status_id:1")
    )
    return shaped.withColumn("path", path).where(F.col("path").isNotNull()).groupBy("shape", "ord", "path").agg(F.count("*").alias("n"))


def generalize_groups(positions: DataFrame, suggested: DataFrame) -> DataFrame:
    """A pattern per group: suggested tokens are captures, other varying ones wildcards."""
    joined = positions.join(suggested.select("shape", "ord", "path"), ["shape", "ord"], "left")
    part = F.when(F.col("path").isNotNull(), F.concat(F.lit("<"), "path", F.lit(">"))).when(F.col("varies"), "<*>").otherwise(F.col("value"))
    return joined.groupBy("shape").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", part.alias("p")))), lambda x: x["p"]), " ").alias("pattern"))


def mine_templates(lines: DataFrame, source: str, line: str, similar: float = 0.4) -> DataFrame:
    """Drain-like clusters. Equal masked shapes are one row; shapes of a source with the same number of
    words and the same first word are merged in order when enough positions agree. Groups hold shapes, not lines."""
    shapes = template_signature(lines, F.col(source), line).groupBy(F.col(source).alias("source"), "shape").agg(F.count("*").alias("n"))
    words = F.split("shape", " ")
    keyed = shapes.select("source", "shape", "n", F.size(words).alias("length"), words[0].alias("first"))

    def merge(table: pa.Table) -> pa.Table:
        clusters: list[list] = []
        rows = sorted(zip(table.column("shape").to_pylist(), table.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
        for shape, n in rows:
            parts = shape.split(" ")
            best = max(clusters, key=lambda c: sum(a == b for a, b in zip(c[0], parts)), default=None)
            if best is not None and sum(a == b for a, b in zip(best[0], parts)) >= similar * len(parts):
                best[0] = [a if a == b else "<*>" for a, b in zip(best[0], parts)]
                best[1] += n
            else:
                clusters.append([parts, n])
        return pa.table({"source_id": [table.column("source")[0].as_py()] * len(clusters), "template": [" ".join(c[0]) for c in clusters], "n": pa.array([c[1] for c in clusters], pa.int64())})

    return keyed.groupBy("source", "length", "first").applyInArrow(merge, "source_id string, template string, n long")


def diff_tables(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns in which two tables differ, row by row."""
    a = expected.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    b = actual.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    both = a.join(b, key, "full_outer")
    return both.select(key, F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")))]).alias("path", "differs")).where("differs").drop("differs")


def _dlq(s: SparkSession, d: str) -> DataFrame:
    return template_signature(parsed(s, d).where("tier >= 3"), F.col("source_id"), "body").select("source_id", "sig", "event_uid", F.col("body").alias("sample"))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    """Stored once: for queries that read it several times."""
    return stored(token_table(parsed(s, d), "event_uid", "body"), "tokens")


def _shaped(s: SparkSession, d: str) -> DataFrame:
    return shaped_tokens(token_table(parsed(s, d), "event_uid", "body"), "event_uid")


def _generalized(s: SparkSession, d: str) -> DataFrame:
    shaped = shaped_tokens(_tokens(s, d), "event_uid")
    return generalize_groups(variable_positions(shaped), suggest_fields(shaped))


_KINDS = """concat(case event_id % 8 when 0 then 'id 3f2504e0-4f89-11d3-9a0c-0305e82c3301' when 1 then 'see https://x.org/a?b=1' when 2 then 'mail a.b@c.org' when 3 then 'at 2026-09-26T14:05:11Z' when 4 then 'to fe80::1:2'
 when 5 then 'sum d41d8cd98f00b204e9800998ecf8427e' when 6 then 'said "big news"' else 'for invalid user admin' end, ' on gw.example.net port 22 src=10.0.0.1 x=y z:7 -5')"""


QUERIES = {
    "token_table": lambda s, d: token_table(log_view(s, d).selectExpr("event_uid", f"{_KINDS} as line"), "event_uid", "line").select("event_uid", "ord", "kind", "name", "value", "start"),
    "generic_extract": lambda s, d: generic_extract(_tokens(s, d), "event_uid"),
    "tier3_events": lambda s, d: tier3_events(log_view(s, d).selectExpr("event_uid", "received_time", "concat('2026-01-02 03:04:05 sudo denied for user u', user_id) as line"), "event_uid", "line", "received_time").withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")),
    "drift_groups": lambda s, d: drift_groups(_dlq(s, d)),
    "sample_shape_groups": lambda s, d: sample_shape_groups(_shaped(s, d), "event_uid").groupBy("shape").agg(F.count("*").alias("n")),
    "variable_positions": lambda s, d: variable_positions(_shaped(s, d)).select("shape", "ord", "varies"),
    "display_template": lambda s, d: display_template(variable_positions(_shaped(s, d))),
    "suggest_fields": lambda s, d: suggest_fields(_shaped(s, d)),
    "generalize_groups": lambda s, d: _generalized(s, d),
    "mine_templates": lambda s, d: mine_templates(parsed(s, d), "source_id", "body"),
    "diff_tables": lambda s, d: diff_tables(log_view(s, d).select("event_uid", "tier", "source_id"), log_view(s, d).selectExpr("event_uid", "case when event_id % 7 = 0 then 9 else tier end as tier", "case when event_id % 11 = 0 then null else source_id end as source_id"), "event_uid", ["tier", "source_id"]),
}

_P = f"{LOG}, p as (select *, case when event_id % 4 = 2 then 'FAILED' else 'OK' end as word, concat('10.0.', user_id % 256, '.', event_id % 256) as src, event_id % 5 as att from log)"
_SHAPE = "concat('<user> ', word, ' login from <ip> via <ip> <ckv>')"
ORACLES = {
    "token_table": f"""{LOG}, t(k, ord, kind, name, value, start) as (values (0, 0, 'word', '', 'id', 0), (0, 1, 'uuid', '', '3f2504e0-4f89-11d3-9a0c-0305e82c3301', 3), (1, 0, 'word', '', 'see', 0), (1, 1, 'url', '', 'https://x.org/a?b=1', 4),
 (2, 0, 'word', '', 'mail', 0), (2, 1, 'email', '', 'a.b@c.org', 5), (3, 0, 'word', '', 'at', 0), (3, 1, 'timestamp', '', '2026-09-26T14:05:11Z', 3), (4, 0, 'word', '', 'to', 0), (4, 1, 'ipv6', '', 'fe80::1:2', 3),
 (5, 0, 'word', '', 'sum', 0), (5, 1, 'hash', '', 'd41d8cd98f00b204e9800998ecf8427e', 4), (6, 0, 'word', '', 'said', 0), (6, 1, 'quoted', '', 'big news', 6), (7, 0, 'word', '', 'for', 0), (7, 1, 'word', '', 'invalid', 4), (7, 2, 'word', '', 'user', 12), (7, 3, 'user', '', 'admin', 17)),
 u(ord, kind, name, value, start) as (values (0, 'word', '', 'on', 1), (1, 'hostname', '', 'gw.example.net', 4), (2, 'port', '', '22', 24), (3, 'word', '', 'src', 27), (4, 'ip', '', '10.0.0.1', 31), (5, 'kv', 'x', 'y', 42), (6, 'ckv', 'z', '7', 46), (7, 'int', '', '-5', 48)),
 w(k, n, chars) as (values (0, 2, 39), (1, 2, 23), (2, 2, 14), (3, 2, 23), (4, 2, 12), (5, 2, 36), (6, 2, 15), (7, 4, 22))
 select event_uid, t.ord::int as ord, kind, t.name, t.value, start::int as start from log join t on event_id % 8 = k
 union all select event_uid, (u.ord + n)::int, kind, u.name, u.value, (start + chars)::int from log join w on event_id % 8 = k, u""",
    "generic_extract": f"""{_P} select event_uid, 'ip_1' as name, src as value from p union all select event_uid, 'ip_2', '10.2.3.4' from p where src <> '10.2.3.4'
 union all select event_uid, 'user', concat('u', user_id) from p union all select event_uid, 'unmapped.attempts', att::varchar from p""",
    "tier3_events": f"""{LOG} select event_uid, 0::int as class_uid, 'auto:text' as parse_path, '2026-01-02 03:04:05' as event_time, 'event' as time_source, 3::int as severity_id, 3002::int as hint, 'medium' as confidence from log""",
    "drift_groups": f"""{_P}, q as (select source_id, event_uid, concat('user=u', user_id, ' ', word, ' login from ', src, ' via 10.2.3.4 attempts:', att) as sample,
 concat('t_', substring(sha256(concat(source_id, chr(31), 'user=<V> ', word, ' login from <IP> via <IP> attempts:<V>')), 1, 12)) as sig from p where tier >= 3),
 f as (select source_id, sig, sample, min(event_uid) as uid from q group by all), k as (select * from f qualify row_number() over (partition by source_id, sig order by uid) <= 5)
 select g.*, u.sample_uids from (select source_id, sig, count(*) as n, min(event_uid) as first_uid, max(event_uid) as last_uid from q group by 1, 2) g
 join (select source_id, sig, string_agg(uid, ',' order by uid) as sample_uids from k group by 1, 2) u using (source_id, sig)""",
    "sample_shape_groups": f"{_P} select {_SHAPE} as shape, count(*) as n from p group by 1",
    "variable_positions": f"{_P} select distinct {_SHAPE} as shape, (x.i)::int as ord, x.i in (0, 4, 6, 7) as varies from p, (select unnest(range(8)) as i) x",
    "display_template": f"{_P} select distinct {_SHAPE} as shape, concat('<*> ', word, ' login from <*> via <*> <*>') as template from p",
    "suggest_fields": f"""{_P}, x(ord, path) as (values (0::int, 'user.name'), (4::int, 'src_endpoint.ip'), (6::int, 'dst_endpoint.ip')), y as (select {_SHAPE} as shape, ord, path from p, x union all select {_SHAPE}, 1::int, case word when 'FAILED' then 'status_id:2' else 'status_id:1' end from p)
 select shape, ord, path, count(*) as n from y group by all""",
    "generalize_groups": f"{_P} select distinct {_SHAPE} as shape, concat('<user.name> ', case word when 'FAILED' then '<status_id:2>' else '<status_id:1>' end, ' login from <src_endpoint.ip> via <dst_endpoint.ip> <*>') as pattern from p",
    "mine_templates": f"{_P} select source_id, case when count(distinct word) > 1 then 'user=<V> <*> login from <IP> via <IP> attempts:<V>' else concat('user=<V> ', min(word), ' login from <IP> via <IP> attempts:<V>') end as template, count(*) as n from p group by 1",
    "diff_tables": f"{LOG} select event_uid, 'tier' as path from log where event_id % 7 = 0 union all select event_uid, 'source_id' from log where event_id % 11 = 0",
}
