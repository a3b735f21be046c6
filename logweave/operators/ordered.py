"""Ordered operators, top lists and set operations."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.bindings import LOG, log_view
from logweave.session import table

MAX_LIMIT = 1000


def replacing_merge(df: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """The row with the largest version of each key. Row limits are applied before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*version))
    return df.withColumn("__n", place).where("__n = 1").drop("__n")


def top_n_per_key(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """W5"""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= n)


def receipts_dedupe(receipts: DataFrame) -> DataFrame:
    """One row per revision, route, status and time."""
    return receipts.dropDuplicates(["revision", "route_id", "status", "day"])


def join_multiline(lines: DataFrame, key: str, order: str, line: str, most_chars: int | None = None) -> DataFrame:
    """A line that begins with a blank, a tab or `at ` continues the one before it. most_chars cuts a joined text, `truncated` says so.

    A line of blanks only belongs to the run it stands in and is dropped before the first event of its key; null and
    empty lines are always dropped, and what follows them still continues the run.
    """
    w = Window.partitionBy(key).orderBy(order)
    says, more = F.col(line).rlike(r"\S"), F.col(line).rlike(r"^([ \t]|\s*at )")
    begun = F.coalesce(F.max(says).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    own = lines.where(F.coalesce(says | more, F.lit(False))).withColumn("__in", says | begun).where("__in").drop("__in")
    kept = own.withColumn("run", F.sum(F.when(more, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = kept.groupBy(key, "run").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n").alias("text"), F.count("*").alias("parts"), F.min(order).alias("first_line")
    )
    if most_chars is None:
        return joined.withColumn("truncated", F.lit(False))
    return joined.withColumn("truncated", F.length("text") > most_chars).withColumn("text", F.substring("text", 1, most_chars))


def assign_segments(records: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """W7 by count: every `size` records of a partition in order are a segment, named after its first offset."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    numbered = records.withColumn("segment_idx", F.floor(n / size).cast("long"))
    first = F.min(order).over(Window.partitionBy(key, "segment_idx"))
    return numbered.withColumn("segment_id", F.concat(F.lit("seg_"), key, F.lit("_"), F.lpad(first.cast("string"), 12, "0")))


def first_distinct(df: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """The first n distinct values of each key in order of arrival, with the row that brought each."""
    firsts = df.groupBy(key, value).agg(F.min(order).alias("first_at"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("first_at"))).where(F.col("place") <= n)


def brute_force(events: DataFrame, key: str, seconds: int, times: int) -> DataFrame:
    """Events that are the `times`-th or later of their key within the last `seconds`."""
    w = Window.partitionBy(key).orderBy("second").rangeBetween(-seconds, 0)
    return events.withColumn("hits", F.count("*").over(w)).where(F.col("hits") >= times)


def ledger_links(roots: DataFrame) -> DataFrame:
    """Each window names the hash of the one before it and doesn't begin before that ends; one row per check."""
    w = Window.orderBy("entry")  # one row per signed window: short by design
    checked = roots.withColumns({
        "link": F.col("prev_sha") == F.coalesce(F.lag("payload_sha").over(w), F.lit("0" * 64)),
        "order": F.coalesce(F.col("window_start") >= F.lag("window_end").over(w), F.lit(True)),
    })
    return checked.select("entry", F.stack(F.lit(2), F.lit("link"), "link", F.lit("order"), "order").alias("check", "ok"))


def revision_timeline(lineage: DataFrame) -> DataFrame:
    """Each revision with the status before it."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lineage.withColumn("before", F.lag("l_returnflag").over(w))


def search_newest(index: DataFrame, kind: str, key: str, limit: int) -> DataFrame:
    """Newest events of an index key; the limit is kept between 1 and 1000."""
    hits = index.where((F.col("kind") == kind) & (F.col("term") == key)).select("event_uid").distinct()
    return hits.orderBy(F.desc("event_uid")).limit(min(max(limit, 1), MAX_LIMIT))


def newest(df: DataFrame, n: int, *order: Column, where: Column | None = None) -> DataFrame:
    """Filter, order, limit."""
    return (df if where is None else df.where(where)).orderBy(*order).limit(n)


def build_search_index(lineage: DataFrame) -> DataFrame:
    """Inverted index rows: each distinct term, the signature and the raw hash of an event."""
    terms = lineage.select(F.lit("term").alias("kind"), F.explode(F.array_distinct("terms")).alias("term"), "event_uid", "tenant_id")
    one = lambda kind, c: lineage.select(F.lit(kind).alias("kind"), F.col(c).alias("term"), "event_uid", "tenant_id")
    return terms.unionByName(one("sig", "sig")).unionByName(one("sha", "sha")).dropDuplicates()


CONTRACT_ROWS = "contract string, part string, template string, name string, value string, place long"


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(contract, part, template, name, change) between two versions of contracts given as CONTRACT_ROWS.

    part is `template` (added or removed), for templates that both versions have `pattern`, `class`, `required`, `map`
    and `unmapped` (the path or name in `name`), `section` for what stands beside the templates, and `order` where
    templates of both versions changed places. Of repeated rows the largest value counts; nulls equal nulls; a version
    without rows has lost or gained everything. One shuffle by contract and template; the order takes another, of template rows only.
    """
    sides = old.select(*_ROW, F.lit(0).alias("side")).unionByName(new.select(*_ROW, F.lit(1).alias("side")))
    key = ["contract", "template", "part", "name"]
    of = lambda side, column: F.max(F.when(F.col("side") == side, F.col(column)))
    own = sides.repartition("contract", "template").groupBy(*key).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"), of(0, "value").alias("before"), of(1, "value").alias("after"))
    stays = F.max((F.col("part") == "template") & (F.col("a") > 0) & (F.col("b") > 0)).over(Window.partitionBy("contract", "template"))
    change = F.when(F.col("b") == 0, "removed").when(F.col("a") == 0, "added").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    told = own.withColumns({"stays": stays, "change": change}).where(F.col("change").isNotNull() & (F.col("stays") | F.col("part").isin("template", "section")))
    placed = sides.where("part = 'template'").groupBy("contract", "template").agg(of(0, "place").alias("before"), of(1, "place").alias("after")).where("before is not null and after is not null")
    back = F.col("after") < F.lag("after").over(Window.partitionBy("contract").orderBy("before", "after"))
    moved = placed.withColumn("back", back).groupBy("contract").agg(F.bool_or("back").alias("back")).where("back")
    return told.select("contract", "part", "template", "name", "change").unionByName(moved.select("contract", F.lit("order").alias("part"), F.lit("").alias("template"), F.lit("").alias("name"), F.lit("changed").alias("change")))


_ROW = ["contract", "part", "template", "name", "value", "place"]


def related_sigs(groups: DataFrame) -> DataFrame:
    """The other signatures of the same source and cluster, from one aggregate instead of a self join."""
    all_ = Window.partitionBy("source_id", "cluster")
    return groups.withColumn("related", F.array_join(F.sort_array(F.array_except(F.collect_set("sig").over(all_), F.array("sig"))), ","))


def _segments(s: SparkSession, d: str) -> DataFrame:
    return log_view(s, d).selectExpr("date_trunc('day', received_time) as day", "event_id").groupBy("day").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


def _roots(s: SparkSession, d: str) -> DataFrame:
    """One signed root per day; every seventh is linked wrongly."""
    seg = _segments(s, d).withColumn("entry", F.row_number().over(Window.orderBy("day")))
    seg = seg.withColumn("payload_sha", F.sha2(F.concat_ws(":", "n", "lo", "hi"), 256)).withColumn("prev", F.coalesce(F.lag("payload_sha").over(Window.orderBy("entry")), F.lit("0" * 64)))
    return seg.withColumn("prev_sha", F.when(F.col("entry") % 7 == 0, F.sha2(F.col("prev"), 256)).otherwise(F.col("prev"))).selectExpr("entry", "payload_sha", "prev_sha", "lo as window_start", "case when entry % 11 = 0 then hi + 5000 else hi + 1 end as window_end")


_TIE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _indexed(s: SparkSession, d: str) -> DataFrame:
    return build_search_index(log_view(s, d).selectExpr("event_uid", "tenant_id", "array(source_id, concat('u', user_id), concat('host-', user_id % 20), source_id) as terms", "concat('t_', substring(sha2(source_id, 256), 1, 12)) as sig", "sha2(line, 256) as sha"))


def template_events(signed: DataFrame, sig: str, source: str, n: int) -> DataFrame:
    """The newest events of a signature and source, each in its latest revision, with the place of the raw record."""
    own = signed.where((F.col("sig") == sig) & (F.col("source_id") == source))
    latest = replacing_merge(own, ["event_uid"], [F.desc("revision")])
    return newest(latest.select("event_uid", "revision", "received_time", F.concat_ws(":", "source_id", "event_id").alias("raw_ref")), n, F.desc("received_time"), F.desc("event_uid"))


def top_templates(signed: DataFrame, k: int) -> DataFrame:
    """The k most frequent shapes of each source, each event counted once."""
    counts = signed.groupBy("source_id", "sig", "shape").agg(F.count_distinct("event_uid").alias("n"))
    return top_n_per_key(counts, ["source_id"], [F.desc("n"), F.col("sig")], k)


def _signed(s: SparkSession, d: str) -> DataFrame:
    """The log view in one or two revisions with the signatures of its bodies."""
    from logweave.functions.normalize import syslog_fields, template_signature

    rows = syslog_fields(log_view(s, d)).withColumn("revision", F.explode(F.expr("if(event_id % 3 = 0, array(1, 2), array(1))")))
    return template_signature(rows, F.col("source_id"), "body")


_PART = "case when role = 'assistant' then concat(' ', case when turn % 4 = 1 then '' else coalesce(text, '') end) else text end as text"
_SHAPE = "user=<V> {} login from <IP> via <IP> attempts:<V>"
_FAILED_SIG = "t_" + hashlib.sha256(f"click\x1f{_SHAPE.format('FAILED')}".encode()).hexdigest()[:12]

# Two versions of contracts over the given tables: orders as templates, their lines as maps, customers as sections.
_VERSIONS = tuple(
    f"""select concat('c', o_orderkey % 1000) as contract, 'template' as part, concat('t', o_orderkey) as template, '' as name, '' as value, cast({place} as bigint) as place from orders where o_orderkey % 7 <> {gone}
 union all select concat('c', o_orderkey % 1000), 'class', concat('t', o_orderkey), '', {status}, cast(null as bigint) from orders where o_orderkey % 7 <> {gone}
 union all select concat('c', l_orderkey % 1000), case when l_partkey % 3 = 0 then 'unmapped' else 'map' end, concat('t', l_orderkey), concat('p', l_linenumber), concat('', {part}), cast(null as bigint) from lineitem where l_orderkey % 7 <> {gone} and l_partkey % 4 <> {lost}
 union all select concat('c', c_custkey % 1000), 'section', '', concat('s', c_custkey), {segment}, cast(null as bigint) from customer where c_custkey % 9 <> {gone}"""
    for gone, lost, place, status, part, segment in (
        (3, 1, "o_orderkey", "o_orderstatus", "l_partkey", "c_mktsegment"),
        (4, 2, "case when o_orderkey % 1000 < 10 then 0 - o_orderkey else o_orderkey end", "case when o_custkey % 5 = 0 then 'X' else o_orderstatus end", "case when l_suppkey % 10 = 0 then 0 - l_partkey else l_partkey end", "case when c_acctbal < 0 then 'Y' else c_mktsegment end"),
    )
)


def _versions(s: SparkSession, d: str) -> list[DataFrame]:
    return [s.sql(v.replace("from orders", "from {orders}").replace("from lineitem", "from {lineitem}").replace("from customer", "from {customer}"), **{t: table(s, d, t) for t in ("orders", "lineitem", "customer")}) for v in _VERSIONS]


QUERIES = {
    "latest_revision": lambda s, d: replacing_merge(table(s, d, "lineitem"), ["l_orderkey"], [F.desc("l_linenumber"), *map(F.desc, _TIE)]).selectExpr(*_LINES.split(", ")),
    "one_per_revision": lambda s, d: replacing_merge(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], [*map(F.desc, _TIE)]).selectExpr(*_LINES.split(", ")),
    "replacing_merge": lambda s, d: replacing_merge(table(s, d, "lineitem"), ["l_partkey"], [*map(F.desc, ["l_orderkey", "l_linenumber", *_TIE[1:]])]).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"),
    "top_n_per_key": lambda s, d: top_n_per_key(table(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place"),
    "receipts_dedupe": lambda s, d: receipts_dedupe(log_view(s, d).selectExpr("cast(1 + event_id % 2 as int) as revision", "source_id as route_id", "case when value < 10 then 'failed' else 'delivered' end as status", "date_format(received_time, 'yyyy-MM-dd') as day")),
    "join_multiline": lambda s, d: join_multiline(table(s, d, "conversations").selectExpr("conv_id", "turn", _PART), "conv_id", "turn", "text").select("conv_id", F.col("run").cast("long").alias("run"), F.sha2("text", 256).alias("sha"), "parts", "first_line"),
    "assign_segments": lambda s, d: assign_segments(log_view(s, d), "source_id", "event_id", 100).groupBy("segment_id").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")),
    "first_distinct": lambda s, d: first_distinct(log_view(s, d), "source_id", "user_id", "event_id", 5),
    "brute_force": lambda s, d: brute_force(log_view(s, d).where("source_id = 'error'").selectExpr("event_uid", "user_id", "unix_seconds(cast(received_time as timestamp)) as second"), "user_id", 86400, 3).select("event_uid", "user_id", "hits"),
    "ledger_links": lambda s, d: ledger_links(_roots(s, d)),
    "revision_timeline": lambda s, d: revision_timeline(table(s, d, "lineitem")).groupBy("before", "l_returnflag").agg(F.count("*").alias("n")),
    "search_newest": lambda s, d: search_newest(_indexed(s, d), "term", "host-3", 25),
    "search_index": lambda s, d: _indexed(s, d),
    "dlq_samples": lambda s, d: newest(log_view(s, d), 50, F.desc("received_time"), F.col("event_uid"), where=F.col("tier") >= 2).select("event_uid", "tier"),
    "last_root": lambda s, d: newest(_segments(s, d), 1, F.desc("day")).select("n", "lo", "hi"),
    "drift_inbox": lambda s, d: newest(log_view(s, d).where("tier = 3").groupBy("source_id", "user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_seen")), 40, F.desc("last_seen"), F.col("source_id"), F.col("user_id")),
    "audit_tail": lambda s, d: newest(log_view(s, d), 30, F.desc("event_id"), where=F.col("tenant_id") == "t2").select("event_uid"),
    "roots_with_audit": lambda s, d: newest(ledger_links(_roots(s, d)).groupBy("entry").pivot("check", ["link", "order"]).agg(F.bool_and("ok")).select("entry", F.col("link").alias("link_ok"), F.col("order").alias("order_ok")), 20, F.desc("entry")),
    "template_events": lambda s, d: template_events(_signed(s, d), _FAILED_SIG, "click", 25).withColumn("received_time", F.date_format("received_time", "yyyy-MM-dd HH:mm:ss")),
    "top_templates": lambda s, d: top_templates(_signed(s, d), 3),
    "contract_diff": lambda s, d: contract_diff(*_versions(s, d)),
    "related_sigs": lambda s, d: related_sigs(log_view(s, d).selectExpr("source_id", "user_id % 10 as cluster", "concat('s', user_id % 50) as sig").distinct()),
}

_SEG = f"{LOG}, seg as (select date_trunc('day', received_time) as day, count(*) as n, min(event_id) as lo, max(event_id) as hi from log group by 1)"
_ROOTS = f"""{_SEG}, e as (select *, row_number() over (order by day) as entry, sha256(concat(n, ':', lo, ':', hi)) as payload_sha from seg),
 p as (select *, coalesce(lag(payload_sha) over (order by entry), repeat('0', 64)) as prev from e),
 roots as (select entry, payload_sha, case when entry % 7 = 0 then sha256(prev) else prev end as prev_sha, lo as window_start, case when entry % 11 = 0 then hi + 5000 else hi + 1 end as window_end from p),
 checked as (select entry, prev_sha = coalesce(lag(payload_sha) over (order by entry), repeat('0', 64)) as link_ok, coalesce(window_start >= lag(window_end) over (order by entry), true) as order_ok from roots)"""
_IX = f"""{LOG}, ix as (select distinct * from (select 'term' as kind, unnest([source_id, concat('u', user_id), concat('host-', user_id % 20)]) as term, event_uid, tenant_id from log
 union all select 'sig', concat('t_', substring(sha256(source_id), 1, 12)), event_uid, tenant_id from log union all select 'sha', sha256(line), event_uid, tenant_id from log))"""
_DESC = ", ".join(f"{c} desc" for c in _TIE)

ORACLES = {
    "latest_revision": f"select {_LINES} from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber desc, {_DESC}) = 1",
    "one_per_revision": f"select {_LINES} from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {_DESC}) = 1",
    "replacing_merge": f"select l_partkey, l_orderkey, l_linenumber, l_suppkey from lineitem qualify row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) = 1",
    "top_n_per_key": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as place from orders qualify place <= 3",
    "receipts_dedupe": f"{LOG} select distinct (1 + event_id % 2)::int as revision, source_id as route_id, case when value < 10 then 'failed' else 'delivered' end as status, strftime(received_time, '%Y-%m-%d') as day from log",
    "join_multiline": f"""with l as (select conv_id, turn, {_PART} from conversations),
 k as (select *, regexp_matches(text, '^([ \\t]|\\s*at )') as more, coalesce(max(case when regexp_matches(text, '\\S') then 1 end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) = 1 as begun from l),
 r as (select *, sum(case when more then 0 else 1 end) over (partition by conv_id order by turn)::bigint as run from k where regexp_matches(text, '\\S') or (more and begun))
 select conv_id, run, sha256(string_agg(text, chr(10) order by turn)) as sha, count(*) as parts, min(turn) as first_line from r group by conv_id, run""",
    "assign_segments": f"""{LOG}, n as (select *, ((row_number() over (partition by source_id order by event_id) - 1) // 100) as i from log)
 select concat('seg_', source_id, '_', lpad(min(event_id)::varchar, 12, '0')) as segment_id, count(*) as n, min(event_id) as lo, max(event_id) as hi from n group by source_id, i""",
    "first_distinct": f"{LOG}, f as (select source_id, user_id, min(event_id) as first_at from log group by all) select *, row_number() over (partition by source_id order by first_at)::int as place from f qualify place <= 5",
    "brute_force": f"""{LOG}, e as (select event_uid, user_id, epoch(date_trunc('second', received_time))::bigint as second from log where source_id = 'error')
 select event_uid, user_id, count(*) over (partition by user_id order by second range between 86400 preceding and current row) as hits from e qualify hits >= 3""",
    "ledger_links": f"""{_ROOTS} select entry::int as entry, 'link' as "check", link_ok as ok from checked union all select entry::int, 'order', order_ok from checked""",
    "revision_timeline": f"""select before, l_returnflag, count(*) as n from (select l_returnflag, lag(l_returnflag) over (partition by l_orderkey order by l_linenumber, {', '.join(_TIE)}) as before from lineitem) group by all""",
    "search_newest": f"{_IX} select event_uid from ix where kind = 'term' and term = 'host-3' order by event_uid desc limit 25",
    "search_index": f"{_IX} select * from ix",
    "dlq_samples": f"{LOG} select event_uid, tier from log where tier >= 2 order by received_time desc, event_uid limit 50",
    "last_root": f"{_SEG} select n, lo, hi from seg order by day desc limit 1",
    "drift_inbox": f"{LOG} select source_id, user_id, count(*) as n, max(event_id) as last_seen from log where tier = 3 group by all order by last_seen desc, source_id, user_id limit 40",
    "audit_tail": f"{LOG} select event_uid from log where tenant_id = 't2' order by event_id desc limit 30",
    "roots_with_audit": f"{_ROOTS} select entry::int as entry, link_ok, order_ok from checked order by entry desc limit 20",
    "template_events": f"{LOG} select event_uid, (case when event_id % 3 = 0 then 2 else 1 end)::int as revision, strftime(received_time, '%Y-%m-%d %H:%M:%S') as received_time, concat('click:', event_id) as raw_ref from log where source_id = 'click' and event_id % 4 = 2 order by log.received_time desc, event_uid desc limit 25",
    "top_templates": f"""{LOG}, t as (select source_id, replace('{_SHAPE}', '{{}}', case when event_id % 4 = 2 then 'FAILED' else 'OK' end) as shape, count(*) as n from log group by 1, 2),
 c as (select *, concat('t_', substring(sha256(concat(source_id, chr(31), shape)), 1, 12)) as sig from t) select *, row_number() over (partition by source_id order by n desc, sig)::int as place from c qualify place <= 3""",
    "contract_diff": f"""with o as (select contract, part, template, name, max(value) as value, max(place) as place from ({_VERSIONS[0]}) group by all), n as (select contract, part, template, name, max(value) as value, max(place) as place from ({_VERSIONS[1]}) group by all),
 stays as (select o.contract, o.template, o.place as was, n.place as is_now from o join n using (contract, template, part) where part = 'template'),
 x as (select coalesce(o.contract, n.contract) as contract, coalesce(o.part, n.part) as part, coalesce(o.template, n.template) as template, coalesce(o.name, n.name) as name, case when n.contract is null then 'removed' when o.contract is null then 'added' else 'changed' end as change
  from o full join n on o.contract = n.contract and o.part = n.part and o.template = n.template and o.name = n.name where n.contract is null or o.contract is null or o.value is distinct from n.value)
 select * from x where part in ('template', 'section') or (contract, template) in (select (contract, template) from stays)
 union all select distinct a.contract, 'order', '', '', 'changed' from stays a join stays b on a.contract = b.contract and a.was < b.was and a.is_now > b.is_now""",
    "related_sigs": f"""{LOG}, g as (select distinct source_id, user_id % 10 as cluster, concat('s', user_id % 50) as sig from log)
 select a.source_id, a.cluster, a.sig, coalesce(string_agg(b.sig, ',' order by b.sig) filter (b.sig <> a.sig), '') as related from g a join g b using (source_id, cluster) group by all""",
}
