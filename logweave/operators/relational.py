"""Filters, index projections and joins."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.bindings import LOG, log_view
from logweave.session import table

UID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ROUTE_KEYS = ("tenants", "tiers", "classes", "sources")
ROUTES = (
    {"id": "soc", "tiers": [1, 2], "sources": ["*"], "format": "ocsf"},
    {"id": "errors", "sources": ["error"], "tenants": ["t0", "t1"], "format": "siem"},
)


def tenant_filter(df: DataFrame, tenant: str | None) -> DataFrame:
    """Empty, null and * mean all tenants."""
    return df if tenant in (None, "", "*") else df.where(F.col("tenant_id") == tenant)


def route_accepts(route: dict) -> Column:
    """All given sets must hold; an absent key is no constraint, * only stands for any tenant or source."""
    if unknown := set(route) - {*ROUTE_KEYS, "id", "format", "mask"}:
        raise ValueError(f"route {route.get('id')}: unknown keys {sorted(unknown)}")
    columns = {"tenants": "tenant_id", "tiers": "tier", "classes": "class_uid", "sources": "source_id"}
    tests = [F.col(columns[k]).isin(v) for k, v in route.items() if k in columns and not (k in ("tenants", "sources") and "*" in v)]
    accepted = F.lit(True)
    for t in tests:
        accepted = accepted & t
    return accepted


def route_filter(df: DataFrame, route: dict) -> DataFrame:
    return df.where(route_accepts(route))


def classify_query(q: DataFrame) -> DataFrame:
    """What kind of search text each row is."""
    kind = F.when(F.lower("q").rlike(UID), "uid").when(F.col("q").rlike("^t_[0-9a-f]{12}$"), "sig").when(F.lower("q").rlike("^[0-9a-f]{8,64}$"), "sha").otherwise("term")
    return q.withColumn("kind", kind)


def lineage_view(log: DataFrame) -> DataFrame:
    """The lineage row with at most 16 distinct search terms, observables first."""
    terms = F.slice(F.array_distinct(F.array_compact(F.array("ip", F.concat(F.lit("u"), "user_id"), "ip", F.concat(F.lit("host-"), F.col("user_id") % 20), "source_id"))), 1, 16)
    with_ip = log.withColumn("ip", F.nullif(F.regexp_extract("line", r"from (\d+\.\d+\.\d+\.\d+)", 1), F.lit("")))
    return with_ip.select("event_uid", "tenant_id", "source_id", "tier", "contract_ref", F.sha2("line", 256).alias("raw_sha256"), terms.alias("search_terms"))


def siem_view(log: DataFrame) -> DataFrame:
    """The event with a flat block for a SIEM, as JSON."""
    flat = F.to_json(F.struct("tier", F.col("class_uid").alias("class"), F.col("tenant_id").alias("tenant"), F.col("source_id").alias("source"), F.col("contract_ref").alias("contract")))
    return log.select("event_uid", flat.alias("siem"))


def resolve_source(raw: DataFrame, inventory: DataFrame) -> DataFrame:
    """By listener and peer, else by listener and the header's host, else unregistered; the inventory's zone or a default."""
    by = lambda kind, name: F.broadcast(inventory.where(F.col("match_kind") == kind).select("listener", F.col("match_value").alias(name), F.col("source").alias(f"{name}_source"), F.col("zone").alias(f"{name}_zone")))
    host = raw.withColumn("host", F.regexp_extract("line", r"^<\d+>\w{3} \d{2} \d{2}:\d{2}:\d{2} (\S+)", 1))
    joined = host.join(by("peer_ip", "peer"), ["listener", "peer"], "left").join(by("syslog_host", "host"), ["listener", "host"], "left")
    return joined.select("event_uid", F.coalesce("peer_source", "host_source", F.lit("unregistered")).alias("resolved"), F.coalesce("peer_zone", "host_zone", F.lit("unassigned")).alias("zone"))


def enrich(events: DataFrame, dimension: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """For each path, the first row of the dimension whose match equals the value; appended in path order."""
    first = dimension.withColumn("n", F.row_number().over(Window.partitionBy("match_value").orderBy("row"))).where("n = 1").drop("n", "row")
    long = events.select("event_uid", F.posexplode(F.array(*paths)).alias("ord", "match_value"))
    hit = long.join(first, "match_value").groupBy("event_uid").agg(F.sort_array(F.collect_list(F.struct("ord", "label"))).alias("hits"))
    return hit.select("event_uid", F.array_join(F.transform("hits", lambda x: x["label"]), ",").alias("enrichments"))


def apply_vocab(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Words to enum values, whatever their case; a miss leaves the path missing."""
    return rows.join(F.broadcast(vocab.select(F.upper("word").alias("w"), "status_id")), F.upper("word") == F.col("w"), "left").drop("w").withColumn("missing", F.col("status_id").isNull())


def bind_contracts(contracts: DataFrame, named: DataFrame) -> DataFrame:
    """Source to contract from both declarations, the last loaded wins."""
    both = contracts.select(F.explode("sources").alias("source_id"), "contract", "loaded").unionByName(named.select("source_id", "contract", "loaded"))
    return both.groupBy("source_id").agg(F.max(F.struct("loaded", "contract")).getField("contract").alias("contract"))


def vault_window(locations: DataFrame, segments: DataFrame) -> DataFrame:
    """Each event's segment and the window of that segment's newest version."""
    newest = segments.groupBy("segment_no").agg(F.max(F.struct("version", "window_id")).getField("window_id").alias("window_id"))
    return locations.join(newest, "segment_no", "left")


def fan_out(events: DataFrame, routes: tuple[dict, ...] = ROUTES) -> DataFrame:
    """Every event for every route; what a route doesn't accept is `filtered`. Routes are a few literals, so no join is needed."""
    made = F.array(*[F.struct(F.lit(r["id"]).alias("route_id"), F.when(route_accepts(r), "delivered").otherwise("filtered").alias("status")) for r in routes])
    return events.select("event_uid", F.inline(made))


def attribute_by_key(requests: DataFrame, keys: DataFrame, sources: DataFrame, pepper: str, vendor: str = "generic", zone: str = "unassigned", quota: int = 1000) -> DataFrame:
    """Whose requests (event_uid, secret) are: found by the hash of pepper and secret, with the outcome `admitted` or the reason against it.

    keys holds one row per key_hash (key_id, pepper_id, status, source_id, quota_eps), sources one per source_id (vendor,
    zone, status). In this order: no_credential (null or empty), unknown_key, pepper_mismatch (the key names another
    pepper), the key's status unless active, source_paused. A source that isn't registered is admitted with the
    defaults, so that nothing is lost. A null or empty value, or a quota of 0, takes the default too.
    """
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    hashed = requests.select("event_uid", "secret", F.sha2(F.concat(F.lit(pepper), "secret"), 256).alias("key_hash"))
    known = keys.select("key_hash", "key_id", "pepper_id", F.coalesce("status", F.lit("unknown")).alias("key_status"), "source_id", "quota_eps")
    joined = hashed.join(known, "key_hash", "left").join(sources.select("source_id", "vendor", "zone", F.col("status").alias("source_status")), "source_id", "left")
    reason = (
        F.when(F.coalesce("secret", F.lit("")) == "", "no_credential").when(F.col("key_id").isNull(), "unknown_key")
        .when(F.nullif("pepper_id", F.lit("")) != pepper_id(pepper), "pepper_mismatch").when(F.col("key_status") != "active", F.col("key_status")).when(F.col("source_status") == "paused", "source_paused").otherwise("admitted")
    )
    return joined.select(
        "event_uid", "key_id", text("source_id", "none").alias("source_id"), text("vendor", vendor).alias("vendor"), text("zone", zone).alias("zone"),
        F.coalesce(F.nullif(F.col("quota_eps").cast("int"), F.lit(0)), F.lit(quota)).alias("quota_eps"), reason.alias("outcome"),
    )


def pepper_id(pepper: str) -> str:
    """The short name by which keys tell their pepper."""
    return "p_" + hashlib.sha256(pepper.encode()).hexdigest()[:8]


def provenance_gap(events: DataFrame, claimed: str, located: str, derived: str) -> DataFrame:
    """U4: events with gap, the claimed paths that are neither located in the line nor derived, in order of name; events without one are left out. Null arrays are empty."""
    held = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return events.withColumn("gap", F.array_sort(F.array_except(held(claimed), F.array_union(held(located), held(derived))))).where(F.size("gap") > 0)


def find_events(sigs: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """Up to limit distinct events of an ordered list of signatures, earlier signatures and newer events first."""
    first = index.join(F.broadcast(sigs), "sig").groupBy("event_uid").agg(F.min("ord").alias("ord"))
    return first.orderBy("ord", F.desc("event_uid")).limit(limit)


def skip_indexed(batch: DataFrame, index: DataFrame) -> DataFrame:
    """Records that aren't indexed yet at the same position and time."""
    return batch.join(index.select("topic", "part", "pos", "received_time"), ["topic", "part", "pos", "received_time"], "left_anti")


def shadow_join(active: DataFrame, candidate: DataFrame) -> DataFrame:
    """Claims (event_uid, path, value) of two contract versions: which paths were added, changed or lost."""
    both = active.withColumnRenamed("value", "before").join(candidate.withColumnRenamed("value", "after"), ["event_uid", "path"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "lost").when(F.col("before") != F.col("after"), "changed")
    return both.withColumn("change", change).where(F.col("change").isNotNull())


def locate(uids: DataFrame, vault: DataFrame, roots: DataFrame) -> DataFrame:
    """Event to segment to the signed window that covers it."""
    covered = roots.select("window_id", F.explode("segments").alias("segment_no"))
    return uids.join(vault, "event_uid", "left").join(covered, "segment_no", "left").select("event_uid", "segment_no", "window_id")


def event_detail(orders: DataFrame, lines: DataFrame, key: str = "l_orderkey") -> DataFrame:
    """One row per event with its revisions in order, for many events at once."""
    revisions = lines.groupBy(F.col(key).alias("o_orderkey")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])), ",").alias("revisions"),
        F.count("*").alias("n_revisions"),
    )
    return orders.join(revisions, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "revisions", F.coalesce("n_revisions", F.lit(0)).alias("n_revisions"))


def search_hits(log: DataFrame, raw: DataFrame, uids: DataFrame) -> DataFrame:
    """Found events with their newest lineage and raw row; an event may be in only one of them."""
    lineage = log.join(uids, "event_uid", "left_semi").select("event_uid", "tier", F.col("tenant_id").alias("lt"))
    stored = raw.join(uids, "event_uid", "left_semi").select("event_uid", F.substring("line", 1, 40).alias("preview"), F.col("tenant_id").alias("rt"))
    return lineage.join(stored, "event_uid", "full_outer").select("event_uid", "tier", "preview", F.coalesce("lt", "rt").alias("tenant_id"))


def replay_select(df: DataFrame, source: str | None, start: str | None, end: str | None) -> DataFrame:
    """P9"""
    for given, test in ((source, F.col("source_id") == source), (start, F.col("received_time") >= F.lit(start).cast("timestamp_ntz")), (end, F.col("received_time") <= F.lit(end).cast("timestamp_ntz"))):
        if given is not None:
            df = df.where(test)
    return df


PROBES = ("error", "t_3c85a1bfbf81", "00000000-0000-7000-8000-000000000001", "deadbeef", "host-3", "DEADBEEF01", "t_zz")


def _inventory(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation")
    peers = n.selectExpr("'l1' as listener", "'peer_ip' as match_kind", "concat('10.0.0.', n_nationkey) as match_value", "concat('src-', n_name) as source", "concat('zone', n_regionkey) as zone")
    hosts = n.where("n_nationkey < 10").selectExpr("'l1' as listener", "'syslog_host' as match_kind", "concat('host-', n_nationkey) as match_value", "concat('host-', n_name) as source", "cast(null as string) as zone")
    return peers.unionByName(hosts)


def _resolve(s: SparkSession, d: str) -> DataFrame:
    raw = log_view(s, d).selectExpr("event_uid", "line", "'l1' as listener", "concat('10.0.0.', user_id % 60) as peer")
    return resolve_source(raw, _inventory(s, d))


def _claims(log: DataFrame, which: str) -> DataFrame:
    return log.select("event_uid", F.explode(F.expr(_PATHS[which])).alias("path", "value")).where("value is not null")


_PATHS = {
    "a": "map('user.name', concat('u', user_id), 'src.ip', concat('10.0.', user_id % 256, '.', event_id % 256), 'status', if(event_id % 4 = 2, 'fail', null))",
    "c": "map('user.name', if(event_id % 7 = 0, concat('U', user_id), concat('u', user_id)), 'src.ip', if(event_id % 5 = 0, null, concat('10.0.', user_id % 256, '.', event_id % 256)), 'attempts', concat(event_id % 5))",
}


def _vocab(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("click", 1), ("VIEW", 1), ("Error", 2), ("signup", 99)], "word string, status_id int")


def _keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").selectExpr("sha2(concat('pepper', concat('secret', c_custkey)), 256) as key_hash", "c_custkey as key_id", *_KEY)


def _fan(s: SparkSession, d: str) -> DataFrame:
    return fan_out(log_view(s, d)).groupBy("route_id", "status").agg(F.count("*").alias("n"))


def _sources(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("BUILDING", "acme", "north", "active"), ("MACHINERY", "globex", None, "paused"), ("FURNITURE", None, "south", "active")], "source_id string, vendor string, zone string, status string")


_KEY = (f"case when c_custkey % 11 = 0 then 'p_former' when c_custkey % 13 = 0 then '' else '{pepper_id('pepper')}' end as pepper_id", "case when c_acctbal < 0 then 'revoked' else 'active' end as status", "c_mktsegment as source_id", "cast(c_custkey % 3 * 10 as int) as quota_eps")
_SECRET = "case when event_id % 17 = 0 then null when event_id % 19 = 0 then '' else concat('secret', user_id * (1 + event_id % 20)) end as secret"


def _gap(s: SparkSession, d: str) -> DataFrame:
    """What two readers claim about each line, located where the line holds the value; one in three states is told as derived."""
    made = "map_concat({}, map('state', if(event_id % 4 = 2, 'fail', null)))".format(_PATHS["c"])
    claims = log_view(s, d).selectExpr("event_uid", "event_id", "line", f"map_filter({made}, (k, v) -> v is not null) as claims")
    parts = claims.selectExpr("event_uid", "map_keys(claims) as claimed", "map_keys(map_filter(claims, (k, v) -> contains(line, v))) as located", "if(event_id % 3 = 0, array('state'), null) as derived")
    return provenance_gap(parts, "claimed", "located", "derived").select("event_uid", F.array_join("gap", ",").alias("gap"))


def _ocsf(events: DataFrame) -> Column:
    """The whole event as compact JSON."""
    return F.to_json(F.struct(*events.columns))


def _siem(events: DataFrame) -> Column:
    """A line of key=value pairs; values with blanks are quoted, nulls are left out."""
    pair = lambda c: F.concat(F.lit(f"{c}="), F.when(F.col(c).cast("string").rlike(r"[\s\"]"), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit("'")), F.lit('"'))).otherwise(F.col(c).cast("string")))
    return F.concat_ws(" ", *[pair(c) for c in events.columns])


RENDERERS = {"ocsf": _ocsf, "siem": _siem}


def render(events: DataFrame, routes: tuple[dict, ...] = ROUTES) -> DataFrame:
    """(route_id, event_uid, value): what each route takes, written in its format; formats are looked up in RENDERERS by name."""
    out = []
    for route in routes:
        if route["format"] not in RENDERERS:
            raise ValueError(f"unknown format {route['format']}; known: {', '.join(sorted(RENDERERS))}")
        taken = route_filter(events, route)
        out.append(taken.select(F.lit(route["id"]).alias("route_id"), "event_uid", RENDERERS[route["format"]](taken).alias("value")))
    return reduce(DataFrame.unionByName, out)


QUERIES = {
    "render": lambda s, d: render(log_view(s, d).selectExpr("event_uid", "tier", "source_id", "tenant_id", "case when event_id % 2 = 0 then concat(source_id, ' x') end as note")),
    "tenant_filter": lambda s, d: tenant_filter(log_view(s, d), "t1").unionByName(tenant_filter(log_view(s, d), "*")).groupBy("tenant_id").agg(F.count("*").alias("n")),
    "route_filter": lambda s, d: route_filter(log_view(s, d), ROUTES[1]).select("event_uid", "tenant_id", "tier"),
    "classify_query": lambda s, d: classify_query(log_view(s, d).select(F.expr("case event_id % 4 when 0 then source_id when 1 then sha2(line, 256) when 2 then concat('t_', substring(sha2(line, 256), 1, 12)) else event_uid end").alias("q"))).groupBy("kind").agg(F.count("*").alias("n")),
    "lineage_view": lambda s, d: lineage_view(log_view(s, d)).withColumn("search_terms", F.array_join("search_terms", "|")),
    "siem_view": lambda s, d: siem_view(log_view(s, d)),
    "resolve_source": _resolve,
    "enrich": lambda s, d: enrich(
        log_view(s, d).selectExpr("event_uid", "concat('k', user_id) as a", "concat('k', event_id % 50) as b", "concat('h', user_id % 20) as c"),
        table(s, d, "customer").selectExpr("concat('k', c_custkey % 1000) as match_value", "c_custkey as row", "c_name as label"), ("a", "b", "c"),
    ),
    "apply_vocab": lambda s, d: apply_vocab(log_view(s, d).select("event_uid", F.col("source_id").alias("word")), _vocab(s)),
    "bind_contracts": lambda s, d: bind_contracts(
        table(s, d, "nation").groupBy(F.concat(F.lit("contract"), F.col("n_regionkey")).alias("contract"), F.col("n_regionkey").cast("long").alias("loaded")).agg(F.collect_list(F.concat(F.lit("s"), F.col("n_nationkey") % 7)).alias("sources")),
        table(s, d, "supplier").selectExpr("concat('s', s_suppkey % 11) as source_id", "concat('named', s_nationkey) as contract", "s_suppkey % 9 as loaded"),
    ),
    "vault_window": lambda s, d: vault_window(log_view(s, d).select("event_uid", "segment_no"), log_view(s, d).selectExpr("segment_no", "event_id as version", "concat('w', event_id % 13) as window_id").where("segment_no % 3 <> 1")),
    "fan_out_receipts": _fan,
    "attribute_by_key": lambda s, d: attribute_by_key(log_view(s, d).selectExpr("event_uid", _SECRET), _keys(s, d), _sources(s), "pepper"),
    "find_events": lambda s, d: find_events(s.createDataFrame([("error", 1), ("signup", 2)], "sig string, ord int"), log_view(s, d).selectExpr("source_id as sig", "event_uid"), 200),
    "skip_indexed": lambda s, d: skip_indexed(
        log_view(s, d).selectExpr("source_id as topic", "user_id % 4 as part", "event_id as pos", "received_time", "event_uid"),
        log_view(s, d).where("event_id % 3 <> 0").selectExpr("source_id as topic", "user_id % 4 as part", "event_id as pos", "case when event_id % 5 = 0 then received_time + interval 1 second else received_time end as received_time"),
    ).select("event_uid", "topic"),
    "shadow_join": lambda s, d: shadow_join(_claims(log_view(s, d), "a"), _claims(log_view(s, d), "c")).groupBy("path", "change").agg(F.count("*").alias("n")),
    "changed_and_lost": lambda s, d: shadow_join(_claims(log_view(s, d), "a"), _claims(log_view(s, d), "c")).groupBy("event_uid").agg(F.array_join(F.sort_array(F.collect_list(F.concat("change", F.lit(":"), "path"))), ",").alias("changes")),
    "provenance_gap": _gap,
    "locate": lambda s, d: locate(log_view(s, d).select("event_uid"), log_view(s, d).where("event_id % 10 <> 9").select("event_uid", "segment_no"), log_view(s, d).where("segment_no % 4 <> 2").groupBy(F.expr("concat('w', segment_no % 3)").alias("window_id")).agg(F.collect_set("segment_no").alias("segments"))),
    "event_detail": lambda s, d: event_detail(table(s, d, "orders"), table(s, d, "lineitem")),
    "search_hits": lambda s, d: search_hits(log_view(s, d).where("event_id % 3 <> 0"), log_view(s, d).where("event_id % 4 <> 0"), log_view(s, d).where("source_id = 'error'").select("event_uid")),
    "replay_select": lambda s, d: replay_select(log_view(s, d), "click", "2024-01-05 00:00:00", "2024-01-08 00:00:00").select("event_uid"),
}

_SRC_IP = "concat('10.0.', user_id % 256, '.', event_id % 256)"
_CL = f"""{LOG}, a as (select event_uid, unnest([{{'path': 'user.name', 'value': concat('u', user_id)}}, {{'path': 'src.ip', 'value': {_SRC_IP}}}, {{'path': 'status', 'value': case when event_id % 4 = 2 then 'fail' end}}], recursive := true) from log),
 c as (select event_uid, unnest([{{'path': 'user.name', 'value': case when event_id % 7 = 0 then concat('U', user_id) else concat('u', user_id) end}}, {{'path': 'src.ip', 'value': case when event_id % 5 <> 0 then {_SRC_IP} end}}, {{'path': 'attempts', 'value': concat(event_id % 5)}}], recursive := true) from log),
 x as (select event_uid, path, case when a.value is null then 'added' when c.value is null then 'lost' when a.value <> c.value then 'changed' end as change
  from (select * from a where value is not null) a full join (select * from c where value is not null) c using (event_uid, path))"""

ORACLES = {
    "render": f"""{LOG}, e as (select *, case when event_id % 2 = 0 then concat(source_id, ' x') end as note from log)
 select 'soc' as route_id, event_uid, concat('{{"event_uid":"', event_uid, '","tier":', tier, ',"source_id":"', source_id, '","tenant_id":"', tenant_id, '"', case when note is null then '' else concat(',"note":"', note, '"') end, '}}') as value from e where tier in (1, 2)
 union all select 'errors', event_uid, concat('event_uid=', event_uid, ' tier=', tier, ' source_id=', source_id, ' tenant_id=', tenant_id, case when note is null then '' else concat(' note="', note, '"') end) from e where source_id = 'error' and tenant_id in ('t0', 't1')""",
    "tenant_filter": f"{LOG} select tenant_id, count(*) * (case when tenant_id = 't1' then 2 else 1 end) as n from log group by 1",
    "route_filter": f"{LOG} select event_uid, tenant_id, tier from log where source_id = 'error' and tenant_id in ('t0', 't1')",
    "classify_query": f"""{LOG} select case when regexp_matches(lower(q), '{UID}') then 'uid' when regexp_matches(q, '^t_[0-9a-f]{{12}}$') then 'sig' when regexp_matches(lower(q), '^[0-9a-f]{{8,64}}$') then 'sha' else 'term' end as kind, count(*) as n
 from (select case event_id % 4 when 0 then source_id when 1 then sha256(line) when 2 then concat('t_', substring(sha256(line), 1, 12)) else event_uid end as q from log) group by 1""",
    "lineage_view": f"""{LOG} select event_uid, tenant_id, source_id, tier, contract_ref, sha256(line) as raw_sha256,
 concat(regexp_extract(line, 'from ([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)', 1), '|u', user_id, '|host-', user_id % 20, '|', source_id) as search_terms from log""",
    "siem_view": f"""{LOG} select event_uid, concat('{{"tier":', tier, ',"class":', class_uid, ',"tenant":"', tenant_id, '","source":"', source_id, '","contract":"', contract_ref, '"}}') as siem from log""",
    "resolve_source": f"""{LOG}, r as (select event_uid, concat('10.0.0.', user_id % 60) as peer, regexp_extract(line, '^<[0-9]+>[A-Za-z]{{3}} [0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}} ([^ ]+)', 1) as host from log)
 select event_uid, coalesce('src-' || p.n_name, 'host-' || h.n_name, 'unregistered') as resolved, coalesce(concat('zone', case when p.n_name is not null then p.n_regionkey end), 'unassigned') as zone
 from r left join nation p on r.peer = concat('10.0.0.', p.n_nationkey) left join nation h on h.n_nationkey < 10 and r.host = concat('host-', h.n_nationkey)""".replace(
        "coalesce(concat('zone', case when p.n_name is not null then p.n_regionkey end), 'unassigned')", "case when p.n_name is not null then concat('zone', p.n_regionkey) else 'unassigned' end"
    ),
    "enrich": f"""{LOG}, dim as (select concat('k', c_custkey % 1000) as m, arg_min(c_name, c_custkey) as label from customer group by 1),
 long as (select event_uid, 0 as ord, concat('k', user_id) as m from log union all select event_uid, 1, concat('k', event_id % 50) from log union all select event_uid, 2, concat('h', user_id % 20) from log)
 select event_uid, string_agg(label, ',' order by ord, label) as enrichments from long join dim using (m) group by 1""",
    "apply_vocab": f"{LOG} select event_uid, source_id as word, case upper(source_id) when 'CLICK' then 1 when 'VIEW' then 1 when 'ERROR' then 2 when 'SIGNUP' then 99 end::int as status_id, upper(source_id) not in ('CLICK', 'VIEW', 'ERROR', 'SIGNUP') as missing from log",
    "bind_contracts": """with b as (select concat('s', n_nationkey % 7) as source_id, concat('contract', n_regionkey) as contract, n_regionkey::bigint as loaded from nation
 union all select concat('s', s_suppkey % 11), concat('named', s_nationkey), s_suppkey % 9 from supplier) select source_id, arg_max(contract, (loaded, contract)) as contract from b group by 1""",
    "vault_window": f"""{LOG}, s as (select segment_no, arg_max(concat('w', event_id % 13), event_id) as window_id from log where segment_no % 3 <> 1 group by 1) select segment_no, event_uid, window_id from log left join s using (segment_no)""",
    "fan_out_receipts": f"""{LOG}, x as (select 'soc' as route_id, tier in (1, 2) as ok from log union all select 'errors', source_id = 'error' and tenant_id in ('t0', 't1') from log)
 select route_id, case when ok then 'delivered' else 'filtered' end as status, count(*) as n from x group by all""",
    "attribute_by_key": f"""{LOG}, k as (select concat('secret', c_custkey) as secret, c_custkey as key_id, {', '.join(_KEY)} from customer)
 select event_uid, key_id, coalesce(source_id, 'none') as source_id, case source_id when 'BUILDING' then 'acme' when 'MACHINERY' then 'globex' else 'generic' end as vendor,
 case source_id when 'BUILDING' then 'north' when 'FURNITURE' then 'south' else 'unassigned' end as zone, coalesce(nullif(quota_eps, 0), 1000)::int as quota_eps,
 case when coalesce(r.secret, '') = '' then 'no_credential' when key_id is null then 'unknown_key' when pepper_id = 'p_former' then 'pepper_mismatch' when status = 'revoked' then 'revoked' when source_id = 'MACHINERY' then 'source_paused' else 'admitted' end as outcome
 from (select event_uid, {_SECRET} from log) r left join k on k.secret = r.secret""",
    "find_events": f"{LOG} select event_uid, case source_id when 'error' then 1 else 2 end::int as ord from log where source_id in ('error', 'signup') order by ord, event_uid desc limit 200",
    "skip_indexed": f"{LOG} select event_uid, source_id as topic from log where event_id % 3 = 0 or event_id % 5 = 0",
    "shadow_join": f"{_CL} select path, change, count(*) as n from x where change is not null group by all",
    "changed_and_lost": f"{_CL} select event_uid, string_agg(change || ':' || path, ',' order by change || ':' || path) as changes from x where change is not null group by 1",
    "provenance_gap": f"""{LOG}, g as (select event_uid, concat_ws(',', case when event_id % 4 = 2 and event_id % 3 <> 0 then 'state' end, case when event_id % 7 = 0 then 'user.name' end) as gap from log) select * from g where gap <> ''""",
    "locate": f"{LOG} select event_uid, case when event_id % 10 <> 9 then segment_no end as segment_no, case when event_id % 10 <> 9 and segment_no % 4 <> 2 then concat('w', segment_no % 3) end as window_id from log",
    "event_detail": """select o_orderkey, o_orderstatus, string_agg(concat(l_linenumber, ':', l_partkey, ':', l_suppkey), ',' order by l_linenumber, l_partkey, l_suppkey) filter (l_orderkey is not null) as revisions, count(l_orderkey) as n_revisions
 from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2""",
    "search_hits": f"""{LOG} select event_uid, case when event_id % 3 <> 0 then tier end as tier, case when event_id % 4 <> 0 then substring(line, 1, 40) end as preview, tenant_id from log
 where source_id = 'error' and (event_id % 3 <> 0 or event_id % 4 <> 0)""",
    "replay_select": f"{LOG} select event_uid from log where source_id = 'click' and received_time between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-08 00:00:00'",
}
