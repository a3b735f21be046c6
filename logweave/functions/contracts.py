"""From lines to tiers by contracts given as data.

normalized() runs the whole chain in one pass over the lines: peel the layers, match a template, map
captures to paths, validate, assemble, and judge the tier. Nothing is shuffled and nothing is joined.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.bindings import LOG, log_view
from logweave.functions.layers import CONTRACTS, LINES_SQL, Contract, MapRow, Template, expression, extract_by_template, held, map_rows, observables, peel_by_contract, sent
from logweave.operators.ordered import CONTRACT_ROWS

# Event classes with their activities, the values of enumerated paths, and paths that hold whole numbers.
ACTIVITIES = {0: (0, 99), 1007: (1, 2), 3002: (1, 2), 4001: (1, 2, 5, 6), 4002: (1, 2, 3, 4, 5, 6, 7, 8, 99)}
ENUMS = {"severity_id": (0, 1, 2, 3, 4, 5, 6), "status_id": (0, 1, 2, 99), "disposition_id": (1, 2)}
WHOLE = ("time", "severity_id", "status_id", "disposition_id", "action_id", "src_endpoint.port", "dst_endpoint.port", "traffic.bytes_in", "traffic.bytes_out", "http_response.code", "process.pid")


def validate_events(mapped: DataFrame) -> DataFrame:
    """Mapped rows with errors: an unknown class, an activity that the class hasn't, a value outside its enumeration, a text where a whole number belongs. Rows without a template have none."""
    paths = [*dict.fromkeys([*ENUMS, *WHOLE])]  # each is looked up and read as a number once
    texts = mapped.withColumn("__texts", held(F.struct(*[F.try_element_at("values", F.lit(p)).alias(f"p{i}") for i, p in enumerate(paths)])))
    looked = texts.withColumn("__numbers", held(F.struct(*[F.col(f"__texts.p{i}").try_cast("long").alias(f"p{i}") for i in range(len(paths))])))
    text, number = ({p: F.col(f"{name}.p{i}") for i, p in enumerate(paths)} for name in ("__texts", "__numbers"))
    known = F.col("class_uid").isin(*ACTIVITIES)
    pairs = reduce(lambda a, b: a | b, [(F.col("class_uid") == c) & F.coalesce("activity_id", F.lit(0)).isin(0, 99, *own) for c, own in ACTIVITIES.items()])
    broken = {"class_uid: unknown": ~known, "activity_id: not of the class": known & ~pairs}
    broken |= {f"{p}: not allowed": number[p].isNotNull() & ~number[p].isin(*allowed) for p, allowed in ENUMS.items()}
    broken |= {f"{p}: not a number": text[p].isNotNull() & number[p].isNull() for p in WHOLE}
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in broken.items()])
    listed = looked.withColumn("__found", held(F.when(F.col("template").isNotNull(), found).otherwise(F.array().cast("array<string>"))))
    return listed.withColumn("errors", held(F.array_compact("__found"))).drop("__found", "__texts", "__numbers")


def assemble_event(mapped: DataFrame, text: str = "text", received: str = "received_time") -> DataFrame:
    """Rows with the struct event: class, category, activity and type, severity 1 and the text as message unless mapped, the mapped time or the arrival's. Without a template the class is 0."""
    uid, activity = F.coalesce("class_uid", F.lit(0)), F.coalesce("activity_id", F.lit(0))
    own = lambda path: F.try_element_at("values", F.lit(path))
    return mapped.withColumn("event", held(F.struct(
        uid.alias("class_uid"), F.floor(uid / 1000).cast("int").alias("category_uid"), activity.alias("activity_id"), (uid * 100 + activity).alias("type_uid"), F.coalesce(own("severity_id").try_cast("int"), F.lit(1)).alias("severity_id"),
        F.coalesce(own("message"), F.col(text)).alias("message"), F.coalesce(own("time").try_cast("long"), F.unix_millis(F.col(received).cast("timestamp"))).alias("time"), F.col("values").alias("mapped"),
    )))


def unmapped_of(mapped: DataFrame, claims: str | None = None) -> DataFrame:
    """Rows with unmapped, a map of all captures and fields that gave no value to a path; what a sender claims (a map column) goes under hec_meta."""
    left = lambda column, kind: F.map_filter(F.coalesce(column, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains("used", F.concat(F.lit(f"{kind}:"), k)))
    captures = left(F.col("captures"), "capture")
    fields = F.map_filter(left(F.col("fields"), "field"), lambda k, v: ~F.map_contains_key(captures, k))
    parts = [captures, fields]
    if claims is not None:
        parts.append(F.transform_keys(F.coalesce(F.col(claims), F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit("hec_meta."), k)))
    return mapped.withColumn("unmapped", held(F.map_concat(*parts)))


def assign_tier(validated: DataFrame, contracts: tuple[Contract, ...], contract: str = "contract", line: str = "line", lossy: str | None = None) -> DataFrame:
    """got_tier, conformance, reason and detail.

    4: nothing to read (`empty`, or `decode_error` where the column lossy is true); 3: no contract or no template
    of it fits; 2: a template fits, but a path finds nothing or a required one is missing (`required_missing`), or a
    type, a rule or a layer failed (`schema_invalid`); 1: all there.
    """
    unread = F.lit(False) if lossy is None else F.coalesce(F.col(lossy), F.lit(False))
    reason = (
        F.when(unread, "decode_error").when(F.trim(F.coalesce(F.col(line), F.lit(""))) == "", "empty").when(~F.coalesce(F.col(contract).isin(*[c.id for c in contracts]), F.lit(False)), "no_contract")
        .when(F.col("template").isNull(), "no_template_match").when((F.size("missing") > 0) | (F.size("unresolved") > 0), "required_missing")
        .when((F.size("errors") > 0) | (F.size("coercion_errors") > 0) | F.col("error").isNotNull(), "schema_invalid")
    )
    tier = F.when(F.col("reason").isin("decode_error", "empty"), 4).when(F.col("reason").isin("no_contract", "no_template_match"), 3).when(F.col("reason").isNotNull(), 2).otherwise(1)
    told = lambda name, values: F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(values, ", ")))
    detail = F.concat_ws(" | ", told("unresolved", "unresolved"), told("missing", "missing"), told("rules", "errors"), told("types", "coercion_errors"), F.concat(F.lit("peel: "), F.col("error")))
    out = validated.withColumn("reason", held(reason)).withColumn("got_tier", held(tier))
    return out.withColumns({"conformance": F.element_at(F.array(*[F.lit(x) for x in ("match", "partial", "unknown_template", "unparseable")]), F.col("got_tier")), "detail": F.when(F.col("got_tier").between(2, 3), F.nullif(detail, F.lit("")))})


def normalized(lines: DataFrame, contracts: tuple[Contract, ...], contract: str = "contract", line: str = "line", received: str = "received_time", lossy: str | None = None) -> DataFrame:
    """The whole chain: lines with all columns of its steps up to event, unmapped and got_tier. An empty table stays empty; null lines are tier 4."""
    return judged(peel_by_contract(lines, contracts, contract, line), contracts, contract, line, received, lossy)


def judged(peeled: DataFrame, contracts: tuple[Contract, ...], contract: str = "contract", line: str = "line", received: str = "received_time", lossy: str | None = None) -> DataFrame:
    """What comes in the chain behind the peeling."""
    mapped = map_rows(extract_by_template(peeled, contracts, contract), contracts, contract, line, received=received)
    return assign_tier(unmapped_of(assemble_event(validate_events(mapped), received=received)), contracts, contract, line, lossy)


def _matches(text: Column, template: Template) -> Column:
    return text.rlike(expression(template)[0])


def template_overlap(lines: DataFrame, contract: Contract, text: str = "text") -> DataFrame:
    """How often a later template of a contract would have matched a text that an earlier one takes."""
    hits = F.array_compact(F.array(*[F.when(_matches(F.col(text), t), F.lit(t.name)) for t in contract.templates]))
    pairs = lines.select(hits.alias("hits")).where(F.size("hits") > 1)
    return pairs.select(F.element_at("hits", 1).alias("winner"), F.explode(F.slice("hits", F.lit(2), F.size("hits"))).alias("shadowed")).groupBy("winner", "shadowed").agg(F.count("*").alias("n"))


def required_coverage(mapped: DataFrame, contracts: tuple[Contract, ...], contract: str = "contract") -> DataFrame:
    """Of each template's required and mapped paths: rows, how many have the path (filled), and whether it is required. A path that no row map names shows as never filled."""
    wanted = F.array().cast("array<struct<path: string, required: boolean>>")
    for c in contracts:
        for t in c.templates:
            paths = dict.fromkeys([*t.required, *[r.path for r in c.rows if r.template in (None, t.name)]])
            listed = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(p in t.required).alias("required")) for p in paths])
            wanted = F.when((F.col(contract) == c.id) & (F.col("template") == t.name), listed).otherwise(wanted) if paths else wanted
    long = mapped.select(contract, "template", "values", F.explode(wanted).alias("w"))
    return long.groupBy(contract, "template", "w.path", "w.required").agg(F.count("*").alias("rows"), F.count_if(F.map_contains_key("values", F.col("w.path"))).alias("filled"))


def both_ways(lines: DataFrame, active: tuple[Contract, ...], candidate: tuple[Contract, ...], **columns: str) -> DataFrame:
    """lines with before and after, structs of got_tier and paths under two sets of contracts: one pass, no join. They are peeled once if the sets have the same layers for the same contracts."""
    layers = [{c.id: c.layers for c in contracts} for contracts in (active, candidate)]
    once = all(layers[0][x] == layers[1][x] for x in layers[0].keys() & layers[1].keys()) and [*map(len, layers)] == [len(active), len(candidate)]
    out = peel_by_contract(lines, (*active, *[c for c in candidate if c.id not in layers[0]]), **{k: v for k, v in columns.items() if k in ("contract", "line")}) if once else lines
    for name, contracts in (("before", active), ("after", candidate)):
        got = judged(out, contracts, **columns) if once else normalized(out, contracts, **columns)
        out = got.select(*[F.col(c) for c in out.columns], held(F.struct("got_tier", F.map_keys("values").alias("paths"))).alias(name))
    return out.select(*lines.columns, "before", "after")


def tier_change() -> Column:
    return F.when(F.col("after.got_tier") < F.col("before.got_tier"), "upgraded").when(F.col("after.got_tier") > F.col("before.got_tier"), "regressed").otherwise("unchanged")


def backtest(lines: DataFrame, active: tuple[Contract, ...], candidate: tuple[Contract, ...], **columns: str) -> DataFrame:
    """How many lines go from which tier to which when other contracts take over."""
    both = both_ways(lines, active, candidate, **columns)
    return both.groupBy(F.col("before.got_tier").alias("before"), F.col("after.got_tier").alias("after"), tier_change().alias("change")).agg(F.count("*").alias("n"))


def backtest_coverage(lines: DataFrame, active: tuple[Contract, ...], candidate: tuple[Contract, ...], **columns: str) -> DataFrame:
    """Of each path the percent of all lines that have it, before and after."""
    both = both_ways(lines, active, candidate, **columns)
    marks = F.explode(F.array_union("before.paths", "after.paths"))
    total = both.agg(F.count("*").alias("all"))
    counted = both.select("before", "after", marks.alias("path")).groupBy("path").agg(*[F.count_if(F.array_contains(f"{w}.paths", F.col("path"))).alias(w) for w in ("before", "after")])
    return counted.crossJoin(F.broadcast(total)).select("path", *[(100.0 * F.col(w) / F.col("all")).alias(f"{w}_pct") for w in ("before", "after")])


def backtest_examples(lines: DataFrame, active: tuple[Contract, ...], candidate: tuple[Contract, ...], key: str, n: int = 20, **columns: str) -> DataFrame:
    """The first n lines by key whose tier or paths change, with what they gain and lose."""
    both = both_ways(lines, active, candidate, **columns).withColumn("change", tier_change())
    gained, lost = F.array_except("after.paths", "before.paths"), F.array_except("before.paths", "after.paths")
    told = both.select(key, "change", F.col("before.got_tier").alias("before"), F.col("after.got_tier").alias("after"), F.array_sort(gained).alias("gained"), F.array_sort(lost).alias("lost"))
    return told.where((F.col("change") != "unchanged") | (F.size("gained") + F.size("lost") > 0)).orderBy(key).limit(n)


def library_match(lines: DataFrame, packs: dict[str, Contract], line: str = "line", received: str = "received_time", least: float = 0.8) -> DataFrame:
    """The share of lines that each pack takes to tier 1 and 2, best first; matched from `least` on. All packs judge a line in one pass over the table; packs with the same layers share the peeling."""
    out = lines.select(line, received)
    for layers in {repr(c.layers): c.layers for c in packs.values()}.values():
        kept = out.columns
        out = peel_by_contract(out.withColumn("__pack", F.lit("")), (Contract("", layers),), "__pack", line)
        for i, contract in enumerate(packs.values()):
            if contract.layers == layers:
                got = judged(out.withColumn("__pack", F.lit(contract.id)), (contract,), "__pack", line, received)
                out, kept = got.select(*[F.col(c) for c in out.columns], F.col("got_tier").alias(f"__t{i}")), [*kept, f"__t{i}"]
        out = out.select(*kept)
    one = out.agg(*[F.avg((F.col(f"__t{i}") == t).cast("double")).alias(f"__a{i}{t}") for i in range(len(packs)) for t in (1, 2)])
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("pack"), F.col(f"__a{i}1").alias("tier1"), F.col(f"__a{i}2").alias("tier2")) for i, n in enumerate(packs)]))
    return one.select(rows).withColumn("matched", F.col("tier1") + F.col("tier2") >= least).orderBy(F.desc("tier1"), F.desc("tier2"), "pack")


def resolve_covered(items: DataFrame, contracts: tuple[Contract, ...], sample: str = "sample") -> DataFrame:
    """Open items whose sample a template of an active contract covers now. Templates are literals, so no join is needed."""
    covered = reduce(lambda a, b: a | b, [_matches(F.col(sample), t) for c in contracts for t in c.templates], F.lit(False))
    return items.withColumn("state", F.when(covered, "resolved").otherwise("open"))


def verify_draft(lines: DataFrame, draft: Contract, line: str = "line", received: str = "received_time") -> DataFrame:
    """A drafted contract on sample lines, by path: how often it is located, derived, unresolved, missing or of a wrong type. The path `*` tells the lines and those of tier 1."""
    got = normalized(lines.select(line, received, F.lit(draft.id).alias("__draft")), (draft,), "__draft", line, received)
    kinds = ("located", "derived", "unresolved", "missing", "type_issue")
    marked = lambda kind, paths: F.transform(paths, lambda p: F.struct(p.alias("path"), F.lit(kind).alias("kind")))
    facts = [marked(k, a) for k, a in zip(kinds, (F.map_keys("located"), F.map_keys("derived"), F.col("unresolved"), F.col("missing"), F.col("coercion_errors")))]
    whole = F.array(F.struct(F.lit("*").alias("path"), F.when(F.col("got_tier") == 1, "tier1").otherwise("other").alias("kind")))
    long = got.select(F.explode(F.concat(whole, *facts)).alias("f"))
    return long.groupBy("f.path").agg(F.count("*").alias("rows"), *[F.count_if(F.col("f.kind") == k).alias(k) for k in (*kinds, "tier1")])


def draft_tiers(lines: DataFrame, draft: Contract, line: str = "line", received: str = "received_time") -> DataFrame:
    """Tiers and reasons of the sample lines under a drafted contract."""
    got = normalized(lines.select(line, received, F.lit(draft.id).alias("__draft")), (draft,), "__draft", line, received)
    return got.groupBy("got_tier", "reason").agg(F.count("*").alias("n"))


def contract_rows(spark: SparkSession, contracts: tuple[Contract, ...]) -> DataFrame:
    """Contracts as rows for ordered.contract_diff: of each template its pattern, class, required paths, map rows and captures that no row uses; layers, zone and formats as sections."""
    rows = []
    for c in contracts:
        rows += [(c.id, "section", "", name, repr(getattr(c, name)), None) for name in ("layers", "tz", "formats")]
        for i, t in enumerate(c.templates):
            own = [r for r in c.rows if r.template in (None, t.name)]
            rows += [(c.id, "template", t.name, "", "", i), (c.id, "pattern", t.name, "", expression(t)[0], None), (c.id, "class", t.name, "", f"{t.class_uid}/{t.activity_id}", None)]
            rows += [(c.id, "required", t.name, path, "", None) for path in t.required]
            rows += [(c.id, "map", t.name, r.path, repr((r.kind, r.ref, r.to, r.words)), None) for r in own]
            rows += [(c.id, "unmapped", t.name, name, "", None) for name in sorted({n for n in expression(t)[1] if n} - {r.ref for r in own if r.kind == "capture"})]
    return spark.createDataFrame(rows, CONTRACT_ROWS)


def login_contract(id: str, *templates: Template) -> Contract:
    rows = (MapRow("user.name", "capture", "user"), MapRow("src_endpoint.ip", "capture", "src", "ip"), MapRow("unmapped.attempts", "capture", "attempts", "int"), MapRow("status_id", "const", "2", "int", "failed"), MapRow("status_id", "const", "1", "int", "ok"))
    return Contract(id, (("syslog", {}, False),), templates, rows)


FAILED = Template("failed", "user=<user:word> FAILED login from <src:ip> via <via> attempts:<attempts:int>", 3002, ("src_endpoint.ip",), 1)
OK = Template("ok", regex=r"^user=(?<user>\w+) OK login from (?<src>\S+) via (?<via>\S+) attempts:(?<attempts>[0-3])$", class_uid=3002, required=("src_endpoint.ip",), activity_id=1)
ANY = Template("any", regex=r"^user=(?<user>\w+) (?<word>OK|FAILED) login (?<rest>.*)$", class_uid=3002, required=("src_endpoint.ip", "status_id"), activity_id=9)
FEW = Template("failed", regex=r"^user=(?<user>\w+) FAILED login from (?<src>\S+) via (?<via>\S+) attempts:(?<attempts>[0-2])$", class_uid=3002, required=("src_endpoint.ip",), activity_id=1)
LOGIN, CANDIDATE, ONLY_OK = login_contract("login", FAILED, OK, ANY), login_contract("login", OK, FEW, ANY), login_contract("ok", OK)

NAMED_HOST = replace(LOGIN, rows=(*LOGIN.rows, MapRow("device.hostname", "field", "syslog.host")))


def own_lines(s: SparkSession, d: str) -> DataFrame:
    return log_view(s, d).selectExpr("event_uid", "line", "received_time", "'login' as contract")


def _login(s: SparkSession, d: str) -> DataFrame:
    return normalized(own_lines(s, d), (LOGIN,))


def _sent(s: SparkSession, d: str) -> DataFrame:
    """The lines of all shapes; one in 13 is marked as not decodable."""
    return normalized(sent(s, d).withColumn("lossy", F.expr("event_id % 13 = 0")), CONTRACTS, lossy="lossy")


_own = lambda path: F.col("values")[path]
QUERIES = {
    "match_templates": lambda s, d: _login(s, d).select("event_uid", "template", F.col("class_uid").alias("template_class"), F.col("captures")["user"].alias("user"), F.col("captures")["src"].alias("src")),
    "template_overlap": lambda s, d: template_overlap(peel_by_contract(own_lines(s, d), (LOGIN,)), LOGIN),
    "map_fields": lambda s, d: _login(s, d).select("event_uid", _own("user.name").alias("user_name"), _own("src_endpoint.ip").alias("src_ip"), _own("unmapped.attempts").cast("int").alias("attempts"), _own("status_id").cast("int").alias("status_id"), F.array_join(F.array_union("unresolved", "missing"), ",").alias("missing")),
    "assign_tier": lambda s, d: _sent(s, d).select("event_uid", "got_tier", "conformance", "reason", "detail"),
    "tier_reasons": lambda s, d: _sent(s, d).groupBy("contract", "got_tier", "reason").agg(F.count("*").alias("n")),
    "validate_events": lambda s, d: _sent(s, d).unionByName(_login(s, d), allowMissingColumns=True).select("event_uid", "contract", F.array_join("errors", ",").alias("errors")),
    "assemble_event": lambda s, d: _sent(s, d).select("event_uid", "event.class_uid", "event.category_uid", "event.type_uid", "event.severity_id", F.sha2("event.message", 256).alias("message_sha"), F.when(F.col("template") == "json", F.col("event.time")).alias("time")),
    "observables_of": lambda s, d: observables(normalized(own_lines(s, d), (NAMED_HOST,)), "event_uid"),
    "unmapped_of": lambda s, d: _sent(s, d).select("event_uid", F.explode("unmapped").alias("name", "value")),
    "required_coverage": lambda s, d: required_coverage(_sent(s, d), CONTRACTS),
    "backtest": lambda s, d: backtest(own_lines(s, d), (LOGIN,), (CANDIDATE,)),
    "backtest_coverage": lambda s, d: backtest_coverage(own_lines(s, d), (LOGIN,), (CANDIDATE,)),
    "backtest_examples": lambda s, d: backtest_examples(own_lines(s, d), (LOGIN,), (CANDIDATE,), "event_uid").select("event_uid", "change", "before", "after", F.array_join("gained", ",").alias("gained"), F.array_join("lost", ",").alias("lost")),
    "library_match": lambda s, d: library_match(own_lines(s, d), {"full": LOGIN, "ok-only": ONLY_OK}),
    "resolve_covered": lambda s, d: resolve_covered(peel_by_contract(own_lines(s, d), (LOGIN,)).select(F.col("text").alias("sample")), (login_contract("active", FAILED, OK),)).groupBy("state").agg(F.count("*").alias("n")),
    "verify_draft": lambda s, d: verify_draft(own_lines(s, d), login_contract("draft", OK, ANY)),
    "draft_tiers": lambda s, d: draft_tiers(own_lines(s, d), login_contract("draft", OK, ANY)),
}

_P = f"""{LOG}, p as (select *, regexp_extract(line, '^<[0-9]+>.{{15}} [^ ]+ app.[0-9]+.: (.*)$', 1) as body, concat('10.0.', user_id % 256, '.', event_id % 256) as src, event_id % 5 as att from log),
 m as (select *, case when event_id % 4 = 2 then 'failed' when att <= 3 then 'ok' else 'any' end as template from p)"""
#: Common table expression r: the tier and reason of each sent line.
_TIERS = f"""{LINES_SQL}, r as (select *, event_id % 13 = 0 as lossy, case when event_id % 13 = 0 then 'decode_error' when k = 5 then 'empty' when k = 2 then 'no_contract' when t is null then 'no_template_match' when t = 'failed' then 'required_missing'
  when t = 'json' and (event_id % 2 = 0 or event_id % 3 = 0) then 'schema_invalid' end as reason from m),
 g as (select *, (case when reason in ('decode_error', 'empty') then 4 when reason in ('no_contract', 'no_template_match') then 3 when reason is not null then 2 else 1 end)::int as tier_ from r)"""
_SYSLOG = "{'n': 'syslog.pri', 'v': pri}, {'n': 'syslog.facility', 'v': (pri::int // 8)::varchar}, {'n': 'syslog.severity', 'v': (pri::int % 8)::varchar}, {'n': 'syslog.timestamp', 'v': 'Jan 01 00:00:00'}, {'n': 'syslog.app', 'v': 'app'}, {'n': 'syslog.pid', 'v': event_id::varchar}"
ORACLES = {
    "match_templates": f"""{_P} select event_uid, template, 3002::int as template_class, concat('u', user_id) as "user", case when template <> 'any' then src end as src from m""",
    "template_overlap": f"{_P} select template as winner, 'any' as shadowed, count(*) as n from m where template <> 'any' group by 1",
    "map_fields": f"""{_P} select event_uid, concat('u', user_id) as user_name, case when template <> 'any' then src end as src_ip, (case when template <> 'any' then att end)::int as attempts,
 (case template when 'failed' then 2 when 'ok' then 1 end)::int as status_id, case when template = 'any' then 'src_endpoint.ip,unmapped.attempts,status_id' else '' end as missing from m""",
    "assign_tier": f"""{_TIERS} select event_uid, tier_ as got_tier, case tier_ when 1 then 'match' when 2 then 'partial' when 3 then 'unknown_template' else 'unparseable' end as conformance, reason,
 case when tier_ = 2 then concat_ws(' | ', case when t = 'failed' then 'missing: time' end, case when t = 'json' and event_id % 2 = 0 then 'rules: status_id: not allowed' end, case when t = 'json' and event_id % 3 = 0 then 'types: src_endpoint.ip' end)
  when tier_ = 3 then case k when 1 then 'peel: layer depth over 4' when 3 then 'peel: layer syslog doesn''t apply' when 6 then 'peel: layer json doesn''t apply' end end as detail from g""",
    "tier_reasons": f"{_TIERS} select contract, tier_ as got_tier, reason, count(*) as n from g group by all",
    "validate_events": f"""{_TIERS}, o as (select event_uid, case when event_id % 4 <> 2 and event_id % 5 > 3 then 'activity_id: not of the class' else '' end as errors from log)
 select event_uid, contract, case when t = 'json' and event_id % 2 = 0 then 'status_id: not allowed' else '' end as errors from g union all select event_uid, 'login', errors from o""",
    "assemble_event": f"""{_TIERS} select event_uid, (case when t = 'json' then 4001 when t is null then 0 else 3002 end)::int as class_uid, (case when t = 'json' then 4 when t is null then 0 else 3 end)::int as category_uid, (case when t = 'json' then 400106 when t is null then 0 else 300201 end)::int as type_uid, 1::int as severity_id,
 sha256(case when k = 0 then concat('say "hé ', user_id, '" action=', case when event_id % 2 = 0 then 'deny' else 'allow' end, ' port=', event_id % 1000) when k in (1, 4) then body else line end) as message_sha, case when t = 'json' then (epoch(timestamp '2026-01-02 03:04:05')::bigint - 19800) * 1000 end as time from g""",
    "observables_of": f"""{_P} select event_uid, 'ip_1' as name, src as value, 'from:src_endpoint.ip' as label from m where template <> 'any' union all select event_uid, 'user', concat('u', user_id), 'from:user.name' from m
 union all select event_uid, 'host_1', concat('host-', user_id % 20), 'from:device.hostname' from m""",
    "unmapped_of": f"""{LINES_SQL}, s as (select *, regexp_extract(logged, '^<([0-9]+)>', 1) as pri, case when event_id % 2 = 0 then 'deny' else 'allow' end as act from m), x as (
 select event_uid, unnest([{_SYSLOG}], recursive := true) from s where k in (1, 4) union all select event_uid, 'syslog.host', concat('host-', user_id % 20) from s where k = 1
 union all select event_uid, 'kv.user', concat('u', user_id) from s where k = 1
 union all select event_uid, unnest(case when failed then [{{'n': 'gate', 'v': '10.2.3.4'}}] else [{{'n': 'tail', 'v': concat(src, ' via 10.2.3.4 attempts:', event_id % 5)}}] end, recursive := true) from s where k = 4
 union all select event_uid, unnest([{{'n': 'json.é', 'v': 'ü'}}, {{'n': 'json.msg', 'v': concat('say "hé ', user_id, '" action=', act, ' port=', event_id % 1000)}}, {{'n': 'json.__rest', 'v': 'tail'}}, {{'n': 'kv.action', 'v': act}}, {{'n': 'kv.port', 'v': (event_id % 1000)::varchar}}], recursive := true) from s where k = 0
 union all select event_uid, 'json.ip', '300.1.1.1' from s where k = 0 and event_id % 3 = 0)
 select event_uid, n as name, v as value from x""",
    "required_coverage": f"""{_TIERS}, w(template, path, required) as (values ('failed', 'user.name', true), ('failed', 'src_endpoint.ip', true), ('failed', 'time', true), ('failed', 'unmapped.attempts', false), ('failed', 'status_id', false), ('failed', 'device.hostname', false), ('failed', 'message', false),
  ('other', 'user.name', true), ('other', 'status_id', false), ('other', 'device.hostname', false), ('other', 'message', false), ('json', 'dst_endpoint.port', true), ('json', 'time', true), ('json', 'device.hostname', false), ('json', 'status_id', false), ('json', 'src_endpoint.ip', false), ('json', 'user.name', false), ('json', 'unmapped.n', false))
 select contract, template, path, required, count(*) as "rows", count(*) filter (not (path = 'time' and t = 'failed') and not (path = 'src_endpoint.ip' and t = 'json' and event_id % 3 = 0)) as filled from g join w on t = template group by all""",
    "backtest": f"""{_P}, b as (select (case when template = 'any' then 2 else 1 end)::int as before, (case when event_id % 4 = 2 then case when att <= 2 then 1 else 2 end when att <= 3 then 1 else 2 end)::int as after from m)
 select before, after, case when after < before then 'upgraded' when after > before then 'regressed' else 'unchanged' end as change, count(*) as n from b group by all""",
    "backtest_coverage": f"""{_P}, b as (select template <> 'any' as before, case when event_id % 4 = 2 then att <= 2 else att <= 3 end as after from m), w(path, always) as (values ('user.name', true), ('src_endpoint.ip', false), ('unmapped.attempts', false), ('status_id', false))
 select path, 100.0::double * count(*) filter (always or before) / count(*) as before_pct, 100.0::double * count(*) filter (always or after) / count(*) as after_pct from b, w group by path""",
    "backtest_examples": f"""{_P} select event_uid, 'regressed' as change, 1::int as before, 2::int as after, '' as gained, 'src_endpoint.ip,status_id,unmapped.attempts' as lost from m where event_id % 4 = 2 and att > 2 order by event_uid limit 20""",
    "library_match": f"""{_P} select 'full' as pack, avg((template <> 'any')::int) as tier1, avg((template = 'any')::int) as tier2, true as matched from m
 union all select 'ok-only', avg((template = 'ok')::int), 0.0::double, avg((template = 'ok')::int) >= 0.8 from m""",
    "resolve_covered": f"{_P} select case when template <> 'any' then 'resolved' else 'open' end as state, count(*) as n from m group by 1",
    "verify_draft": f"""{_P}, v as (select event_id % 4 <> 2 and att <= 3 as ok from m), w(path, kind, want) as (values ('user.name', 'located', null), ('src_endpoint.ip', 'located', true), ('unmapped.attempts', 'located', true), ('status_id', 'derived', true), ('src_endpoint.ip', 'unresolved', false), ('unmapped.attempts', 'unresolved', false),
  ('src_endpoint.ip', 'missing', false), ('status_id', 'missing', false), ('*', 'tier1', true), ('*', 'other', false))
 select path, count(*) as "rows", count(*) filter (kind = 'located') as located, count(*) filter (kind = 'derived') as derived, count(*) filter (kind = 'unresolved') as unresolved, count(*) filter (kind = 'missing') as missing, 0::bigint as type_issue, count(*) filter (kind = 'tier1') as tier1
 from v join w on want is null or want = ok group by path""",
    "draft_tiers": f"{_P}, v as (select event_id % 4 <> 2 and att <= 3 as ok from m) select (case when ok then 1 else 2 end)::int as got_tier, case when not ok then 'required_missing' end as reason, count(*) as n from v group by ok",
}
