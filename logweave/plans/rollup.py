"""Rollups by source and route, and the status queries on top of them (aggregations A1 to A23)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.bindings import EXPECTED, EXPECTED_SQL, LOG, RECEIPT_COLUMNS, log_view, receipts
from logweave.session import stored

TIERS = (1, 2, 3, 4)


def text_time(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def per_minute(c: str) -> Column:
    return F.date_trunc("minute", F.col(c))


def source_minute_raw(raw: DataFrame) -> DataFrame:
    """A1: events, bytes and last arrival per tenant, source and minute."""
    return raw.groupBy("tenant_id", "source_id", per_minute("received_time").alias("minute")).agg(
        F.count("*").alias("raw_count"), F.sum(F.octet_length("line")).alias("raw_bytes"), F.max("received_time").alias("last_received")
    )


def source_minute_lineage(lineage: DataFrame) -> DataFrame:
    """A2: tier counts, replays and the newest contract per tenant, source and minute."""
    return lineage.groupBy("tenant_id", "source_id", per_minute("received_time").alias("minute")).agg(
        F.count("*").alias("norm_count"), *[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in TIERS],
        F.count_if(F.col("event_id") % 20 == 0).alias("replays"),
        F.max(F.struct("received_time", "event_uid", "contract_ref")).alias("newest"),
    )


def source_minute_skew(norm: DataFrame) -> DataFrame:
    """A3: exact median clock skew per source; skew_sketches is the form that is stored and merged."""
    return norm.where(F.col("skew_ms").isNotNull()).groupBy("source_id").agg(F.percentile("skew_ms", F.lit(0.5)).alias("skew_p50"), F.count("*").alias("n"))


SKETCH_K = 200  # of a quantile sketch: its rank error is about 1.7 % (99 % of the time) at some 2 KB, at any number of rows


def skew_sketches(norm: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """Per tenant, source and minute a mergeable quantile sketch (KLL) of the clock skew, with count, least and greatest. Null skews count as nothing; a minute without any has no row."""
    known = norm.where(F.col("skew_ms").isNotNull())
    return known.groupBy("tenant_id", "source_id", per_minute("received_time").alias("minute")).agg(
        F.kll_sketch_agg_bigint("skew_ms", k).alias("sketch"), F.count("*").alias("n"), F.min("skew_ms").alias("least"), F.max("skew_ms").alias("most")
    )


def merged_skew(sketches: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.5,), k: int = SKETCH_K) -> DataFrame:
    """Stored sketches merged to coarser keys: n, least, most and an estimate for each rank (p50 for 0.5), within the sketch's rank error. Minutes are never read again as rows."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return merged.select(*by, "n", "least", "most", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(r)).alias(f"p{r * 100:g}") for r in ranks])


def skew_health(log: DataFrame, stored_sketches: DataFrame, since: str = "received_time is not null") -> DataFrame:
    """A11 from stored sketches: of each source the merged median, and how far its rank is from one half among the source's rows (rank_error), which the sketch bounds."""
    merged = merged_skew(stored_sketches, ["source_id"])
    ranks = log.where(since).where(F.col("skew_ms").isNotNull()).join(merged.select("source_id", "p50"), "source_id").groupBy("source_id").agg(
        F.avg((F.col("skew_ms") < F.col("p50")).cast("double")).alias("below"), F.avg((F.col("skew_ms") <= F.col("p50")).cast("double")).alias("upto")
    )
    error = F.greatest(F.col("below") - 0.5, F.lit(0.5) - F.col("upto"), F.lit(0.0))
    return merged.join(ranks, "source_id").withColumn("rank_error", error)


def source_minute(log: DataFrame) -> DataFrame:
    """A4: the partial aggregates of one key merged; a part that has no rows of the key counts as nothing."""
    parts = source_minute_raw(log).unionByName(source_minute_lineage(log), allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return parts.groupBy("tenant_id", "source_id", "minute").agg(
        *[zero(c) for c in ("raw_count", "raw_bytes", "norm_count", *[f"tier{t}" for t in TIERS], "replays")],
        F.max("last_received").alias("last_received"), F.max("newest").getField("contract_ref").alias("contract_ref"),
    )


def route_minute(got: DataFrame) -> DataFrame:
    """A5: outcomes per route and minute."""
    return got.groupBy("route_id", per_minute("at_time").alias("minute")).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("delivered", "failed", "filtered")], F.max("at_time").alias("last_at")
    )


def recent(df: DataFrame, column: str, span: str, asof: str | None = None) -> DataFrame:
    """Rows of the last `span` before asof, or before the newest row. The time is a literal in the plan, so the filter reaches the scan."""
    newest = asof or df.agg(F.max(column)).first()[0]
    if newest is None:
        return df.limit(0)
    return df.where(F.col(column) >= F.lit(str(newest)).cast(df.schema[column].dataType) - F.expr(f"interval {span}"))


def since_of(df: DataFrame, since: str | None, column: str = "minute") -> DataFrame:
    return df if since is None else df.where(F.col(column) >= F.lit(since).cast(df.schema[column].dataType))


def eps(log: DataFrame, span: str = "60 seconds", seconds: int = 60, asof: str | None = None) -> DataFrame:
    """Events per second of each source in the last span."""
    return recent(log, "received_time", span, asof).groupBy("source_id").agg((F.count("*") / seconds).alias("eps"))


def source_strip(minutes: DataFrame, since: str | None = None) -> DataFrame:
    """Totals per source since a time, largest first."""
    return since_of(minutes, since).groupBy("source_id").agg(
        F.sum("raw_count").alias("raw"), F.sum("raw_bytes").alias("bytes"), F.max("last_received").alias("last_seen"), *[F.sum(f"tier{t}").alias(f"tier{t}") for t in TIERS]
    )


def route_totals(minutes: DataFrame, since: str | None = None) -> DataFrame:
    """Sums and health per route since a time."""
    sums = since_of(minutes, since).groupBy("route_id").agg(*[F.sum(c).alias(c) for c in ("delivered", "failed", "filtered")])
    health = (
        F.when(F.col("delivered") + F.col("failed") == 0, "idle").when(F.col("failed") == 0, "ok").when(F.col("failed") >= F.col("delivered"), "failing").otherwise("degraded")
    )
    return sums.withColumn("health", health)


def overview_parts(log: DataFrame, got: DataFrame, since: str | None = None) -> DataFrame:
    """A10: all parts of the overview as (part, item, metric, value): rates, sources, routes, tiers, the vault and its newest window."""
    row = lambda df, part, item, metrics: df.select(F.lit(part).alias("part"), item.alias("item"), F.stack(F.lit(len(metrics)), *[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]).alias("metric", "value"))
    strip = source_strip(source_minute(log), since)
    tiers = strip.agg(*[F.sum(f"tier{t}").alias(f"tier{t}") for t in TIERS])
    vault = log.agg(F.count_distinct("segment_no").alias("segments"), F.max("segment_no").alias("newest_segment"))
    parts = [
        row(eps(log), "eps", F.col("source_id"), ["eps"]), row(strip, "source", F.col("source_id"), ["raw", "bytes"]), row(route_totals(route_minute(got), since), "route", F.col("route_id"), ["delivered", "failed", "filtered"]),
        row(tiers, "tiers", F.lit("all"), [f"tier{t}" for t in TIERS]), row(vault, "vault", F.lit("all"), ["segments", "newest_segment"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def overview(log: DataFrame) -> DataFrame:
    """A10: tier totals by source, by tenant and over all, in one pass with grouping sets."""
    return log.groupingSets([["tenant_id", "source_id"], ["tenant_id"], []], "tenant_id", "source_id").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("events"), *[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in TIERS]
    )


def source_health(log: DataFrame, expected: DataFrame, span: str = "5 days", seconds: int = 432000) -> DataFrame:
    """A11 with J6: registered sources without data are silent, senders without registration unexpected."""
    got = recent(log, "received_time", span).groupBy("source_id").agg(
        (F.count("*") / seconds).alias("eps"), *[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in TIERS],
        F.max(F.struct("received_time", "event_uid", "contract_ref")).getField("contract_ref").alias("contract_ref"),
        F.percentile("skew_ms", F.lit(0.5)).alias("skew_p50"),
    )
    joined = got.join(F.broadcast(expected), "source_id", "full_outer")
    status = (
        F.when(F.col("expected_eps").isNull(), "unexpected").when(F.col("eps").isNull(), "silent").when(F.col("eps") < 0.5 * F.col("expected_eps"), "low").otherwise("ok")
    )
    return joined.withColumn("status", status)


def shadow_totals(diffs: DataFrame) -> DataFrame:
    """How each candidate contract does against the active one."""
    better = F.col("candidate_tier") < F.col("tier")
    worse = F.col("candidate_tier") > F.col("tier")
    return diffs.groupBy("contract_ref").agg(
        F.count("*").alias("total"), F.count_distinct("event_uid").alias("events"), F.count_if(better).alias("improved"), F.count_if(worse).alias("worsened"),
        F.count_if(~better & ~worse).alias("unchanged"), F.count_if(F.size("regressions") > 0).alias("with_regressions"),
        F.max(F.struct("received_time", "event_uid", "source_id")).getField("source_id").alias("last_source"),
    )


def shadow_samples(diffs: DataFrame, n: int = 10) -> DataFrame:
    """Up to n sample events per candidate, the first ones that got worse."""
    place = F.row_number().over(Window.partitionBy("contract_ref").orderBy("event_uid"))
    return diffs.where("candidate_tier > tier").withColumn("n", place).where(F.col("n") <= n).select("contract_ref", "n", "event_uid")


def shadow_transitions(diffs: DataFrame) -> DataFrame:
    """A13"""
    return diffs.groupBy("contract_ref", "tier", "candidate_tier").agg(F.count("*").alias("n"))


def shadow_fields(diffs: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent changed and regressed fields of each candidate."""
    halves = [diffs.select("contract_ref", F.lit(kind).alias("kind"), F.explode(c).alias("field")) for kind, c in (("changed", "changed_fields"), ("regressed", "regressions"))]
    counts = halves[0].unionByName(halves[1]).groupBy("contract_ref", "kind", "field").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("contract_ref", "kind").orderBy(F.desc("n"), "field"))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def diffs_of(log: DataFrame) -> DataFrame:
    """Shadow records of the log view; which fields changed follows from the value."""
    changed = F.expr("filter(array(if(value > 20, 'src_endpoint.ip', null), if(event_id % 3 = 0, 'user.name', null), if(value < 5, 'status_id', null)), x -> x is not null)")
    return log.withColumn("changed_fields", changed).withColumn("regressions", F.expr("filter(changed_fields, x -> candidate_tier > tier and x <> 'status_id')"))


def route_stats(minutes: DataFrame, since: str | None = None) -> DataFrame:
    """Totals per route and its series of minutes as text (minute:delivered/failed, in order)."""
    kept = since_of(minutes, since).withColumn("at", F.date_format("minute", "yyyy-MM-dd HH:mm"))
    series = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "delivered", "failed"))), lambda x: F.concat(x["at"], F.lit(":"), x["delivered"], F.lit("/"), x["failed"])), ",")
    return kept.groupBy("route_id").agg(F.sum("delivered").alias("delivered"), F.sum("failed").alias("failed"), series.alias("series"))


def tier_history(minutes: DataFrame, since: str | None = None) -> DataFrame:
    """Tier counts by minute, oldest first."""
    return since_of(minutes, since).groupBy("minute").agg(*[F.sum(f"tier{t}").alias(f"tier{t}") for t in TIERS]).orderBy("minute")


def source_dimensions(log: DataFrame) -> DataFrame:
    """The last seen zone and transport of each source within a day."""
    newest = F.max(F.struct("received_time", "event_uid", (F.col("user_id") % 4).alias("zone"), F.when(F.col("event_id") % 2 == 0, "udp").otherwise("tcp").alias("transport"))).alias("x")
    return recent(log, "received_time", "1 day").groupBy("source_id").agg(newest).select("source_id", "x.zone", "x.transport")


def route_rates(minutes: DataFrame) -> DataFrame:
    """Outcomes per distinct minute."""
    n = F.greatest(F.lit(1), F.count_distinct("minute"))
    return minutes.groupBy("route_id").agg((F.sum("delivered") / n).alias("delivered_rate"), (F.sum("failed") / n).alias("failed_rate"))


def vault_status(segments: DataFrame) -> DataFrame:
    """A9"""
    return segments.agg(F.count_distinct("segment_no").alias("segments"), F.max("received_time").alias("last_sealed"))


def replay_progress(log: DataFrame, published: DataFrame) -> DataFrame:
    """Distinct events of each replay job; done when all published ones have come."""
    done = log.where(F.col("tier") < 4).groupBy((F.col("event_id") % 20).alias("job_id")).agg(F.count_distinct("event_uid").alias("arrived"))
    return published.join(done, "job_id", "left").select("job_id", "published", F.coalesce("arrived", F.lit(0)).alias("arrived"), (F.coalesce("arrived", F.lit(0)) >= F.col("published")).alias("done"))


def counts_reconcile(raw: DataFrame, lineage: DataFrame, dlq: DataFrame) -> DataFrame:
    """Totals per source at each stage; diff is what lineage lacks, dlq must be the rows of tier 2 and more."""
    count = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    out = count(raw, "raw").join(count(lineage, "lineage"), "source_id", "full_outer").join(count(dlq, "dlq"), "source_id", "full_outer").fillna(0)
    return out.withColumn("diff", F.col("raw") - F.col("lineage"))


def _source_minute(spark: SparkSession, d: str) -> DataFrame:
    return source_minute(log_view(spark, d)).withColumns({"minute": text_time("minute"), "last_received": text_time("last_received")})


def _expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXPECTED), "source_id string, expected_eps double")


def _log(f):
    return lambda spark, d: f(log_view(spark, d))


SINCE = "2024-01-10 00:00:00"  # that the queries are registered with

QUERIES = {
    "source_minute": _source_minute,
    "source_minute_skew": _log(source_minute_skew),
    "skew_sketches": lambda s, d: merged_skew(stored(skew_sketches(log_view(s, d)), "sketches"), ["tenant_id", "source_id"]).select("tenant_id", "source_id", "n", "least", "most", F.col("p50").between(F.col("least"), F.col("most")).alias("inside")),
    "skew_health": lambda s, d: skew_health(log_view(s, d), stored(skew_sketches(log_view(s, d)), "sketches")).select("source_id", "n", "least", "most", (F.col("rank_error") <= 0.03).alias("within")),
    "route_minute": lambda s, d: route_minute(receipts(s, d)).withColumns({"minute": text_time("minute"), "last_at": text_time("last_at")}),
    "eps_1m": _log(eps),
    "source_strip": lambda s, d: source_strip(source_minute(log_view(s, d)), SINCE).withColumn("last_seen", text_time("last_seen")).orderBy(F.desc("raw"), "source_id"),
    "route_totals": lambda s, d: route_totals(route_minute(receipts(s, d)), SINCE),
    "overview": _log(overview),
    "overview_parts": lambda s, d: overview_parts(log_view(s, d), receipts(s, d), SINCE),
    "source_health": lambda s, d: source_health(log_view(s, d), _expected(s)),
    "shadow_totals": lambda s, d: shadow_totals(diffs_of(log_view(s, d))),
    "shadow_samples": lambda s, d: shadow_samples(log_view(s, d)),
    "shadow_transitions": _log(shadow_transitions),
    "shadow_fields": lambda s, d: shadow_fields(diffs_of(log_view(s, d))),
    "route_stats": lambda s, d: route_stats(route_minute(receipts(s, d)), SINCE),
    "tier_history": lambda s, d: tier_history(source_minute(log_view(s, d)), SINCE).withColumn("minute", text_time("minute")),
    "source_dimensions": _log(source_dimensions),
    "route_rates": lambda s, d: route_rates(route_minute(receipts(s, d))),
    "vault_status": lambda s, d: vault_status(log_view(s, d)).withColumn("last_sealed", text_time("last_sealed")),
    "replay_progress": lambda s, d: replay_progress(log_view(s, d), log_view(s, d).groupBy((F.col("event_id") % 20).alias("job_id")).agg(F.count("*").alias("published"))),
    "counts_reconcile": lambda s, d: counts_reconcile(log_view(s, d), log_view(s, d).where("event_id % 101 <> 0"), log_view(s, d).where("tier >= 2")),
}

_T = ", ".join(f"count(*) filter (tier = {t}) as tier{t}" for t in TIERS)
_R = f"{LOG}, rec as (select {RECEIPT_COLUMNS} from log)"
_RM = f"""{_R}, rm as (select route_id, date_trunc('minute', at_time) as minute, count(*) filter (status = 'delivered') as delivered,
 count(*) filter (status = 'failed') as failed, count(*) filter (status = 'filtered') as filtered, max(at_time) as last_at from rec group by all)"""
_D = f"""{LOG}, d as (select *, list_filter([case when value > 20 then 'src_endpoint.ip' end, case when event_id % 3 = 0 then 'user.name' end, case when value < 5 then 'status_id' end],
 lambda x: x is not null) as changed_fields from log), diffs as (select *, list_filter(changed_fields, lambda x: candidate_tier > tier and x <> 'status_id') as regressions from d)"""
_STATUS = "case when expected_eps is null then 'unexpected' when eps is null then 'silent' when eps < 0.5 * expected_eps then 'low' else 'ok' end"

ORACLES = {
    "source_minute": f"""{LOG} select tenant_id, source_id, strftime(date_trunc('minute', received_time), '%Y-%m-%d %H:%M:%S') as minute,
 count(*) as raw_count, sum(strlen(line))::bigint as raw_bytes, count(*) as norm_count, {_T}, count(*) filter (event_id % 20 = 0) as replays,
 strftime(max(received_time), '%Y-%m-%d %H:%M:%S') as last_received, arg_max(contract_ref, (received_time, event_uid)) as contract_ref
 from log group by tenant_id, source_id, date_trunc('minute', received_time)""",
    "skew_sketches": f"{LOG} select tenant_id, source_id, count(*) as n, min(skew_ms) as least, max(skew_ms) as most, true as inside from log group by 1, 2",
    "skew_health": f"{LOG} select source_id, count(*) as n, min(skew_ms) as least, max(skew_ms) as most, true as within from log group by 1",
    "source_minute_skew": f"{LOG} select source_id, quantile_cont(skew_ms, 0.5)::double as skew_p50, count(*) as n from log group by source_id",
    "route_minute": f"{_RM} select route_id, strftime(minute, '%Y-%m-%d %H:%M:%S') as minute, delivered, failed, filtered, strftime(last_at, '%Y-%m-%d %H:%M:%S') as last_at from rm",
    "eps_1m": f"{LOG} select source_id, count(*) / 60.0::double as eps from log where received_time >= (select max(received_time) from log) - interval 60 seconds group by 1",
    "source_strip": f"{LOG} select source_id, count(*) as raw, sum(strlen(line))::bigint as bytes, strftime(max(received_time), '%Y-%m-%d %H:%M:%S') as last_seen, {_T} from log where date_trunc('minute', received_time) >= timestamp '{SINCE}' group by 1",
    "route_totals": f"""{_R} select *, case when delivered + failed = 0 then 'idle' when failed = 0 then 'ok' when failed >= delivered then 'failing' else 'degraded' end as health from (
 select route_id, count(*) filter (status = 'delivered') as delivered, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'filtered') as filtered from rec where date_trunc('minute', at_time) >= timestamp '{SINCE}' group by 1)""",
    "overview": f"{LOG} select tenant_id, source_id, grouping_id(tenant_id, source_id)::int as level, count(*) as events, {_T} from log group by grouping sets ((tenant_id, source_id), (tenant_id), ())",
    "source_health": f"""{LOG}, got as (select source_id, count(*) / 432000.0::double as eps, {_T}, arg_max(contract_ref, (received_time, event_uid)) as contract_ref, quantile_cont(skew_ms, 0.5)::double as skew_p50
 from log where received_time >= (select max(received_time) from log) - interval 5 days group by 1)
 select source_id, eps, tier1, tier2, tier3, tier4, contract_ref, skew_p50, expected_eps, {_STATUS} as status from got full join {EXPECTED_SQL} using (source_id)""",
    "shadow_totals": f"""{_D} select contract_ref, count(*) as total, count(distinct event_uid) as events, count(*) filter (candidate_tier < tier) as improved,
 count(*) filter (candidate_tier > tier) as worsened, count(*) filter (candidate_tier = tier) as unchanged, count(*) filter (len(regressions) > 0) as with_regressions,
 arg_max(source_id, (received_time, event_uid)) as last_source from diffs group by 1""",
    "shadow_samples": f"{LOG} select contract_ref, n::int as n, event_uid from (select *, row_number() over (partition by contract_ref order by event_uid) as n from log where candidate_tier > tier) where n <= 10",
    "shadow_transitions": f"{LOG} select contract_ref, tier, candidate_tier, count(*) as n from log group by all",
    "shadow_fields": f"""{_D}, h as (select contract_ref, 'changed' as kind, unnest(changed_fields) as field from diffs union all select contract_ref, 'regressed', unnest(regressions) from diffs),
 c as (select contract_ref, kind, field, count(*) as n from h group by all)
 select *, row_number() over (partition by contract_ref, kind order by n desc, field)::int as place from c qualify place <= 10""",
    "route_stats": f"""{_RM} select route_id, sum(delivered)::bigint as delivered, sum(failed)::bigint as failed, string_agg(concat(strftime(minute, '%Y-%m-%d %H:%M'), ':', delivered, '/', failed), ',' order by minute) as series from rm where minute >= timestamp '{SINCE}' group by 1""",
    "tier_history": f"{LOG} select strftime(date_trunc('minute', received_time), '%Y-%m-%d %H:%M:%S') as minute, {_T} from log where date_trunc('minute', received_time) >= timestamp '{SINCE}' group by 1",
    "overview_parts": f"""{_R}, k as (select * from log where date_trunc('minute', received_time) >= timestamp '{SINCE}'), r as (select * from rec where date_trunc('minute', at_time) >= timestamp '{SINCE}')
 select 'eps' as part, source_id as item, 'eps' as metric, count(*) / 60.0::double as value from log where received_time >= (select max(received_time) from log) - interval 60 seconds group by 2
 union all select 'source', source_id, 'raw', count(*)::double from k group by 2 union all select 'source', source_id, 'bytes', sum(strlen(line))::double from k group by 2
 union all select 'route', route_id, s.status, count(*) filter (r.status = s.status)::double from r, (values ('delivered'), ('failed'), ('filtered')) s(status) group by 2, 3
 union all select 'tiers', 'all', concat('tier', t.t), count(*) filter (k.tier = t.t)::double from k, (values (1), (2), (3), (4)) t(t) group by 3
 union all select 'vault', 'all', 'segments', count(distinct segment_no)::double from log union all select 'vault', 'all', 'newest_segment', max(segment_no)::double from log""",
    "source_dimensions": f"""{LOG} select source_id, arg_max(user_id % 4, (received_time, event_uid)) as zone, arg_max(case when event_id % 2 = 0 then 'udp' else 'tcp' end, (received_time, event_uid)) as transport
 from log where received_time >= (select max(received_time) from log) - interval 1 day group by 1""",
    "route_rates": f"{_RM} select route_id, sum(delivered) / count(distinct minute)::double as delivered_rate, sum(failed) / count(distinct minute)::double as failed_rate from rm group by 1",
    "vault_status": f"{LOG} select count(distinct segment_no) as segments, strftime(max(received_time), '%Y-%m-%d %H:%M:%S') as last_sealed from log",
    "replay_progress": f"""{LOG} select event_id % 20 as job_id, count(*) as published, count(distinct event_uid) filter (tier < 4) as arrived,
 count(distinct event_uid) filter (tier < 4) >= count(*) as done from log group by 1""",
    "counts_reconcile": f"""{LOG} select source_id, count(*) as raw, count(*) filter (event_id % 101 <> 0) as lineage, count(*) filter (tier >= 2) as dlq, count(*) - count(*) filter (event_id % 101 <> 0) as diff
 from log group by 1""",
}
