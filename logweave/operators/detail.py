"""All that is known of events, over seven tables and with one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.bindings import LOG, log_view

#: The parts of an event's detail, with the columns each table brings and whether it has at most one row an event.
PARTS = {
    "raw": (("source_id", "raw_sha256"), True), "revisions": (("revision", "tier", "contract_ref"), False), "bodies": (("revision", "class_uid"), False), "vault": (("segment_no", "record_idx"), True),
    "receipts": (("route_id", "status"), False), "dlq": (("revision", "reason"), False), "shadow": (("candidate_ref", "candidate_tier"), False),
}


def tagged(name: str, rows: DataFrame, key: str) -> DataFrame:
    """A table as rows of (key, part, row): its columns as text, in the order of PARTS."""
    columns, _ = PARTS[name]
    return rows.select(key, F.lit(name).alias("part"), F.array(*[F.col(c).cast("string") for c in columns]).alias("row"))


def event_detail(tables: dict[str, DataFrame], key: str = "event_uid", uids: DataFrame | None = None) -> DataFrame:
    """Key and the seven parts of each event that any table knows, each an array of structs in order, copies of a row once.

    The tables are one tagged union that is grouped once, so there is one exchange however many tables there are; rows are
    folded into distinct sets before it. uids (few): only these events; each table is filtered before the union. A part
    without rows is an empty array, one that has at most one row (raw, vault) shows the first in order.
    """
    parts = None
    for name in PARTS:
        rows = tagged(name, tables[name] if uids is None else tables[name].join(uids.select(key), key, "left_semi"), key)
        parts = rows if parts is None else parts.unionByName(rows)
    found = parts.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("part") == name, F.col("row")))).alias(name) for name in PARTS])

    def shown(name: str) -> Column:
        columns, single = PARTS[name]
        rows = F.transform(name, lambda r: F.struct(*[r[i].alias(c) for i, c in enumerate(columns)]))
        return (F.slice(rows, 1, 1) if single else rows).alias(name)

    return found.select(key, *[shown(n) for n in PARTS])


def detail_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The seven tables of the log, some of them with copies and several rows an event."""
    log = log_view(s, d)
    twice = log.withColumn("revision", F.explode(F.expr("if(event_id % 3 = 0, array(1, 2, 2), array(1))")))
    return {
        "raw": log.where("event_id % 11 <> 0").select("event_uid", "source_id", F.sha2("line", 256).alias("raw_sha256")), "revisions": twice.select("event_uid", "revision", "tier", "contract_ref"), "bodies": twice.where("tier < 4").select("event_uid", "revision", "class_uid"),
        "vault": log.select("event_uid", "segment_no", (F.col("event_id") % 1000).alias("record_idx")), "receipts": log.select("event_uid", F.explode(F.array(F.col("source_id"), F.lit("soc"))).alias("route_id"), F.lit("delivered").alias("status")),
        "dlq": log.where("tier >= 2").select("event_uid", F.lit(1).alias("revision"), F.concat(F.lit("tier"), "tier").alias("reason")), "shadow": log.where("candidate_tier <> tier").select("event_uid", F.lit("c@2").alias("candidate_ref"), "candidate_tier"),
    }


def _flat(name: str) -> Column:
    return F.array_join(F.transform(name, lambda r: F.concat_ws(":", *[r[c] for c in PARTS[name][0]])), ",").alias(name)


def _all(s: SparkSession, d: str) -> DataFrame:
    return event_detail(detail_tables(s, d)).select("event_uid", *[_flat(n) for n in PARTS])


QUERIES = {"event_parts": _all}
ORACLES = {
    "event_parts": f"""{LOG} select event_uid, case when event_id % 11 <> 0 then concat(source_id, ':', sha256(line)) else '' end as raw, case when event_id % 3 = 0 then concat('1:', tier, ':', contract_ref, ',2:', tier, ':', contract_ref) else concat('1:', tier, ':', contract_ref) end as revisions,
 case when tier = 4 then '' when event_id % 3 = 0 then concat('1:', class_uid, ',2:', class_uid) else concat('1:', class_uid) end as bodies, concat(segment_no, ':', event_id % 1000) as vault,
 case when source_id < 'soc' then concat(source_id, ':delivered,soc:delivered') else concat('soc:delivered,', source_id, ':delivered') end as receipts, case when tier >= 2 then concat('1:tier', tier) else '' end as dlq, case when candidate_tier <> tier then concat('c@2:', candidate_tier) else '' end as shadow from log""",
}
