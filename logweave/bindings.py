"""Bindings of the given tables to the engine's inputs: a log view over events and small dimensions.

The column expressions are plain SQL that Spark and the oracle engine read alike, so both start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.session import table

LOG_COLUMNS = """
event_id, user_id, ts as received_time, event_type as source_id, concat('t', user_id % 3) as tenant_id,
cast(1 + event_id % 4 as int) as tier, cast(1 + (event_id * 7) % 4 as int) as candidate_tier, value, props,
concat('e', lpad(cast(event_id as string), 12, '0')) as event_uid,
cast(case when event_id % 4 = 0 then 3002 when event_id % 4 = 1 then 4001 when event_id % 4 = 2 then 3002 else 0 end as int) as class_uid,
concat('c', user_id % 4, '@', event_id % 3) as contract_ref,
cast(round(value * 1000) as bigint) - 100000 as skew_ms,
cast(floor(event_id / 1000) as bigint) as segment_no,
concat('<', event_id % 192, '>Jan 01 00:00:00 host-', user_id % 20, ' app[', event_id, ']: user=u', user_id,
  case when event_id % 4 = 2 then ' FAILED' else ' OK' end, ' login from 10.0.', user_id % 256, '.', event_id % 256,
  ' via 10.2.3.4 attempts:', event_id % 5) as line
"""

#: Common table expression `log` of every oracle.
LOG = f"with log as (select {LOG_COLUMNS} from events)"

RECEIPT_COLUMNS = """
event_uid, cast(1 + event_id % 2 as int) as revision, source_id as route_id,
case when value < 10 then 'failed' when value < 20 then 'filtered' else 'delivered' end as status, received_time as at_time
"""


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_split(LOG_COLUMNS))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery outcome per event; the route is the source."""
    return log_view(spark, sf_dir).selectExpr(*_split(RECEIPT_COLUMNS))


def _split(columns: str) -> list[str]:
    """Top-level commas of a select list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [x.strip() for x in [*out, columns[at:]]]


#: Registered sources and the events per second expected of them; one sends nothing.
EXPECTED = (("click", 0.002), ("view", 1.0), ("signup", 0.0001), ("silent-source", 0.5), ("purchase", 0.0005))
EXPECTED_SQL = "(values " + ", ".join(f"('{s}', {e}::double)" for s, e in EXPECTED) + ") as expected(source_id, expected_eps)"
MINUTE = "date_trunc('minute', received_time)"
TEXT_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
