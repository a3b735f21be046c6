"""All registered queries of the log engine: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from logweave.functions import contracts, drift, layers, normalize
from logweave.operators import detail, jumps, ordered, relational
from logweave.plans import evidence, rollup
from logweave.sources import ingest, topics
from logweave.streaming import commits, jobs

QUERIES = {}
ORACLES = {}
for module in (rollup, relational, detail, ordered, jumps, normalize, layers, contracts, evidence, ingest, topics, drift, jobs, commits):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
