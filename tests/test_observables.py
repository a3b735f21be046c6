"""Observables of the login lines hold the host again, as before its SQL was made smaller."""

from __future__ import annotations

from logweave import catalog


def test_every_line_tells_its_host(spark):
    rows = catalog.QUERIES["observables_of"](spark, "/root/testdata/sf0.001").where("name = 'host_1'")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert rows.where("value not rlike '^host-[0-9]+$' or label <> 'from:device.hostname'").isEmpty()
    assert "host_1" in catalog.ORACLES["observables_of"]
