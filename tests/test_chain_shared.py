"""Other contracts judge lines that were peeled once, and what a query doesn't ask for isn't made."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from logweave.functions import contracts as c

LINES = [(i, f"<{i}>Jan 01 00:00:00 host-{i} app[{i}]: user=u{i} {'FAILED' if i % 3 else 'OK'} login from 10.0.0.{i} via 10.2.3.4 attempts:{i % 5}") for i in range(20)]
LINES += [(20, "no header"), (21, None), (22, " ")]


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def lines_of(spark):
    rows = [(n, line, contract) for n, line in LINES for contract in ("login", "nobody", "kv")]
    return spark.createDataFrame(rows, "n int, line string, contract string").withColumn("received_time", F.lit("2026-01-02").cast("timestamp"))


def judged_apart(lines, contracts):
    got = c.normalized(lines, contracts)
    return {(r["n"], r["contract"]): (r["got_tier"], sorted(r["paths"])) for r in got.select("n", "contract", "got_tier", F.map_keys("values").alias("paths")).collect()}


def judged_together(lines, before, after):
    both = c.both_ways(lines, before, after)
    assert both.columns == [*lines.columns, "before", "after"]
    rows = both.collect()
    return plan_of(both), *[{(r["n"], r["contract"]): (r[w]["got_tier"], sorted(r[w]["paths"])) for r in rows} for w in ("before", "after")]


def test_sets_of_the_same_layers_are_peeled_once(spark):
    lines, more = lines_of(spark), replace(c.LOGIN, id="kv", layers=(("kv", {}, False),))
    for before, after, times in (((c.LOGIN,), (c.CANDIDATE, more), 1), ((c.LOGIN,), (replace(c.CANDIDATE, layers=more.layers), more), 2)):
        plan, *got = judged_together(lines, before, after)
        assert plan.count("__l0#") > 0 and len({x.split(",")[0].split("]")[0] for x in plan.split("AS __l0#")[1:]}) == times
        assert got == [judged_apart(lines, before), judged_apart(lines, after)]


def test_packs_of_the_same_layers_share_the_peeling(spark):
    lines = lines_of(spark)
    bare = replace(c.ONLY_OK, id="bare", layers=())
    got = {r["pack"]: (r["tier1"], r["tier2"]) for r in c.library_match(lines, {"full": c.LOGIN, "bare": bare, "ok": c.ONLY_OK}).collect()}
    for name, contract in (("full", c.LOGIN), ("bare", bare), ("ok", c.ONLY_OK)):
        tiers = [t for t, _ in judged_apart(lines.withColumn("contract", F.lit(contract.id)).withColumn("n", F.monotonically_increasing_id()), (contract,)).values()]
        assert got[name] == (tiers.count(1) / len(tiers), tiers.count(2) / len(tiers))


def test_places_are_made_only_where_they_are_asked_for(spark):
    got = c.normalized(lines_of(spark), (c.LOGIN,))
    assert "octet_length" not in plan_of(got.select("n", "values", "got_tier")) and "__at" not in plan_of(got.select("n", "values", "got_tier"))
    assert "octet_length" in plan_of(got.select("n", "located"))


def test_lines_without_a_contract_get_places_only_if_asked_for(spark):
    from logweave.functions import layers

    lines = spark.createDataFrame([('<13>Jan 01 00:00:00 h a: {"id":7,"s":"k=1 j=2 k=3"} b=5',)], "line string")
    calls, kv = [], layers.LAYERS["kv"]
    layers.LAYERS["kv"] = lambda text, given: calls.append(1) or kv(text, given)
    try:
        got = layers.peel_auto(lines)
    finally:
        layers.LAYERS["kv"] = kv
    assert len(calls) == 1  # an expression for all steps
    plans = [plan_of(got.select(*asked)) for asked in (("spans",), ("parse_path", F.size("fields")))]
    assert [("__s_places" in p, "__s_offsets" in p) for p in plans] == [(True, True), (False, False)]
    row = got.first()
    assert row["parse_path"] == "auto:syslog>json>kv" and row["fields"]["kv.k"] == "3" and row["fields"]["kv.b"] == "5"
    assert all(row["line"][p["start"] : p["end"]] == row["fields"][k] for k, p in row["spans"].items()) and {"kv.k", "kv.j", "kv.b", "json.id"} <= set(row["spans"])
