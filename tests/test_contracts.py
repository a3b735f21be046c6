"""Spans through layers, patterns, the contract chain and masking: exact vectors and odd inputs."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from logweave.functions import contracts, drift, layers, normalize
from logweave.functions.layers import Contract, MapRow, Template
from logweave.operators import ordered


def mapped_one(spark, contract, lines):
    rows = spark.createDataFrame([(i, contract.id, x) for i, x in enumerate(lines)], "n int, contract string, line string").withColumn("received_time", F.lit("2026-09-26 14:10:00").cast("timestamp"))
    return contracts.normalized(rows, (contract,)).orderBy("n").collect()


def cut(line, span):
    return line.encode()[span["start"] : span["end"]].decode()


def test_captures_are_located_through_escaped_json_in_syslog(spark):
    """A value that stands earlier in the line too is located at its capture, behind escapes and multi-byte characters."""
    inner = json.dumps({"a": 'é"bob"', "msg": 'x\n"y" user=bob é port=7'})
    outer = json.dumps({"bob": 1, "ü": [{"deep": "bob"}], "event": inner}, ensure_ascii=True)
    line = f"<134>Sep 26 14:05:11 bob app[7]: {outer} | rest"
    contract = Contract("c", (("syslog", {}, False), ("json", {"text_field": "event"}, False), ("json", {"text_field": "msg"}, False)), (Template("t", '<*> "<q:quoted>" user=<who:word> é port=<port:int>', 3002),),
                        (MapRow("user.name", "capture", "who"), MapRow("src_endpoint.port", "capture", "port", "int"), MapRow("a", "field", "json.a"), MapRow("deep", "field", "json.ü[0].deep"), MapRow("host", "field", "syslog.host"), MapRow("q", "capture", "q")))
    (r,) = mapped_one(spark, contract, [line])
    assert r["got_tier"] == 1 and r["values"] == {"user.name": "bob", "src_endpoint.port": "7", "a": 'é"bob"', "deep": "bob", "host": "bob", "q": "y"}
    at = r["located"]
    assert {p: cut(line, at[p]) for p in at} == {"user.name": "bob", "src_endpoint.port": "7", "deep": "bob", "host": "bob", "q": "y"}
    raw = line.encode()
    assert raw[: at["user.name"]["start"]].endswith(b"user=") and raw[: at["deep"]["start"]].endswith(b'"deep": "') and at["host"]["start"] == raw.index(b"bob")
    assert r["derived"] == {"a": "field:json.a"}  # escapes lie inside it
    kinds = "n int, line string, values map<string,string>, located map<string,struct<start:int,end:int>>, derived map<string,string>"
    claims = spark.createDataFrame([tuple(r[c] for c in ("n", "line", "values", "located", "derived"))], kinds)
    assert layers.provenance_check(claims, "n").where("not ok").count() == 0



def test_json_scanner_against_the_library():
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(7 if depth < 4 else 5)
        if kind == 5:
            return [value(depth + 1) for _ in range(rng.randrange(3))]
        if kind == 6:
            return {rng.choice(["a", "b.c", "é", "k\n", '"']): value(depth + 1) for _ in range(rng.randrange(3))}
        return [None, True, rng.randrange(-9, 10**6), rng.random() * 1e9, rng.choice(["", "x", "é\U0001f600", 'q"\\\n', "  tail"])][kind]

    def leaves(v, path):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from leaves(x, f"{path}.{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from leaves(x, f"{path}[{i}]")
        else:
            yield path, v

    for n in range(500):
        whole = {"r": value(0)} if n % 2 else [value(0)]
        text = json.dumps(whole, ensure_ascii=n % 3 == 0) + rng.choice(["", " tail", "{", " ]"])
        got = layers.json_scan(text)
        assert got is not None, text
        found = [e for e in got["entries"] if e[0] != "json.__rest"]
        want = list(leaves(whole, "json"))
        assert [p for p, *_ in found] == [p for p, _ in want]
        for (_, v, s, e), (_, x) in zip(found, want):
            raw = text[s:e]
            if isinstance(x, str):
                assert v == x and json.loads(f'"{raw}"') == x
            else:
                assert v == raw and json.loads(raw) == x
    for bad in ("", "{", "[1,]", '{"a"}', '{"a":1,}', '{"a" 1}', "{1:2}", '"text"', "12", "[01]", '["\\x"]', "[1 2]", "{]", "nul", "[tru]", '{"a":[}'):
        assert layers.json_scan(bad) is None, bad
    assert layers.json_scan("[" * 20_000 + "1" + "]" * 20_000)["entries"][0][1] == "1"


def test_places_of_all_layers(spark):
    cases = {
        "kv": (("kv", {}, False), "é=0 user='a b' x=\"\" n=1 user=z, k=v", {"kv.user": "z", "kv.n": "1", "kv.k": "v"}),
        "cef": (("cef", {}, False), r"CEF:0|ac\|me|ngfw|1|e|the name|5|src=10.0.0.1 msg=hello big world dpt=7 ", {"cef.product": "ngfw", "cef.msg": "hello big world", "cef.dpt": "7", "cef.name": "the name"}),
        "leef": (("leef", {}, False), "LEEF:1.0|acme|fw|2|e9|usr=u1\tsrc=1.1.1.1", {"leef.event_id": "e9", "leef.usr": "u1", "leef.src": "1.1.1.1"}),
        "delimited": (("delimited", {"delimiter": "|", "columns": ("a", "b", "c")}, False), "x| ü y |z|w", {"delimited.a": "x", "delimited.b": "ü y", "delimited.c": "z", "delimited.col_4": "w"}),
        "regex": (("regex", {"pattern": r"(?i)VIA (?<gate>\S+)(?: port)? (?<p>(\d)+)"}, False), "x via ü9 port 22 y", {"regex.gate": "ü9", "regex.p": "22"}),
        "syslog": (("syslog", {}, False), '<165>1 2026-09-26T14:05:11Z fw01 app - ID47 [x@1 a="b"] msg', {"syslog.host": "fw01", "syslog.msgid": "ID47", "syslog.sd": '[x@1 a="b"]'}),
    }
    rows = spark.createDataFrame([(k, c[1]) for k, c in cases.items()], "contract string, line string")
    for r in layers.peel_by_contract(rows, tuple(Contract(k, (c[0],)) for k, c in cases.items())).collect():
        want = cases[r["contract"]][2]
        assert {k: r["fields"].get(k) for k in want} == want, r
        assert {k: r["line"][r["spans"][k]["start"] : r["spans"][k]["end"]] for k in want} == want
    nested = layers.peel_by_contract(spark.createDataFrame([("c", "alt a1")], "contract string, line string"), (Contract("c", (("regex", {"pattern": r"(?:(?<a>a\d)|b)"}, False),)),)).first()
    assert nested["fields"] == {"regex.a": "a1"} and nested["spans"] == {}


def test_odd_lines_are_peeled(spark):
    lines = [None, "", " ", "\x01a=1\x02 b=2", "a=" * 3000, "<1>", "{" * 3000, '{"a":"\\ud83d"}', "=", "'", 'a="b', "é" * 5000]
    frame = spark.createDataFrame([(i, "c", x) for i, x in enumerate(lines)], "n int, contract string, line string")
    got = layers.peel_by_contract(frame, (Contract("c", (("syslog", {}, True), ("json", {}, True), ("kv", {}, True))),)).orderBy("n").collect()
    assert [r["line"] for r in got] == lines and got[3]["fields"] == {"kv.a": "1\x02", "kv.b": "2"} or got[3]["fields"]["kv.b"] == "2"
    for r in got:
        for k, s in r["spans"].items():
            assert k.startswith("json.") or r["line"][s["start"] : s["end"]] == r["fields"][k]
    assert layers.peel_by_contract(frame.limit(0), ()).collect() == []


def test_many_pairs_take_linear_time(spark):
    def run(n):
        line = " ".join(f"k{i}={i}" for i in range(n))
        frame = spark.createDataFrame([("c", line)] * 3, "contract string, line string").coalesce(1)
        began = time.time()
        rows = layers.peel_by_contract(frame, (Contract("c", (("kv", {}, False), ("kv", {}, False))),)).select(F.size("fields").alias("n"), F.col("spans")[f"kv.k{n - 1}"]["start"].alias("s")).collect()
        assert all(r["n"] == n and r["s"] == len(line) - len(str(n - 1)) for r in rows)
        return time.time() - began

    run(10)
    few, many = run(10), run(5000)
    assert (many - few) / 3 < 3


def test_patterns(spark):
    with pytest.raises(ValueError):
        layers.compile_pattern("a <b")
    for bad in ("user=<unclosed", "<:ip>", "<a><a>", "<x:nosuchtype>"):
        with pytest.raises(ValueError):
            layers.compile_pattern(bad)
    contract = Contract("c", (), (Template("q", 'msg="<m:quoted>" from <ip:ip>'), Template("r", regex=r"^x=(?<x>\d+)( y)?$")), (MapRow("src_endpoint.ip", "capture", "ip", "ip", "q"),))
    got = mapped_one(spark, contract, ['msg="a b" from ::ffff:10.0.0.1', "x=9 y", 'msg="" from 010.0.0.1', "msg=a from 1.2.3.4"])
    assert [r["template"] for r in got] == ["q", "r", "q", None] and got[0]["captures"] == {"m": "a b", "ip": "::ffff:10.0.0.1"} and got[1]["captures"] == {"x": "9"}
    assert got[2]["values"]["src_endpoint.ip"] == "10.0.0.1" and got[2]["derived"] == {"src_endpoint.ip": "capture:ip"}  # changed by its type, so not located


@pytest.mark.parametrize("value,to,want", [("10.0.0.1", "ip", "10.0.0.1"), ("not-an-ip", "ip", None), ("::1", "ip", "::1"), ("1:2", "ip", None), ("::ffff:1.2.3.4", "ip", "::ffff:1.2.3.4"), ("::ffff:1.2.3.999", "ip", None), ("1:2:3:4:5:6:7:8", "ip", "1:2:3:4:5:6:7:8"), ("1:2:3:4:5:6:7:8:9", "ip", None), ("443", "int", "443"), ("http", "int", None)])
def test_types(spark, value, to, want):
    assert spark.createDataFrame([(value,)], "v string").select(layers.coerced(F.col("v"), to).alias("v")).first()["v"] == want


def test_times_dont_depend_on_the_session(spark):
    contract = Contract("c", (("kv", {}, False),), (Template("t", "at=<at> <rest:rest>"),), (MapRow("time", "ts", "at"),), "Asia/Kolkata")
    got = []
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got.append(mapped_one(spark, contract, ["at=2026-01-02T03:04:05 x"])[0]["values"]["time"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["1767303245000"] * 2


def test_validation_rules(spark):
    contract = lambda **k: Contract("c", (), (Template("t", "<v:rest>", **k),), (MapRow("severity_id", "capture", "v"),))
    errors = lambda c, line: mapped_one(spark, c, [line])[0]["errors"]
    assert errors(contract(class_uid=3002, activity_id=1), "3") == []
    assert errors(contract(class_uid=3002, activity_id=1), "42") == ["severity_id: not allowed"]
    assert errors(contract(class_uid=1007, activity_id=7), "1") == ["activity_id: not of the class"]
    assert errors(contract(class_uid=9999), "1") == ["class_uid: unknown"]
    assert errors(contract(class_uid=3002), "high") == ["severity_id: not a number"]


MASKED = {
    "session opened by user alice": "session opened by user <USER_1>", "job started by account bob": "job started by account <USER_1>", "failed for invalid user eve.": "failed for invalid user <USER_1>.", "account user bob": "account user <USER_1>",
    "closed for r.patil by neel-k": "closed for <USER_1> by <USER_2>", "user=al for al and AL": "user=<USER_1> for <USER_1> and AL", "by user": "by user", "for user invalid": "for user invalid",
    "mail a@x.org. then a@x.org": "mail <EMAIL_1>. then <EMAIL_1>", "A@x.org,a@x.org;b@y.co": "<EMAIL_1>,<EMAIL_1>;<EMAIL_2>", "token: 'a b' x": "token: <SECRET> x", "monkey=1 session_key=2": "monkey=1 session_key=<SECRET>", "deadbeefdeadbeefdeadbeef01": "<BLOB>", "from 10.0.0.1": "from 10.0.0.1",
}


def test_mask_vectors(spark):
    got = {r["line"]: r["masked"] for r in normalize.mask_pii(spark.createDataFrame([(x,) for x in [*MASKED, None, ""]], "line string"), "line").collect()}
    assert got == MASKED | {None: None, "": ""}


def test_token_shapes():
    kinds = lambda text: [(k, v) for k, _, v, _, _ in drift.tokens_of(text)]
    assert kinds("fe80::1 ::1 12:30:01 1:2:3:4:5:6:7:8 a::b::c")[:2] == [("ipv6", "fe80::1"), ("ipv6", "::1")] and ("ipv6", "1:2:3:4:5:6:7:8") in kinds("x 1:2:3:4:5:6:7:8")
    assert ("timestamp", "Sep  6 14:05:11") in kinds("Sep  6 14:05:11 x") and ("timestamp", "26/09/2026 14:05:11") in kinds("26/09/2026 14:05:11")
    assert kinds("k=" + "y" * 300 + "10.0.0.1")[0] == ("kv", "y" * 300 + "10.0.0.1") or kinds("k=" + "y" * 300 + "/10.0.0.1")[-1] == ("ip", "10.0.0.1")
    for text in ("a:" * 20_000, "a=" * 20_000, "a=b:" * 9000, "1:" * 20_000, "for " * 9000, "a." * 20_000, "x=1,10.0.0.1 " * 3000):
        began = time.time()
        drift.tokens_of(text)
        assert time.time() - began < 10, text[:9]


def test_json_values_and_paths(spark):
    texts = {1: '{"a":{"b":[{"c":"x\\"}"},2.50,true,null]},"e":{},"n":-7} rest } ]', 2: "[1", 3: "x", 4: None, 5: '{"a":1,"a":2}', 6: " [[[3]]] ", 7: '{"k":"' + "y" * 200_000 + '"}', 8: "[" * 5000 + "]" * 5000, 9: "[]"}
    frame = spark.createDataFrame(list(texts.items()), "id int, j string")
    whole = {r["id"]: (r["rest"], r["rejected"]) for r in normalize.json_values(frame, "id", "j").collect()}
    assert whole == {1: ("rest } ]", False), 2: (None, True), 3: (None, True), 4: (None, True), 5: (None, True), 6: (None, False), 7: (None, False), 8: (None, True), 9: (None, False)}
    got = sorted((r["id"], r["path"], r["value"], r["type"]) for r in normalize.json_fields(frame.where("id <> 7"), "id", "j").fillna("-").collect())
    assert got == [(1, "a.b[0].c", 'x"}', "string"), (1, "a.b[1]", "2.5", "float"), (1, "a.b[2]", "true", "bool"), (1, "a.b[3]", "-", "null"), (1, "n", "-7", "int"), (6, "[0][0][0]", "3", "int")]
    cut = normalize.json_fields(frame.where("id = 6"), "id", "j", levels=2).collect()
    assert [(r["path"], r["value"], r["type"]) for r in cut] == [("[0][0]", "[3]", "json")]
    assert normalize.json_fields(frame.limit(0), "id", "j").collect() == []


def test_diff_of_contracts(spark):
    ok, failed, extra = Template("ok", "user=<user> OK", 3002, ("user.name",), 1), Template("failed", "user=<user> FAILED <n:int>", 3002, (), 1), Template("extra", "<all>", 0)
    rows = (MapRow("user.name", "capture", "user"), MapRow("count", "capture", "n", "int", "failed"))
    old = Contract("c", (("syslog", {}, False),), (ok, failed), rows)
    new = Contract("c", (("syslog", {}, False), ("kv", {}, True)), (Template("failed", "user=<user> FAILED <n:int>", 3002, (), 2), Template("ok", "user=<user> fine", 3002, (), 1), extra), (MapRow("user.name", "capture", "user"), MapRow("actor", "capture", "user", template="ok")))
    diff = lambda a, b: {(r.part, r.template, r.name, r.change) for r in ordered.contract_diff(contracts.contract_rows(spark, a), contracts.contract_rows(spark, b)).collect()}
    assert diff((old,), (new,)) == {
        ("section", "", "layers", "changed"), ("template", "extra", "", "added"), ("pattern", "ok", "", "changed"), ("required", "ok", "user.name", "removed"), ("class", "failed", "", "changed"),
        ("map", "failed", "count", "removed"), ("map", "ok", "actor", "added"), ("unmapped", "failed", "n", "added"), ("order", "", "", "changed"),
    }
    assert diff((old,), (old,)) == set()
    assert {(part, change) for part, _, _, change in diff((old,), ())} == {("template", "removed"), ("section", "removed")}
