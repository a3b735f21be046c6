"""Frozen vectors, exact values and invariants of single operators."""

from __future__ import annotations

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from logweave.functions import drift, normalize
from logweave.operators import ordered, relational
from logweave.plans import evidence
from logweave.sources import ingest


def test_template_signatures(spark):
    rows = spark.createDataFrame([("authsrv", "user=neel.k FAILED login from 45.12.3.9 via 10.2.3.4 attempts:3"), ("unregistered", "Sep 26 14:05:11 conn 88213 closed by 10.0.0.5")], "scope string, line string")
    got = [r.sig for r in normalize.template_signature(rows, F.col("scope"), "line").collect()]
    assert got == ["t_3c85a1bfbf81", "t_940f551bf008"]


def merkle(leaves):
    if not leaves:
        return hashlib.sha256(b"").digest()
    if len(leaves) == 1:
        return hashlib.sha256(b"\0" + leaves[0]).digest()
    k = 1
    while k * 2 < len(leaves):
        k *= 2
    return hashlib.sha256(b"\1" + merkle(leaves[:k]) + merkle(leaves[k:])).digest()


def test_merkle_roots_and_proofs(spark):
    rows, want = [], {}
    for n in (1, 2, 3, 5, 6, 7, 11):
        leaves = [hashlib.sha256(f"segment-{i}".encode()).hexdigest() for i in range(n)]
        rows += [(f"w{n}", i, x) for i, x in enumerate(leaves)]
        want[f"w{n}"] = merkle([bytes.fromhex(x) for x in leaves]).hex()
    frame = spark.createDataFrame(rows, "window string, idx long, leaf string")
    roots = evidence.merkle_roots(frame, 11)
    assert {r.window: r.root for r in roots.collect()} == want
    assert want["w3"] == "49a27ff0ee8487600104ea234555fdaa1b3f8ac98d67d12fa3c3620a0e7000f4"
    got = evidence.verify_inclusion(frame, evidence.inclusion_proofs(frame, 11), roots).collect()
    assert len(got) == len(rows) and all(r.included for r in got)


def test_hash_chain(spark):
    rng = random.Random(1)
    rows = [(t, p, o, hashlib.sha256(f"{t}{p}{o}".encode()).hexdigest(), bytes(rng.randrange(256) for _ in range(16))) for t in "ab" for p in (0, 1) for o in range(20)]
    rng.shuffle(rows)
    kinds = "topic string, part long, offset long, raw_sha string, uid16 binary"
    chains = evidence.hash_chain(spark.createDataFrame(rows, kinds))
    got = {(r.topic, r.part, r.offset): r.chain_hash for r in chains.collect()}
    for t, p in {r[:2] for r in rows}:
        last = hashlib.sha256(f"{evidence.GENESIS}\x1f{t}\x1f{p}".encode()).digest()
        for _, _, o, sha, uid in sorted(r for r in rows if r[:2] == (t, p)):
            last = hashlib.sha256(last + bytes.fromhex(sha) + uid + o.to_bytes(8, "big")).digest()
            assert got[t, p, o] == last.hex()
    forged = [(t, p, o, "00" * 32 if (t, p, o) == ("a", 1, 7) else sha, uid) for t, p, o, sha, uid in rows if (t, p, o) != ("b", 0, 19)]
    checked = {(r.topic, r.part): (r.head_ok, r.first_break, r.broken) for r in evidence.verify_chain(spark.createDataFrame(forged, kinds), chains).collect()}
    assert checked == {("a", 0): (True, None, 0), ("a", 1): (False, 7, 13), ("b", 0): (False, 19, 1), ("b", 1): (True, None, 0)}


@pytest.mark.parametrize("key", [b"k", b"x" * 100])
def test_hmac(spark, key):
    rows = spark.createDataFrame([("value",), ("",), ("ü",)], "v string")
    for r in rows.select("v", normalize.hmac_hex(F.col("v"), key).alias("h")).collect():
        assert r.h == hmac.new(key, r.v.encode(), "sha256").hexdigest()


def test_syslog_variants(spark):
    lines = ["<34>1 2024-01-01T00:00:00Z h app 12 ID - hello", "<13>Jan  1 00:00:00 host sshd[9]: Failed password", "CEF:0|a|b|c|d|e|5|x=1", "", None, "\xff\x00 random"]
    got = normalize.syslog_fields(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r.variant for r in got] == ["rfc5424", "rfc3164", "none", "none", "none", "none"]
    assert (got[0].host, got[0].app, got[0].body, got[0].facility, got[0].severity) == ("h", "app", "hello", 4, 2)
    assert (got[1].host, got[1].app, got[1].pid, got[1].body) == ("host", "sshd", "9", "Failed password")


def test_mask_pii_numbers_values(spark):
    text = "user=bob wrote a@b.com and c@d.org, then a@b.com password=hunter2 user=eve"
    got = normalize.mask_pii(spark.createDataFrame([(text,)], "t string"), "t").first().masked
    assert got == "user=<USER_1> wrote <EMAIL_1> and <EMAIL_2>, then <EMAIL_1> password=<SECRET> user=<USER_2>"


def test_tokens_claim_once():
    for text in ("user=neel.k FAILED login from 45.12.3.9:22 attempts:3", "a=" * 5000, "", "https://x.y/z a@b.c 12:30:00"):
        got = drift.tokens_of(text)
        assert all(a[4] <= b[3] for a, b in zip(got, got[1:])) and all(text[a:b] == v for _, _, v, a, b in got)
    got = drift.tokens_of("Failed for invalid user admin from 45.12.3.9:22 port 77 key='a b' url=http://x/y")
    assert [(k, n, v) for k, n, v, _, _ in got] == [
        ("word", "", "Failed"), ("word", "", "for"), ("word", "", "invalid"), ("word", "", "user"), ("user", "", "admin"), ("word", "", "from"), ("ip", "", "45.12.3.9"), ("port", "", "22"),
        ("port", "", "77"), ("kv", "key", "a b"), ("word", "", "url"), ("url", "", "http://x/y"),
    ]


def test_token_limits_are_told(spark):
    rows = spark.createDataFrame([("a", "one two three"), ("b", "one")], "k string, line string")
    got = {(r.k, r.value, r.truncated) for r in drift.token_table(rows, "k", "line", most_tokens=2).collect()}
    assert got == {("a", "one", True), ("a", "two", True), ("b", "one", False)}
    assert drift.token_table(rows, "k", "line").count() == 4


def test_signature_shapes(spark):
    """One vector for each shape, and for what only looks like one."""
    want = {
        "3f2504e0-4f89-11d3-9a0c-0305e82c3301": "<UUID>", "10.0.0.1:80": "<IP>", "2026-09-26": "<TS>", "2026-09-26T14:05:11Z": "<TS>", "12:30": "<TS>", "fe80::1": "<IP>", "1:2:3:4": "<TS>", "ab:cd:ef:01": "<IP>",
        "a@b.org": "<EMAIL>", "a@b": "a@b", "k=": "k=<V>", "k:/x": "k:<V>", "k:": "k:", "9k=v": "<NUM>", "deadbeef": "<HEX>", "deadbee": "deadbee", "x1": "<NUM>", "plain": "plain",
    }
    got = {r.line: r.shape for r in normalize.template_signature(spark.createDataFrame([(x,) for x in want], "line string"), F.lit("s"), "line").collect()}
    assert got == want


def test_event_times(spark):
    rows = [("2026-09-26 14:05:11", "2026-09-26 09:00:00"), ("2026-09-26T14:05:11+05:30", "2026-09-26 09:00:00"), ("Dec 31 23:59:00", "2027-01-01 00:05:00"), ("no time", "2026-09-26 09:00:00")]
    frame = spark.createDataFrame(rows, "t string, received string").withColumn("received", F.col("received").cast("timestamp"))
    got = {r.t: r for r in normalize.event_time(frame, "t", "received", "Asia/Kolkata").collect()}
    assert got[rows[0][0]].epoch_ms == got[rows[1][0]].epoch_ms == 1790411711000 and (got[rows[0][0]].tz_assumed, got[rows[1][0]].tz_assumed) == ("Asia/Kolkata", None)
    assert got[rows[2][0]].year_inferred and got[rows[2][0]].event_time.year == 2026
    assert (got[rows[3][0]].time_source, got[rows[3][0]].skew_s) == ("received", 0)


def test_multiline_joins(spark):
    rows = [("p", 1, "first"), ("p", 2, "  at x"), ("p", 3, "at y"), ("p", 4, ""), ("p", 5, "second"), ("q", 1, "\tlone")]
    got = ordered.join_multiline(spark.createDataFrame(rows, "peer string, n int, line string"), "peer", "n", "line").collect()
    assert sorted((r.peer, r.text, r.parts) for r in got) == [("p", "first\n  at x\nat y", 3), ("p", "second", 1), ("q", "\tlone", 1)]


def test_blank_lines_of_a_run(spark):
    rows = [("p", 1, "   "), ("p", 2, "first"), ("p", 3, " \t"), ("p", 4, "  at x"), ("p", 5, ""), ("p", 6, "at y"), ("p", 7, None), ("p", 8, "second"), ("q", 1, " "), ("r", 1, "\tlone"), ("r", 2, " more")]
    frame = spark.createDataFrame(rows, "peer string, n int, line string")
    got = ordered.join_multiline(frame, "peer", "n", "line").collect()
    assert sorted((r.peer, r.text, r.parts) for r in got) == [("p", "first\n \t\n  at x\nat y", 4), ("p", "second", 1), ("r", "\tlone\n more", 2)]
    assert ordered.join_multiline(frame.limit(0), "peer", "n", "line").collect() == []


def test_keys_of_another_pepper_and_unregistered_sources(spark):
    digest = lambda secret: hashlib.sha256(f"salt{secret}".encode()).hexdigest()
    own = relational.pepper_id("salt")
    keys = spark.createDataFrame([(digest("a"), 1, own, "active", "s1", 5), (digest("b"), 2, "p_other", "active", "s1", 5), (digest("c"), 3, None, "expired", "s1", None), (digest("d"), 4, "", "active", "s9", 0), (digest("e"), 5, own, "active", "s2", 7), (digest("f"), 6, own, None, "s1", 7)], "key_hash string, key_id int, pepper_id string, status string, source_id string, quota_eps int")
    sources = spark.createDataFrame([("s1", "v1", "z1", "active"), ("s2", "v2", "", "paused")], "source_id string, vendor string, zone string, status string")
    asked = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("e", "e"), ("f", "f"), ("x", "nobody's"), ("y", ""), ("z", None)], "event_uid string, secret string")
    got = {r.event_uid: (r.outcome, r.source_id, r.vendor, r.zone, r.quota_eps) for r in relational.attribute_by_key(asked, keys, sources, "salt", quota=50).collect()}
    assert got == {
        "a": ("admitted", "s1", "v1", "z1", 5), "b": ("pepper_mismatch", "s1", "v1", "z1", 5), "c": ("expired", "s1", "v1", "z1", 50), "d": ("admitted", "s9", "generic", "unassigned", 50),
        "e": ("source_paused", "s2", "v2", "unassigned", 7), "f": ("unknown", "s1", "v1", "z1", 7), "x": ("unknown_key", "none", "generic", "unassigned", 50), "y": ("no_credential", "none", "generic", "unassigned", 50), "z": ("no_credential", "none", "generic", "unassigned", 50),
    }
    assert relational.attribute_by_key(asked.limit(0), keys, sources, "salt").collect() == []


def test_gap_of_null_and_repeated_paths(spark):
    rows = [("a", ["x", "y", "x"], ["y"], None), ("b", None, ["y"], ["x"]), ("c", ["x"], ["x"], []), ("d", ["z", "b"], None, ["q"])]
    frame = spark.createDataFrame(rows, "event_uid string, claimed array<string>, located array<string>, derived array<string>")
    assert {r.event_uid: r.gap for r in relational.provenance_gap(frame, "claimed", "located", "derived").collect()} == {"a": ["x"], "d": ["b", "z"]}


def test_manifest_of_odd_files(spark, tmp_path):
    for name, content in {"empty": b"", "open": b"a\nb", "closed": b"a\n\n", "bad": b"\xff\xfe\nz\n"}.items():
        (tmp_path / f"{name}.txt").write_bytes(content)
    got = {r.file: r for r in ingest.file_manifest(spark, str(tmp_path)).collect()}
    stamped = lambda file, n, line: hashlib.sha256(f"{file}\x1f{n}\x1f{hashlib.sha256(line).hexdigest()}".encode()).hexdigest()[:32]
    lines = {"open.txt": [b"a", b"b"], "closed.txt": [b"a", b""], "bad.txt": [b"\xff\xfe", b"z"]}
    assert set(got) == set(lines)
    for file, own in lines.items():
        assert got[file].events == len(own) and got[file].sha256 == hashlib.sha256((tmp_path / file).read_bytes()).hexdigest()
        assert (got[file].first_uid, got[file].last_uid) == (stamped(file, 1, own[0]), stamped(file, len(own), own[-1]))


def test_route_with_unknown_key_is_refused(spark):
    with pytest.raises(ValueError):
        relational.route_accepts({"id": "x", "colour": ["red"]})


def test_envelopes_never_crash(spark):
    rng = random.Random(3)
    lines = ["", "{", "null", "[1]", '{"event_uid": 3}', '{"event_uid":"x","raw_sha256":"' + "a" * 64 + '","replay":"oops"}', *("".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(40)) for _ in range(50))]
    good, bad = ingest.parse_envelope(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert good.count() + bad.count() == len(lines)


def test_push_batches(spark):
    rows = [(1, '{"a":1}{"b":{"z":1,"a":2}} [3]'), (2, '{"a":1}{oops'), (3, None), (4, "")]
    got = sorted((r.k, r.n, r.event, r.reject) for r in ingest.explode_push_batches(spark.createDataFrame(rows, "k long, body string"), "k", "body").collect())
    assert got == [(1, 0, '{"a":1}', None), (1, 1, '{"b":{"a":2,"z":1}}', None), (1, 2, "[3]", None), (2, 0, '{"a":1}', None), (2, 1, None, "malformed")]


def test_json_layer_as_arrow():
    """Columns of a batch at once: null and broken texts, scalars without strings, escapes, an empty batch."""
    from logweave.functions.layers import json_scan, layer_array

    texts = [None, '{"a":', '{"a":[1,{"b":"x"}]}', '{"m":"q\\"é\\u00e9","n":null} tail', "{}", '{"m":""}']
    rows = [None if t is None else json_scan(t, "m") for t in texts]
    got = layer_array(rows).to_pylist()
    for row, made in zip(rows, got, strict=True):
        want = row or {"entries": None, "text": None, "cuts": None}
        assert made["text"] == want["text"]
        assert made["entries"] == (None if row is None else [dict(zip("kvse", x)) for x in want["entries"]])
        assert made["cuts"] == (None if want["cuts"] is None else [{"at": a, "src": b} for a, b in want["cuts"]])
    assert [r["entries"] is None for r in got] == [True, True, False, False, False, False]
    assert got[3]["text"] == 'q"éé' and len(layer_array([])) == 0 and layer_array([None])[0]["entries"].as_py() is None
