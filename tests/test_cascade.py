"""Every step of the cascade without a contract is tried in its order, on the text that the steps before left."""

from __future__ import annotations

from logweave.functions import layers

HEAD = "<13>Jan 01 00:00:00 h app: "
CEF = "CEF:0|acme|fw|1|7|{}|5|src=10.0.0.1"
#: line, the layers found, the text that is left.
CASES = (
    # what a text only seems to be is passed over
    ("{broken a=1 b=2", "kv", None),
    ("[info] a=1 b=2", "kv", None),
    (HEAD + "{broken a=1 b=2", "syslog>kv", "{broken a=1 b=2"),
    ("<13>1 foo=1 bar=2", "kv", None),
    ("CEF:0|a b=1 c=2", "kv", None),
    ("CEF:0|a|b|c", "delimited", None),
    ("LEEF:1.0 a=1 b=2", "kv", None),
    ('{"m":"Jan 01 00:00:00 h app: a=1 b=2 c=3 d=4 e=5"}', "json>kv", "Jan 01 00:00:00 h app: a=1 b=2 c=3 d=4 e=5"),
    # the steps behind a header or pairs
    (CEF.format("user=u1 act=deny"), "cef>kv", "user=u1 act=deny"),
    (HEAD + CEF.format("user=u1 act=deny"), "syslog>cef>kv", "user=u1 act=deny"),
    (CEF.format("a;b;c;d"), "cef>delimited", "a;b;c;d"),
    (" " + CEF.format("login"), "cef", "login"),
    ('{"m":"' + CEF.format("user=u1 act=deny") + '"}', "json>cef>kv", "user=u1 act=deny"),
    ("LEEF:1.0|a|b|1|u=1 v=2|usr=x", "leef>kv", "u=1 v=2"),
    ("user=a, src=1, act=deny, port=5", "kv>delimited", None),
    # columns only if no more than one layer was found, pairs behind JSON being one
    (HEAD + "user=a, src=1, act=deny, port=5", "syslog>kv", "user=a, src=1, act=deny, port=5"),
    ('{"m":"a;b;c;d"} x=1', "json", "a;b;c;d"),
    ("[1] a;b;c;d", "json>delimited", None),
    # the longest string of JSON goes on: escaped ones, other scripts and digits too, the first of ties; true and false are none
    ('{"m":"user=\\"a b\\" act=deny","k":"x"}', "json>kv", 'user="a b" act=deny'),
    ('{"e":"a\\u00e9 b=1 c=2 d=3 e=4"}', "json>kv", "aé b=1 c=2 d=3 e=4"),
    ('{"log":"{\\"a\\":\\"u=1 v=2\\"}"}', "json>json>kv", "u=1 v=2"),
    ('{"m":"जनरेटर लोड","k":"x"}', "json", "जनरेटर लोड"),
    ('{"k":"12345678","m":"x"}', "json", "12345678"),
    ('{"ok":false,"m":"a"}', "json", "a"),
    ('{"m":"aaa","n":"bbb"}', "json", "aaa"),
    ('{"a":"x y","a":"z"}', "json", "z"),
    # two pairs, not two signs
    ('a="x b=1" c', "text", None),
    ("\ta=1 b=2 c d", "kv", None),
)


def test_each_layer_is_tried_in_its_order(spark):
    got = layers.peel_auto(spark.createDataFrame([(i, line) for i, (line, _, _) in enumerate(CASES)], "n int, line string")).orderBy("n").collect()
    assert [(r["line"], r["parse_path"], r["text"]) for r in got] == [(line, f"auto:{path}", line if text is None else text) for line, path, text in CASES]
    for r in got:
        for k, p in r["spans"].items():
            assert r["line"][p["start"] : p["end"]] == r["fields"][k] or "\\" in r["line"][p["start"] : p["end"]], (r["line"], k)
    by = {r["line"]: r for r in got}
    escaped = by['{"m":"user=\\"a b\\" act=deny","k":"x"}']
    assert escaped["fields"]["kv.user"] == "a b" and escaped["line"][slice(*escaped["spans"]["kv.act"])] == "deny"
    assert by[CEF.format("user=u1 act=deny")]["fields"]["kv.act"] == "deny" and by[CEF.format("user=u1 act=deny")]["fields"]["cef.src"] == "10.0.0.1"


def test_depth_counts_layers(spark):
    lines = spark.createDataFrame([(HEAD + '{"m":"' + CEF.format("a=1 b=2") + '"}',)], "line string")
    assert [layers.peel_auto(lines, depth=n).first()["parse_path"] for n in range(1, 5)] == ["auto:syslog", "auto:syslog>json", "auto:syslog>json>cef", "auto:syslog>json>cef>kv"]
