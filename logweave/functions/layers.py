"""Contracts as tables: layers that are peeled in order, patterns with typed captures, and a map from captures to paths.

Nothing here knows the names of any source: a contract's layers, templates and map rows are data.

Every value keeps its place. A text that a layer leaves has an offset map, an array of (at, src): from
position `at` of the text on, characters stand from position `src` of the line on; the last entry is the
end. A syslog body is one stretch, an escaped JSON string one for each escape, and the map of a text inside
a text is composed of both. Patterns are written so that their groups tile the text, so the lengths of the
groups before a capture are its place, and one pass gives values and places.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.bindings import LOG, log_view
from logweave.functions.normalize import DELIMITERS, time_of

MAX_DEPTH = 4
ENTRIES = "array<struct<k: string, v: string, s: int, e: int>>"
CUTS = "array<struct<at: int, src: int>>"
PLACES = "array<struct<s: int, e: int>>"
LAYER = f"struct<entries: {ENTRIES}, text: string, cuts: {CUTS}>"


@dataclass(frozen=True)
class Template:
    """A pattern such as `user=<name> from <src:ip> <*>`; the first of a contract that matches a whole text wins.

    regex, if given, is taken instead of the pattern: an expression for the whole text whose named groups (?<name>...) are the captures.
    """

    name: str
    pattern: str = ""
    class_uid: int = 0
    required: tuple[str, ...] = ()
    activity_id: int = 0
    regex: str = ""


@dataclass(frozen=True)
class MapRow:
    """How one path gets its value: kind capture, field, const, vocab, ts or text; `to` is string, int or ip; template None: all of the contract."""

    path: str
    kind: str
    ref: str = ""
    to: str = "string"
    template: str | None = None
    words: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Contract:
    id: str
    layers: tuple[tuple[str, dict, bool], ...]  # kind, parameters, optional
    templates: tuple[Template, ...] = ()
    rows: tuple[MapRow, ...] = field(default=())
    tz: str = "UTC"  # of times without an offset
    formats: tuple = ()  # of times, tried before the general ones, as in normalize.FORMATS


# --- places


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once. An aggregate without elements, as an element taken of a transformed array asks for its whole type again in each row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def held(value: Column) -> Column:
    """A column that the optimizer leaves where it is: as it can't move filters or merge projections across it, a long expression isn't copied into each place that uses it."""
    return F.when(F.spark_partition_id() >= 0, value)


def starts(pieces: Column, gap: int = 0, block: int = 64) -> Column:
    """Where each of the pieces of a text begins, `gap` characters lying between two. Blocks keep the work linear in the pieces."""

    def within(ps: Column, at: Column) -> Column:
        """Of the pieces of one block, whose first begins at `at`; the sum behind the last is left out."""
        return F.slice(F.aggregate(ps, F.array(at), lambda sums, p: F.array_append(sums, F.element_at(sums, -1) + F.length(p) + gap)), F.lit(1), F.size(ps))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / block).cast("int")), lambda b: F.slice(pieces, b * block + 1, F.lit(block)))
    upto = lambda lengths: F.transform(lengths, lambda _, b: F.aggregate(F.slice(lengths, F.lit(1), b), F.lit(0), lambda a, x: a + x))
    many = let(blocks, lambda bs: let(upto(F.transform(bs, lambda ps: F.length(F.array_join(ps, "")) + F.size(ps) * gap)), lambda at: F.flatten(F.transform(bs, lambda ps, b: within(ps, F.get(at, b))))))
    return F.when(F.size(pieces) == 0, F.array().cast("array<int>")).when(F.size(pieces) <= block, within(pieces, F.lit(0))).otherwise(many)


def tiles(text: Column, pattern: str, marked: str, whole: int | None = None) -> Column:
    """(v, s, e) of the pieces into which the groups of a pattern cut a text: `marked` is the replacement, with \\x02 between pieces.

    whole: the number of groups of a pattern that must match the whole text, null where it doesn't.
    A text's own marks don't count: it is cut with others in their place, and values come from the text itself.
    """
    def cut(safe: Column) -> Column:
        made = F.regexp_replace(safe, pattern, marked)
        if whole is None:
            return F.split(made, "\x02", -1)
        return F.when(made.startswith("\x01"), F.split(F.substring(made, 2, 2147483647), "\x02", whole))

    odd = F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02"))

    def spread(o: Column) -> Column:
        one = lambda p, at: F.struct(F.when(o, F.substring(text, at + 1, F.length(p))).otherwise(p).alias("v"), at.alias("s"), (at + F.length(p)).alias("e"))
        return let(cut(F.when(o, F.translate(text, "\x01\x02", "\ufffd\ufffd")).otherwise(text)), lambda ps: let(starts(ps), lambda st: F.zip_with(ps, st, one)))

    return let(odd, spread)


def whole_tiles(text: Column, pattern: str, n: int) -> Column:
    return tiles(text, pattern, "\x01" + "\x02".join(f"${i}" for i in range(1, n + 1)), n)


def entry(k: str | Column, tile: Column) -> Column:
    return F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), tile["v"].alias("v"), tile["s"].alias("s"), tile["e"].alias("e"))


def stretch(tile: Column) -> Column:
    """The offset map of a text that stands in another as it is."""
    return F.array(F.struct(F.lit(0).alias("at"), tile["s"].alias("src")), F.struct((tile["e"] - tile["s"]).alias("at"), tile["e"].alias("src")))


def placed(offsets: Column, at: Column) -> Column:
    """The line's position for a position of a text, null without an offset map."""
    last = F.try_element_at(F.filter(offsets, lambda m: m["at"] <= at), F.lit(-1))
    return F.when(F.size(offsets) == 2, F.get(offsets, F.lit(0))["src"] + at).otherwise(let(last, lambda m: m["src"] + at - m["at"]))


def composed(offsets: Column, cuts: Column) -> Column:
    """The offset map of a text whose cuts tell its places in an outer text, offsets those of the outer text in the line."""
    own = F.transform(cuts, lambda c: F.struct(c["at"].alias("at"), placed(offsets, c["src"]).alias("src")))
    runs = F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda i: F.struct(F.get(cuts, i)["at"].alias("at"), F.get(cuts, i)["src"].alias("src"), (F.get(cuts, i + 1)["at"] - F.get(cuts, i)["at"]).alias("n")))
    inside = lambda r: F.transform(F.filter(offsets, lambda m: (m["at"] > r["src"]) & (m["at"] < r["src"] + r["n"])), lambda m: F.struct((r["at"] + m["at"] - r["src"]).alias("at"), m["src"].alias("src")))
    both = F.array_sort(F.array_distinct(F.concat(own, F.flatten(F.transform(runs, inside)))))
    return F.when(F.size(offsets) == 2, own).when(F.size(cuts) < 2, own).otherwise(both)


def layer_of(entries: Column, text: Column | None = None, cuts: Column | None = None) -> Column:
    """What a layer gives: entries, and the text it leaves with that text's cuts; without a text the next layer sees the same one."""
    none = F.lit(None)
    return F.struct(entries.alias("entries"), (none if text is None else text).alias("text"), (none if cuts is None else cuts).alias("cuts")).cast(LAYER)


def filled(entries: Column) -> Column:
    return F.filter(entries, lambda x: F.coalesce(x["v"] != "", F.lit(False)))


# --- layers: (text, parameters) -> (entries, the text that is left, its cuts), null where the layer doesn't apply

# The header layouts of the two syslog RFCs, every part a group.
NEW_SYSLOG = r"(?s)^(<)(\d{1,3})(>)(\d)(\s+)(\S+)(\s+)(\S+)(\s+)(\S+)(\s+)(\S+)(\s+)(\S+)(\s+)((?:\[[^\]]*\])+|-)(\s?)(.*)$"
OLD_SYSLOG = r"(?s)^(?:(<)(\d{1,3})(>))?([A-Z][a-z]{2}\s+\d{1,2}\s+\d{1,2}:\d{2}:\d{2})(\s+)(\S+)(\s+)(?:(?!(?:CEF|LEEF):\d)([^\s\[:]+)(?:(\[)(\d+)(\]))?(:\s*))?(.*)$"
NEW_NAMES = {1: "pri", 3: "version", 5: "timestamp", 7: "host", 9: "app", 11: "pid", 13: "msgid", 15: "sd"}
OLD_NAMES = {1: "pri", 3: "timestamp", 5: "host", 7: "app", 9: "pid"}


def _syslog(text: Column, given: dict) -> Column:
    def made(t: Column, names: dict[int, str], body: int) -> Column:
        pri = F.get(t, F.lit(1))["v"].try_cast("int")
        counted = [F.struct(F.lit(f"syslog.{n}").alias("k"), v.cast("string").alias("v"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e")) for n, v in (("facility", F.floor(pri / 8)), ("severity", pri % 8))]
        fields = F.filter(F.array(*[entry(f"syslog.{n}", t[i]) for i, n in names.items()], *counted), lambda x: F.coalesce(~x["v"].isin("", "-"), F.lit(False)))
        return layer_of(fields, t[body]["v"], stretch(t[body]))

    new = let(whole_tiles(text, NEW_SYSLOG, 18), lambda t: F.when(t.isNotNull(), made(t, NEW_NAMES, 17)))
    old = let(whole_tiles(text, OLD_SYSLOG, 13), lambda t: F.when(t.isNotNull(), made(t, OLD_NAMES, 12)))
    return F.when(text.startswith("<") & text.rlike(r"^<\d{1,3}>\d\s"), F.coalesce(new, old)).otherwise(old)


TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|true\b|false\b|null\b))')
ESCAPE = re.compile(r"(?:\\u[0-9a-fA-F]{4})+|\\.")


def unescaped(raw: str) -> tuple[str, list[tuple[int, int]]]:
    """A JSON string's text and its cuts: a new stretch begins behind every escape."""
    if "\\" not in raw:
        return raw, [(0, 0), (len(raw), len(raw))]
    out, cuts, size, at = [], [(0, 0)], 0, 0
    for m in ESCAPE.finditer(raw):
        value = json.loads(f'"{m[0]}"')
        out += raw[at : m.start()], value
        size += m.start() - at
        cuts += (size, m.start()), (size + len(value), m.end())
        size, at = size + len(value), m.end()
    text = "".join([*out, raw[at:]]).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text, sorted({(a, s) for a, s in [*cuts, (len(text), len(raw))]}) if len(cuts) > 1 else [(0, 0), (len(text), len(raw))]


def json_scan(text: str, chosen: str | None = None, longest: bool = False) -> dict | None:
    """Scalars of the first JSON value of a text as entries (path, value, place), places of strings without their quotes; what stands behind it is json.__rest.

    The chosen string member becomes the text, or the longest string (the first of ties). None: no object or array begins the text, or it is broken.
    """
    entries, stack, at, want, strings = [], [], 0, "value", {}
    name = "json"
    while True:
        m = TOKEN.match(text, at)
        if m is None:
            return None
        mark, at = m[1], m.end()
        if mark and mark in "{[" and want in ("value", "first"):
            stack.append((mark, name, 0))
            want = "key or end" if mark == "{" else "first"
            name = f"{name}[0]" if mark == "[" else name
            continue
        if mark and mark in "}]" and stack and stack[-1][0] == {"}": "{", "]": "["}[mark] and want in ("more", "key or end" if mark == "}" else "first"):
            stack.pop()
        elif mark == "," and want == "more":
            kind, base, n = stack.pop()
            stack.append((kind, base, n + 1))
            name, want = (f"{base}[{n + 1}]", "value") if kind == "[" else (base, "key")
            continue
        elif m[2] and want in ("key", "key or end"):
            key = unescaped(m[2][1:-1])[0]
            colon = TOKEN.match(text, at)
            if colon is None or colon[1] != ":":
                return None
            at, name, want = colon.end(), f"{stack[-1][1]}.{key}", "value"
            continue
        elif (m[2] or m[3]) and want in ("value", "first") and stack:
            s, e = (m.start(2) + 1, m.end(2) - 1) if m[2] else m.span(3)
            value, cuts = unescaped(m[2][1:-1]) if m[2] else (m[3], [])
            entries.append((name, value, s, e))
            if m[2] and (longest or chosen is not None and name == f"json.{chosen}"):
                strings[name] = value, s, cuts  # of equal names the last one counts
            elif longest:
                strings.pop(name, None)
        else:
            return None
        want = "more"
        if not stack:
            break
    rest = text[at:].strip()
    if rest:
        s = text.index(rest, at)
        entries.append(("json.__rest", rest, s, s + len(rest)))
    left, s, cuts = max(strings.values(), key=lambda x: len(x[0]), default=(None, 0, None))
    return {"entries": entries, "text": left, "cuts": None if cuts is None else [(a, s + b) for a, b in cuts]}


def listed(rows: list[list[tuple] | None], kinds: tuple[tuple[str, pa.DataType], ...]) -> pa.Array:
    """Lists of tuples as an Arrow array of lists of structs, made column by column."""
    flat = [x for r in rows if r is not None for x in r]
    parts = zip(*flat) if flat else [()] * len(kinds)
    ends = [0, *accumulate(0 if r is None else len(r) for r in rows)]
    values = pa.StructArray.from_arrays([pa.array(p, kind) for p, (_, kind) in zip(parts, kinds)], [n for n, _ in kinds])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([r is None for r in rows], pa.bool_()))


def layer_array(rows: list[dict | None]) -> pa.Array:
    """What json_scan gives of each text, as an Arrow array of LAYER."""
    entries, text, cuts = ([None if r is None else r[c] for r in rows] for c in ("entries", "text", "cuts"))
    made = listed(entries, (("k", pa.string()), ("v", pa.string()), ("s", pa.int32()), ("e", pa.int32()))), pa.array(text, pa.string()), listed(cuts, (("at", pa.int32()), ("src", pa.int32())))
    return pa.StructArray.from_arrays(made, ["entries", "text", "cuts"])


def _json(text: Column, given: dict) -> Column:
    """All scalars of the first JSON value by their path; a small scanner tells their places, which no built-in function does."""
    chosen = given.get("text_field")

    @F.arrow_udf(LAYER)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield layer_array([None if t is None else json_scan(t, chosen) for t in texts.to_pylist()])

    made = scan(F.when(text.rlike(r"^[ \t\n\r]*[\{\[]"), text))
    return made


PAIR = r"""([A-Za-z_][\w.\-]*+)(\s*+=\s*+)("[^"\n]*"|'[^'\n]*'|[^\s,;]++)|([A-Za-z_][\w.\-]*+)"""


def kv_entries(text: Column, prefix: str = "") -> Column:
    """key=value pairs with the places of their values, quotes left out; words that begin no pair are passed as a whole, so the work is linear."""
    pieces = tiles(text, PAIR, "\x02$1\x02$2\x02$3\x02$4\x02")  # gap, key, sign, value, other word; and again
    pair = lambda k, v: let(v["v"].rlike(r"(?s)^([\"']).*\1$") & (F.length(v["v"]) > 1), lambda q: F.struct(
        F.concat(F.lit(prefix), k["v"]).alias("k"), F.when(q, F.substring(v["v"], F.lit(2), F.length(v["v"]) - 2)).otherwise(v["v"]).alias("v"), (v["s"] + q.cast("int")).alias("s"), (v["e"] - q.cast("int")).alias("e"),
    ))
    found = lambda ps: F.filter(F.sequence(F.lit(1), F.size(ps), F.lit(5)), lambda i: (i < F.size(ps)) & (F.coalesce(F.get(ps, i)["v"], F.lit("")) != ""))
    return let(pieces, lambda ps: F.transform(found(ps), lambda i: pair(F.get(ps, i), F.get(ps, i + 2))))


def _kv(text: Column, given: dict) -> Column:
    return let(kv_entries(text, given.get("prefix", "kv") + "."), lambda pairs: F.when(F.size(pairs) > 0, layer_of(pairs)))


def spaced_entries(text: Column, prefix: str) -> Column:
    """key=value pairs whose values run to the next key."""
    pieces = tiles(text, r"(^|[ \t])([\w.]+)(=)", "\x02$1\x02$2\x02$3\x02")  # value before, blank, key, sign; and again
    value = lambda v: F.struct(F.rtrim(v["v"]).alias("v"), v["s"].alias("s"), (v["s"] + F.length(F.rtrim(v["v"]))).alias("e"))
    return let(pieces, lambda ps: F.transform(F.filter(F.sequence(F.lit(2), F.size(ps) + 2, F.lit(4)), lambda i: i < F.size(ps)), lambda i: let(value(F.get(ps, i + 2)), lambda v: entry(F.concat(F.lit(prefix), F.get(ps, i)["v"]), v))))


def _header(kind: str, first: str, names: tuple[str, ...], text_from: str, part: str) -> Callable[[Column, dict], Column]:
    pattern = "(?s)^" + first + rf"(\|)({part})" * (len(names) - 1) + r"(\|)(.*)$"
    n = 2 * len(names) + 2  # mark, value and bar by turns, then the rest

    def layer(text: Column, given: dict) -> Column:
        chosen = names.index(given.get("text_field", text_from))

        def made(t: Column) -> Column:
            head = [entry(f"{kind}.{x}", F.struct(F.regexp_replace(t[2 * i + 1]["v"], r"\\([|\\])", "$1").alias("v"), t[2 * i + 1]["s"].alias("s"), t[2 * i + 1]["e"].alias("e"))) for i, x in enumerate(names)]
            rest = t[n - 1]
            more = F.transform(spaced_entries(rest["v"], f"{kind}."), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"), (x["s"] + rest["s"]).alias("s"), (x["e"] + rest["s"]).alias("e")))
            own = t[2 * chosen + 1]
            plain = F.instr(own["v"], "\\") == 0
            return layer_of(filled(F.concat(F.array(*head), more)), F.regexp_replace(own["v"], r"\\([|\\])", "$1"), F.when(plain, stretch(own)))

        return let(whole_tiles(text, pattern, n), lambda t: F.when(t.isNotNull(), made(t)))

    return layer


def _delimited(text: Column, given: dict) -> Column:
    """Columns by the given names, or col_1, col_2 and so on."""
    by = given.get("delimiter", DELIMITERS[0])
    names = F.array(*[F.lit(n) for n in given["columns"]]) if "columns" in given else F.array().cast("array<string>")
    least = len(given["columns"]) if "columns" in given else 2
    one = lambda v, s, i: F.struct(
        F.concat(F.lit("delimited."), F.coalesce(F.get(names, i), F.concat(F.lit("col_"), i + 1))).alias("k"), F.trim(v).alias("v"), (s + F.length(v) - F.length(F.ltrim(v))).alias("s"), (s + F.length(F.rtrim(v))).alias("e"),
    )
    entries = let(F.split(text, re.escape(by), -1), lambda vs: let(starts(vs, len(by)), lambda st: F.when(F.size(vs) >= least, F.transform(vs, lambda v, i: one(v, st[i], i)))))
    own = lambda es: F.try_element_at(F.filter(es, lambda x: x["k"] == "delimited." + given["text_field"]), F.lit(-1))
    made = lambda es: layer_of(filled(es), own(es)["v"], stretch(own(es))) if "text_field" in given else layer_of(filled(es))
    return let(entries, lambda es: F.when(es.isNotNull(), made(es)))


def flat_groups(pattern: str) -> tuple[str, list[str | None]] | None:
    """A pattern whose named groups lie side by side as one whose groups tile what it matches, with their names; None for other patterns."""
    flags = re.match(r"\(\?[a-zA-Z]+\)", pattern)
    at, depth, out, names, plain = flags.end() if flags else 0, 0, [], [], ""
    own = ""
    while at < len(pattern):
        c = pattern[at]
        step = 1
        if c == "\\":
            step = 2
            if pattern[at + 1 : at + 2] in "123456789k":
                return None
        elif c == "[":
            step = re.match(r"\[\^?\]?(?:\\.|[^\]\\])*\]", pattern[at:]).end()
        elif c == "(":
            named_ = re.match(r"\(\?<([A-Za-z]\w*)>", pattern[at:])
            if named_ and depth:
                return None
            depth += 1
            if named_:
                out.append(f"({plain})")
                names += None, named_[1]
                plain, own, at = "", "(", at + named_.end()
                continue
            if not pattern.startswith("(?", at):
                own, plain = (own + "(?:", plain) if own else (own, plain + "(?:")
                at += 1
                continue
        elif c == ")":
            depth -= 1
            if own and not depth:
                if pattern[at + 1 : at + 2] in tuple("*+?{"):
                    return None
                out.append(own + ")")
                own, at = "", at + 1
                continue
        elif c == "|" and not depth:
            return None
        piece = pattern[at : at + step]
        own, plain = (own + piece, plain) if own else (own, plain + piece)
        at += step
    return (flags[0] if flags else "") + "".join([*out, f"({plain})"]), [*names, None]


def _regex(text: Column, given: dict) -> Column:
    """Named groups (?<name>...) of a pattern that is found anywhere; groups inside others, optional ones and alternatives have no places."""
    pattern = given["pattern"]
    flat = flat_groups(pattern)
    if flat is not None:
        body, names = flat
        flags = re.match(r"(?:\(\?[a-zA-Z]+\))?", body)
        tiled = whole_tiles(text, f"{flags[0]}(?s)^(.*?){body[flags.end():]}(.*)$", len(names) + 2)
        return let(tiled, lambda t: F.when(t.isNotNull(), layer_of(filled(F.array(*[entry(f"regex.{n}", t[i + 1]) for i, n in enumerate(names) if n])))))
    none = F.lit(None).cast("int")
    names = [(m[1], len(re.findall(r"(?<!\\)\((?!\?)|\(\?<[A-Za-z]", pattern[: m.start()])) + 1) for m in re.finditer(r"\(\?<([A-Za-z]\w*)>", pattern)]
    made = [F.struct(F.lit(f"regex.{n}").alias("k"), F.regexp_extract(text, pattern, i).alias("v"), none.alias("s"), none.alias("e")) for n, i in names]
    return F.when(text.rlike(pattern), layer_of(filled(F.array(*made).cast(ENTRIES))))


def _base64(text: Column, given: dict) -> Column:
    """The decoded text, whose parts have no places in the line."""
    raw = F.try_to_binary(F.trim(text), F.lit("base64"))
    size = F.array(F.struct(F.lit("base64.length").alias("k"), F.length(raw).cast("string").alias("v"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e")))
    return F.when(raw.isNotNull() & (F.length(text) > 0), layer_of(size, F.make_valid_utf8(raw.cast("string"))))


LAYERS: dict[str, Callable[[Column, dict], Column]] = {
    "syslog": _syslog, "json": _json, "kv": _kv, "delimited": _delimited, "regex": _regex, "base64": _base64,
    "cef": _header("cef", r"(\s*+CEF:)(\d+)", ("version", "vendor", "product", "device_version", "event_class", "name", "severity"), "name", r"(?:\\.|[^|\\])*+"),
    "leef": _header("leef", r"(\s*+LEEF:)([\d.]+)", ("version", "vendor", "product", "product_version", "event_id"), "event_id", r"[^|]*+"),
}


def register_layer(kind: str, layer: Callable[[Column, dict], tuple[Column, Column]]) -> None:
    """a parser of one's own for peel_by_contract: a column of texts and a contract's parameters to (fields, rest).

    fields is a map of texts, null where the parser doesn't apply; rest is the text for the next layer. Such values have no places.
    """
    if kind in LAYERS:
        raise ValueError(f"layer {kind} is there already")

    def wrapped(text: Column, given: dict) -> Column:
        fields, rest = layer(text, given)
        none = F.lit(None).cast("int")
        entries = F.transform(F.map_entries(fields), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v"), none.alias("s"), none.alias("e")))
        return F.when(fields.isNotNull(), layer_of(filled(entries), rest, F.when(rest == text, F.array(F.struct(F.lit(0), F.lit(0)), F.struct(F.length(text), F.length(text))).cast(CUTS))))

    LAYERS[kind] = wrapped


def named_fields(out: DataFrame, entries: Column, places: Column) -> DataFrame:
    """out with fields and spans, the maps of entries; places has (s, e) of each. Of equal names the last one counts: sorted by name and place in the list, the last of each name stays."""
    out = out.withColumn("__e", held(F.sort_array(F.transform(entries, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v"))))))
    last = F.filter("__e", lambda x, i: F.coalesce(F.get(F.col("__e"), i + 1)["k"] != x["k"], F.lit(True)))
    at = lambda x: F.get(places, x["i"])
    return out.withColumn("__e", held(last)).withColumns({
        "fields": held(F.map_from_entries(F.transform("__e", lambda x: F.struct(x["k"], x["v"])))),
        "spans": held(F.map_from_entries(F.transform(F.filter("__e", lambda x: at(x)["s"].isNotNull()), lambda x: F.struct(x["k"], F.struct(at(x)["s"].alias("start"), at(x)["e"].alias("end")))))),
    }).drop("__e")


def peel_by_contract(lines: DataFrame, contracts: tuple[Contract, ...], contract: str = "contract", line: str = "line", depth: int = MAX_DEPTH) -> DataFrame:
    """Lines with fields and spans (maps of texts and of their (start, end) in the line), text (what the last layer left), offsets (its offset map), parse_path and error.

    A contract's layers are taken in order; an optional one that doesn't apply is skipped, another one ends
    the peeling with the reason, as does the depth. Later layers win a clash of names. Lines of no known
    contract keep their text. Contracts that have the same layer at a step share one branch; each layer's
    result is a column of its own, so nothing is parsed twice. No shuffle.
    """
    text = F.col(line).cast("string")
    size = F.length(text)
    state = {"entries": F.array().cast(ENTRIES), "text": text, "offsets": F.array(F.struct(F.lit(0), F.lit(0)), F.struct(size, size)).cast(CUTS), "path": F.array().cast("array<string>"), "error": F.lit(None).cast("string")}
    out = lines.withColumns({f"__s_{x}": made for x, made in state.items()})
    now = {x: F.col(f"__s_{x}") for x in state}
    for step in range(max((len(c.layers) for c in contracts), default=0)):
        shared: dict[str, tuple[str, dict, dict[bool, list[str]]]] = {}
        for c in (c for c in contracts if step < len(c.layers)):
            kind, given, optional = c.layers[step]
            shared.setdefault(f"{kind} {sorted(given.items())!r}", (kind, given, {}))[2].setdefault(optional, []).append(c.id)
        chain = dict(now)
        for i, (kind, given, users) in enumerate(shared.values()):
            active = F.col(contract).isin([x for ids in users.values() for x in ids]) & now["error"].isNull()
            if step >= depth or kind not in LAYERS:
                chain["error"] = F.when(active, F.lit(f"layer depth over {depth}" if step >= depth else f"unknown envelope layer {kind}")).otherwise(chain["error"])
                continue
            out = out.withColumn(f"__l{i}", held(LAYERS[kind](F.when(active, now["text"]), given)))
            got = F.col(f"__l{i}")
            lined = F.transform(got["entries"], lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"), placed(now["offsets"], x["s"]).alias("s"), placed(now["offsets"], x["e"]).alias("e")))
            taken = {
                "entries": F.concat(now["entries"], lined), "text": F.coalesce(got["text"], now["text"]), "offsets": F.when(got["text"].isNull(), now["offsets"]).otherwise(composed(now["offsets"], got["cuts"])),
                "path": F.concat(now["path"], F.array(F.lit(kind))),
            }
            fits = active & got["entries"].isNotNull()
            chain |= {x: F.when(fits, made).otherwise(chain[x]) for x, made in taken.items()}
            strict = active & got["entries"].isNull() & ~F.col(contract).isin(users.get(True, []))
            chain["error"] = F.when(strict, F.lit(f"layer {kind} doesn't apply")).otherwise(chain["error"])
        out = out.withColumns({f"__s_{x}": held(made) for x, made in chain.items()}).drop(*[f"__l{i}" for i in range(len(shared))])
    return named_fields(out, now["entries"], now["entries"]).withColumns({"text": now["text"], "offsets": now["offsets"], "parse_path": now["path"], "error": now["error"]}).drop(*[f"__s_{x}" for x in state])


# --- without a contract


def _columns(text: Column, given: dict) -> Column:
    """Four columns or more by the delimiter that gives most, the first of ties."""
    tried = [(F.length(text) - F.length(F.replace(text, F.lit(x), F.lit(""))), _delimited(text, {"delimiter": x})) for x in DELIMITERS]
    most = F.greatest(*[n for n, _ in tried])
    return reduce(lambda other, one: F.when((one[0] == most) & (most >= 3), one[1]).otherwise(other), reversed(tried), F.lit(None).cast(LAYER))


def _dense(pairs: Column, text: Column, least: int, share: float) -> Column:
    """Whether so many pairs are there, and so many for each word of the text."""
    return (F.size(pairs) >= least) & (F.size(pairs) >= share * F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1)))


def json_levels(text: str, most: int) -> list[dict]:
    """What json_scan gives of a text, of its longest string if that is JSON too, and so on."""
    levels = []
    while text is not None and len(levels) < most and (got := json_scan(text, longest=True)) is not None:
        levels.append(got)
        text = got["text"]
    return levels


def _json_levels(text: Column, most: int) -> Column:
    @F.arrow_udf(f"array<{LAYER}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [[] if t is None else json_levels(t, most) for t in texts.to_pylist()]
            yield pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), layer_array([x for r in rows for x in r]))

    return scan(F.when(text.rlike(r"^[ \t\n\r]*[\{\[]"), text))


def _with_pairs(scanned: Column) -> Column:
    """A level of JSON with the pairs behind the value as fields too, if they are a tenth of the words there."""
    rest = F.try_element_at(F.filter(scanned["entries"], lambda x: x["k"] == "json.__rest"), F.lit(-1))
    moved = lambda r, pairs: F.transform(pairs, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"), (x["s"] + r["s"]).alias("s"), (x["e"] + r["s"]).alias("e")))
    pairs = let(rest, lambda r: let(kv_entries(r["v"], "kv."), lambda ps: F.when(_dense(ps, r["v"], 1, 0.1), moved(r, ps))))
    return layer_of(F.concat(scanned["entries"], F.coalesce(pairs, F.array().cast(ENTRIES))), scanned["text"], scanned["cuts"])


def peel_auto(lines: DataFrame, line: str = "line", depth: int = MAX_DEPTH, most_chars: int | None = None) -> DataFrame:
    """Lines without a contract, with fields, spans, text, offsets and parse_path, `auto:` and the layers found, by > (auto:text if none).

    A cascade of up to depth layers, each tried on the text that the ones before left: syslog, JSON (its longest string goes on, an
    escaped one too; pairs behind it are fields), CEF (its name goes on) or LEEF (its event id), pairs (two or more, half of the words),
    and, if no more than one was found, columns (four or more). A layer that a text only seems to be is passed over; one that leaves no
    text leaves it as it was. A string that is JSON again is read as such. most_chars: judge pairs and columns by the first ones only.
    """
    size = F.length(F.col(line).cast("string"))
    # a column for each part of the state, so that what isn't asked for isn't made.
    # places come before offsets: in the body of a function Spark takes the new value of a column that stands before it
    state = {
        "places": F.array().cast(PLACES), "entries": F.array().cast(ENTRIES), "text": F.col(line).cast("string"), "offsets": F.array(F.struct(F.lit(0), F.lit(0)), F.struct(size, size)).cast(CUTS), "path": F.array().cast("array<string>"),
    }
    out = lines.withColumns({f"__s_{x}": made for x, made in state.items()})
    now = {x: F.col(f"__s_{x}") for x in state}
    found, levels, pairs, columns, passed = (F.col(f"__{x}") for x in "ljkdn")
    known = F.size(now["path"])
    judged = now["text"] if most_chars is None else F.substring(now["text"], 1, most_chars)
    lined = lambda entries, offsets: F.transform(entries, lambda x: F.struct(placed(offsets, x["s"]).alias("s"), placed(offsets, x["e"]).alias("e")))
    behind = lambda layer, offsets: F.when(layer["text"].isNull(), offsets).otherwise(composed(offsets, layer["cuts"]))
    taken = lambda fits, made: {f"__s_{x}": held(F.when(fits, new).otherwise(now[x])) for x, new in made.items()}

    def header(out: DataFrame, layer: Column, kind: Column) -> DataFrame:
        made = {
            "places": F.concat(now["places"], lined(found["entries"], now["offsets"])), "entries": F.concat(now["entries"], found["entries"]), "text": F.coalesce(found["text"], now["text"]), "offsets": behind(found, now["offsets"]),
            "path": F.concat(now["path"], F.array(kind)),
        }
        return out.withColumn("__l", held(layer)).withColumns(taken(found["entries"].isNotNull(), made)).drop("__l")

    # a layer names its text often, so the text that seems to be of its kind is a column
    seeming = lambda **kinds: {f"__t_{kind}": held(F.when((known < depth) & seems, now["text"])) for kind, seems in kinds.items()}
    read = lambda kind: LAYERS[kind](F.col(f"__t_{kind}"), {})
    out = header(out.withColumns(seeming(syslog=now["text"].rlike(r"^(?:<\d{1,3}>|[A-Z][a-z]{2}\s)"))), read("syslog"), F.lit("syslog")).drop("__t_syslog")

    through = F.aggregate(levels, F.struct(now["offsets"].alias("offsets"), F.array().cast(PLACES).alias("places")), lambda a, x: F.struct(behind(x, a["offsets"]).alias("offsets"), F.concat(a["places"], lined(x["entries"], a["offsets"])).alias("places")))
    texts = F.filter(F.transform(levels, lambda x: x["text"]), lambda t: t.isNotNull())
    made = {
        "places": F.concat(now["places"], through["places"]), "entries": F.concat(now["entries"], F.flatten(F.transform(levels, lambda x: x["entries"]))), "text": F.coalesce(F.try_element_at(texts, F.lit(-1)), now["text"]),
        "offsets": F.aggregate(levels, now["offsets"], lambda a, x: behind(x, a)), "path": F.concat(now["path"], F.transform(levels, lambda x: F.lit("json"))),
    }
    out = out.withColumn("__j", _json_levels(now["text"], depth)).withColumn("__j", held(F.transform(F.slice(levels, F.lit(1), F.greatest(depth - known, F.lit(0))), _with_pairs)))
    out = out.withColumns(taken(F.size(levels) > 0, made)).drop("__j")

    out = out.withColumns(seeming(cef=now["text"].rlike(r"^\s*CEF:\d"), leef=now["text"].rlike(r"^\s*LEEF:[\d.]")))  # a CEF name can't be a LEEF header, as it has no bare bars
    out = header(out, F.coalesce(read("cef"), read("leef")), F.when(F.col("__t_cef").isNotNull(), "cef").otherwise("leef")).drop("__t_cef", "__t_leef")

    near = lambda entries: entries if most_chars is None else F.filter(entries, lambda x: x["s"] < most_chars)
    bars = F.greatest(*[F.length(judged) - F.length(F.replace(judged, F.lit(x), F.lit(""))) for x in DELIMITERS])
    more = (F.get(now["path"], F.lit(0)) == "json") & F.exists(now["entries"], lambda x: x["k"].startswith("kv."))
    out = out.withColumns(seeming(kv=F.contains(judged, F.lit("=")), columns=bars >= 3) | {"__n": held(known + F.coalesce(more, F.lit(False)).cast("int"))})
    out = out.withColumn("__k", held(let(read("kv"), lambda x: F.when(_dense(near(x["entries"]), judged, 2, 0.5), x["entries"]))))
    room = (passed + pairs.isNotNull().cast("int") <= 1) & (known + pairs.isNotNull().cast("int") < depth)
    out = out.withColumn("__d", held(_columns(F.when(room, F.col("__t_columns")), {})["entries"])).drop("__t_kv", "__t_columns", "__n")
    both = lambda one: F.concat(F.when(pairs.isNotNull(), one("kv", pairs)).otherwise(one("", F.array().cast(ENTRIES))), F.when(columns.isNotNull(), one("delimited", columns)).otherwise(one("", F.array().cast(ENTRIES))))
    made = {
        "places": F.concat(now["places"], both(lambda _, entries: lined(entries, now["offsets"]))), "entries": F.concat(now["entries"], both(lambda _, entries: entries)),
        "path": F.concat(now["path"], both(lambda kind, _: F.array(F.lit(kind)) if kind else F.array().cast("array<string>"))),
    }
    out = out.withColumns(taken(pairs.isNotNull() | columns.isNotNull(), made)).drop("__k", "__d")
    path = F.concat(F.lit("auto:"), F.when(known == 0, "text").otherwise(F.array_join(now["path"], ">")))
    return named_fields(out, now["entries"], now["places"]).withColumns({"text": now["text"], "offsets": now["offsets"], "parse_path": path}).drop(*[f"__s_{x}" for x in state])


def path_census(peeled: DataFrame, source: str) -> DataFrame:
    """Of each source how often which parse path is found, and how many fields its lines have on average."""
    return peeled.groupBy(source, "parse_path").agg(F.count("*").alias("n"), F.avg(F.size("fields").cast("double")).alias("fields"))


# --- templates

# What a capture of each type may hold; a quoted one stands between the quotes that the pattern writes.
CAPTURES = {"token": r"\S+", "string": r"\S+", "word": r"[\w.\-]+", "int": r"[+-]?\d+", "ip": r"(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]+)", "rest": r".*", "quoted": r'[^"]*'}


def compile_pattern(pattern: str) -> tuple[str, tuple[str | None, ...]]:
    """The anchored expression of a template's pattern, its groups tiling the text, and the name of each group's capture (None between captures); white space matches any run of it."""
    out, names, at, gap = [], [], 0, ""
    literal = lambda text: re.sub(r"(?:\\?\s)+", r"\\s+", re.escape(text))
    for m in re.finditer(r"<([^<>]*)>", pattern):
        gap += literal(pattern[at : m.start()])
        at = m.end()
        name, _, kind = m[1].partition(":")
        if m[1] == "*":
            gap += r"\S+"
        elif not re.fullmatch(r"[A-Za-z_]\w*", name) or (kind or "token") not in CAPTURES or name in names:
            raise ValueError(f"bad capture <{m[1]}>")
        else:
            names += None, name
            out += f"({gap})", f"({CAPTURES[kind or 'token']})"
            gap = ""
    rest = pattern[at:]
    if "<" in rest:
        raise ValueError("a capture isn't closed")
    return "(?s)^" + "".join([*out, f"({gap}{literal(rest)})"]) + "$", (*names, None)


def expression(template: Template) -> tuple[str, tuple[str | None, ...]]:
    """A template's anchored expression, its groups tiling the text, and their names."""
    if not template.regex:
        return compile_pattern(template.pattern)
    flat = flat_groups(re.sub(r"^\^|(?<!\\)\$$", "", template.regex))
    if flat is None:
        raise ValueError(f"the named groups of {template.name} must lie side by side")
    return f"^{flat[0]}$", tuple(flat[1])


MATCH = f"struct<template: string, class_uid: int, activity_id: int, captures: {ENTRIES}>"


def template_match(text: Column, template: Template) -> Column:
    """A template's captures of a text it matches as a whole, else null."""
    pattern, names = expression(template)
    head = [F.lit(template.name).alias("template"), F.lit(template.class_uid).alias("class_uid"), F.lit(template.activity_id).alias("activity_id")]
    return let(whole_tiles(text, pattern, len(names)), lambda t: F.when(t.isNotNull(), F.struct(*head, F.array(*[entry(n, t[i]) for i, n in enumerate(names) if n]).cast(ENTRIES).alias("captures")))).cast(MATCH)


def extract_by_template(peeled: DataFrame, contracts: tuple[Contract, ...], contract: str = "contract", text: str = "text") -> DataFrame:
    """The first template of a row's contract that matches its whole text: template, class_uid, activity_id, captures (a map) and capture_spans, their places in the line; null where none does."""
    chain = F.lit(None).cast(MATCH)
    for c in contracts:
        own = [template_match(F.col(text), t) for t in c.templates]
        if own:
            chain = F.when(F.col(contract) == c.id, F.coalesce(*own)).otherwise(chain)
    out = peeled.withColumn("__m", held(chain))
    found = F.transform("__m.captures", lambda x: F.struct(x["k"], F.struct(placed(F.col("offsets"), x["s"]).alias("start"), placed(F.col("offsets"), x["e"]).alias("end"))))
    return out.withColumns({
        "template": F.col("__m.template"), "class_uid": F.col("__m.class_uid"), "activity_id": F.col("__m.activity_id"), "captures": held(F.map_from_entries(F.transform("__m.captures", lambda x: F.struct(x["k"], x["v"])))),
        "capture_spans": held(F.map_from_entries(F.filter(found, lambda x: x["col2"]["start"].isNotNull()))),
    }).drop("__m")


# --- mapping


def coerced(value: Column, to: str) -> Column:
    """The canonical text of a value of this type, null if it isn't one."""
    if to == "int":
        return F.trim(value).try_cast("bigint").cast("string")
    if to == "ip":
        four = lambda v: v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~F.exists(F.split(v, r"\."), lambda x: x.try_cast("int") > 255)
        plain = lambda v: F.array_join(F.transform(F.split(v, r"\."), lambda x: x.try_cast("int").cast("string")), ".")
        tail = F.substring_index(value, ":", -1)
        head = F.when(F.instr(tail, ".") > 0, F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(tail)), F.lit("0:0"))).otherwise(value)
        groups = F.size(F.filter(F.split(head, ":"), lambda x: x != ""))
        six = head.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$") & ~head.rlike(r":::|::.*::|[0-9A-Fa-f]{5}|^:[^:]|[^:]:$") & F.when(F.instr(head, "::") > 0, groups < 8).otherwise(groups == 8)
        return F.when(four(value), plain(value)).when(six & ((F.instr(tail, ".") == 0) | four(tail)), F.lower(value))
    return value


ROW = "struct<i: int, path: string, value: string, label: string, used: string, bad: boolean, lost: boolean>"
PLACE = "struct<s: int, e: int>"


def map_rows(matched: DataFrame, contracts: tuple[Contract, ...], contract: str = "contract", line: str = "line", text: str = "text", received: str | None = None) -> DataFrame:
    """Values (path to text), located (path to its byte span in the line), derived (path to what made it), used, unresolved, missing and coercion_errors (arrays).

    A value is located if the bytes at its span are the value, else derived: consts, words of a vocabulary,
    times, and such as were unescaped, changed by their type or decoded. unresolved are paths whose rows
    find nothing, missing a template's required paths without a value, used the captures and fields that
    gave a value. Of several rows for a path the first that gives a value counts. Times without a zone are the
    contract's; those without a year need `received`, the column of arrivals.
    """
    # places are a column of their own and no step nests what it can read: what a query doesn't ask for is pruned, and only short lambdas aren't compiled
    rows, places, need = F.array().cast(f"array<{ROW}>"), F.array().cast(f"array<{PLACE}>"), F.array().cast("array<string>")
    captures, fields, none = F.col("captures"), F.col("fields"), F.lit(None).cast("int")
    arrived = F.lit(None).cast("timestamp") if received is None else F.col(received)
    for c in contracts:
        made, at = [], []
        for i, r in enumerate(c.rows):
            captured, known = captures[r.ref], fields[r.ref]
            label, used = F.lit(r.kind if not r.ref or r.kind == "const" else f"{r.kind}:{r.ref}"), F.lit(None).cast("string")
            s = e = none
            if r.kind == "capture":
                raw, used, span = captured, F.lit(f"capture:{r.ref}"), F.col("capture_spans")[r.ref]
            elif r.kind == "field":
                raw, used, span = known, F.lit(f"field:{r.ref}"), F.col("spans")[r.ref]
            elif r.kind == "text":
                raw, span = F.col(text), F.struct(placed(F.col("offsets"), F.lit(0)).alias("start"), placed(F.col("offsets"), F.length(text)).alias("end"))
            elif r.kind in ("vocab", "ts"):
                raw, span, used = F.coalesce(captured, known), None, F.when(captured.isNotNull(), F.lit(f"capture:{r.ref}")).otherwise(F.lit(f"field:{r.ref}"))
            elif r.kind == "const":
                raw, span = F.lit(r.ref), None
            else:
                raise ValueError(f"unknown kind {r.kind}")
            if span is not None:
                s, e = span["start"], span["end"]
            value = raw
            if r.kind == "vocab":
                value = reduce(lambda other, kv: F.when(F.lower(raw) == kv[0].lower(), F.lit(kv[1])).otherwise(other), reversed(r.words), F.lit(None).cast("string"))  # noqa: B023
            elif r.kind == "ts":
                found = time_of(raw, arrived, F.lit(c.tz), c.formats)
                value, label = F.unix_millis(found["at"]).cast("string"), F.concat(F.lit("ts:"), F.coalesce(found["format"], F.lit("")))
            typed = coerced(value, r.to)
            here = F.col("template").isNotNull() if r.template is None else F.col("template") == r.template
            bad = value.isNotNull() & (value != "") & typed.isNull()
            at.append(F.struct(s.alias("s"), e.alias("e")))
            one = F.struct(F.lit(i).alias("i"), F.lit(r.path).alias("path"), typed.alias("value"), label.alias("label"), used.alias("used"), bad.alias("bad"), (F.coalesce(value, F.lit("")) == "").alias("lost")).cast(ROW)
            made.append(F.when(F.coalesce(here, F.lit(False)), one))
        own = F.col(contract) == c.id
        if made:
            rows = F.when(own, F.array(*made)).otherwise(rows)
            places = F.when(own, F.array(*at)).otherwise(places)
        for t in (t for t in c.templates if t.required):
            need = F.when(own & (F.col("template") == t.name), F.array(*[F.lit(x) for x in t.required])).otherwise(need)
    out = matched.withColumns({"__a": held(rows), "__at": held(places), "__need": held(need)}).withColumn("__r", held(F.array_compact("__a")))
    good = F.filter("__r", lambda x: x["value"].isNotNull() & (x["value"] != ""))
    out = out.withColumn("__g", held(good))
    out = out.withColumn("__v", held(F.filter("__g", lambda x, i: ~F.exists(F.slice(F.col("__g"), F.lit(1), i), lambda y: y["path"] == x["path"]))))
    bytes_to = lambda at: F.octet_length(F.substring(F.col(line), F.lit(1), at))
    span = lambda x, at: F.when(F.substring(F.col(line), at["s"] + 1, at["e"] - at["s"]) == x["value"], F.struct(bytes_to(at["s"]).alias("start"), bytes_to(at["e"]).alias("end")))
    spanned = F.transform("__v", lambda x: F.struct(x["path"].alias("path"), x["label"].alias("label"), let(F.get(F.col("__at"), x["i"]), lambda at: span(x, at)).alias("span")))
    out = out.withColumn("__p", held(spanned))
    paths = lambda keep: F.sort_array(F.array_distinct(F.transform(F.filter("__r", keep), lambda x: x["path"])))
    return out.withColumns({name: held(made) for name, made in {
        "values": F.map_from_entries(F.transform("__v", lambda x: F.struct(x["path"], x["value"]))),
        "located": F.map_from_entries(F.transform(F.filter("__p", lambda x: x["span"].isNotNull()), lambda x: F.struct(x["path"], x["span"]))),
        "derived": F.map_from_entries(F.transform(F.filter("__p", lambda x: x["span"].isNull()), lambda x: F.struct(x["path"], x["label"]))),
        "used": F.array_distinct(F.array_compact(F.transform("__g", lambda x: x["used"]))),
        "unresolved": F.array_except(paths(lambda x: x["lost"]), F.transform("__v", lambda x: x["path"])),
        "coercion_errors": paths(lambda x: x["bad"]),
        "missing": F.filter("__need", lambda p: ~F.exists("__v", lambda x: x["path"] == p)),
    }.items()}).drop("__a", "__at", "__r", "__g", "__v", "__p", "__need")


def provenance_check(mapped: DataFrame, key: str, line: str = "line") -> DataFrame:
    """One row per claim (key, path, ok, reason): the bytes at a located path's span are its value, and every value is located or derived.

    Works on map_rows' output or any table with values, located and derived; spans are of bytes. A line is read as UTF-8.
    """
    raw = F.col(line).cast("binary")
    claims = mapped.select(key, raw.alias("__raw"), "located", "derived", F.explode("values").alias("path", "value"))
    span = F.try_element_at("located", "path")
    inside = (span["start"] >= 0) & (span["start"] <= span["end"]) & (span["end"] <= F.length("__raw"))
    cut = F.substring(F.col("__raw"), span["start"] + 1, span["end"] - span["start"])
    reason = (
        F.when(span.isNull(), F.when(~F.map_contains_key("derived", F.col("path")), "neither located nor derived")).when(~F.coalesce(inside, F.lit(False)), "span outside the line")
        .when(cut != F.col("value").cast("binary"), "span cuts another value")
    )
    return claims.select(key, "path", reason.isNull().alias("ok"), reason.alias("reason"))


def observables(events: DataFrame, key: str, values: str = "values") -> DataFrame:
    """ip_1, ip_2 ... by sorted path, one user and host_1 ... of a map of paths, with the path each comes from."""
    pairs = F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value"))))
    of = lambda pattern: F.filter(pairs, lambda e: e["path"].rlike(pattern))
    numbered = lambda base, rows: F.transform(rows, lambda e, i: F.struct(F.concat(F.lit(f"{base}_"), i + 1).alias("name"), e["value"].alias("value"), F.concat(F.lit("from:"), e["path"]).alias("label")))
    user = F.transform(F.slice(of(r"(^|\.)user\.name$"), 1, 1), lambda e: F.struct(F.lit("user").alias("name"), e["value"].alias("value"), F.concat(F.lit("from:"), e["path"]).alias("label")))
    return events.select(key, F.inline(F.concat(numbered("ip", of(r"\.ip$")), user, numbered("host", of(r"hostname$")))))


CONTRACTS = (
    Contract(
        "auth", (("syslog", {}, False),),
        (Template("failed", "user=<who:word> FAILED login from <from_ip:ip> via <gate:ip> attempts:<tries:int>", 3002, ("user.name", "src_endpoint.ip", "time"), 1), Template("other", "user=<who:word> <word> login <*> <tail:rest>", 3002, ("user.name",), 1)),
        (MapRow("user.name", "capture", "who"), MapRow("src_endpoint.ip", "capture", "from_ip", "ip", "failed"), MapRow("unmapped.attempts", "capture", "tries", "int", "failed"), MapRow("status_id", "const", "2", "int", "failed"),
         MapRow("status_id", "vocab", "word", "int", "other", (("ok", "1"), ("failed", "2"))), MapRow("device.hostname", "field", "syslog.host"), MapRow("message", "text")),
    ),
    Contract(
        "gate", (("syslog", {}, True), ("json", {"text_field": "msg"}, False), ("kv", {}, True)),
        (Template("json", 'say "<word:quoted>" action=<action:word> port=<port:int>', 4001, ("dst_endpoint.port", "time"), 6),),
        (MapRow("dst_endpoint.port", "capture", "port", "int"), MapRow("device.hostname", "field", "json.host"), MapRow("status_id", "vocab", "action", "int", None, (("allow", "1"), ("deny", "7"))), MapRow("src_endpoint.ip", "field", "json.ip", "ip"),
         MapRow("user.name", "capture", "word"), MapRow("unmapped.n", "field", "json.n[0].p"), MapRow("time", "ts", "json.at")),
        "Asia/Kolkata",
    ),
    Contract("deep", (("syslog", {}, False), ("kv", {}, True), ("kv", {}, True), ("kv", {}, True), ("kv", {}, True))),
)
#: What lies where in SENT, by event_id % 7: JSON under contract gate, four kv layers, no contract, no syslog header, the log's own line, no line, and broken JSON.
OF = "case event_id % 7 when 0 then 'gate' when 6 then 'gate' when 1 then 'deep' when 2 then 'nobody' else 'auth' end as contract"
SENT = """case event_id % 7
 when 0 then concat('{"host":"h', user_id, '","é":"ü","ip":"', case when event_id % 3 = 0 then '300.1.1.1' else '10.0.0.1' end, '","at":"2026-01-02 03:04:05","n":[{"p":', event_id % 10, '}],"msg":"say ', chr(92), '"hé ', user_id, chr(92), '" action=',
  case when event_id % 2 = 0 then 'deny' else 'allow' end, ' port=', event_id % 1000, '"} tail')
 when 3 then concat('plain ', event_id) when 5 then null when 6 then '{"host":' else line end as line"""


def sent(s: SparkSession, d: str) -> DataFrame:
    return log_view(s, d).selectExpr("event_uid", "event_id", "received_time", OF, SENT)


def _peeled(s: SparkSession, d: str) -> DataFrame:
    return peel_by_contract(sent(s, d), CONTRACTS)


def _mapped(s: SparkSession, d: str) -> DataFrame:
    return map_rows(extract_by_template(_peeled(s, d), CONTRACTS), CONTRACTS, received="received_time")


def _bracketed(text: Column, given: dict) -> tuple[Column, Column]:
    """A parser of one's own: [name] before the text."""
    hit = text.rlike(r"^\[\w+\] ")
    return F.when(hit, F.create_map(F.lit("bracket.name"), F.regexp_extract(text, r"^\[(\w+)\] ", 1))), F.regexp_replace(text, r"^\[\w+\] ", "")


def own_layer(s: SparkSession, d: str) -> DataFrame:
    """lines that begin with a bracketed name, read by a registered parser before the key-value layer."""
    if "bracketed" not in LAYERS:
        register_layer("bracketed", _bracketed)
    lines = log_view(s, d).selectExpr("event_uid", "'own' as contract", "concat(case when event_id % 3 = 0 then '' else '[app] ' end, 'user=u', user_id, ' n=', event_id) as line")
    got = peel_by_contract(lines, (Contract("own", (("bracketed", {}, False), ("kv", {}, False))),))
    return got.select("event_uid", "error", F.col("fields")["bracket.name"].alias("name"), F.col("fields")["kv.n"].alias("n"), F.map_contains_key("spans", F.lit("kv.n")).alias("located"))


#: Lines of no contract: JSON in syslog with pairs behind it, JSON whose text holds pairs, CEF in syslog, LEEF, pairs, columns, plain text and none.
UNKNOWN = """case event_id % 8 when 0 then concat('<13>Jan 01 00:00:00 h', user_id, ' app: {"id":', event_id, ',"note":"all is well here","s":"x"} a=1 b=', event_id) when 1 then concat('{"n":[1,2],"msg":"user=u', user_id, ' act=deny n=', event_id, '"}')
 when 2 then concat('<13>Jan 01 00:00:00 h1 CEF:0|acme|ngfw|1|', event_id, '|login|5|src=10.0.0.1 msg=x y') when 3 then concat('LEEF:1.0|acme|fw|1|e', event_id, '|usr=u', user_id) when 4 then concat('user=u', user_id, ' n=', event_id) when 5 then concat(event_id, '; a ;', user_id, ';z')
 when 6 then concat('just some text ', event_id) else null end as line"""


def _auto(s: SparkSession, d: str) -> DataFrame:
    return peel_auto(log_view(s, d).selectExpr("event_uid", "source_id", UNKNOWN))


_PATHS = ("user.name", "src_endpoint.ip", "dst_endpoint.port", "status_id", "time", "unmapped.n", "device.hostname")
_LOCATED = ("user.name", "src_endpoint.ip", "dst_endpoint.port", "unmapped.n", "device.hostname", "message")
QUERIES = {
    "peel_by_contract": lambda s, d: _peeled(s, d).select("event_uid", F.array_join("parse_path", ">").alias("parse_path"), "error", F.size("fields").alias("n_fields"), F.coalesce(F.col("fields")["syslog.host"], F.col("fields")["json.host"]).alias("host"), "text",
        *[F.col("spans")[k][e].alias(f"{n}_{e}") for k, n in (("syslog.host", "host"), ("kv.port", "port"), ("json.__rest", "rest")) for e in ("start", "end")]),
    "extract_by_template": lambda s, d: extract_by_template(_peeled(s, d), CONTRACTS).select("event_uid", "template", "class_uid", F.col("captures")["who"].alias("who"), F.col("captures")["port"].alias("port"), F.col("captures")["word"].alias("word"), F.col("capture_spans")["word"]["start"].alias("word_start"), F.col("capture_spans")["tail"]["start"].alias("tail_start")),
    "map_rows": lambda s, d: _mapped(s, d).select(
        "event_uid", *[F.col("values")[p].alias(p.replace(".", "_")) for p in _PATHS], F.array_join(F.array_sort(F.map_keys("derived")), ",").alias("derived"), *[F.array_join(c, ",").alias(c) for c in ("unresolved", "missing", "coercion_errors")],
        *[F.col("located")[p][e].alias(f"{p.replace('.', '_')}_{e}") for p in _LOCATED for e in ("start", "end")],
    ),
    "provenance_check": lambda s, d: provenance_check(_mapped(s, d).withColumn("located", F.expr("case when event_id % 161 = 4 then map('user.name', struct(1 as start, 3 as end)) when event_id % 161 = 7 then map_filter(located, (k, v) -> k <> 'user.name') else located end")), "event_uid").groupBy("path", "ok", "reason").agg(F.count("*").alias("n")),
    "contract_observables": lambda s, d: observables(_mapped(s, d), "event_uid"),
    "own_layer": own_layer,
    "peel_auto": lambda s, d: _auto(s, d).select("event_uid", "parse_path", "text", F.size("fields").alias("n_fields"), *[F.col("fields")[k].alias(n) for n, k in (("b", "kv.b"), ("kv_n", "kv.n"), ("src", "cef.src"), ("usr", "leef.usr"), ("col", "delimited.col_2"))], *[F.col("spans")["kv.n"][e].alias(f"n_{e}") for e in ("start", "end")]),
    "path_census": lambda s, d: path_census(_auto(s, d), "source_id"),
}

_U = f"""{LOG}, u as (select event_uid, event_id, user_id, source_id, {UNKNOWN}, event_id % 8 as k, case event_id % 8 when 0 then 'auto:syslog>json' when 1 then 'auto:json>kv' when 2 then 'auto:syslog>cef' when 3 then 'auto:leef' when 4 then 'auto:kv' when 5 then 'auto:delimited' else 'auto:text' end as parse_path,
 (case event_id % 8 when 0 then 12 when 1 then 6 when 2 then 14 when 3 then 6 when 4 then 2 when 5 then 4 else 0 end)::int as n_fields from log)"""
#: Common table expressions: q with the sent lines, m with the template t of each.
LINES_SQL = f"""{LOG}, q as (select * exclude (line, contract_ref), line as logged, {OF}, {SENT}, event_id % 7 as k, event_id % 4 = 2 as failed, regexp_extract(line, '^<[0-9]+>.{{15}} [^ ]+ app.[0-9]+.: (.*)$', 1) as body from log),
 m as (select *, case when k = 0 then 'json' when k = 4 then case when failed then 'failed' else 'other' end end as t, concat('10.0.', user_id % 256, '.', event_id % 256) as src from q)"""
_AT = lambda what: f"strlen(left(line, instr(line, {what}) - 1))"
_SPAN = lambda name, when, lead, value: f"case when {when} then ({_AT(lead)} + strlen({lead}))::int end as {name}_start, case when {when} then ({_AT(lead)} + strlen({lead}) + strlen({value}))::int end as {name}_end"
_CHARS = lambda lead: f"instr(line, {lead}) - 1 + length({lead})"
_HOST = "case when k in (1, 4) then concat('host-', user_id % 20) when k = 0 then concat('h', user_id) end"
_CLAIMS = f"""select event_uid, event_id, unnest(case t when 'json' then ['dst_endpoint.port', 'device.hostname', 'status_id', 'user.name', 'unmapped.n', 'time'] when 'failed' then ['user.name', 'src_endpoint.ip', 'unmapped.attempts', 'status_id', 'device.hostname', 'message']
 when 'other' then ['user.name', 'status_id', 'device.hostname', 'message'] else [] end) as path from m union all select event_uid, event_id, 'src_endpoint.ip' from m where t = 'json' and event_id % 3 <> 0"""
ORACLES = {
    "peel_by_contract": f"""{LINES_SQL} select event_uid, case k when 0 then 'json>kv' when 1 then 'syslog>kv>kv>kv' when 4 then 'syslog' else '' end as parse_path, case k when 1 then 'layer depth over 4' when 3 then 'layer syslog doesn''t apply' when 5 then 'layer syslog doesn''t apply' when 6 then 'layer json doesn''t apply' end as error,
 (case k when 0 then 9 when 1 then 8 when 4 then 7 else 0 end)::int as n_fields, {_HOST} as host,
 case when k = 0 then concat('say "hé ', user_id, '" action=', case when event_id % 2 = 0 then 'deny' else 'allow' end, ' port=', event_id % 1000) when k in (1, 4) then body else line end as text,
 case when k in (1, 4) then ({_CHARS("'00:00:00 '")})::int end as host_start, case when k in (1, 4) then ({_CHARS("'00:00:00 '")} + length(concat('host-', user_id % 20)))::int end as host_end,
 case when k = 0 then ({_CHARS("' port='")})::int end as port_start, case when k = 0 then ({_CHARS("' port='")} + length((event_id % 1000)::varchar))::int end as port_end,
 case when k = 0 then (length(line) - 4)::int end as rest_start, case when k = 0 then length(line)::int end as rest_end from q""",
    "extract_by_template": f"""{LINES_SQL} select event_uid, t as template, (case when t = 'json' then 4001 when t is not null then 3002 end)::int as class_uid, case when k = 4 then concat('u', user_id) end as who, case when k = 0 then (event_id % 1000)::varchar end as port,
 case when k = 0 then concat('hé ', user_id) when t = 'other' then 'OK' end as word, (case when k = 0 then {_CHARS("concat('say ', chr(92), '\"')")} when t = 'other' then {_CHARS("concat('user=u', user_id, ' ')")} end)::int as word_start, (case when t = 'other' then {_CHARS("'login from '")} end)::int as tail_start from m""",
    "map_rows": f"""{LINES_SQL} select event_uid, case when k = 4 then concat('u', user_id) when k = 0 then concat('hé ', user_id) end as user_name, case when t = 'failed' then src when k = 0 and event_id % 3 <> 0 then '10.0.0.1' end as src_endpoint_ip,
 case when k = 0 then (event_id % 1000)::varchar end as dst_endpoint_port, case t when 'failed' then '2' when 'other' then '1' when 'json' then case when event_id % 2 = 0 then '7' else '1' end end as status_id,
 case when k = 0 then ((epoch(timestamp '2026-01-02 03:04:05')::bigint - 19800) * 1000)::varchar end as time, case when k = 0 then (event_id % 10)::varchar end as unmapped_n, case when k = 1 then null else {_HOST} end as device_hostname,
 case when t is null then '' when k = 0 then 'status_id,time' else 'status_id' end as derived, '' as unresolved, case t when 'failed' then 'time' else '' end as missing, case when k = 0 and event_id % 3 = 0 then 'src_endpoint.ip' else '' end as coercion_errors,
 {_SPAN("user_name", "k in (0, 4)", "case when k = 4 then ': user=' else concat('say ', chr(92), '\"') end", "case when k = 4 then concat('u', user_id) else concat('hé ', user_id) end")},
 {_SPAN("src_endpoint_ip", "t = 'failed' or (k = 0 and event_id % 3 <> 0)", "case when k = 4 then 'login from ' else '\"ip\":\"' end", "case when k = 4 then src else '10.0.0.1' end")},
 {_SPAN("dst_endpoint_port", "k = 0", "' port='", "(event_id % 1000)::varchar")}, {_SPAN("unmapped_n", "k = 0", "'\"p\":'", "(event_id % 10)::varchar")},
 {_SPAN("device_hostname", "k in (0, 4)", "case when k = 4 then '00:00:00 ' else '\"host\":\"' end", _HOST)}, {_SPAN("message", "k = 4", "concat('app[', event_id, ']: ')", "body")} from m""",
    "provenance_check": f"""{LINES_SQL}, c as ({_CLAIMS}), r as (select path, case when path = 'user.name' and event_id % 161 = 4 then 'span cuts another value' when path = 'user.name' and event_id % 161 = 7 then 'neither located nor derived'
 when event_id % 161 = 4 and path in ('src_endpoint.ip', 'unmapped.attempts', 'device.hostname', 'message') then 'neither located nor derived' end as reason from c) select path, reason is null as ok, reason, count(*) as n from r group by all""",
    "contract_observables": f"""{LINES_SQL} select event_uid, 'ip_1' as name, case when k = 0 then '10.0.0.1' else src end as value, 'from:src_endpoint.ip' as label from m where t = 'failed' or (k = 0 and event_id % 3 <> 0)
 union all select event_uid, 'user', case when k = 4 then concat('u', user_id) else concat('hé ', user_id) end, 'from:user.name' from m where k in (0, 4) union all select event_uid, 'host_1', {_HOST}, 'from:device.hostname' from m where k in (0, 4)""",
    "peel_auto": f"""{_U} select event_uid, parse_path, n_fields, case k when 0 then 'all is well here' when 1 then concat('user=u', user_id, ' act=deny n=', event_id) when 2 then 'login' when 3 then concat('e', event_id) else line end as text, case when k = 0 then event_id::varchar end as b,
 case when k in (1, 4) then event_id::varchar end as kv_n, case when k = 2 then '10.0.0.1' end as src, case when k = 3 then concat('u', user_id) end as usr, case when k = 5 then 'a' end as col,
 (case when k in (1, 4) then instr(line, ' n=') + 2 end)::int as n_start, (case when k in (1, 4) then instr(line, ' n=') + 2 + length(event_id::varchar) end)::int as n_end from u""",
    "path_census": f"{_U} select source_id, parse_path, count(*) as n, avg(n_fields)::double as fields from u group by 1, 2",
    "own_layer": f"""{LOG} select event_uid, case when event_id % 3 = 0 then 'layer bracketed doesn''t apply' end as error, case when event_id % 3 <> 0 then 'app' end as name, case when event_id % 3 <> 0 then event_id::varchar end as n, false as located from log""",
}
