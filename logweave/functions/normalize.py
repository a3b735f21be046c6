"""Normalization jobs over line tables with built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.bindings import LOG, log_view
from logweave.session import table

# The header layouts of the two syslog RFCs.
RFC5424 = r"(?s)^<(\d{1,3})>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+((?:\[[^\]]*\])+|-)\s?(.*)$"
RFC3164 = r"(?s)^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s+\d{1,2}\s+\d{1,2}:\d{2}:\d{2})\s+(\S+)\s+(?:(?!(?:CEF|LEEF):\d)([^\s\[:]+)(?:\[(\d+)\])?:\s*)?(.*)$"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
EMAIL = r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"  # ends with letters, so a full stop behind it isn't part of it
DELIMITERS = (";", "|", "\t", ",")
# Key names and words that the rules look for.
USER_KEYS = ("user", "username", "usr", "account", "acct", "login", "uid", "userid")
SECRET_KEYS = ("pass", "passwd", "password", "pwd", "token", "secret", "apikey", "api_key", "key", "session", "sessionid", "cookie", "auth", "authorization", "credential", "signature")
NOT_USERS = ("invalid", "user", "password", "uid", "unknown", "root@", "authentication", "from")
WORST_WORDS = ("critical", "alert", "panic", "fatal")
BAD_WORDS = ("fail", "failed", "failure", "error", "denied", "deny", "blocked", "refused")
AUTH_WORDS = ("login", "logon", "logoff", "auth", "authentication", "password", "ssh", "sudo", "su", "kerberos")
NETWORK_WORDS = ("allow", "allowed", "deny", "denied", "drop", "dropped", "accept", "accepted", "block", "blocked", "traffic", "firewall")
PROCESS_WORDS = ("exec", "execve", "spawn", "pid", "process", "command", "cmdline")
VALUE = r"""("[^"\n]*"|'[^'\n]*'|[^\s,;]+)"""


def any_word(words: tuple[str, ...]) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b"

def groups(text: str | Column, pattern: str, n: int) -> Column:
    """All n groups of a pattern that matches a whole text, by one pass; null where it doesn't match. The last one may hold anything."""
    text = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(text, pattern, "\x01" + "\x02".join(f"${i}" for i in range(1, n + 1)))
    return F.when(marked.startswith("\x01") & ~text.startswith("\x01"), F.split(F.substring(marked, 2, 2147483647), "\x02", n))


def syslog_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """Header fields of RFC 5424 lines, else of RFC 3164 ones, with or without a priority; fields a header lacks are null.

    A CEF or LEEF tag is payload, not an app; bodies of several lines stay whole. Other lines are `none`,
    `rejected`, with the whole text as body.
    """
    parts = lines.withColumn("__new", groups(line, RFC5424, 9)).withColumn("__old", F.when(F.col("__new").isNull(), groups(line, RFC3164, 6)))
    new, old = F.col("__new"), F.col("__old")
    pick = lambda a, b: F.nullif(F.coalesce(new[a] if a is not None else None, old[b] if b is not None else None), F.lit(""))
    only = lambda a: F.nullif(new[a], F.lit("-"))
    pri = pick(0, 0).try_cast("int")
    return parts.withColumns({
        "variant": F.when(new.isNotNull(), "rfc5424").when(old.isNotNull(), "rfc3164").otherwise("none"), "rejected": new.isNull() & old.isNull(),
        "pri": pri, "facility": F.floor(pri / 8).cast("int"), "severity": pri % 8, "version": only(1), "timestamp": F.coalesce(only(2), old[1]), "host": F.coalesce(only(3), old[2]),
        "app": F.coalesce(only(4), F.nullif(old[3], F.lit(""))), "pid": F.coalesce(only(5), F.nullif(old[4], F.lit(""))), "msgid": only(6), "sd": only(7), "body": F.coalesce(new[8], old[5], F.col(line)),
    }).drop("__new", "__old")


def kv_pairs(text: str | Column, most: int | None = None) -> Column:
    """Array of (k, v) of all key=value pairs, quotes around values dropped; `most`: only the first ones."""
    pattern = F.lit(r"([A-Za-z_][\w.\-]*)\s*=\s*" + VALUE)
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("v"))
    pairs = F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), F.regexp_replace(p["v"], r"^([\"'])(.*)\1$", "$2").alias("v")))
    return pairs if most is None else F.slice(pairs, 1, most)


def kv_fields(lines: DataFrame, key: str, line: str, most: int | None = None) -> DataFrame:
    """One row per key=value pair; quotes around values are dropped. `most` limits the pairs of a line, `truncated` says so."""
    pairs = kv_pairs(line, most)
    cut = F.lit(False) if most is None else F.size(kv_pairs(line)) > most
    return lines.select(key, cut.alias("truncated"), F.posexplode(pairs).alias("ord", "kv")).select(key, "ord", F.col("kv.k").alias("name"), F.col("kv.v").alias("value"), "truncated")


def kv_census(lines: DataFrame, source: str, line: str) -> DataFrame:
    """Of each source how often each key comes and how many different values it has."""
    pairs = lines.select(source, F.explode(kv_pairs(line)).alias("p"))
    return pairs.groupBy(source, F.col("p.k").alias("name")).agg(F.count("*").alias("n"), F.count_distinct("p.v").alias("values"))


def kv_density(line: str | Column) -> Column:
    """Pairs per word; text is taken for key=value from two pairs and one half on."""
    return F.size(kv_pairs(line)) / F.size(F.split(F.trim(line), r"\s+"))


def json_end(text: str | Column) -> Column:
    """Where the first JSON object or array of a text ends (characters), null if none begins it or it isn't closed.

    The text is cut at strings and brackets; a running depth over the pieces, kept in a struct of numbers, finds
    the bracket that closes the first one, so the work is linear. `depth` is the deepest nesting up to there.
    """
    text = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(F.translate(text, "\x02", " "), r'("(?:[^"\\]|\\.)*+")|([\[\]{}])', "\x02$1$2\x02")
    pieces = F.split(F.when(text.rlike(r"^[ \t\n\r]*[\{\[]"), marked), "\x02", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("most"), F.lit(None).cast("int").alias("end"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.isin("{", "["), 1).when(piece.isin("}", "]"), -1).otherwise(0)
        at = state["at"] + F.length(piece)
        closed = (depth == 0) & piece.isin("}", "]")
        return F.when(state["end"].isNotNull(), state).otherwise(F.struct(at.alias("at"), depth.alias("depth"), F.greatest(state["most"], depth).alias("most"), F.when(closed, at).alias("end")))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["end"].isNotNull(), F.struct(s["end"].alias("end"), s["most"].alias("depth"))))


def json_values(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Key, value (a VARIANT of the first JSON object or array), rest (what stands behind it) and rejected.

    Texts that begin with neither, are broken, aren't closed or repeat a key in an object are rejected; null is too.
    """
    found = rows.select(key, F.col(column).cast("string").alias("__text")).withColumn("__end", json_end("__text"))
    value = F.try_parse_json(F.substring(F.col("__text"), F.lit(1), F.col("__end.end")))
    out = found.select(key, value.alias("value"), F.nullif(F.trim(F.expr("substring(__text, __end.`end` + 1)")), F.lit("")).alias("rest"), F.col("__end.depth").alias("depth"))
    return out.withColumn("rejected", F.col("value").isNull()).withColumn("rest", F.when(F.col("value").isNotNull(), F.col("rest")))


# How the kinds of scalars are named.
JSON_TYPES = {"STRING": "string", "BOOLEAN": "bool", "VOID": "null", "BIGINT": "int", "DOUBLE": "float"}


def json_fields(rows: DataFrame, key: str, column: str, levels: int = 64) -> DataFrame:
    """One row per scalar of the first JSON value: path such as `a.b[0].c`, value and type (string, int, float, bool, null).

    The value is walked level by level, as deep as the deepest text goes; a level is a generator, so nothing is
    shuffled. What lies below `levels` comes as its JSON text, of type `json`, so that one odd text doesn't make the
    plan long. Empty objects and arrays give no rows, nor do rejected texts (see json_values).
    """
    values = json_values(rows, key, column).where(~F.col("rejected"))
    deepest = values.agg(F.max("depth")).first()[0] or 0
    out = values.select(F.col(key).alias("__id"), F.col("value").alias("__v"), F.lit("").alias("path"))
    for _ in range(min(deepest, levels)):
        walked = out.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("__v").outer()))
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.when(F.col("path") != "", ".").otherwise(""), "key"))
        leaf = F.col("pos").isNull()
        out = walked.select("__id", F.when(leaf, F.col("__v")).otherwise(F.col("value")).alias("__v"), F.when(leaf, F.col("path")).otherwise(F.concat("path", name)).alias("path"))
    kind = F.schema_of_variant("__v")
    named = F.create_map(*[F.lit(x) for pair in JSON_TYPES.items() for x in pair])[kind]
    number = F.when(kind.startswith("DECIMAL"), F.when(kind.endswith(",0)"), "int").otherwise("float"))
    text = F.when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json("__v")).otherwise(F.variant_get("__v", "$", "string"))
    return out.select(F.col("__id").alias(key), "path", text.alias("value"), F.coalesce(named, number, F.lit("json")).alias("type")).where((F.col("type") != "json") | ~F.col("value").isin("{}", "[]"))


def delimited_fields(lines: DataFrame, key: str, line: str, least: int = 4) -> DataFrame:
    """The delimiter that gives most columns (first of ties, at least `least`), with trimmed values."""
    counts = [F.length(line) - F.length(F.replace(F.col(line), F.lit(x), F.lit(""))) + 1 for x in DELIMITERS]
    most = F.greatest(*counts)
    chosen = reduce(lambda other, cx: F.when(cx[0] == most, F.lit(cx[1])).otherwise(other), reversed(list(zip(counts, DELIMITERS))), F.lit(None))
    chosen = F.when(most >= least, chosen)
    parts = F.transform(F.split(F.col(line), F.concat(F.lit("\\Q"), chosen, F.lit("\\E")), -1), lambda x: F.trim(x))
    return lines.select(key, chosen.alias("delimiter"), F.posexplode(parts).alias("col", "value"))


def base64_fields(rows: DataFrame, column: str) -> DataFrame:
    """Decoded payloads; malformed ones are rejected."""
    raw = F.try_to_binary(F.col(column), F.lit("base64"))
    return rows.withColumn("decoded", F.make_valid_utf8(raw.cast("string"))).withColumn("rejected", raw.isNull())


CEF = r"^CEF:(\d+)" + r"\|((?:\\\||[^|])*)" * 6 + r"\|(.*)$"
LEEF = r"^LEEF:([\d.]+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"


def cef_fields(rows: DataFrame, line: str) -> DataFrame:
    """Seven header columns and the extension map; a value runs to the next key."""
    names = ("version", "vendor", "product", "device_version", "event_class", "name", "severity")
    head = [F.replace(F.regexp_extract(line, CEF, i), F.lit("\\|"), F.lit("|")).alias(n) for i, n in enumerate(names, 1)]
    pairs = F.split(F.regexp_extract(line, CEF, 8), r" (?=[\w.]+=)")
    extension = F.map_from_entries(F.transform(F.filter(pairs, lambda p: F.instr(p, "=") > 0), lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_extract(p, r"^[^=]*=(.*)$", 1))))
    return rows.where(F.col(line).rlike(CEF)).withColumns({a: h for a, h in zip(names, head)}).withColumn("extension", extension)


def leef_fields(rows: DataFrame, line: str) -> DataFrame:
    """Five header columns and the attributes."""
    names = ("version", "vendor", "product", "product_version", "event_id_")
    pairs = F.split(F.regexp_extract(line, LEEF, 6), "\t")
    attributes = F.map_from_entries(F.transform(F.filter(pairs, lambda p: F.instr(p, "=") > 0), lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_extract(p, r"^[^=]*=(.*)$", 1))))
    return rows.where(F.col(line).rlike(LEEF)).withColumns({n: F.regexp_extract(line, LEEF, i) for i, n in enumerate(names, 1)}).withColumn("attributes", attributes)


def regex_fields(lines: DataFrame, key: str, line: str, patterns: dict[str, str]) -> DataFrame:
    """The first match of each pattern anywhere in a line, one row per hit."""
    hits = F.array_compact(F.array(*[F.when(F.col(line).rlike(p), F.struct(F.lit(n).alias("pattern"), F.regexp_extract(line, p, 1).alias("value"))) for n, p in patterns.items()]))
    return lines.select(key, F.explode(hits).alias("h")).select(key, "h.pattern", "h.value")


# How times are written, tried in this order: (guard, pattern, what it lacks).
FORMATS = (
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,6}(?:Z|[+-]\d\d:\d\d)$", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", ""),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,6}[+-]\d{4}$", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX", ""),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:Z|[+-]\d\d:\d\d)$", "yyyy-MM-dd'T'HH:mm:ssXXX", ""),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d{4}$", "yyyy-MM-dd'T'HH:mm:ssXX", ""),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,6}$", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "zone"),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", "yyyy-MM-dd'T'HH:mm:ss", "zone"),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{1,6}$", "yyyy-MM-dd HH:mm:ss.SSSSSS", "zone"),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss", "zone"),
    (r"^\d\d/\d\d/\d{4} \d\d:\d\d:\d\d$", "dd/MM/yyyy HH:mm:ss", "zone"),
    (r"^\d\d-\d\d-\d{4} \d\d:\d\d:\d\d$", "dd-MM-yyyy HH:mm:ss", "zone"),
    (r"^[A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d$", "MMM d HH:mm:ss", "year"),
    (r"^[A-Z][a-z]{2} +\d{1,2} \d{4} \d\d:\d\d:\d\d$", "MMM d yyyy HH:mm:ss", "zone"),
    (r"^\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}$", "dd/MMM/yyyy:HH:mm:ss XX", ""),
)


def time_of(text: str | Column, arrived: Column, zone: Column, formats: tuple = ()) -> Column:
    """(at, format, lacks) of a written time, null if it fits none; contract formats come first, then FORMATS.

    An offset in the text wins over the zone (a column of names), never the session's. A time without a year takes the
    arrival's, one less if that is over a day ahead. Guards keep texts of other shapes from the date parser.
    """
    value = F.regexp_replace(F.trim(text), " +", " ")
    dated = lambda y, pattern: F.try_to_timestamp(F.concat(y.cast("string"), F.lit(" "), value, F.lit(" "), zone), F.lit(f"yyyy {pattern} VV"))
    found = []
    for guard, pattern, lacks in (*formats, *FORMATS):
        if lacks == "year":
            this = dated(F.year(arrived), pattern)
            at = F.when(this > arrived + F.expr("interval 1 day"), dated(F.year(arrived) - 1, pattern)).otherwise(this)
        elif lacks == "zone":
            at = F.try_to_timestamp(F.concat(value, F.lit(" "), zone), F.lit(f"{pattern} VV"))
        else:
            at = F.try_to_timestamp(value, F.lit(pattern))
        found.append(F.when(value.rlike(guard), F.struct(at.alias("at"), F.lit(pattern).alias("format"), F.lit(lacks).alias("lacks"))))
    return F.get(F.filter(F.array_compact(F.array(*found)), lambda x: x["at"].isNotNull()), F.lit(0))


def event_time(rows: DataFrame, text: str, received: str, tz: str | Column = "UTC", formats: tuple = ()) -> DataFrame:
    """event_time, its epoch_ms, time_source, time_format, tz_assumed, year_inferred and skew_s, the seconds from event to arrival.

    Times are read as in time_of; tz is a name or a column of names. What fits no format takes the arrival.
    """
    zone = F.lit(tz) if isinstance(tz, str) else tz
    arrived = F.col(received).cast("timestamp")
    out = rows.withColumn("__t", time_of(text, arrived, zone, formats))
    known = F.col("__t.at").isNotNull()
    out = out.withColumn("event_time", F.coalesce("__t.at", arrived))
    return out.withColumns({
        "epoch_ms": F.unix_millis("event_time"), "time_source": F.when(known, "event").otherwise("received"), "time_format": F.col("__t.format"), "tz_assumed": F.when(known & (F.col("__t.lacks") != ""), zone),
        "year_inferred": F.coalesce(F.col("__t.lacks") == "year", F.lit(False)), "skew_s": F.unix_seconds(arrived) - F.unix_seconds("event_time"),
    }).drop("__t")


def detect_layers(lines: DataFrame, line: str, most_chars: int | None = None) -> DataFrame:
    """The layers a line seems to have: a syslog header, and what its body (or the line) is. `most_chars`: judge by the first ones only."""

    def inner(text: Column) -> Column:
        cuts = F.greatest(*[F.length(text) - F.length(F.replace(text, F.lit(x), F.lit(""))) for x in DELIMITERS])
        return (
            F.when(text.rlike(r"^\s*[\{\[]"), "json").when(text.rlike(r"^CEF:\d"), "cef").when(text.rlike(r"^LEEF:\d"), "leef")
            .when((F.size(kv_pairs(text)) >= 2) & (kv_density(text) >= 0.5), "kv").when(cuts >= 3, "delimited").otherwise("text")
        )

    judged = lines if most_chars is None else lines.withColumn(line, F.substring(line, 1, most_chars))
    body = F.coalesce(F.get(groups(line, RFC5424, 9), F.lit(8)), F.get(groups(line, RFC3164, 6), F.lit(5)))
    judged = judged.withColumn("__body", body)
    path = F.when(F.col("__body").isNotNull(), F.concat(F.lit("auto:syslog>"), inner(F.col("__body")))).otherwise(F.concat(F.lit("auto:"), inner(F.col(line))))
    return judged.withColumn("parse_path", path).drop("__body")


USER_KEY = r"(?:" + "|".join(USER_KEYS) + r")\s*[=:]\s*"
#: What leads to a name in prose, the longest lead first; a name isn't itself such a word.
USER_LEAD = r"(?:(?:for|by)\s+(?:invalid\s+)?(?:user|account)|(?:invalid\s+)?(?:user|account)|for|by)\s+"
NO_NAME = r"(?!(?:account|" + "|".join(NOT_USERS) + r")(?![\w]))"
USER_NAME = r"[A-Za-z_][\w.\-]*\w"
USER_VALUE = r"(?i)(?<!\w)" + USER_KEY + VALUE
USER_PROSE = r"(?i)(?<!\w)" + USER_LEAD + NO_NAME + "(" + USER_NAME + ")"
SECRET = r"""(?i)(?<![A-Za-z0-9])((?:\w*[_\-])?(?:""" + "|".join(SECRET_KEYS) + r""")["']?\s*[=:]\s*)(?:(?:bearer|basic|digest)\s+[^\s,;]+|"[^"]*"|'[^']*'|[^\s,;&]+)"""
BLOB = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24,}={0,2}"


def class_hint(lines: DataFrame, line: str) -> DataFrame:
    """A guess of the event class by ordered rules, http before auth before network before process, and how far to trust it; none is 0."""
    ips = F.size(F.regexp_extract_all(line, F.lit(IPV4), F.lit(0)))
    http = F.col(line).rlike(r"(?i)(\bGET\b|\bPOST\b|\bPUT\b|\bDELETE\b|\bHEAD\b|HTTP/\d)")
    auth, network, process = (F.col(line).rlike(any_word(w)) for w in (AUTH_WORDS, NETWORK_WORDS, PROCESS_WORDS))
    user = F.col(line).rlike(USER_VALUE) | F.col(line).rlike(USER_PROSE)
    port = F.col(line).rlike(r"(?i)\bport\s+\d{1,5}\b|\d\.\d{1,3}:\d{1,5}\b")
    rule = F.when(http, F.struct(F.lit(4002), F.when(ips > 0, "medium").otherwise("low"))).when(auth, F.struct(F.lit(3002), F.when(user, "medium").otherwise("low")))
    rule = rule.when(network & (ips >= 2), F.struct(F.lit(4001), F.when(port, "medium").otherwise("low"))).when(process, F.struct(F.lit(1007), F.lit("low")))
    out = lines.withColumn("__rule", rule.cast("struct<hint: int, confidence: string>"))
    return out.withColumns({"hint": F.coalesce("__rule.hint", F.lit(0)), "confidence": F.col("__rule.confidence")}).drop("__rule")


def severity_words(lines: DataFrame, line: str) -> DataFrame:
    """4 for the worst words, 3 for bad ones, else 0."""
    return lines.withColumn("word_severity", F.when(F.col(line).rlike(any_word(WORST_WORDS)), 4).when(F.col(line).rlike(any_word(BAD_WORDS)), 3).otherwise(0))


# The shapes of words and what stands for them in a signature, in order; groups of a pattern are kept.
SHAPES = (
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "<UUID>"),
    (r"(?U)^(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?$", "<IP>"),
    (r"(?U)^\d{1,4}[-/:T]\d{1,2}(?:[-/:T.]\d{1,4})*Z?$", "<TS>"),
    (r"^(?=.*::|(?:[^:]*:){3})[0-9a-fA-F:]*:[0-9a-fA-F:]*:[0-9a-fA-F:]*$", "<IP>"),
    (r"(?U)^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$", "<EMAIL>"),
    (r"(?U)^([A-Za-z_][\w.\-]*)=.*$", "$1=<V>"),
    (r"(?U)^([A-Za-z_][\w.\-]*):.+$", "$1:<V>"),
    (r"^[0-9a-fA-F]{8,}$", "<HEX>"),
    (r"(?U)^.*\d.*$", "<NUM>"),
)
PLAIN_WORD = r"^[g-zG-Z][A-Za-z]*$|^[A-Za-z]{1,7}$"  # no shape fits such a word


def template_signature(lines: DataFrame, scope: Column, line: str) -> DataFrame:
    """The masked shape of a line, word by word, and the hash of scope and shape. White space between words counts as one blank."""

    def mask(t: Column) -> Column:
        chain = F.when(t.rlike(PLAIN_WORD), t)
        for pattern, shown in SHAPES:
            chain = chain.when(t.rlike(pattern), F.regexp_replace(t, pattern, shown) if "$" in shown else F.lit(shown))
        return chain.otherwise(t)

    shape = F.array_join(F.transform(F.split(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), r"(?U)\s+"), mask), " ")
    return lines.withColumn("shape", shape).withColumn("sig", F.concat(F.lit("t_"), F.substring(F.sha2(F.concat(scope, F.lit("\x1f"), F.col("shape")), 256), 1, 12)))


def mask_pii(lines: DataFrame, line: str) -> DataFrame:
    """Masked, with secrets, then e-mails, long blobs, and users after their keys or in prose hidden; IPs stay.

    Numbers count the distinct values of a line; an e-mail is the same in upper and lower case. A name is hidden
    wherever a key or a lead stands before it. Null lines stay null.
    """
    text = F.regexp_replace(line, SECRET, "$1<SECRET>")

    def numbered(text: Column, values: Column, name: str, before: str, after: str) -> Column:
        """Each distinct value replaced by its number where it stands between before (one group) and after; longer ones first."""
        places = F.transform(F.array_distinct(values), lambda v, i: F.struct(-F.length(v), v.alias("v"), i.alias("i")))
        one = lambda t, x: F.regexp_replace(t, F.concat(F.lit(before), F.lit("\\Q"), F.replace(x["v"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E" + after)), F.concat(F.lit(f"$1<{name}_"), (x["i"] + 1).cast("string"), F.lit(">")))
        return F.aggregate(F.array_sort(places), text, one)

    made = lines.withColumn("__masked", text)
    mails = F.transform(F.regexp_extract_all("__masked", F.lit(EMAIL), F.lit(0)), lambda v: F.lower(v))
    made = made.withColumn("__masked", numbered(F.col("__masked"), mails, "EMAIL", r"(?i)()(?<![\w.%+\-])", r"(?![\w\-])"))
    made = made.withColumn("__masked", F.regexp_replace("__masked", BLOB, "<BLOB>"))
    keyed = F.filter(F.regexp_extract_all("__masked", F.lit(USER_VALUE), F.lit(1)), lambda v: ~v.startswith("<"))
    told = F.regexp_extract_all("__masked", F.lit(USER_PROSE), F.lit(1))
    place = r"((?i:(?<!\w)(?:" + USER_KEY + "|" + USER_LEAD + ")))"
    made = made.withColumn("masked", numbered(F.col("__masked"), F.concat(keyed, told), "USER", place, r"(?![\w\-]|\.\w)"))
    return made.drop("__masked")


HIDDEN = ("SECRET", "EMAIL", "BLOB", "USER")


def mask_census(masked: DataFrame, source: str) -> DataFrame:
    """Of each source the lines, the lines that hide something and how often each kind is hidden."""
    counts = {k: F.regexp_count("masked", F.lit(f"<{k}(?:_[0-9]+)?>")) for k in HIDDEN}
    return masked.groupBy(source).agg(F.count("*").alias("lines"), F.count_if(F.col("masked").rlike("<(?:" + "|".join(HIDDEN) + ")")).alias("hidden"), *[F.sum(c).cast("long").alias(k.lower() + "s") for k, c in counts.items()])


def hmac_hex(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex from nested hashes; only the two pads come from the driver."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def mask_route(events: DataFrame, key: bytes, plan: dict[str, str], payload: str) -> DataFrame:
    """Columns hidden by a route's plan, `hmac` (the same value gives the same name) or `redact`.

    A value of four characters or more also goes from the payload wherever it stands; shorter ones only
    in place. The key is the route's own.
    """
    out, swept = events, F.col(payload)
    for column, how in plan.items():
        hidden = F.concat(F.lit("h_"), F.substring(hmac_hex(F.col(column), key), 1, 16)) if how == "hmac" else F.when(F.col(column).isNotNull(), "[REDACTED]")
        out = out.withColumn(f"__{column}", hidden)
        swept = F.when(F.length(column) >= 4, F.replace(swept, F.col(column), F.col(f"__{column}"))).otherwise(swept)
    out = out.withColumn(payload, swept)
    return out.withColumns({c: F.col(f"__{c}") for c in plan}).drop(*[f"__{c}" for c in plan])


def siem_rules(events: DataFrame) -> DataFrame:
    """The first rule that fits, and its level."""
    rule = F.when(F.col("tier") == 4, 100104).when(F.col("tier") == 3, 100103).when((F.col("class_uid") == 3002) & (F.col("candidate_tier") == 2), 100110).when(F.col("event_id") % 9 == 0, 100120).otherwise(100100)
    level = F.when(rule == 100104, 7).when(rule == 100103, 5).when(rule == 100110, 5).when(rule == 100120, 4).otherwise(3)
    return events.withColumn("rule_id", rule).withColumn("level", level)


def decode_lines(rows: DataFrame, raw: str, codecs: tuple[str, ...] = ()) -> DataFrame:
    """Encoding, decoded, confidence, invalid_bytes and lossy: strict UTF-8, else the first codec whose text encodes to the same bytes, else replacement characters.

    Codecs are names that Spark can decode without failing on any bytes, such as ISO-8859-1.
    """
    text = F.col(raw).cast("string")
    good = F.is_valid_utf8(text)
    name, value = F.lit("lossy"), F.make_valid_utf8(text)
    for codec in reversed(codecs):
        same = F.encode(F.decode(F.col(raw), codec), codec) == F.col(raw)
        name, value = F.when(same, codec.lower()).otherwise(name), F.when(same, F.decode(F.col(raw), codec)).otherwise(value)
    made = rows.withColumns({"encoding": F.when(good, "utf-8").otherwise(name), "decoded": F.when(good, text).otherwise(value)})
    lossy = F.col("encoding") == "lossy"
    marks = F.length("decoded") - F.length(F.replace("decoded", F.lit("\ufffd"), F.lit("")))
    return made.withColumns({"lossy": lossy, "invalid_bytes": F.when(lossy, marks).otherwise(0), "confidence": F.when(F.col("encoding") == "utf-8", 1.0).when(lossy, 0.0).otherwise(0.5)})


def encoding_census(decoded: DataFrame, source: str) -> DataFrame:
    """How each source's lines are encoded."""
    return decoded.groupBy(source, "encoding").agg(F.count("*").alias("n"), F.sum("invalid_bytes").alias("invalid_bytes"))


def byte_spans(rows: DataFrame, text: str, value: str) -> DataFrame:
    """The byte offsets of a located value: the UTF-8 length of what stands before it."""
    at = F.expr(f"locate({value}, {text})")
    start = F.octet_length(F.expr(f"left({text}, locate({value}, {text}) - 1)"))
    return rows.withColumn("start", F.when(at > 0, start)).withColumn("end", F.col("start") + F.octet_length(value))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return syslog_fields(log_view(spark, d))


def _mixed(s: SparkSession, d: str) -> DataFrame:
    """One line table of several shapes."""
    a = log_view(s, d).selectExpr("concat('l', event_id) as id", "line")
    b = log_view(s, d).selectExpr("concat('j', event_id) as id", "props as line")
    c = log_view(s, d).selectExpr("concat('k', event_id) as id", "concat('user=u', user_id, ' kind=', source_id, ' v=', event_id) as line")
    e = log_view(s, d).selectExpr("concat('c', event_id) as id", "concat('CEF:0|acme|ngfw|1|', event_id, '|', source_id, '|5|src=10.0.0.1 msg=x y') as line")
    f = log_view(s, d).selectExpr("concat('s', event_id) as id", "concat(event_id, ';', user_id, ';', source_id, ';end') as line")
    return a.unionByName(b).unionByName(c).unionByName(e).unionByName(f)


_MSG = "concat('CEF:0|ac\\\\|me|ngfw|1.', user_id, '|', event_id, '|login ', source_id, '|', event_id % 10, '|src=10.0.0.', user_id % 256, ' msg=hello big world dpt=', event_id % 1000)"
_AT = "received_time - interval 30 seconds"
_LOCAL = f"from_utc_timestamp({_AT}, 'Asia/Kolkata')"
_WHEN = f"""case event_id % 9 when 0 then date_format({_LOCAL}, "yyyy-MM-dd'T'HH:mm:ss") when 1 then date_format({_LOCAL}, 'yyyy-MM-dd HH:mm:ss.SSS') when 2 then date_format({_LOCAL}, 'MMM dd HH:mm:ss') when 3 then concat(date_format({_AT}, "yyyy-MM-dd'T'HH:mm:ss"), 'Z')
 when 4 then concat(date_format({_AT} + interval 2 hours, 'dd/MMM/yyyy:HH:mm:ss'), ' +0200') when 5 then date_format({_LOCAL}, 'dd/MM/yyyy HH:mm:ss') when 6 then date_format({_LOCAL}, 'MMM dd yyyy HH:mm:ss') when 7 then concat(date_format({_AT} - interval 5 hours, "yyyy-MM-dd'T'HH:mm:ss.SSS"), '-05:00') else 'nonsense' end"""
_HEADERS = """case event_id % 5 when 0 then line when 1 then concat('<', event_id % 192, '>1 2026-09-26T14:05:11.003Z host-', user_id % 20, ' app ', event_id, ' ID47 [x@1 a="b"][y c="d"] the message')
 when 2 then concat('Sep 26 14:05:11 host-', user_id % 20, ' app: body here') when 3 then concat('<134>Sep 6 14:05:11 fw01 CEF:0|acme|ngfw|1|', event_id, '|x|5|a=b') else concat('no header ', event_id) end"""
_WORDS = """case event_id % 8 when 0 then 'GET /index from 10.0.0.1' when 1 then 'HTTP/1.1 200' when 2 then concat('sudo by user root', user_id) when 3 then 'ssh closed' when 4 then 'Deny tcp 10.0.0.1 to 10.0.0.2 port 22'
 when 5 then 'traffic 10.0.0.1 10.0.0.2' when 6 then 'execve failed' else 'panic: disk rejected' end"""
_SHAPED = """concat(case event_id % 9 when 0 then '2026-09-26' when 1 then 'fe80::1' when 2 then 'deadbeef' when 3 then 'k=' when 4 then 'k:/x' when 5 then '9k=v' when 6 then 'a.b@c.org' when 7 then '10.0.0.1:99999' else '12:30:01' end, '  ', line, ' 3F2504E0-4F89-11D3-9A0C-0305E82C3301 ')"""
_NESTED = """case event_id % 17 when 0 then substring(props, 2) when 1 then '{"a":[1,' when 2 then null when 3 then '[]' else concat('{"p":', props, ',"a":{"b":[{"c":"x', event_id, '"},', event_id, ',[true,null]],"e":{}},"q":"say ', chr(92), '"hi', chr(92), '" }{","f":', event_id % 7, '.25} tail {', event_id) end"""
_PAIRS = "concat(line, ' a = 1 b=\"x y\",c=\\'z\\'; d.e=', event_id) as line"
_NAMED = """case event_id % 8 when 0 then concat('session opened by user alice', user_id, '.') when 1 then concat('job started by account bob', user_id) when 2 then concat('failure for invalid user eve', user_id, ', user eve', user_id)
 when 3 then concat('mail A', user_id, '@x.org. then a', user_id, '@X.org, b@y.co.uk') when 4 then concat('Authorization: Bearer tok', event_id, ' by root') when 5 then concat('"password":"p', event_id, '","n":1') when 6 then concat('for user at 10.0.0.1 x_api_key=k', event_id, '&z=1') else 'nothing here' end"""
_PRIVATE = """concat('login for user neel', user_id % 7, ' password=hunter', event_id, ' mail a', user_id % 5, '@example.org and a', user_id % 5, '@example.org from 10.0.0.1 key ', case when event_id % 2 = 0 then 'deadbeefdeadbeefdeadbeef' else 'short' end, ' user=neel', user_id % 7, ' acct: ops', event_id % 3, ' user=neel')"""
QUERIES = {
    "syslog_fields": lambda s, d: syslog_fields(log_view(s, d).selectExpr("event_uid", f"{_HEADERS} as line")).select("event_uid", "variant", "rejected", "pri", "facility", "severity", "version", "timestamp", "host", "app", "pid", "msgid", "sd", "body"),
    "kv_fields": lambda s, d: kv_fields(log_view(s, d).selectExpr("event_uid", _PAIRS), "event_uid", "line"),
    "json_fields": lambda s, d: json_fields(log_view(s, d).selectExpr("event_uid", f"{_NESTED} as j"), "event_uid", "j"),
    "json_values": lambda s, d: json_values(log_view(s, d).selectExpr("event_uid", f"{_NESTED} as j"), "event_uid", "j").select("event_uid", "rest", "rejected", "depth"),
    "kv_census": lambda s, d: kv_census(log_view(s, d).selectExpr("source_id", _PAIRS), "source_id", "line"),
    "delimited_fields": lambda s, d: delimited_fields(log_view(s, d).selectExpr("event_uid", "case when event_id % 3 = 0 then concat(event_id, '; ', user_id, ';', source_id, ' ;x') else concat(event_id, '|a|', user_id, '|b') end as line"), "event_uid", "line"),
    "base64_fields": lambda s, d: base64_fields(log_view(s, d).selectExpr("event_uid", "case when event_id % 19 = 0 then '!!' else base64(cast(source_id as binary)) end as b"), "b").drop("b"),
    "cef_fields": lambda s, d: cef_fields(log_view(s, d).selectExpr("event_uid", f"{_MSG} as line"), "line").select("event_uid", "vendor", "event_class", "name", "severity", F.col("extension")["src"].alias("src"), F.col("extension")["msg"].alias("msg"), F.col("extension")["dpt"].alias("dpt")),
    "leef_fields": lambda s, d: leef_fields(log_view(s, d).selectExpr("event_uid", "concat('LEEF:1.0|acme|fw|', user_id, '|e', event_id, '|src=1.1.1.1\t', 'usr=u', user_id) as line"), "line").select("event_uid", "vendor", "product_version", "event_id_", F.col("attributes")["usr"].alias("usr")),
    "regex_fields": lambda s, d: regex_fields(log_view(s, d), "event_uid", "line", {"via": r"via (\S+)", "failed": r"(FAILED)", "many": r"attempts:([3-9])"}),
    "event_time": lambda s, d: event_time(log_view(s, d).selectExpr("event_uid", "received_time", f"{_WHEN} as t"), "t", "received_time", "Asia/Kolkata").select("event_uid", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "time_source", "tz_assumed", "year_inferred", "skew_s"),
    "detect_layers": lambda s, d: detect_layers(_mixed(s, d), "line").groupBy(F.substring("id", 1, 1).alias("shape"), "parse_path").agg(F.count("*").alias("n")),
    "class_hint": lambda s, d: class_hint(log_view(s, d).selectExpr("event_uid", f"{_WORDS} as line"), "line").select("event_uid", "hint", "confidence"),
    "severity_words": lambda s, d: severity_words(log_view(s, d).selectExpr("event_uid", f"{_WORDS} as line"), "line").select("event_uid", "word_severity"),
    "template_signature": lambda s, d: template_signature(log_view(s, d).selectExpr("source_id", f"{_SHAPED} as line"), F.col("source_id"), "line").groupBy("source_id", "shape", "sig").agg(F.count("*").alias("n")),
    "mask_pii": lambda s, d: mask_pii(log_view(s, d).selectExpr("event_uid", f"{_PRIVATE} as line"), "line").select("event_uid", "masked"),
    "mask_leads": lambda s, d: mask_pii(log_view(s, d).selectExpr("event_uid", f"{_NAMED} as line"), "line").select("event_uid", "masked"),
    "mask_census": lambda s, d: mask_census(mask_pii(log_view(s, d).selectExpr("source_id", f"{_NAMED} as line"), "line"), "source_id"),
    "pii_census": lambda s, d: table(s, d, "documents").groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), F.lit(0)))).alias("ips"), F.sum(F.size(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)))).alias("emails")),
    "mask_route": lambda s, d: mask_route(log_view(s, d).selectExpr("event_uid", "concat('user', user_id) as who", "concat('n', user_id, '@x.org') as mail", "cast(event_id % 7 as string) as code", "concat('login of user', user_id, ' n', user_id, '@x.org as user', user_id, ' code ', event_id % 7) as msg"), b"route-key", {"mail": "redact", "who": "hmac", "code": "redact"}, "msg").select("event_uid", "who", "mail", "code", "msg"),
    "siem_rules": lambda s, d: siem_rules(log_view(s, d)).select("event_uid", "rule_id", "level"),
    "decode_lines": lambda s, d: decode_lines(table(s, d, "documents").select("doc_id", F.expr("case when doc_id % 10 = 3 then concat(cast(text as binary), unhex('FF')) else cast(text as binary) end").alias("raw")), "raw").select("doc_id", "encoding", "lossy", "confidence", "invalid_bytes", F.length("decoded").alias("chars")),
    "encoding_census": lambda s, d: encoding_census(decode_lines(table(s, d, "documents").select("source", F.expr("case when doc_id % 10 = 3 then unhex('E9FF') else cast('x' as binary) end").alias("raw")), "raw", ("ISO-8859-1",)), "source"),
    "byte_spans": lambda s, d: byte_spans(table(s, d, "documents").select("doc_id", "text", F.lit("ion").alias("needle")), "text", "needle").select("doc_id", "start", "end"),
}

_PADS = [bytes(b ^ x for b in b"route-key".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
_P = f"{LOG}, p as (select *, regexp_extract(line, '^<[0-9]+>.{{15}} [^ ]+ app.[0-9]+.: (.*)$', 1) as body, concat('10.0.', user_id % 256, '.', event_id % 256) as src, event_id % 5 as att from log), m as (select *, case when event_id % 4 = 2 then 'failed' when att <= 3 then 'ok' else 'any' end as template from p)"
_TAKE = "case when event_id % 4 = 2 then true else att <= 3 end"
ORACLES = {
    "syslog_fields": f"""{_P}, x as (select *, event_id % 5 as k, (case event_id % 5 when 0 then event_id % 192 when 1 then event_id % 192 when 3 then 134 end)::int as pr, concat('host-', user_id % 20) as h from p)
 select event_uid, case k when 1 then 'rfc5424' when 4 then 'none' else 'rfc3164' end as variant, k = 4 as rejected, pr as pri, (pr // 8)::int as facility, (pr % 8)::int as severity, case k when 1 then '1' end as version,
 case k when 0 then 'Jan 01 00:00:00' when 1 then '2026-09-26T14:05:11.003Z' when 2 then 'Sep 26 14:05:11' when 3 then 'Sep 6 14:05:11' end as timestamp, case k when 4 then null when 3 then 'fw01' else h end as host,
 case when k <= 2 then 'app' end as app, case when k <= 1 then event_id::varchar end as pid, case k when 1 then 'ID47' end as msgid, case k when 1 then '[x@1 a="b"][y c="d"]' end as sd,
 case k when 0 then body when 1 then 'the message' when 2 then 'body here' when 3 then concat('CEF:0|acme|ngfw|1|', event_id, '|x|5|a=b') else concat('no header ', event_id) end as body from x""",
    "kv_fields": f"""{LOG}, x as (select event_uid, unnest([{{'ord': 0, 'name': 'user', 'value': concat('u', user_id)}}, {{'ord': 1, 'name': 'a', 'value': '1'}}, {{'ord': 2, 'name': 'b', 'value': 'x y'}}, {{'ord': 3, 'name': 'c', 'value': 'z'}}, {{'ord': 4, 'name': 'd.e', 'value': event_id::varchar}}], recursive := true) from log)
 select event_uid, ord::int as ord, name, value, false as truncated from x""",
    "json_fields": f"""{LOG}, j as (select event_uid, event_id, concat('{{"p":', props, ',"a":{{"b":[{{"c":"x', event_id, '"}},', event_id, ',[true,null]],"e":{{}}}},"q":"say ', chr(92), '"hi', chr(92), '" }}{{","f":', event_id % 7, '.25}}')::json as j from log where event_id % 17 > 3),
 t as (select event_uid, event_id, t.* from j, json_tree(j.j) as t where t.type not in ('OBJECT', 'ARRAY'))
 select event_uid, replace(fullkey[3:], '"', '') as path, json_extract_string(atom, '$') as value, case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'bool' when 'NULL' then 'null' when 'DOUBLE' then 'float' else 'int' end as type from t""",
    "json_values": f"""{LOG} select event_uid, case when event_id % 17 > 3 then concat('tail {{', event_id) end as rest, event_id % 17 <= 2 as rejected, (case when event_id % 17 = 3 then 1 when event_id % 17 > 3 then 4 end)::int as depth from log""",
    "kv_census": f"""{LOG}, k(name) as (values ('user'), ('a'), ('b'), ('c'), ('d.e')) select source_id, name, count(*) as n, count(distinct case name when 'user' then user_id when 'd.e' then event_id else 0 end) as "values" from log, k group by 1, 2""",
    "delimited_fields": f"""{LOG}, x as (select event_uid, case when event_id % 3 = 0 then ';' else '|' end as delimiter, case when event_id % 3 = 0 then [event_id::varchar, user_id::varchar, source_id, 'x'] else [event_id::varchar, 'a', user_id::varchar, 'b'] end as v from log)
 select event_uid, delimiter, (generate_subscripts(v, 1) - 1)::int as col, unnest(v) as value from x""",
    "base64_fields": f"{LOG} select event_uid, case when event_id % 19 <> 0 then source_id end as decoded, event_id % 19 = 0 as rejected from log",
    "cef_fields": f"{LOG} select event_uid, 'ac|me' as vendor, event_id::varchar as event_class, concat('login ', source_id) as name, (event_id % 10)::varchar as severity, concat('10.0.0.', user_id % 256) as src, 'hello big world' as msg, (event_id % 1000)::varchar as dpt from log",
    "leef_fields": f"{LOG} select event_uid, 'acme' as vendor, user_id::varchar as product_version, concat('e', event_id) as event_id_, concat('u', user_id) as usr from log",
    "regex_fields": f"""{LOG} select event_uid, 'via' as pattern, '10.2.3.4' as value from log union all select event_uid, 'failed', 'FAILED' from log where event_id % 4 = 2 union all select event_uid, 'many', (event_id % 5)::varchar from log where event_id % 5 >= 3""",
    "event_time": f"""{LOG}, x as (select event_uid, received_time, event_id % 9 as k, date_trunc('second', case event_id % 9 when 8 then received_time else received_time - interval 30 seconds end) as t from log)
 select event_uid, strftime(t, '%Y-%m-%d %H:%M:%S') as event_time, case k when 8 then 'received' else 'event' end as time_source, case when k in (0, 1, 2, 5, 6) then 'Asia/Kolkata' end as tz_assumed, k = 2 as year_inferred, (epoch(date_trunc('second', received_time)) - epoch(t))::bigint as skew_s from x""",
    "detect_layers": f"""{LOG}, k(shape, parse_path) as (values ('l', 'auto:syslog>text'), ('j', 'auto:json'), ('k', 'auto:kv'), ('c', 'auto:cef'), ('s', 'auto:delimited')) select shape, parse_path, count(*) as n from k, log group by all""",
    "class_hint": f"""{LOG} select event_uid, (case event_id % 8 when 0 then 4002 when 1 then 4002 when 2 then 3002 when 3 then 3002 when 4 then 4001 when 5 then 4001 when 6 then 1007 else 0 end)::int as hint, case when event_id % 8 in (0, 2, 4) then 'medium' when event_id % 8 <> 7 then 'low' end as confidence from log""",
    "severity_words": f"""{LOG} select event_uid, (case event_id % 8 when 4 then 3 when 6 then 3 when 7 then 4 else 0 end)::int as word_severity from log""",
    "template_signature": f"""{_P}, s as (select source_id, concat(case event_id % 9 when 0 then '<TS>' when 1 then '<IP>' when 2 then '<HEX>' when 3 then 'k=<V>' when 4 then 'k:<V>' when 5 then '<NUM>' when 6 then '<EMAIL>' when 7 then '<IP>' else '<TS>' end,
 ' <NUM> <NUM> <TS> <NUM> <NUM> user=<V> ', case when event_id % 4 = 2 then 'FAILED' else 'OK' end, ' login from <IP> via <IP> attempts:<V> <UUID>') as shape from p)
 select source_id, shape, concat('t_', substring(sha256(concat(source_id, chr(31), shape)), 1, 12)) as sig, count(*) as n from s group by all""",
    "mask_pii": f"""{LOG} select event_uid, concat('login for user <USER_1> password=<SECRET> mail <EMAIL_1> and <EMAIL_1> from 10.0.0.1 key ', case when event_id % 2 = 0 then '<BLOB>' else 'short' end, ' user=<USER_1> acct: <USER_2> user=<USER_3>') as masked from log""",
    "mask_leads": f"""{LOG} select event_uid, case event_id % 8 when 0 then 'session opened by user <USER_1>.' when 1 then 'job started by account <USER_1>' when 2 then 'failure for invalid user <USER_1>, user <USER_1>' when 3 then 'mail <EMAIL_1>. then <EMAIL_1>, <EMAIL_2>'
 when 4 then 'Authorization: <SECRET> by <USER_1>' when 5 then '"password":<SECRET>,"n":1' when 6 then 'for user <USER_1> 10.0.0.1 x_api_key=<SECRET>&z=1' else 'nothing here' end as masked from log""",
    "mask_census": f"""{LOG} select source_id, count(*) as lines, count(*) filter (event_id % 8 <> 7) as hidden, count(*) filter (event_id % 8 in (4, 5, 6)) as secrets, (3 * count(*) filter (event_id % 8 = 3))::bigint as emails, 0::bigint as blobs, (count(*) filter (event_id % 8 in (0, 1, 4, 6)) + 2 * count(*) filter (event_id % 8 = 2))::bigint as users from log group by 1""",
    "mask_route": f"""{LOG}, h as (select event_id, event_uid, user_id, concat('h_', substring(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || concat('user', user_id)::blob))), 1, 16)) as who from log)
 select event_uid, who, '[REDACTED]' as mail, '[REDACTED]' as code, concat('login of ', who, ' [REDACTED] as ', who, ' code ', event_id % 7) as msg from h""",
    "pii_census": r"""select source, sum(len(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')))::bigint as ips, sum(len(regexp_extract_all(text, '[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}')))::bigint as emails from documents group by 1""",
    "siem_rules": f"""{LOG}, r as (select event_uid, (case when tier = 4 then 100104 when tier = 3 then 100103 when class_uid = 3002 and candidate_tier = 2 then 100110 when event_id % 9 = 0 then 100120 else 100100 end)::int as rule_id from log)
 select event_uid, rule_id, (case rule_id when 100104 then 7 when 100103 then 5 when 100110 then 5 when 100120 then 4 else 3 end)::int as level from r""",
    "encoding_census": "select source, case when doc_id % 10 = 3 then 'iso-8859-1' else 'utf-8' end as encoding, count(*) as n, 0 as invalid_bytes from documents group by 1, 2",
    "decode_lines": "select doc_id, case when doc_id % 10 = 3 then 'lossy' else 'utf-8' end as encoding, doc_id % 10 = 3 as lossy, case when doc_id % 10 = 3 then 0.0 else 1.0 end as confidence, (doc_id % 10 = 3)::int as invalid_bytes, (length(text) + (doc_id % 10 = 3)::int)::int as chars from documents",
    "byte_spans": "select doc_id, case when instr(text, 'ion') > 0 then strlen(substring(text, 1, instr(text, 'ion') - 1))::int end as start, case when instr(text, 'ion') > 0 then strlen(substring(text, 1, instr(text, 'ion') - 1))::int + 3 end as \"end\" from documents",
}
