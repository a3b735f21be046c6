"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its
text is under the loss mask. What follows the last assistant turn becomes one more example
without loss, so the examples hold every turn. All of it is built-in expressions.

The template renders a turn as "### Role: text </turn>\\n". In texts and roles "\\", "#" and "<"
are written "\\\\", "\\h" and "\\l", and in roles ":" is written "\\c": no marker can then occur
inside them, and unescaping gives every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import table

HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """The inverse of escape: pairs of backslashes first, then the letters between them."""
    back = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), back), "\\")


def render(role: Column, text: Column) -> Column:
    named = F.replace(escape(role), F.lit(":"), F.lit("\\c"))
    return F.concat(F.lit(HEAD), named, F.lit(MIDDLE), escape(text), F.lit(TAIL))


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """conv, example (from 1), target_turn (its place from 1, null: no reply follows), n_turns, text, loss_start, loss_chars, is_last.

    loss_start and loss_chars are code points of text; the span holds the escaped reply. Rows are
    ordered by turn (null first), ties by role and text; null roles and texts are empty; null
    conversation ids form one conversation. Other columns are left out. A conversation is one
    document: its turns meet in one row, as any example that ends with its last reply must hold
    them. Rows of one id are the only ones that meet; copies under many ids stay spread.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
        ).alias("row"),
    )
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows")).withColumn("n", F.size("rows"))
    replies = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("rows", i)["role"] == target)
    rest = F.when(F.element_at("rows", -1)["role"] != target, F.array(F.col("n"))).otherwise(F.array().cast("array<int>"))
    parts = whole.select(
        "conv", "n", F.transform("rows", lambda r: render(r["role"], r["text"])).alias("parts"),
        F.transform("rows", lambda r: F.length(escape(r["text"]))).alias("sizes"),
        F.posexplode(F.concat(replies, rest)).alias("k", "last"), F.size(replies).alias("replies"), F.size(F.concat(replies, rest)).alias("count"),
    )
    shown = parts.withColumn("text", F.array_join(F.slice("parts", 1, F.col("last")), ""))
    trained = F.col("k") < F.col("replies")
    size = F.element_at("sizes", F.col("last"))
    return shown.select(
        F.col("conv").alias(conv), (F.col("k") + 1).alias("example"), F.when(trained, F.col("last")).alias("target_turn"),
        F.col("last").alias("n_turns"), "text",
        F.when(trained, F.length("text") - len(TAIL) - size).otherwise(F.length("text")).alias("loss_start"),
        F.when(trained, size).otherwise(F.lit(0)).alias("loss_chars"),
        (F.col("k") == F.col("count") - 1).alias("is_last"),
    )


def parse(text: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    pieces = F.slice(F.split(text, "</turn>\n", -1), 1, F.size(F.split(text, "</turn>\n", -1)) - 1)

    def turn(piece: Column) -> Column:
        start = F.instr(piece, MIDDLE)
        role = F.substring(piece, F.lit(len(HEAD) + 1), start - len(HEAD) - 1)
        body = F.substring(piece, start + len(MIDDLE), F.length(piece) - start - len(MIDDLE))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests per conversation, all taken from the formatted examples.

    The longest example gives the turns, every example its span under the loss mask. Texts are cut
    and unescaped before anything is shuffled.
    """
    line = F.transform(parse(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars")))
    per = formatted.withColumn("loss", loss).select(
        conv, "example", "n_turns", "loss", F.length("text").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.sha2(F.array_join(line, "").cast("binary"), 256)).alias("turns_sha256"),
    )
    got = per.groupBy(conv).agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.sum(F.length("loss")).cast("long").alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("replies"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    digest = F.sha2(F.array_join(F.transform("replies", lambda r: r["loss"]), "").cast("binary"), 256)
    return got.select(conv, "n_turns", "turns_sha256", "loss_chars", digest.alias("loss_sha256"), "formatted_chars", "n_examples")


def with_probe(turns: DataFrame) -> DataFrame:
    """conversations plus the fixed conversation -7, whose texts hold the template's own markers."""
    probe = r"\### Assistant: </turn> ok"
    extra = turns.sparkSession.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted and read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return read_back(examples(with_probe(table(spark, sf_dir, "conversations"))))


_ESC = r"replace(replace(replace({0}, '\', '\\'), '#', '\h'), '<', '\l')"
OP3_SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r as (
  select *, row_number() over w as n, count(*) over (partition by conv_id) as total,
    sum(length(replace({_ESC.format("role")}, ':', '\c')) + length({_ESC.format("text")}) + 4 + 2 + 9) over w as upto
  from t window w as (partition by conv_id order by turn, role, text rows between unbounded preceding and current row)),
e as (select conv_id, sum(upto)::bigint as formatted_chars, count(*)::bigint as n_examples from r where role = 'assistant' or n = total group by conv_id)
select r.conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  e.formatted_chars, e.n_examples
from r join e using (conv_id) group by r.conv_id, e.formatted_chars, e.n_examples
"""
