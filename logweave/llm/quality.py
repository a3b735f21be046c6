"""Line-first cleaning of texts.

Each line is judged by itself: by its punctuation, as navigation, as boilerplate and as a repeat of
an earlier line. Lines that fail are removed, then documents that lost too much of their text, or
that have too few or too repetitive words, are rejected. All is a matter of one row, so nothing is
shuffled; a task works through blocks of about 2 MB of texts with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import blocks, fresh, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5  # words of a window that counts as repeated
LEAST_WORDS, MOST_REPEATED = 10, 20  # words; percent of the words in repeated windows
MOST_LOST = 50  # percent of the characters in words that removed lines may hold
SHORT_WORDS, SHORT_CHARS = 8, 40  # below both, a line without an end mark is a stub; longer ones may be wrapped prose
SYMBOL_SHARE = 20  # percent: symbols to words of a line

# Marks that end a sentence (quotes and brackets may follow), separators of menus, phrases of menus and of legal or site notices.
ENDED = r"[.!?:;…。！？：；．؟؛۔।॥։።]['\"”’»›)\]}」』）》]*[\x20\x09-\x0D]*$"
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|»›•·>/](?:[\x20\x09-\x0D]|$)"
MENU = r"(?i)^[\x20\x09-\x0D]*(?:home|menu|log ?in|sign ?(?:in|up|out)|register|search|share|next|previous|read more|click here|back to top|skip to (?:main )?content|inicio|buscar|siguiente|anterior|leer más|startseite|suche|anmelden|weiter|zurück|mehr lesen|accueil|rechercher|suivant|précédent|lire la suite)(?:[\x20\x09-\x0D]|[.!?:;…]|$)"
MENU_WORDS = 5
NOTICE = r"(?i)all rights reserved|(?:©|\(c\)|copyright)[\x20\x09-\x0D]*(?:19|20)[0-9][0-9]|licensed under|released under the|terms of (?:use|service)|privacy policy|cookie policy|(?:uses?|accept|enable) (?:all )?cookies|(?:enable|requires?) javascript|lorem ipsum|powered by"
NOTICE_WORDS = 30

RULES = ("punctuation", "navigation", "boilerplate", "repeated")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", *(f"n_{r}" for r in RULES), "lost_chars")


def _ends(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each list's values."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[ends[1:]] - upto[ends[:-1]]


def _codes(values: pa.Array) -> np.ndarray:
    """Equal texts have equal numbers."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _found(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def repeated_words(codes: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Flags of the words that lie in a window of words found twice or more in the same document; exact, as equal windows get equal numbers word by word."""
    n = len(codes) - window + 1
    out = np.zeros(len(codes), bool)
    if n < 2:
        return out
    number = pd.factorize(doc[:n] * (codes.max() + 1) + codes[:n])[0].astype(np.int64)
    for i in range(1, window):
        number = pd.factorize(number * (codes.max() + 1) + codes[i : i + n])[0].astype(np.int64)
    inside = doc[:n] == doc[window - 1 :]
    times = np.bincount(number[inside], minlength=number.max() + 1)
    starts = np.flatnonzero(inside & (times[number] > 1))
    for i in range(window):
        out[starts + i] = True
    return out


def judge(texts: pa.Array) -> dict[str, pa.Array]:
    """COUNTS and the cleaned text of every text; null texts have no lines and stay null."""
    filled = pc.fill_null(texts.cast(pa.string()), "")
    split = pc.split_pattern(filled, "\n")
    lines, ends = split.flatten(), _ends(split)
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    words = _count(lines, WORD)
    used = words > 0
    chars = pc.utf8_length(pc.replace_substring_regex(lines, r"[\x20\x09-\x0D]+", "")).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = _count(lines, SYMBOL)
    codes = _codes(lines)
    first = np.ones(len(lines), bool)
    if len(lines):
        first[:] = False
        first[np.unique(doc * (codes.max() + 1) + codes, return_index=True)[1]] = True
    separators = _count(lines, SEPARATOR)
    failed = {
        "punctuation": used & ((~_found(lines, ENDED) & (words < SHORT_WORDS) & (chars < SHORT_CHARS)) | ((symbols > 2) & (100 * symbols > SYMBOL_SHARE * words))),
        "navigation": used & (((separators > 1) & (5 * separators >= words)) | (_found(lines, MENU) & (words <= MENU_WORDS))),
        "boilerplate": used & _found(lines, NOTICE) & (words <= NOTICE_WORDS),
        "repeated": used & ~first,
    }
    lost = np.logical_or.reduce(list(failed.values()))

    split_words = pc.split_pattern_regex(filled, r"[\x20\x09-\x0D]+")
    word, word_ends = split_words.flatten(), _ends(split_words)
    real = pc.not_equal(word, "").to_numpy(zero_copy_only=False)
    word_doc = np.repeat(np.arange(len(texts)), np.diff(word_ends))[real]
    again = repeated_words(_codes(word.filter(pa.array(real))), word_doc)

    keep = ~lost
    kept = np.concatenate([[0], np.cumsum(keep)])[ends]
    left = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), lines.filter(pa.array(keep)))
    clean = pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), pc.binary_join(left, "\n"))
    made = {
        "n_words": _sums(words, ends), "word_chars": _sums(chars, ends), "n_symbols": _sums(symbols, ends), "n_dup_lines": _sums(failed["repeated"], ends),
        "n_repeat_words": np.bincount(word_doc[again], minlength=len(texts)), "n_lines": _sums(used, ends), **{f"n_{r}": _sums(failed[r], ends) for r in RULES},
        "lost_chars": _sums(np.where(lost, chars, 0), ends),
    }
    return {k: pa.array(made[k], pa.int64()) for k in COUNTS} | {"clean_text": clean}


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS, base_failed, kept and clean_text (the text without the lines that a rule removes).

    A line is removed for punctuation (a stub without an end mark, or symbols more than SYMBOL_SHARE
    percent of its words), navigation (a row of short items between separators, or a menu phrase),
    boilerplate (a legal or site notice) or as repeated (equal to an earlier line of its text). Lines
    without words stay and count for nothing. base_failed: fewer than LEAST_WORDS words, or more than
    MOST_REPEATED percent of them in WINDOW-word windows found twice or more. kept: not base_failed, and
    the removed lines hold at most MOST_LOST percent of the characters in words. A null text has counts of
    0, fails and stays null; so do an empty text and one of blanks, which stay as they are. Repeated rows
    are judged alike. New columns whose name docs has already get a number. An empty table stays empty.
    """
    names = dict(zip((*COUNTS, "clean_text", "base_failed", "kept", "__text"), fresh(docs, *COUNTS, "clean_text", "base_failed", "kept", "__text")))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(names[c], T.LongType()) for c in COUNTS], T.StructField(names["clean_text"], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, names["__text"]):
                made = judge(batch.column(names["__text"]))
                columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != names["__text"]]
                yield pa.RecordBatch.from_arrays([*columns, *made.values()], [f.name for f in schema])

    out = docs.withColumn(names["__text"], F.col(text).cast("string")).mapInArrow(run, schema)
    c = {k: F.col(v) for k, v in names.items()}
    base = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
    return out.withColumn(names["base_failed"], base).withColumn(names["kept"], ~c["base_failed"] & (100 * c["lost_chars"] <= MOST_LOST * c["word_chars"]))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged line by line: doc_id, the counts, base_failed, kept and how many lines each rule removed. Null, empty and repeated rows as in clean_lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:])


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP11_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
l as (select rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from d),
m as (select *, len(regexp_extract_all(line, {_sql(WORD)})) as words, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as chars, len(regexp_extract_all(line, {_sql(SYMBOL)})) as symbols,
  len(regexp_extract_all(line, {_sql(SEPARATOR)})) as seps, row_number() over (partition by rid, line order by n) > 1 as again from l),
r as (select *, (not regexp_matches(line, {_sql(ENDED)}) and words < {SHORT_WORDS} and chars < {SHORT_CHARS}) or (symbols > 2 and 100 * symbols > {SYMBOL_SHARE} * words) as p,
  (seps > 1 and 5 * seps >= words) or (regexp_matches(line, {_sql(MENU)}) and words <= {MENU_WORDS}) as v, regexp_matches(line, {_sql(NOTICE)}) and words <= {NOTICE_WORDS} as b from m where words > 0),
s as (select rid, sum(words)::bigint as n_words, sum(chars)::bigint as word_chars, count(*) as n_lines, count(*) filter (again) as n_dup_lines, count(*) filter (p) as n_punctuation,
  count(*) filter (v) as n_navigation, count(*) filter (b) as n_boilerplate, coalesce(sum(chars) filter (p or v or b or again), 0)::bigint as lost_chars from r group by rid),
y as (select rid, sum(symbols)::bigint as n_symbols from m group by rid),
w as (select rid, regexp_extract_all(text, {_sql(WORD)}) as ws from d),
g as (select rid, unnest(range(1, len(ws) - {WINDOW - 2})) as i, ws from w where len(ws) >= {WINDOW}),
h as (select rid, i, count(*) over (partition by rid, list_slice(ws, i, i + {WINDOW - 1})) as times from g),
c as (select rid, count(distinct i + k) as n_repeat_words from h, range({WINDOW}) as o(k) where times > 1 group by rid),
t as (select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, coalesce(n_symbols, 0) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  coalesce(n_lines, 0) as n_lines, coalesce(n_punctuation, 0) as n_punctuation, coalesce(n_navigation, 0) as n_navigation, coalesce(n_boilerplate, 0) as n_boilerplate, coalesce(n_dup_lines, 0) as n_repeated, coalesce(lost_chars, 0) as lost_chars
  from d left join s using (rid) left join y using (rid) left join c using (rid))
select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) and 100 * lost_chars <= {MOST_LOST} * word_chars as kept from t
"""
