"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one space, and n-grams of one to three
characters are hashed into buckets. Training sums counts per language and bucket over all rows
that may be learned from. The matrix of log-probabilities is broadcast in blocks of languages, each
of a fixed size. Scoring gathers the matrix rows of a text's n-grams and adds them up in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, blocks, fresh, table

BUCKETS = 1 << 15
LANGUAGES = 64  # of a block: its matrix is 8 MB; more languages are scored in more passes
ORDERS = (1, 2, 3)
PRIOR = 0.5
UNKNOWN = "und"
PIECE = 1 << 20  # characters that are turned into n-grams at once
_LETTERS: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For every code point: its lower-case letter, or a space."""
    if not _LETTERS:
        # one call each on the whole range; the few letters whose lower case is longer keep their own form
        points = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000)]
        _LETTERS.append(np.array([(ord(c.lower()) if len(c.lower()) == 1 else i) if c.isalpha() else 32 for i, c in enumerate(points)], np.uint32))
    return _LETTERS[0]


def folded(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, int]]:
    """(rows, points, owner, skip): lower-case letters of some texts, one blank for all else, one before and one after each text.

    owner numbers the texts among rows. Very long texts come in parts; the first `skip` points of a part
    are the last ones of the part before and only begin n-grams.
    """

    def points(text: str) -> np.ndarray:
        return _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def single(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (owner[1:] != owner[:-1])
        return x[keep], owner[keep]

    at = 0
    while at < len(texts):
        rows, held = [], 0
        while at < len(texts) and (not rows or held + len(texts[at]) <= PIECE) and len(texts[at]) <= PIECE:
            rows.append(at)
            held += len(texts[at])
            at += 1
        if rows:
            owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(texts[i]) + 2 for i in rows])
            yield rows, *single(points("".join([f" {texts[i]} " for i in rows])), owner), 0
            continue
        before = np.zeros(0, np.uint32)
        for begin in range(0, len(texts[at]), PIECE):
            end = begin + PIECE
            part = " " * (begin == 0) + texts[at][begin:end] + " " * (end >= len(texts[at]))
            x = np.concatenate([before, points(part)])
            x, owner = single(x, np.zeros(len(x), np.int32))
            yield [at], x, owner, len(before)
            before = x[-(max(ORDERS) - 1) :]
        at += 1


def grams(points: np.ndarray, owner: np.ndarray, skip: int, buckets: int, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (bucket, number of the text) of all n-grams that don't end in the first `skip` points. Blanks alone are none."""
    key = np.zeros(len(points), np.uint32)
    for n in range(1, max(orders) + 1):
        key = key[: max(len(points) - n + 1, 0)] * np.uint32(0x01000193) ^ points[n - 1 :] * np.uint32(0x9E3779B1)
        if n in orders:
            mixed = key ^ key >> np.uint32(15)
            mixed = mixed * np.uint32(0x85EBCA6B) + np.uint32(n)
            one = (owner[n - 1 :] == owner[: len(key)]) & ((points[n - 1 :] != 32) if n == 1 else True)
            one[: max(0, skip - n + 1)] = False
            yield (mixed >> np.uint32(8))[one] % np.uint32(buckets), owner[n - 1 :][one]


def count(rows: DataFrame, buckets: int) -> DataFrame:
    """(lang, bucket, n) over rows of (text, lang), summed within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])
            sums.clear()

        for whole in batches:
            for batch in blocks(whole, "text"):
                names = batch.column("lang").to_pylist()
                for rows_, points, owner, skip in folded([t or "" for t in batch.column("text").to_pylist()]):
                    langs = sorted({names[i] for i in rows_})
                    code = np.array([langs.index(names[i]) for i in rows_], np.int64)
                    for k, lang in enumerate(langs):
                        one = points, owner
                        if len(langs) > 1:
                            mine = (code == k)[owner]
                            one = points[mine], owner[mine]
                        for bucket, _ in grams(*one, skip, buckets):
                            n = np.bincount(bucket, minlength=buckets)
                            sums[lang] = sums[lang] + n if lang in sums else n
                    if len(sums) > 2 * LANGUAGES:
                        yield from out()
        yield from out()

    counted = rows.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, buckets: int = BUCKETS) -> list[tuple[list[str], np.ndarray]]:
    """Blocks of languages in order, each with its matrix (bucket, language) of log-probabilities, float32.

    The driver gets the names and LANGUAGES * buckets counts at a time, however many rows there are.
    """
    scratch = Scratch(rows.sparkSession, "langid")
    counted = scratch.save(count(rows, buckets), "counts")
    names = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    out = []
    for at in range(0, len(names), LANGUAGES):
        block = names[at : at + LANGUAGES]
        got = counted.where(F.col("lang").isin(block)).toArrow()
        n = np.full((buckets, len(block)), PRIOR)
        n[got.column("bucket").to_numpy(), pc.index_in(got.column("lang"), pa.array(block)).to_numpy()] += got.column("n").to_numpy()
        out.append((block, np.log(n / n.sum(0)).astype(np.float32)))
    return out


def predict(docs: DataFrame, keep: list[str], blocks_: list[tuple[list[str], np.ndarray]]) -> DataFrame:
    """keep + lang_pred and score, the posterior of lang_pred with equal priors (length-tempered, 0 to 1); docs has a column text."""
    text, best, most, mass = fresh(docs.select(*keep), "__text", "__best", "__most", "__mass")
    rows = docs.select(*keep, F.col("text").cast("string").alias(text), F.lit(UNKNOWN).alias(best), F.lit(float("-inf")).alias(most), F.lit(0.0).alias(mass))
    fields = list(docs.select(*keep).schema)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    for names, matrix in blocks_:
        shared = docs.sparkSession.sparkContext.broadcast(matrix)

        def run(batches: Iterator[pa.RecordBatch], names: list[str] = names, shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            matrix = shared.value
            buckets = len(matrix)
            for whole in batches:
                for batch in blocks(whole, text):
                    texts = [t or "" for t in batch.column(text).to_pylist()]
                    total, size = np.zeros((len(texts), len(names))), np.zeros(len(texts))
                    for own, points, owner, skip in folded(texts):
                        at = np.array(own)
                        for bucket, whose in grams(points, owner, skip, buckets):
                            if not len(whose):
                                continue
                            starts = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
                            np.add.at(total, at[whose[starts]], np.add.reduceat(matrix[bucket], starts, axis=0, dtype=np.float64))
                            np.add.at(size, at[whose[starts]], np.diff(np.r_[starts, len(whose)]))
                    # n-grams overlap: their evidence counts as that of the square root of their number
                    cool = total / np.sqrt(np.maximum(size, 1.0))[:, None]
                    before, sums = (batch.column(c).to_numpy(zero_copy_only=False) for c in (most, mass))
                    here = cool.max(1)
                    now = np.maximum(before, here)
                    sums = sums * np.exp(before - now) + np.exp(cool - now[:, None]).sum(1)
                    known = size > 0
                    lang = [names[i] if k and h > b else old for i, k, h, b, old in zip(cool.argmax(1), known, here, before, batch.column(best).to_pylist())]
                    made = [pa.array(lang, pa.string()), pa.array(np.where(known, now, -np.inf)), pa.array(np.where(known, sums, 0.0))]
                    yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], batch.column(text), *made], [*[f.name for f in fields], text, best, most, mass])

        rows = rows.mapInArrow(run, f"{kinds}, `{text}` string, `{best}` string, `{most}` double, `{mass}` double")
    score = F.when(F.col(mass) > 0, 1 / F.greatest(F.col(mass), F.lit(1.0))).otherwise(F.lit(0.0))
    return rows.select(*keep, F.col(best).alias("lang_pred"), score.alias("score"))


def identify(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang_pred, score) of all rows; learned from rows where `learn` holds and lang isn't null.

    A blank stands before and after every text, so counts and scores don't depend on what other rows
    there are in a task. Texts that are null or hold no letter, and all texts if nothing was learned, are
    `und` with score 0. Ties go to the first language in order. Repeated rows count as often as they
    occur, null ids are rows like others. Whole texts of any length are read, in parts that share the
    characters of n-grams over the cut. Only these columns are read, so no other can clash.
    """
    rows = docs.where(learn & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return predict(docs.select(F.col(key), F.col(text).alias("text")), [key], fit(rows))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents; rows whose crc32(doc_id) mod 4 is 2 are never learned from.

    Rows without an id aren't learned from and aren't held out, but are told; null texts and those without letters are
    `und`. Rows that repeat an id are rows of their own. An empty table gives no rows.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    got = identify(table(spark, sf_dir, "documents"), F.coalesce(rest != 2, F.lit(False)))
    return got.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
