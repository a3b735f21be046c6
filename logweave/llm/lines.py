"""Fuzzy line deduplication over a whole corpus.

Lines get MinHash signatures of their character shingles, high-recall bands put similar lines in
common buckets, candidate pairs are confirmed by exact Jaccard similarity, and distributed
union-find keeps the first line of each component. Equal lines are one node from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, blocks, fresh, possibly, table
from logweave.llm.linking import crowded, in_buckets, link
from logweave.llm.minhash import _ODD, _SEEDS, band_keys

SHINGLE = 8  # characters
BANDS, ROWS = 10, 4  # a pair at the threshold misses all bands with probability 0.005
NUM, DEN = 80, 100
BLOCK = 1 << 16  # bytes of lines that are signed at once, so their hashes stay in the processor's cache


BLANK = " \t\r\x0b\x0c\xa0"  # around a line; these and case don't tell lines apart


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, row, line_no, line, id): row is a hash of the whole text, line is in lower case and trimmed, id is null for blank lines, else 64 bits of the line's hash."""
    whole = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(whole).alias("row"), F.lower(whole).alias("text"))  # once a text, not once a line
    split = rows.select("doc", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    cut = split.withColumn("line", F.trim("line", F.lit(BLANK)))
    return cut.withColumn("id", F.when(F.col("line") != "", F.xxhash64("line")))


_MIX = {4: (0x9E3779B1, 0x85EBCA6B, 15), 8: (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 29)}


def rolled(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k values, as wide as these; windows of 2, 4, 8 ... are made of two halves."""
    kind = points.dtype.type
    odd, more, shift = (kind(x) for x in _MIX[points.itemsize])
    x = points * odd
    x ^= x >> shift
    out, used, width = None, 0, 1
    while width <= k:
        if width > 1:
            half = width // 2
            x = x[:-half] * odd + x[half:]
            x ^= x >> shift
            x *= more
        if k & width:
            if out is None:
                out = x
            else:
                n = min(len(out), len(x) - used)
                out = out[:n] * more + x[used : used + n]
                out ^= out >> shift
            used += width
        width *= 2
    return out


def char_shingles(texts: list[str], k: int, words: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 32 * words bits of all k-character shingles and where each text's begin. A shorter text is one shingle."""
    kind = (np.uint32, np.uint64)[words - 1]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(kind, copy=False)
    key = np.zeros(len(points), kind)
    if len(points) >= k:
        key[: len(points) - k + 1] = rolled(points, k)
    keep = np.ones(len(points), bool)
    for i in range(1, k):  # what would run into the next text
        keep[(ends - i)[sizes > i]] = False
    for i in np.flatnonzero((sizes < k) & (sizes > 0)):
        key[ends[i] - sizes[i]] = int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=4 * words).digest())
        keep[ends[i] - sizes[i]] = True
    counts = np.maximum(sizes - k + 1, 1)
    return key[keep], np.cumsum(counts) - counts


def line_bands(texts: list[str], k: int, bands: int, rows: int) -> np.ndarray:
    flat, starts = char_shingles(texts, k)
    minima, mixed = np.empty((bands * rows, len(texts)), np.uint32), np.empty_like(flat)
    for j in range(bands * rows):
        np.bitwise_xor(flat, _SEEDS[j], out=mixed)
        np.multiply(mixed, _ODD[j], out=mixed)
        np.minimum.reduceat(mixed, starts, out=minima[j])
    return band_keys(minima.T, rows)


def signed(lines: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """lines as (doc, row, line_no, id, bands); blank lines have no bands, nor have lines that came before in the same batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            known = ids.fill_null(0).to_numpy()
            first = np.unique(known, return_index=True)[1]
            place = np.sort(first[np.asarray(ids.is_valid())[first]])
            new = pa.RecordBatch.from_arrays([batch.column("line").take(pa.array(place))], ["line"])
            made = [line_bands(b.column("line").to_pylist(), k, bands, rows) for b in blocks(new, "line", BLOCK)]
            flat = np.concatenate(made).astype(np.int64).ravel() if made else np.zeros(0, np.int64)
            has = np.zeros(len(known), bool)
            has[place] = True
            offsets = np.concatenate([[0], np.cumsum(has) * bands]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc", "row", "line_no", "id")], keys], ["doc", "row", "line_no", "id", "bands"])

    return lines.select("doc", "row", "line_no", "id", "line").mapInArrow(run, "doc long, row long, line_no int, id long, bands array<long>")


_PAIR = np.uint64(54)  # bits of a shingle's hash beside the number of its pair


def paired(texts: list[str], k: int) -> np.ndarray:
    """The distinct shingles of each text: 54 bits of their hashes below the text's number, sorted. At most 1,024 texts."""
    flat, starts = char_shingles(texts, k, 2)
    number = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(np.append(starts, len(flat))))
    flat = np.sort(number << _PAIR | flat >> np.uint64(64 - 54))
    return flat[np.append(True, flat[1:] != flat[:-1])] if len(flat) else flat


def text_overlap(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """pairs (a, b, ...) with common and union of the character shingles of their texts (id, line)."""
    left = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    right = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
    fields = list(pairs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (x.slice(at, 512) for x in blocks(whole, "line_b", 1 << 18) for at in range(0, x.num_rows, 512)):
                a, b = (paired(batch.column(c).to_pylist(), k) for c in ("line_a", "line_b"))
                both = np.sort(np.concatenate([a, b]))
                common = np.bincount(both[1:][both[1:] == both[:-1]] >> _PAIR, minlength=batch.num_rows)
                union = np.bincount(both >> _PAIR, minlength=batch.num_rows) - common
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(common, pa.int64()), pa.array(union, pa.int64())], [*[f.name for f in fields], "common", "union"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return pairs.join(left, "b").join(right, "a").select(*pairs.columns, "line_a", "line_b").mapInArrow(run, f"{kinds}, common long, union long")


def text_items(texts: DataFrame, k: int) -> DataFrame:
    """(id, items): 64-bit hashes of the distinct character shingles of (id, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "line", 1 << 18):
                lines = batch.column("line").to_pylist()
                flat, starts = char_shingles(lines, k, 2)
                items = [np.unique(x) for x in np.split(flat, starts[1:])] if lines else []
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.view(np.int64) for x in items], pa.list_(pa.int64()))], ["id", "items"])

    return texts.select("id", "line").mapInArrow(run, "id long, items array<long>")


def sized(texts: DataFrame, k: int) -> DataFrame:
    """(id, n): the number of distinct character shingles of (id, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "line", 1 << 18):
                flat, starts = char_shingles(batch.column("line").to_pylist(), k, 2)
                counts = [len(np.unique(x)) for x in np.split(flat, starts[1:])] if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64())], ["id", "n"])

    return texts.select("id", "line").mapInArrow(run, "id long, n long")


def line_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per line: doc, row, line_no (from 0), rep_doc, rep_line (the first line of its component), kept.

    Lines are cut at "\\n"; case and outer blanks don't matter. Lines with 100 * common >= 80 * union
    of their distinct 8-character shingles are linked; a shorter line is one shingle. Blank lines are
    their own component and kept. Null texts have no lines. The first line is that with the smallest
    (document, line number, hash of the document's text `row`), null ids first. Rows that repeat a
    document id with another text are documents of their own; those that repeat id and text are one
    document, their lines share a fate. Only key and text are read, so no other column can clash. An
    empty table gives no rows. Nodes are 64-bit hashes of lines: two different lines of n share one with
    probability n / 2^64.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = scratch.save(signed(lines_of(docs, key, text), k), "signed")
    # a bucket's rows are counted before ids are looked at: most lines share none and go no further
    keys = rows.where(F.col("bands").isNotNull()).select(F.explode("bands").alias("bucket"), "id")
    several = scratch.save(crowded(keys, scratch, "shared").distinct(), "several")
    members = scratch.save(in_buckets(several), "members")
    wanted = scratch.save(members.select("id").distinct(), "wanted")
    scratch.drop("shared", "several")
    texts = possibly(wanted, lines_of(docs, key, text).select("id", "line")).join(wanted, "id").groupBy("id").agg(F.min("line").alias("line"))
    texts = scratch.save(texts, "texts")
    members = members.join(sized(texts, k), "id").select("bucket", "id", "n")
    roots = link(members, lambda pairs: text_overlap(pairs, texts, k), lambda ids: text_items(texts.join(ids, "id", "left_semi"), k), num, den, scratch, extension=0)
    # blank lines stay apart: they have no group
    named = rows.select("doc", "row", "line_no", "id").join(roots, "id", "left").select("doc", "row", "line_no", F.coalesce("root", "id").alias("group"))
    named = scratch.save(named, "named")
    scratch.drop("signed", "members", "wanted", "texts")
    place = F.struct("doc", "line_no", "row")
    repeated = (
        named.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("group", "first")
    )
    out = named.join(repeated, "group", "left").withColumn("first", F.coalesce("first", place))
    return out.select("doc", "row", "line_no", F.col("first.doc").alias("rep_doc"), F.col("first.line_no").alias("rep_line"), (F.col("first") == place).alias("kept"))


def without(text: Column, gone: Column) -> Column:
    """A text without the lines of these numbers (sorted): what lies between two of them is taken in one piece."""
    between = lambda lines: F.transform(
        F.sequence(F.lit(0), F.size(gone)),
        lambda i: F.slice(lines, F.when(i == 0, 1).otherwise(F.get(gone, i - 1) + 2), F.coalesce(F.get(gone, i), F.size(lines)) - F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)),
    )
    # one element: the lines are split once, not once for each gap
    return F.array_join(F.flatten(F.flatten(F.transform(F.array(F.split(text, "\n", -1)), between))), "\n")


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text of all kept lines. Same columns and rows; documents that lose nothing, also null and empty ones, are unchanged."""
    doc, row, gone = fresh(docs, "__doc", "__row", "__gone")
    lost = line_components(docs, key, text).where("not kept").groupBy(F.col("doc").alias(doc), F.col("row").alias(row)).agg(F.sort_array(F.collect_set("line_no")).alias(gone))
    joined = docs.join(lost, F.col(key).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text).cast("string")) == F.col(row)), "left")
    return joined.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(without(F.col(text).cast("string"), F.col(gone)))).select(*docs.columns)


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents: doc_id, line_no, rep_doc_id, rep_line_no, kept."""
    got = line_components(table(spark, sf_dir, "documents"))
    return got.select(F.col("doc").alias("doc_id"), "line_no", F.col("rep_doc").alias("rep_doc_id"), F.col("rep_line").alias("rep_line_no"), "kept")
