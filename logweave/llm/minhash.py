"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of band hashes are computed per document, and a table key is a pair of one
from each: 8 + 8 bands of 3 values give 64 tables of 6 values from 48 minimum hashes instead of
384. A document enters a table only where both its halves are shared with another document.
Links are confirmed on the full shingle sets and joined by distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, blocks, fresh, possibly, table
from logweave.llm.linking import crowded, in_buckets, link, set_overlap

SHINGLE = 3
BANDS = 8  # of each of the two collections
ROWS = 3  # minimum hashes of a band
BLOCK_BYTES = 1 << 18  # of text that are hashed at once: each byte takes several 8-byte numbers
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.Generator(np.random.PCG64(7))
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_SEEDS = _RANDOM.integers(0, 1 << 32, 256, np.uint32)
_ODD = _RANDOM.integers(0, 1 << 32, 256, np.uint32) | np.uint32(1)
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]).astype(np.uint64) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words in lower-cased bytes."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(b) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * power[: len(b)], dtype=np.uint64)])
    return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words in order; long texts in pieces cut at white space."""
    text = text.translate(_LOWER)
    out, at = [], 0
    while at < len(text):
        end = at + BLOCK_BYTES
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        out.append(_word_hashes(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    take = min(k, len(words))
    total = np.full(len(words) - take + 1, take if take < k else 0, np.uint64)
    for i in range(take):
        total = mix64(total * np.uint64(0x9FB21C651E98DF25) + words[i : len(words) - take + 1 + i])
    return np.unique(total)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The shingle set of each text. Texts of a block are hashed together."""
    lengths = [len(t or b"") for t in texts]
    if sum(lengths) > 2 * BLOCK_BYTES:
        return [shingles(word_hashes(t or b""), k) for t in texts]
    joined = b" ".join(t or b"" for t in texts).translate(_LOWER)
    words, start = _word_hashes(joined) if joined else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    ends = np.searchsorted(start, np.cumsum(np.array(lengths) + 1) - 1, "right")
    return [shingles(words[a:b], k) for a, b in zip([0, *ends[:-1]], ends)]


def min_hashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(set, n) smallest hashes under n random functions; all sets must have items."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out, mixed = np.empty((n, len(sets)), np.uint32), np.empty_like(flat)
    for j in range(n):
        np.bitwise_xor(flat, _SEEDS[j], out=mixed)
        np.multiply(mixed, _ODD[j], out=mixed)
        np.minimum.reduceat(mixed, starts, out=out[j])
    return out.T


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """(set, band) keys of rows minimum hashes each; the band's number is part of its key."""
    bands = minima.shape[1] // rows
    key = np.tile(np.arange(bands, dtype=np.uint64), (len(minima), 1))
    for r in range(rows):
        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + minima[:, r::rows][:, :bands].astype(np.uint64))
    return key


def signatures(docs: DataFrame, key: str, text: str, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, row, n_shingles, node, halves) per row: row is a hash of the text, node one of the shingle set, halves are 2 * bands keys (node and halves are null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text", BLOCK_BYTES):
                sets = shingle_sets(batch.column("text").to_pylist(), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                halves, nodes = [None] * len(sets), [None] * len(sets)
                if full:
                    got = band_keys(min_hashes([sets[i] for i in full], 2 * bands * rows), rows)
                    for i, row in zip(full, got.astype(np.int64)):
                        halves[i] = row
                        both = np.array([sets[i].sum(dtype=np.uint64), mix64(sets[i]).sum(dtype=np.uint64), len(sets[i])], np.uint64)
                        nodes[i] = int(np.bitwise_xor.reduce(mix64(both * np.array([_BASE, 1, _BASE], np.uint64) + np.arange(3, dtype=np.uint64))).astype(np.int64))
                made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(halves, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), *made], ["id", "row", "n_shingles", "node", "halves"])

    rows_ = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("row"), F.col(text).cast("binary").alias("text"))
    return rows_.mapInArrow(run, "id long, row long, n_shingles long, node long, halves array<long>")


def item_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, items) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text", BLOCK_BYTES):
                sets = [s.view(np.int64) for s in shingle_sets(batch.column("text").to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "items"])

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, items array<long>")


def tensored(sets: DataFrame, scratch: Scratch, bands: int = BANDS) -> DataFrame:
    """(bucket, id) of sets (id, halves) for all tables in which a set shares its bucket.

    Each half is counted first; only pairs of shared halves are formed, so most sets form none.
    """
    halves = sets.select("id", F.posexplode("halves").alias("slot", "bucket"))
    shared = crowded(halves.select("bucket", "id", "slot"), scratch, "shared")
    own = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("slot", "bucket"))).alias("own"))  # 2 * bands at most
    first, second = F.filter("own", lambda x: x["slot"] < bands), F.filter("own", lambda x: x["slot"] >= bands)
    pairs = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a["bucket"], b["bucket"]))))
    tables = scratch.save(own.select(F.explode(pairs).alias("bucket"), "id").distinct(), "tables")
    return in_buckets(tables)


def components(docs: DataFrame, key: str, text: str, shingle: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(id, row, n_shingles, component) per row; component is the smallest id of the linked rows, null without an id, and the own id if nothing is linked."""
    rows = scratch.save(signatures(docs, key, text, shingle), "signatures")
    alive = rows.where(F.col("id").isNotNull() & F.col("node").isNotNull())
    place = F.struct("id", "row")
    first = alive.groupBy("node").agg(F.min(place).alias("rep"), F.first("halves").alias("halves"), F.first("n_shingles").alias("n"))
    first = scratch.save(first.select(F.col("node").alias("id"), "rep", "halves", "n"), "sets")
    members = scratch.save(tensored(first, scratch).join(first.select("id", "n"), "id").select("bucket", "id", "n"), "members")
    scratch.drop("shared", "tables")
    # one row stands for all whose sets are equal; only such rows' texts are shuffled
    wanted = first.join(members.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("node"), "rep.id", F.col("rep.row").alias("row"))
    wanted = scratch.save(wanted, "wanted")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("row"), F.col(text).alias("text"))
    texts = possibly(wanted.select(F.col("row").alias("id")), texts, "row").join(wanted, ["id", "row"]).select(F.col("node").alias("id"), "text").dropDuplicates(["id"])
    sets = scratch.save(item_sets(texts, shingle), "items")
    roots = link(members, lambda pairs: set_overlap(pairs, sets), lambda ids: sets.join(ids, "id", "left_semi"), num, den, scratch)
    named = first.select("id", F.col("rep.id").alias("least")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = scratch.save(named.join(smallest, "root").select(F.col("id").alias("node"), "component"), "named")
    out = rows.drop("halves").join(named, "node", "left")
    return out.select("id", "row", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, num: int = 85, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id, kept) per row: rows with den * common >= num * union of their shingle sets are linked.

    Texts are lower-cased (A-Z) and cut at white space; a text with fewer words than a shingle is one
    shingle, an empty or null one is empty and alone. component_id is the smallest id that can be
    reached, kept says that it is the row's own; a null id takes no part, its row is kept and has no
    component. Rows that repeat an id are linked by their texts like all others; equal sets are compared
    once. Only key and text are read, so no other column can clash. An empty table gives no rows. Nodes
    are 64-bit hashes of sets: two different sets of n share one with probability n / 2^64.
    """
    found = components(docs, key, text, shingle, num, den, Scratch(docs.sparkSession, "minhash"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return found.select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group: that with the smallest id, then the smallest hash of its text.

    Rows that repeat both are one row; which of their other columns stay isn't defined. Rows whose id is
    null or whose text has no words stay. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "keep-first")
    found = components(docs, key, text, shingle, num, den, scratch).where("component is not null and n_shingles > 0")
    found = scratch.save(found.groupBy("component", "id", "row").agg(F.count("*").alias("copies")), "found")
    first = found.groupBy("component").agg(F.min(F.struct("id", "row")).alias("first"))
    judged = found.join(first, "component").withColumn("stays", F.struct("id", "row") == F.col("first"))
    doc, row = fresh(docs, "__doc", "__row")
    names = [F.col("id").alias(doc), F.col("row").alias(row)]
    gone = scratch.save(judged.where("not stays or copies > 1").select(*names, "stays"), "gone")
    hashed = docs.withColumns({doc: F.col(key).cast("long"), row: F.xxhash64(F.col(text).cast("string"))})
    rest = hashed.join(gone.drop("stays"), [doc, row], "left_anti").select(*docs.columns)
    twice = gone.where("stays").drop("stays")
    if twice.isEmpty():
        return rest
    one = possibly(twice.select(F.col(row).alias("id")), hashed, row).join(twice, [doc, row]).dropDuplicates([doc, row])
    return rest.unionByName(one.select(*docs.columns))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_shingles, component_id, kept; 3-word shingles, Jaccard similarity 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))
