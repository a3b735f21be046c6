"""Approximate nearest neighbours by an inverted multi-index, for largest inner product.

Both halves of the vectors are quantised with codebooks of their own; a cell is a pair of
centroids. A query walks the pairs by falling sum of its two half products with a heap, until the
cells passed hold a share of all rows, and only their rows are scored exactly. The share is fitted:
the smallest of a grid that finds nearly all true neighbours within the bounded sample that the
codebooks are fitted on. All rows are indexed.

Rows and queries lie in blocks of neighbouring cells; a cell with very many rows has several blocks.
A query goes to the blocks that hold a cell it passes, a block of rows to the blocks of queries that
come to it, so what isn't passed isn't moved either.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, table

SAMPLE = 16_384  # distinct vectors that the codebooks are fitted on at most
CENTROIDS = 64
TRIALS = 256  # sampled queries for fitting the share of rows to pass
SHARES = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.8, 1.0)
RECALL = 0.93  # wanted within the sample
QUERY_BLOCK, ROW_BLOCK = 4096, 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids of at most k clusters, started from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        for j in range(len(c)):
            if (own := near == j).any():
                c[j] = x[own].mean(0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (2 * (x @ c.T) - (c * c).sum(1)).argmax(1)


class Index:
    """Two codebooks, the number of rows in each cell and the share of rows that a query passes."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.half = first, second, first.shape[1]
        self.counts = np.zeros(len(first) * len(second), np.int64)
        self.share = 1.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first) * len(self.second) + nearest(x[:, self.half :], self.second)

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Cells by falling sum of the query's half products with their centroids (multi-sequence order)."""
        a, b = self.first @ query[: self.half], self.second @ query[self.half :]
        by_a, by_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b = a[by_a].tolist(), b[by_b].tolist()
        done = [0] * len(a)  # how far each row of the grid has been passed
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield by_a[i] * len(by_b) + by_b[j]
            done[i] = j + 1
            if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if i + 1 < len(a) and done[i + 1] == j:
                heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))

    def last(self, query: np.ndarray, wanted: int) -> float:
        """The sum of the cell at which `wanted` rows, or all, have been passed: cells of at least that sum are passed."""
        held, sums, a, b = 0, 0.0, self.first @ query[: self.half], self.second @ query[self.half :]
        for cell in self.walk(query):
            i, j = divmod(cell, len(b))
            sums = float(a[i] + b[j])
            if (held := held + self.counts[cell]) >= wanted:
                break
        return sums

    def passed(self, queries: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(query, cell) flags of the cells passed."""
        a, b = queries[:, : self.half] @ self.first.T, queries[:, self.half :] @ self.second.T
        return ((a[:, :, None] + b[:, None, :]) >= (last - 1e-9 * (1 + np.abs(last)))[:, None, None]).reshape(len(queries), -1)


def cut_blocks(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell: blocks of about `size` rows in the order of cells; a larger cell has blocks of its own."""
    first, many, block, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > size:
            block, held = block + 1, 0
        first[cell] = block
        held += n
        if n > size:
            many[cell] = -(-n // size)
            block, held = block + int(many[cell]), 0
    return first, many


def fit_index(sample: np.ndarray, k: int, centroids: int = CENTROIDS, recall: float = RECALL) -> Index:
    """Codebooks and share from a bounded sample of vectors (rows of float64)."""
    half = sample.shape[1] // 2
    index = Index(kmeans(sample[:, :half], centroids), kmeans(sample[:, half:], centroids))
    cell = index.cells(sample)
    index.counts = np.bincount(cell, minlength=len(index.counts))
    trials = sample[np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)]
    scores = trials @ sample.T
    k = min(k, len(sample))
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    need = []  # rows that lie in the cells passed up to each true neighbour's
    for query, best in zip(trials, true):
        place = {c: n for n, c in enumerate(index.walk(query))}
        upto = np.cumsum(index.counts[list(place)])
        need += [upto[place[c]] for c in cell[best].tolist()]
    part = np.array(need) / len(sample)
    index.share = next((s for s in SHARES if (part <= s).mean() >= recall), 1.0)
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest_neighbours(vectors: DataFrame, is_query: str, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, nearest first, ties to the smaller id.

    Rows whose vector is null, zero, holds a null or non-finite component or has another length than
    the most frequent one, or whose id is null, take no part. Repeated rows count once; a query never
    finds rows of its own id. Of equal vectors one is indexed; it stands for their k + 1 smallest ids,
    more can't be among the k nearest, so a vector that very many rows share costs no more than others.
    Fewer than k others: all of them. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.expr(is_query).alias("asks"))
    sound = F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0)
    rows = rows.where(sound)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == length["n"])
    same = rows.groupBy("v").agg(F.min("id").alias("vkey"), F.max("asks").alias("asks"))
    distinct = scratch.save(same, "distinct")
    # the window keeps k + 1 rows of a vector per task before it shuffles
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = rows.select("v", "id").distinct().withColumn("n", place).where(F.col("n") <= k + 1)
    ids = scratch.save(ids.join(distinct, "v").select("vkey", "id"), "ids")

    sample = distinct.orderBy(F.xxhash64("vkey"), "vkey").limit(SAMPLE).select("v").toArrow()
    index = fit_index(_matrix(sample.column(0).combine_chunks()), k + 1)
    shared = spark.sparkContext.broadcast(index)

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("vkey"), batch.column("v"), pa.array(cells.astype(np.int32)), batch.column("asks")], ["vkey", "v", "cell", "asks"])

    placed = scratch.save(distinct.select("vkey", "v", "asks").mapInArrow(place_rows, "vkey long, v array<double>, cell int, asks boolean"), "cells")
    asking = np.zeros(len(index.counts), np.int64)
    for row in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).collect():  # at most CENTROIDS squared
        index.counts[row["cell"]], asking[row["cell"]] = row["n"], row["asking"]
    n = int(index.counts.sum())
    wanted = max(int(np.ceil(index.share * n)), k + 1)
    row_cut, query_cut = cut_blocks(index.counts, ROW_BLOCK), cut_blocks(asking, QUERY_BLOCK)
    full = spark.sparkContext.broadcast((index, row_cut, query_cut))  # a few numbers a cell

    def block_of(cut: tuple[np.ndarray, np.ndarray], cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
        first, many = cut
        return (first[cells] + (keys * 0x9E3779B1 >> 16) % many[cells]).astype(np.int32)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (first, many), query_cut = full.value
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                v, keys = _matrix(batch.column("v")), batch.column("vkey").to_numpy()
                last = np.array([index.last(q, wanted) for q in v])
                flags = index.passed(v, last)
                reached = [np.unique(np.concatenate([np.arange(first[c], first[c] + many[c]) for c in np.flatnonzero(f & (index.counts > 0))])).astype(np.int32) for f in flags]
                made = [pa.array(last), pa.array(block_of(query_cut, batch.column("cell").to_numpy(), keys)), pa.array(reached, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("vkey"), batch.column("v"), *made], ["vkey", "v", "last", "qb", "reached"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_cut = full.value[1]
        for batch in batches:
            rb = block_of(row_cut, batch.column("cell").to_numpy(), batch.column("vkey").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("vkey"), batch.column("v"), batch.column("cell"), pa.array(rb)], ["vkey", "v", "cell", "rb"])

    queries = placed.where("asks").select("vkey", "v", "cell").repartition(max(1, min(int(asking.sum()) // 64, 4096)))
    queries = scratch.save(queries.mapInArrow(ask, "vkey long, v array<double>, last double, qb int, reached array<int>"), "queries")
    queries = queries.select("vkey", "v", "last", "qb", F.explode("reached").alias("rb"))
    meet = queries.select(F.col("qb").alias("qb"), F.col("rb").alias("rb")).distinct()
    entries = placed.select("vkey", "v", "cell").mapInArrow(lay, "vkey long, v array<double>, cell int, rb int").join(meet, "rb")

    def score(q: pa.Table, e: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if q.num_rows and e.num_rows:
            index = full.value[0]
            e = e.sort_by("vkey")
            qv, ev = (_matrix(t.column("v").combine_chunks()) for t in (q, e))
            qk, ek, cell = q.column("vkey").to_numpy(), e.column("vkey").to_numpy(), e.column("cell").to_numpy()
            last = q.column("last").to_numpy()
            for at in range(0, len(qk), 256):
                flags = index.passed(qv[at : at + 256], last[at : at + 256])
                use = np.flatnonzero(flags.any(0)[cell])  # rows of cells that any of these queries passes
                if not len(use):
                    continue
                s = np.where(flags[:, cell[use]], qv[at : at + 256] @ ev[use].T, -np.inf)
                most = min(k + 1, len(use))
                least = np.partition(s, len(use) - most, axis=1)[:, len(use) - most]
                r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                order = np.lexsort((c, -s[r, c], r))  # rows are sorted by id: ties keep the smaller
                r, c = r[order], c[order]
                first = np.searchsorted(r, r)
                keep = np.arange(len(r)) - first < most
                r, c = r[keep], use[c[keep]]
                found.append((qk[at + r], ek[c], np.einsum("ij,ij->i", qv[at + r], ev[c])))
        parts = [np.concatenate(x) if found else np.array([]) for x in (zip(*found) if found else ((), (), ()))]
        return pa.table({"q": pa.array(parts[0], pa.int64()), "e": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    hits = queries.groupBy("qb", "rb").cogroup(entries.groupBy("qb", "rb")).applyInArrow(score, "q long, e long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "e")
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    # vectors to ids, the k + 1 best of a query vector, then each query of that vector without its own id
    named = hits.join(ids.withColumnRenamed("vkey", "e"), "e")
    nearest_ids = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    named = named.withColumn("n", F.row_number().over(nearest_ids)).where(F.col("n") <= k + 1).select("q", "id", "score")
    askers = rows.where("asks").select("v", F.col("id").alias("query_id")).distinct().join(distinct.select("v", F.col("vkey").alias("q")), "v").select("q", "query_id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = askers.join(named, "q").where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every embedding whose vec_id is divisible by 20."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
