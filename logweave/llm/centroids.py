"""Centroid clustering of integer vectors over a vector-approximation file.

Every vector has a few bits per dimension beside it: the cell its component lies in. For a set of
centroids, lookup tables hold the least and the greatest contribution that a cell can make to each
centroid's distance, so the sums over a row of cells are distance intervals. Where one interval lies
below all others, the nearest centroid is known without the vector; where intervals overlap the
vector itself is fetched.

Sums of clusters are exact integers and follow the moves: a round compares the nearest centroid
under the old and the new centroids, and only vectors that are open or have moved are fetched. The
table is columnar and laid out in parts by how clear a vector's choice is, so a round reads the
cells of all rows and the vectors of those parts only that hold an open or moved one. A round moves
nothing between tasks but a few sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import Scratch, cleaned, table

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
BITS = 7  # of a cell, so cells take 56 bytes of a row and the vector 256
SAMPLE = 8192  # vectors that the borders of the cells are taken from at most; any borders give right results
LIMIT = 1 << 27  # of an integer component; beyond, squared distances don't fit a long
PART_ROWS, MAX_PARTS = 4096, 4096  # rows of a part; more parts than that become larger instead
LAYOUT = 2  # rounds after which the parts are laid out
CHUNK = 4096  # rows that a task works on at once


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


class Cells:
    """Borders of 2^bits cells per dimension; the first and the last cell take what lies outside the sample."""

    def __init__(self, sample: np.ndarray, bits: int = BITS):
        self.bits, self.dims = bits, sample.shape[1]
        inner = np.quantile(sample, np.linspace(0, 1, (1 << bits) - 1), axis=0, method="nearest").astype(np.int64)
        inner[-1] += 1
        self.borders = np.ascontiguousarray(inner.T)  # cell j holds borders[j - 1] <= x < borders[j]
        outer = np.full((self.dims, 1), LIMIT)
        self.low, self.high = np.hstack([-outer, self.borders]), np.hstack([self.borders - 1, outer])

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Rows of packed cells."""
        cells = np.stack([np.searchsorted(self.borders[d], x[:, d], "right") for d in range(self.dims)], axis=1).astype(np.uint8)
        return np.packbits((cells[:, :, None] >> np.arange(self.bits, dtype=np.uint8) & 1).reshape(len(x), -1), axis=1)

    def decode(self, packed: pa.Array) -> np.ndarray:
        width = -(-self.dims * self.bits // 8)
        rows = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(-1, width)
        flags = np.unpackbits(rows, axis=1, count=self.dims * self.bits).reshape(len(rows), self.dims, self.bits)
        return flags @ (1 << np.arange(self.bits))


class Bounds:
    """Lookup tables of distance intervals to a set of centroids, and the exact comparison behind them.

    Distances are told less the distance to a reference centroid, so that terms common to both fall away
    and the intervals are narrow; each row's reference is the centroid whose interval has the nearest middle.
    """

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.cells, self.centroids, self.dims, self.tables = cells, centroids, cells.dims, {}

    def table(self, reference: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest contribution by (dimension, cell, centroid) to distance(x, centroid) - distance(x, reference), and what all cells have in common."""
        if reference not in self.tables:
            point = self.centroids[reference]
            factor = -2 * (self.centroids - point)
            ends = [factor.T[:, None, :] * side[:, :, None] for side in (self.cells.low, self.cells.high)]
            self.tables[reference] = (np.minimum(*ends), np.maximum(*ends), (self.centroids**2 - point**2).sum(1))
        return self.tables[reference]

    def intervals(self, cells: np.ndarray, reference: int) -> tuple[np.ndarray, np.ndarray]:
        least, most, base = self.table(reference)
        low, high = np.tile(base, (len(cells), 1)), np.tile(base, (len(cells), 1))
        for d in range(self.dims):
            low += least[d][cells[:, d]]
            high += most[d][cells[:, d]]
        return low, high

    def middles(self, cells: np.ndarray) -> np.ndarray:
        low, high = self.intervals(cells, 0)
        return (low + high) / 2

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """(row, centroid) flags of the centroids that may be as near as the row's reference, which is one of them."""
        reference, out = self.middles(cells).argmin(1), np.empty((len(cells), len(self.centroids)), bool)
        for r in np.unique(reference):
            own = reference == r
            out[own] = self.intervals(cells[own], r)[0] <= 0
        return out

    def nearest(self, x: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The nearest of the candidates, the smaller number of equally near ones."""
        far = np.iinfo(np.int64).max
        return np.stack([np.where(among[:, k], ((x - c) ** 2).sum(1), far) for k, c in enumerate(self.centroids)], axis=1).argmin(1)

    def clearness(self, cells: np.ndarray) -> np.ndarray:
        """By how much the second nearest centroid is farther than the nearest, by the middles of the intervals."""
        if len(self.centroids) < 2:
            return np.zeros(len(cells))
        two = np.partition(self.middles(cells), 1, axis=1)
        return two[:, 1] - two[:, 0]


def open_or_moved(cells: np.ndarray, old: Bounds, new: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that need their vector, and the candidates under both sets of centroids."""
    a, b = old.candidates(cells), new.candidates(cells)
    return (a.sum(1) > 1) | (b.sum(1) > 1) | (a.argmax(1) != b.argmax(1)), a, b


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def summed(changes: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Count and sums by cluster: one row a cluster comes to the driver."""
    rows = changes.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(dims)]).alias("sums")).collect()
    return {r["cluster"]: (r["n"], list(r["sums"])) for r in rows}


def partial_sums(clusters: int, dims: int, parts: Iterator[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    """Of (cluster, vectors, sign), what a task adds to each cluster."""
    n, sums = np.zeros(clusters, np.int64), np.zeros((clusters, dims), np.int64)
    for own, x, sign in parts:
        n += sign * np.bincount(own, minlength=clusters)
        np.add.at(sums, own, sign * x)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(clusters), pa.int32()), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


CHANGE = "cluster int, n long, sums array<long>"


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED, key: str = "vec_id", vector: str = "embedding", bits: int = BITS, part_rows: int = PART_ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance) of every kept vector, final centroids).

    Kept are vectors of exactly `dims` components, none null or non-finite; components become
    floor(scale * x). The `clusters` kept vectors with the smallest sha256 of `seed:key` start as
    centroids (fewer, if there are fewer; equal keys by their vector; a null key as an empty text). Each
    round assigns all vectors to the nearest centroid, ties to the smaller number, then moves every
    centroid that has vectors to the floor of their mean. Repeated rows are vectors of their own, also
    those with a null key. A component beyond LIMIT raises an error, as distances wouldn't fit a long.
    Other columns are left out, so none can clash. No kept vector: no rows and no centroids.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    v = F.col("v")
    sound = (F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.floor(c * float(scale)))
    fits = F.when(F.exists(whole, lambda c: F.abs(c) > LIMIT), F.raise_error(F.lit(f"a component is beyond {LIMIT}"))).otherwise(whole)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(sound)
    rows = scratch.save(rows.select(F.monotonically_increasing_id().alias("row"), "id", fits.cast("array<int>").alias("x")), "rows")
    id_type = rows.schema["id"].dataType
    result = T.StructType([T.StructField(key, id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    start = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "x").limit(clusters).select("x").toArrow()
    if not start.num_rows:
        return spark.createDataFrame([], result), np.zeros((0, dims), np.int64)
    centroids = matrix(start.column(0).combine_chunks(), dims)
    k = len(centroids)
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("x").toArrow()
    grid = Cells(matrix(sample.column(0).combine_chunks(), dims), bits)
    shared = spark.sparkContext.broadcast(grid)  # 2^bits borders a dimension

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            packed = pa.array([r.tobytes() for r in shared.value.encode(matrix(batch.column("x"), dims))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], [*batch.schema.names, "cells"])

    store = scratch.save(rows.mapInArrow(encode, T.StructType([*rows.schema.fields, T.StructField("cells", T.BinaryType())])), "store")
    scratch.drop("rows")

    def first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(shared.value, centroids)

        def own() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            for batch in chunks(batches):
                x = matrix(batch.column("x"), dims)
                yield bounds.nearest(x, np.ones((len(x), k), bool)), x, 1

        yield partial_sums(k, dims, own())

    def moves(old: np.ndarray, new: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, after = Bounds(shared.value, old), Bounds(shared.value, new)

            def own() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
                for batch in chunks(batches):
                    need, a, b = open_or_moved(shared.value.decode(batch.column("cells")), before, after)
                    if need.any():
                        x = matrix(batch.column("x").filter(pa.array(need)), dims)
                        left, came = before.nearest(x, a[need]), after.nearest(x, b[need])
                        moved = left != came
                        yield left[moved], x[moved], -1
                        yield came[moved], x[moved], 1

            yield partial_sums(k, dims, own())

        return run

    def touched(old: np.ndarray, new: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, after = Bounds(shared.value, old), Bounds(shared.value, new)
            for batch in chunks(batches):
                need = open_or_moved(shared.value.decode(batch.column("cells")), before, after)[0]
                parts = np.unique(batch.column("part").to_numpy()[need])
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32())], ["part"])

        return run

    def lay_out(now: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = Bounds(shared.value, now)
            for batch in chunks(batches):
                clear = bounds.clearness(shared.value.decode(batch.column("cells")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clear)], [*batch.schema.names, "clear"])

        marked = store.mapInArrow(run, T.StructType([*store.schema.fields, T.StructField("clear", T.DoubleType())]))
        parts = max(1, min(MAX_PARTS, -(-total // part_rows)))
        dealt = marked.repartitionByRange(parts, "clear", "row").withColumn("part", F.spark_partition_id())  # the row splits equal vectors
        path = scratch.path("parts")
        with cleaned(spark):
            dealt.drop("clear", "row").write.option("compression", "zstd").partitionBy("part").parquet(path)
        return spark.read.schema(T.StructType([*[f for f in store.schema.fields if f.name != "row"], T.StructField("part", T.IntegerType())])).parquet(path)

    counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    before, total = centroids, 0
    laid = False
    for n in range(1, rounds + 1):
        if n == 1:
            change = summed(store.select("x").mapInArrow(first_sums, CHANGE), dims)
        else:
            within = store
            if n > LAYOUT and not laid:
                store, laid = lay_out(centroids), True
                scratch.drop("store")
            if laid:
                parts = [r["part"] for r in store.select("part", "cells").mapInArrow(touched(before, centroids), "part int").distinct().collect()]
                within = store.where(F.col("part").isin(parts))
            change = summed(within.select("cells", "x").mapInArrow(moves(before, centroids), CHANGE), dims)
        for own, (more, add) in change.items():
            counts[own] += more
            sums[own] += np.array(add, np.int64)
        total = int(counts.sum())
        before, centroids = centroids, np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        if (before == centroids).all():
            break  # no later round can change anything

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(shared.value, centroids)
        for batch in chunks(batches):
            among, x = bounds.candidates(shared.value.decode(batch.column("cells"))), matrix(batch.column("x"), dims)
            own, unsure = among.argmax(1), among.sum(1) > 1
            own[unsure] = bounds.nearest(x[unsure], among[unsure])
            far = ((x - centroids[own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.int32()), pa.array(far)], result.names)

    return store.select("id", "cells", "x").mapInArrow(assign, result), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept embedding with its cluster: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Odd rows as in cluster_vectors; no rows for an empty table."""
    assigned, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    assigned = Scratch(spark, "clustered").save(assigned, "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row a cluster
    number = F.col("cluster")
    own = F.create_map(*[F.lit(x) for pair in inertia.items() for x in pair]).cast("map<int,bigint>")
    text = F.array(*[F.lit(",".join(map(str, c.tolist()))) for c in centroids]).cast("array<string>")
    return assigned.select("vec_id", "cluster", "distance", own[number].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.sha2(F.get(text, number), 256).alias("centroid_sha256"))


def _round(n: int) -> str:
    distance = "list_sum(list_transform(list_zip(v.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    return f"""a{n} as materialized (select rid, min({distance} * {CLUSTERS} + k) as best from v, c{n - 1} as c group by rid),
s{n} as (select (best % {CLUSTERS})::int as k, j, sum(x[j])::bigint as s, count(*) as n from a{n} join v using (rid), range(1, {DIMS + 1}) as g(j) group by 1, 2),
m{n} as (select k, list((s - ((s % n) + n) % n) // n order by j) as c from s{n} group by k),
c{n} as materialized (select c.k, coalesce(m.c, c.c) as c from c{n - 1} as c left join m{n} as m on m.k = c.k)"""


OP12_SQL = f"""with v as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::double)::bigint) as x from embeddings
  where len(embedding) = {DIMS} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {DIMS}),
c0 as materialized (select (row_number() over (order by sha256(concat('{SEED}:', vec_id)), x) - 1)::int as k, x as c from v qualify k < {CLUSTERS}),
{", ".join(_round(n) for n in range(1, ROUNDS + 2))},
f as (select v.vec_id, (best % {CLUSTERS})::int as cluster, best // {CLUSTERS} as distance from v join a{ROUNDS + 1} using (rid))
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from f join c{ROUNDS} on k = cluster"""
