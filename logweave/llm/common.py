"""What the training-data operators share: a scratch store and bounded Arrow batches."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python tasks work on at most about this many bytes of text at once.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session (tests) that names none gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


# shuffle files go when a query ends, and Arrow batches of long texts stay small
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """SETTINGS for the queries that are run inside."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
        pa.default_memory_pool().release_unused()  # what the driver collected before


def release(spark: SparkSession) -> None:
    """Free what earlier queries left on the driver.

    Broadcasts, plans and shuffle files go when the objects that name them are collected, which a driver
    with room in its heap puts off: Python's names first, then the JVM's, which gives free heap back.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def heap(spark: SparkSession) -> tuple[int, int]:
    """Bytes in use of the driver's heap, and the most it may have."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    return runtime.totalMemory() - runtime.freeMemory(), runtime.maxMemory()


class Scratch:
    """Parquet tables in the shared folder; they cut lineage and outlive lost executors. Each operator begins with one, on a driver without the leftovers of the last.

    An operator of very many queries leaves as much itself: when they have taken a SHARE-th of the heap's limit, that is freed too.
    """

    SHARE = 8

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.release()
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def release(self) -> None:
        release(self.spark)
        self.least = heap(self.spark)[0]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with cleaned(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        used, limit = heap(self.spark)
        if (used - self.least) * self.SHARE > limit:
            self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later read needs."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with a number after each that a column of df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        n, free = 0, name
        while free.lower() in taken:
            n += 1
            free = f"{name}{n}"
        taken.add(free.lower())
        out.append(free)
    return out


BITS = 25


def possibly(ids: DataFrame, rows: DataFrame, column: str = "id") -> DataFrame:
    """rows (column, ...) without most of those whose value isn't in ids (id), before anything is shuffled.

    A bitmap of 2^25 bits over the ids is broadcast (4 MB at any input size). With very many ids it
    lets more rows through; the join after it decides. That should be an inner join: Spark moves a semi
    join below this one, so all rows would be shuffled for it.
    """
    spark = ids.sparkSession
    (name,) = fresh(rows, "__bitmap")
    place = ids.select(F.pmod("id", F.lit(1 << BITS)).alias("h")).distinct()
    words = place.groupBy(F.shiftright("h", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    with cleaned(spark):
        words = words.toArrow()
    bitmap = np.zeros(1 << BITS - 6, np.int64)
    bitmap[words.column(0).to_numpy()] = words.column(1).to_numpy()
    one = spark.createDataFrame(pa.table({name: pa.array([bitmap], pa.list_(pa.int64()))}))
    h = f"pmod(`{column}`, {1 << BITS})"
    hit = F.expr(f"(shiftrightunsigned(get(`{name}`, cast({h} >> 6 as int)), cast({h} & 63 as int)) & 1) = 1")
    return rows.where(F.col(column).isNotNull()).join(F.broadcast(one), hit).drop(name)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column holds about `limit` bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
