"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. Words are summed by source and hash bucket;
the running sum finds the bucket in which a source's budget ends, only that bucket is
split further, and after three nested histograms the threshold is exact. Nothing is sorted:
a document is taken when its hash is below its source's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, fresh, table

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = (14, 14, 32)  # bits of the 60-bit hash that each histogram resolves; few documents reach the last
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def id_hash(key: Column) -> Column:
    """60 bits of the id's MD5: stable between runs, engines and cluster sizes."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of sources: shares of all words by weight, no source above max_repeats times its size.

    `sizes` has one row per source (source, source_size). Sources take the weights in turn, by code
    point, null last. What capped sources can't use is shared again by weight until none is above.
    The ranks come from range partitions and their counts, so no task holds all sources.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "targets")
    parts = scratch.save(
        sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "parts"
    )
    offset = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = parts.withColumn("inside", inside).join(offset.select("part", "before"), "part").withColumn("rank", F.col("before") + F.col("inside"))
    ranked = scratch.save(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_repeats)).alias("most")), "ranked"
    )
    level = 0.0
    while True:  # each round caps at least one more source; only four sums come to the driver
        capped = F.col("most") <= F.col("weight") * level
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("most"))).alias("most"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")
        ).first()
        if row["all"] is None or row["weight"] is None:
            break
        new = (row["all"] - (row["most"] or 0.0)) / row["weight"]
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: key, source, size, source_size, target and taken (words, repeats counted).

    A source takes all its documents floor(target / source_size) times and, for the rest, those with
    the smallest hashes once more. The document in which the budget ends is taken up to the budget;
    documents that tie there (repeated rows of an id) share it in proportion to their size. Null text
    has size 0; a source without words has target 0; null sources form one source; a null id hashes
    as the empty string. Other columns are left out, so none can clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = scratch.save(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), id_hash(F.col(key)).alias("hash")), "sized"
    )
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn(
        "left", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    )
    plan = scratch.save(plan.withColumn("prefix", F.lit(0).cast("long")), "plan0")
    shift = sum(LEVELS)
    same = F.expr("b.source <=> p.source")
    for n, bits in enumerate(LEVELS, 1):
        shift -= bits
        inside = base.alias("b").join(plan.alias("p"), same & (F.shiftright("b.hash", shift + bits) == F.col("p.prefix")))
        bins = inside.groupBy("p.source", F.shiftright("b.hash", shift).alias("bin")).agg(F.sum("b.size").alias("words"))
        order = Window.partitionBy("source").orderBy("bin")
        summed = bins.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("b")
        boundary = (
            summed.join(plan.alias("p"), same)
            .where(F.col("b.upto") > F.col("p.left"))
            .groupBy("b.source")
            .agg(F.min_by(F.struct("b.bin", (F.col("b.upto") - F.col("b.words")).alias("before"), "b.words"), F.col("b.bin")).alias("cut"))
            .alias("b")
        )
        # a source whose bins all fit below its budget keeps no boundary: prefix -1 matches nothing more
        cut = plan.alias("p").join(boundary, same, "left")
        plan = scratch.save(
            cut.select(
                "p.source", "p.source_size", "p.target", "p.whole",
                (F.col("p.left") - F.coalesce(F.col("b.cut.before"), F.lit(0))).alias("left"),
                F.coalesce(F.col("b.cut.bin"), F.lit(-1)).alias("prefix"),
                F.col("b.cut.words").alias("tied"),
            ),
            f"plan{n}",
        )
    once_more = (
        F.when(F.col("p.prefix") < 0, F.lit(0))
        .when(F.col("b.hash") < F.col("p.prefix"), F.col("b.size"))
        .when(F.col("b.hash") == F.col("p.prefix"), F.floor(F.col("p.left") * F.col("b.size") / F.col("p.tied")))
        .otherwise(F.lit(0))
    )
    return base.alias("b").join(plan.alias("p"), same).select(
        F.col("b.key").alias(key), F.col("b.source").alias(source), "b.size", "p.source_size", "p.target",
        (F.col("p.whole") * F.col("b.size") + once_more).cast("long").alias("taken"),
    )


def repeat_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it whole: floor(taken / size) times.

    The one document in which a source's budget ends counts only if it fits. Rows without words can't
    be counted by words; they stay once. Repeated rows of an id are taken alike, ids are matched null-safe.
    """
    id_, words, size, times, copy = fresh(docs, "__key", "__words", "__size", "__times", "__copy")
    plan = mix(docs, key, text, source).where("size > 0").select(F.col(key).alias(id_), F.col("size").alias(size), F.floor(F.col("taken") / F.col("size")).cast("int").alias(times))
    plan = plan.groupBy(id_, size).agg(F.max(times).alias(times))
    found = docs.withColumn(words, word_count(F.col(text))).join(plan, F.col(key).eqNullSafe(F.col(id_)) & (F.col(words) == F.col(size)), "left")
    found = found.withColumn(times, F.coalesce(times, F.lit(1))).where(F.col(times) > 0)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as hash
  from documents),
src as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rn from sized group by source),
w as (select *, ((rn - 1) % 3 + 1)::double as weight, 3.0::double * source_size as most from src),
run as (
  select *, sum(most) over o - most as capped_before, sum(weight) over () - (sum(weight) over o - weight) as weight_left,
         sum(source_size) over () as total
  from w window o as (order by most / weight, rn rows between unbounded preceding and current row)),
lev as (
  select arg_min((total - capped_before)::double / weight_left, most / weight) as level from run where most / weight >= (total - capped_before)::double / weight_left),
plan as (
  select source, source_size, case when level is null then most else least(most, weight * level) end as target
  from w, lev),
plan2 as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from plan),
plan3 as (select *, floor(target - whole * source_size)::bigint as budget from plan2),
tie as (select source, hash, sum(size)::bigint as tied from sized group by source, hash),
cum as (select *, sum(tied) over (partition by source order by hash rows between unbounded preceding and current row)::bigint as upto from tie)
select s.doc_id, s.size, p.source_size, p.target,
  (p.whole * s.size + case when c.upto <= p.budget then s.size
     when c.upto - c.tied < p.budget then floor((p.budget - (c.upto - c.tied)) * s.size::double / c.tied)::bigint else 0 end)::bigint as taken
from sized s join plan3 p on s.source is not distinct from p.source
join cum c on s.source is not distinct from c.source and s.hash = c.hash
"""
