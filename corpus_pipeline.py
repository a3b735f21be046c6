"""The corpus pipeline: documents through toxicity, line dedup, near-dedup, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
into the shared folder and reads it back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import lines, minhash, mixing, pieces, toxicity
from logweave.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. Labels of held-out documents aren't used."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"), learn)


def drop_fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the lines that come first in the corpus; all documents stay, n_chars follows the text."""
    return lines.drop_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.keep_first(docs, shingle=5, num=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole: a source's budget ends with the last one that fits."""
    return mixing.repeat_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chunks, n_pieces, ids, round_trip of every document."""
    return pieces.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_fuzzy_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# Models, signatures and pieces have no SQL form; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
