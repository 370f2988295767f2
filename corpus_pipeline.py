"""Cleaning and packing a corpus: each stage works on all that its predecessor kept.

For all stages: an empty table gives an empty one, columns beside those of ``documents`` are dropped, and rows
with a null id are kept as they are unless their text alone is a reason to drop them (toxic, contaminated).
Rows that repeat an id are judged one by one but for near duplicates, where an id is one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, minhash, packing, substring, toxicity
from nearfield.llm._common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; labels only train the score. Null and empty texts score 0 and stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (similarity 0.8 or more of runs of five words).

    Null and wordless texts are duplicates of nothing. Of equal texts the smallest id stays; rows that repeat an id go or
    stay together.
    """
    found = minhash.near_duplicates(docs, percent=80, bands=45).where(~F.col("kept")).select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document (a smaller id) has; texts left without words go.

    Null texts and those without words from the start stay; where something is removed, the words left are joined by one
    space and ``n_chars`` is counted anew.
    """
    out = substring.remove_repeated_words(docs).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts have none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_contamination(docs, benchmark).where("n_hit = 0").select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document, those without words included (length 1, the end mark)."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_batches),
]

#: Training, sketches and packing aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
