"""A corpus pipeline of the training-data operators.

Language identification, near-dedup, substring dedup, benchmark decontamination
and mixing.  Each stage gets what its predecessor kept, written as Parquet in
the shared folder and read again.

Defined cases, for all stages: a null text is an empty one, has no language and goes
with the first stage; null and repeated ids are documents of their own, and what a
stage decides holds for rows, not for ids; of equal texts under equal ids near-dedup
keeps one; texts of any length are read whole; ties go to the smaller id; an empty
table passes through; further columns stay, whatever their names, until the mix.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import decontaminate, languages, minhash, mixing, substrings
from refloom.llm.durable import durable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a recognised language."""
    # ids may be null or repeated: a verdict holds for the rows that share all that it depends on
    keys = ["doc_id", "lang", "source"]
    digest = F.sha2("text", 256)
    facts = docs.select(*keys, "text", digest.alias("_digest"))
    judged = languages.identify(facts, carry=("_digest", "source")).filter(~F.col("keep"))
    rejected = judged.select("doc_id", F.col("declared").alias("lang"), "source", F.col("_digest").alias("digest")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("digest_of"))
    same = functools.reduce(lambda a, b: a & b, [F.col(f"row.{k}").eqNullSafe(rejected[k]) for k in keys], F.col("digest_of").eqNullSafe(rejected["digest"]))
    return rows.join(rejected, same, "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return minhash.keep_one(docs)


def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the passages that an earlier document has; drop documents cut to nothing."""
    parsed = substrings.parse(docs)
    kept = parsed.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars").cast("long"))
    new = {"text": F.col("text"), "n_chars": length}
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them."""
    return mixing.mix(docs).filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_duplicates", substring_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
]

#: SQL can express neither the language model nor the signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
