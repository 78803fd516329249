"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import curves, decontaminate, divergence, kdtree, languages, licenses, minhash, mixing, pitman_yor, spelling, substrings, urls, warc
from refloom.llm.durable import shared_dir
from refloom.llm.sql import SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(table(spark, sf_dir, "documents"))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").alias("first_word"),
        F.array_max("places.at").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )




def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parsed = substrings.parse(docs, cut=False)
    return parsed.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, payload=False).drop("payload", "url")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return kdtree.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents"))


def op12_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return curves.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def llm_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = languages.pages_evidence(table(spark, sf_dir, "pages"))
    return languages.identify(pages, id_col="page_id", host_col="host", suffix_col="suffix")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_mixing, op3_pitman_yor, op4_decontamination, op5_licenses, op6_warc, op7_minhash, op8_topk, op9_language, op10_substrings, op11_spelling, op12_curves, op13_divergence, llm_page_languages)}
