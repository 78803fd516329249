"""Status classes, counts, filters, statistics and truncations of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.extract import parsed_int
from refloom.functions.text import filled, plain_ascii, rounded


def ui_status(exists: Column, confidence: Column) -> Column:
    return F.when(~exists, "Not Found").when(confidence > 80, "Verified").when(confidence > 50, "Partial").otherwise("Mismatch")


def service_status(exists: Column, source: Column, confidence: Column) -> Column:
    return F.when(~exists | (source == "NotFound"), "not_found").when(confidence >= 80, "verified").when(confidence >= 50, "partial_match").otherwise("mismatch")


def batch_status(exists: Column, confidence: Column) -> Column:
    return F.when(~exists, "Not Found").when(confidence > 80, "Verified").otherwise("Partial")


def existence_status(exists: Column) -> Column:
    return F.when(exists, "Verified").otherwise("Not Found")


def report_badge(exists: Column, confidence: Column, retracted: Column) -> Column:
    return F.when(retracted, "RETRACTED").otherwise(ui_status(exists, confidence))


def paper_status(candidates: DataFrame) -> DataFrame:
    """Published rule over all candidates (ref_id, title, author, year_ok) of a reference."""
    sure = (F.col("title") >= 0.85) & (F.col("author") >= 0.5)
    fuzzy = ((F.col("title") >= 0.5) & (F.col("title") < 0.85)) | (sure & ~F.col("year_ok"))
    return candidates.groupBy("ref_id").agg(F.when(F.bool_or(sure & F.col("year_ok")), "Verified").when(F.bool_or(fuzzy), "Typo/Fuzzy").otherwise("Suspicious").alias("status"))


def counts(results: DataFrame) -> DataFrame:
    """One row of overlapping counters; rows have exists, confidence, issues, retracted, predatory."""
    status = ui_status(F.col("exists"), F.col("confidence"))
    return results.withColumn("_s", status).agg(
        F.count_if(F.col("_s") == "Verified").alias("verified"),
        F.count_if(F.col("_s") == "Partial").alias("partial"),
        F.count_if(F.col("_s") == "Mismatch").alias("mismatch"),
        F.count_if(F.col("_s") == "Not Found").alias("not_found"),
        F.count_if(F.size("issues") > 0).alias("with_issues"),
        F.count_if("retracted").alias("retracted"),
        F.count_if("predatory").alias("predatory"),
        F.count("*").alias("total"),
    )


def service_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(service_status(F.col("exists"), F.col("source"), F.col("confidence")).alias("status")).agg(F.count("*").alias("n"))


def select_rows(results: DataFrame, which: str) -> DataFrame:
    """all, verified, partial, mismatch, notfound or issues; rows still loading always pass."""
    status = ui_status(F.col("exists"), F.col("confidence"))
    wanted = {"verified": status == "Verified", "partial": status == "Partial", "mismatch": status == "Mismatch", "notfound": status == "Not Found", "issues": F.size("issues") > 0}
    return results if which == "all" else results.filter(F.col("exists").isNull() | wanted[which])


def by_file_filter(results: DataFrame, which: str) -> DataFrame:
    """Per file, the results of one class in order; files without any are left out.  all, verified, partial, mismatch or notfound."""
    return by_file(select_rows(results.withColumn("issues", F.array().cast("array<string>")) if "issues" not in results.columns else results, which))


def page_counts(results: DataFrame) -> DataFrame:
    """The five counters of a file's results: all, verified, partial, mismatch, not found."""
    every = counts(results)
    return every.select("total", "verified", "partial", "mismatch", "not_found")


def file_totals(files: DataFrame) -> DataFrame:
    """Files, distinct files and references of (file_id, refs)."""
    return files.agg(F.count("*").alias("n_rows"), F.count_distinct("file_id").alias("n_files"), F.sum(F.size("refs")).alias("n_refs"))


def verdict_counts(rows: DataFrame, verdict_col: str = "verdict") -> DataFrame:
    """How many references a second look confirms as missing, and how many it finds."""
    found = F.col(verdict_col)
    return rows.agg(F.count_if(found).alias("found_after_all"), F.count_if(~found).alias("missing"), F.count("*").alias("total"))


def reprobed(rows: DataFrame, hits: DataFrame, least: float = 20.0) -> DataFrame:
    """Rows that were not found, with the best hit (ref_id, found_title, score) of a second search, if it scores above ``least``."""
    best = hits.groupBy("ref_id").agg(F.max_by(F.struct("found_title", "score"), F.struct("score", "found_title")).alias("_h"))
    looked = rows.filter(F.col("status") == "Not Found").join(best, "ref_id", "left")
    found = F.coalesce(F.col("_h.score") > least, F.lit(False))
    return looked.withColumn("verdict", found).withColumn("found_title", F.when(found, F.col("_h.found_title")).otherwise("")).drop("_h")


def temporal(results: DataFrame, year_col: str = "year") -> DataFrame:
    """min, max, rounded mean, span and number of the years from 1801 to 2099."""
    year = parsed_int(F.col(year_col).cast("string"))
    return results.select(year.alias("y")).filter((F.col("y") > 1800) & (F.col("y") < 2100)).agg(
        F.min("y").alias("min_year"), F.max("y").alias("max_year"), rounded(F.avg("y")).alias("avg_year"), (F.max("y") - F.min("y")).alias("span"), F.count("*").alias("n")
    )


def citations(results: DataFrame) -> DataFrame:
    return results.filter(F.col("exists") & F.col("citations").isNotNull()).agg(F.sum("citations").alias("total"), rounded(F.avg("citations")).alias("mean"))


def progress(current: Column, total: Column) -> Column:
    return F.when(total > 0, rounded(current / total * 100)).otherwise(F.lit(0).cast("long"))


def by_file(results: DataFrame) -> DataFrame:
    """Results of each file in order."""
    return results.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "result"))), lambda x: x["result"]).alias("results"))


def first_k(rows: DataFrame, key: str, order: str, k: int = 50) -> DataFrame:
    """The first k rows of each key."""
    by = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= k).drop("_n")


#: Characters of a reference in a corpus row, and of the text of a web probe.
ROW_CHARS = 500
PROBE_CHARS = 100


def corpus_rows(results: DataFrame) -> DataFrame:
    """A row of the corpus table for each result (its column names are fixed): the first ``ROW_CHARS`` of the reference, blanks for nulls, class without mismatches.

    Results have file_name, dataset, seq, raw, exists, confidence, title, journal, year, doi,
    retracted, predatory and source; the first 50 references of a file count, and of
    those the ones of 15 characters or more.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    yes = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "YES").otherwise("NO")
    known = first_k(results, "file_name", "seq").filter(F.length("raw") >= 15)
    status = batch_status(F.col("exists"), F.col("confidence"))
    return known.select(
        F.col("file_name").alias("Paper File"), F.col("dataset").alias("Dataset"), F.substring("raw", 1, ROW_CHARS).alias("Original Reference"), F.when(status == "Partial", "Partial Match").otherwise(status).alias("Status"),
        blank("title").alias("Found Title"), blank("journal").alias("Found Journal"), blank("year").alias("Year"), blank("doi").alias("DOI"), F.coalesce("confidence", F.lit(0.0)).alias("Confidence %"),
        yes("retracted").alias("Retracted"), yes("predatory").alias("Predatory"), blank("source").alias("Source"),
    )


def probe_text(ref: Column) -> Column:
    """What a web probe asks for: the start of the cleaned reference; null for nothing."""
    return F.substring(filled(plain_ascii(ref)), 1, PROBE_CHARS)


def apply_overrides(results: DataFrame, overrides: DataFrame) -> DataFrame:
    """Edited citations replace computed ones, by ref_id."""
    fields = ["apa", "mla", "iso690", "bibtex"]
    edits = overrides.select("ref_id", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = results.join(edits, "ref_id", "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in results.columns])


def guarded(refs: DataFrame, most: int = 15) -> DataFrame:
    """The references of a request; an error if there are more than ``most``."""
    if refs.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} references")
    return refs


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A repeatable sample of n rows, by a seeded hash of the key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
