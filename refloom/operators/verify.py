"""The whole way of a batch: text, references, waterfall, flags, classes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions import extract
from refloom.functions.text import filled
from refloom.operators import duplicates, parsing, resolve
from refloom.operators.report import service_status, ui_status
from refloom.operators.stored import stored


def references(inputs: DataFrame) -> DataFrame:
    """References of the texts (batch_id, text): ref_id, batch_id, seq, raw and the parsed fields."""
    parsed = parsing.parse_input(inputs)
    doi = F.coalesce(filled(F.col("parsed.doi")), extract.doi(F.col("raw")))
    arxiv = F.coalesce(extract.arxiv_id_of_doi(doi), extract.arxiv_id(F.col("raw")))
    return parsed.select(
        F.concat_ws(":", F.col("batch_id").cast("string"), F.col("seq").cast("string")).alias("ref_id"),
        "batch_id", "seq", "raw", "parsed.title", "parsed.authors", "parsed.journal", "parsed.year", doi.alias("doi"), arxiv.alias("arxiv_id"), "parsed.ref_number",
    )


def verify_batch(inputs: DataFrame, catalog: DataFrame, denylist: DataFrame, as_of_year: int, k: int = 5) -> DataFrame:
    """One row per reference of the texts: what was found, scores, issues, flags and classes.

    The denylist is asked for the venue found, else for the one cited;
    ``duplicate_of`` is the label of the reference that this one repeats.
    """
    refs = stored(references(inputs), "references")
    checked = resolve.resolve(refs.select("ref_id", "raw", "title", "authors", "journal", "year", "doi", "arxiv_id"), catalog, k, as_of_year)
    copies = duplicates.last_originals(refs)
    rows = refs.select("ref_id", "batch_id", "seq", "raw", F.col("journal").alias("_cited"), F.col("doi").alias("_doi")).join(checked, "ref_id").join(copies, ["batch_id", "seq"], "left")
    rows = rows.select(
        "batch_id", "seq", "ref_id", "raw", "path", "exists", "source", "confidence", "title_score", "author_score", "journal_score", "retracted", "issues", "duplicate_of",
        F.col("found.title").alias("title"),
        F.array_join("found.authors", ", ").alias("authors"),
        F.col("found.year").alias("year"),
        F.coalesce(filled(F.col("found.venue")), F.when(F.col("source") == "NotFound", F.col("_cited"))).alias("journal"),
        F.coalesce(F.col("found.doi"), F.when(F.col("exists") & (F.col("source") == "NotFound"), F.col("_doi"))).alias("doi"),
        F.col("found.url").alias("url"),
        F.col("found.citations").alias("citations"),
    )
    flagged = duplicates.on_denylist(rows, denylist, "journal")
    return flagged.withColumn("status", ui_status(F.col("exists"), F.col("confidence"))).withColumn("service_status", service_status(F.col("exists"), F.col("source"), F.col("confidence")))
