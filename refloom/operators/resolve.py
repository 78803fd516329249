"""Resolving references against catalogs: lookups, blocked top-k, best candidates.

References are (ref_id, raw, title, authors, journal, year, doi, arxiv_id);
catalogs follow ``sources.catalogs``.  Candidates come from ``retrieval`` (shared title
words by weight) and, where asked for, from ``near_titles`` (few edits, no word needed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions import extract
from refloom.functions.extract import parsed_int
from refloom.functions.similarity import (
    adapter_similarity,
    adapter_similarity_of_forms,
    author_similarity,
    folded_title_similarity,
    forms,
    free_text_similarity,
    free_text_similarity_of_forms,
    similarity,
    similarity_of_forms,
    title_similarity,
)
from refloom.functions.text import filled, fold, rounded
from refloom.operators import validate
from refloom.operators.near_titles import near_titles
from refloom.operators.retrieval import candidates, title_words  # noqa: F401
from refloom.operators.stored import Scratch, stored

#: Largest confidence and venue score (with, without a venue) of a source.
CAPS = {"SemanticScholar": (95, 90), "OpenAlex": (90, 85), "arXiv": (90, 80), "DBLP": (90, 85)}


def doi_lookup(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """References with a known DOI: 100, or 80 / 50 where the title differs."""
    known = catalog.filter(F.col("doi").isNotNull()).withColumn("_doi", F.lower("doi"))
    order = Window.partitionBy("_doi").orderBy("source_rank", "rec_id")
    known = known.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("_doi", F.struct(*[c for c in catalog.columns]).alias("found"))
    joined = refs.filter(F.col("doi").isNotNull()).withColumn("_doi", F.lower("doi")).join(known, "_doi").drop("_doi")
    joined = joined.withColumn("_score", title_similarity(F.coalesce(filled(F.col("title")), F.col("raw")), F.col("found.title")))
    score = F.col("_score")
    retracted = F.coalesce(F.col("found.retracted"), F.lit(False)) | F.coalesce(F.col("found.related"), F.lit(False))
    issue = F.when(score < 70, F.concat(F.lit('⚠️ Title mismatch with DOI metadata. Found: "'), F.col("found.title"), F.lit('"'))).when(score < 85, "Note: Title from DOI slightly differs from input.")
    return joined.select(
        "ref_id",
        F.lit("doi").alias("path"),
        F.when(score < 70, 50.0).when(score < 85, 80.0).otherwise(100.0).alias("confidence"),
        score.alias("title_score"),
        F.lit(100).cast("long").alias("author_score"),
        F.lit(100).cast("long").alias("journal_score"),
        retracted.alias("retracted"),
        F.array_compact(F.array(F.when(retracted, "⚠️ This paper has been RETRACTED"), issue)).alias("issues"),
        "found",
    )


def arxiv_lookup(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """References with a known arXiv id, of several records the one with the nearest title; a title below 70 does not count."""
    folded = fold(F.coalesce("title", F.lit("")))  # once a row: an id can have many records and references
    known = catalog.filter(F.col("arxiv_id").isNotNull()).select("arxiv_id", folded.alias("_y"), F.struct(*catalog.columns).alias("found"))
    joined = refs.filter(F.col("arxiv_id").isNotNull()).withColumn("_x", folded).join(known, "arxiv_id")
    by_doi = F.coalesce(F.lower("doi").startswith("10.48550/arxiv."), F.lit(False))
    score = F.when(filled(F.col("title")).isNotNull(), folded_title_similarity(F.col("_x"), F.col("_y"))).otherwise(F.lit(90).cast("long"))
    order = Window.partitionBy("ref_id").orderBy(F.desc("_s"), "found.source_rank", "found.rec_id", "found.title")
    joined = joined.withColumn("_s", score).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return joined.filter(by_doi | filled(F.col("title")).isNull() | (F.col("_s") >= 70)).select(
        "ref_id",
        F.lit("arxiv").alias("path"),
        F.when(by_doi, 100.0).otherwise(F.least(F.lit(100), F.col("_s") + 5).cast("double")).alias("confidence"),
        F.when(by_doi, F.lit(100)).otherwise(F.col("_s")).cast("long").alias("title_score"),
        F.lit(100).cast("long").alias("author_score"),
        F.lit(100).cast("long").alias("journal_score"),
        F.lit(False).alias("retracted"),
        F.array().cast("array<string>").alias("issues"),
        "found",
    )


def crossref_score(title: Column, raw: Column, year: Column, journal: Column, found, title_part: Column | None = None, venue_part: Column | None = None) -> Column:
    """3 x title + year (40, or 10 next to it; 30 for free text) + a fifth of the journal; the similarities can be given."""
    has_title = filled(title).isNotNull()
    if title_part is None:
        title_part = F.when(has_title, similarity(title, found["title"])).otherwise(free_text_similarity(raw, found["title"]))
    venue_part = similarity(journal, found["venue"]) if venue_part is None else venue_part
    asked = filled(year)
    near = F.abs(parsed_int(year) - parsed_int(found["year"])) <= 1
    free_years = F.regexp_extract_all(raw, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    year_part = F.when(asked.isNotNull(), F.when(F.array_contains(found["years"], year), 40).when(near, 10).otherwise(0)).otherwise(
        F.when(~has_title & F.arrays_overlap(free_years, found["years"]), 30).otherwise(0)
    )
    both = filled(journal).isNotNull() & filled(found["venue"]).isNotNull()
    return title_part * 3 + F.coalesce(year_part, F.lit(0)) + F.when(both, rounded(venue_part * 0.2)).otherwise(F.lit(0))


def adapter_score(title: Column, year: Column, found, title_part: Column | None = None) -> Column:
    """Common title words (their similarity can be given), + 20 for the year, + 5 next to it."""
    gap = F.abs(parsed_int(year) - parsed_int(found["year"]))
    return (adapter_similarity(title, found["title"]) if title_part is None else title_part) + F.coalesce(F.when(gap == 0, 20).when(gap == 1, 5), F.lit(0))


def result_score(title_score: Column, author_score: Column, year: Column, found_year: Column, journal: Column, venue: Column) -> Column:
    """(2 x title + author) / 3 + year (40, 15, 5) + 0.3 x journal: ranks the sources."""
    gap = F.abs(parsed_int(year) - parsed_int(found_year))
    both = filled(journal).isNotNull() & filled(venue).isNotNull()
    return (
        (title_score * 2 + author_score) / 3
        + F.coalesce(F.when(gap == 0, 40).when(gap <= 1, 15).when(gap <= 2, 5), F.lit(0))
        + F.when(both, rounded(similarity(journal, venue) * 0.3)).otherwise(F.lit(0))
    )


def _search_title() -> Column:
    """What is searched for: the title, else the likely title of the text, else the text."""
    return F.coalesce(filled(F.col("title")), extract.likely_title(F.col("raw")), F.col("raw"))


def _near_candidates(asked: DataFrame, listed: DataFrame, catalog: DataFrame, k: int, edits: int) -> DataFrame:
    """For references without any candidate: the k records of each source with the fewest edits."""
    missing = asked.join(listed.select("ref_id").distinct(), "ref_id", "left_anti").select("ref_id", F.col("_query").alias("title"))
    near = near_titles(missing, catalog.select(F.struct("source", "source_rank", "rec_id").alias("record"), "title"), edits, catalog_id="record")
    order = Window.partitionBy("ref_id", "record.source").orderBy("distance", "record.rec_id")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    none = F.lit(0).cast("long")
    return near.select("ref_id", "record.*", none.alias("hits"), none.alias("weight"), "rank")


def _picked(listed: DataFrame, asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """The best candidate of each reference and source, with all columns of both and ``_title``, CrossRef's title score.

    What the scores read of a title or venue is made once a row, not once a candidate,
    and only that meets the candidates; the rest is joined to the best ones.
    """
    numbered = stored(catalog.withColumn("_rec", F.monotonically_increasing_id()), "numbered")
    briefs = stored(numbered.select("_rec", "source", "rec_id", F.struct("year", "years", "venue").alias("found"), forms(F.col("title")).alias("_found"), forms(F.col("venue")).alias("_place")), "briefs")
    no_title = filled(F.col("title")).isNull()
    own = ["ref_id", "title", F.when(no_title, F.col("raw")).alias("raw"), "year", "journal"]
    text = F.when(no_title, F.col("raw")).otherwise(F.col("title"))
    wanted = stored(asked.select(*own, forms(text).alias("_asked"), forms(F.col("journal")).alias("_venue"), forms(F.col("_query")).alias("_words")), "wanted")
    crossref, c = F.col("source") == "CrossRef", F.col
    title = F.when(no_title, free_text_similarity_of_forms(c("_asked"), c("_found"))).otherwise(similarity_of_forms(c("_asked"), c("_found")))
    score = lambda: crossref_score(c("title"), c("raw"), c("year"), c("journal"), c("found"), c("_title"), similarity_of_forms(c("_venue"), c("_place")))
    key = ["ref_id", "source", "_rec", "rank", "_title", "pick"]
    by_field = listed.filter(crossref).select("ref_id", "source", "rec_id", "rank").join(briefs, ["source", "rec_id"]).join(wanted.drop("_words"), "ref_id")
    by_field = by_field.withColumn("_title", title).withColumn("pick", score().cast("double")).select(*key)
    by_word = listed.filter(~crossref).select("ref_id", "source", "rec_id", "rank").join(briefs.drop("_place"), ["source", "rec_id"]).join(wanted.select("ref_id", "year", "_words"), "ref_id")
    words = adapter_similarity_of_forms(c("_words"), c("_found"))
    by_word = by_word.withColumn("_title", F.lit(None).cast("long")).withColumn("pick", adapter_score(F.lit(None), c("year"), c("found"), words).cast("double")).select(*key)
    order = Window.partitionBy("ref_id", "source").orderBy(F.desc("pick"), "rank")
    best = by_field.unionByName(by_word).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("source")
    found = numbered.select("_rec", "source", "source_rank", F.struct(*catalog.columns).alias("found"))
    return stored(best.join(found, "_rec").join(asked, "ref_id"), "picked")


def best_per_source(refs: DataFrame, catalog: DataFrame, k: int = 5, edits: int = 0, least: int = 0) -> DataFrame:
    """The best of the k candidates of each source, with its field checks; the first wins ties.

    arXiv and DBLP are asked with the first author's name as well.  CrossRef's
    best is checked field by field and may be rejected; the other sources are
    scored by title and authors.  With ``edits``, references that share no word with any
    record get the records whose titles are so many edits away.  Candidates with a title score
    below ``least`` are left out before their other fields are looked at.
    """
    asked = stored(refs.withColumn("_query", _search_title()), "asked")  # a long expression that many steps read
    asked = asked.withColumn("_sharp", F.when(filled(F.col("authors")).isNotNull(), extract.sharp_query(F.col("_query"), F.col("authors"))).otherwise(F.col("_query")))
    sharp = F.col("source").isin("arXiv", "DBLP")
    listed = candidates(asked, catalog.filter(~sharp), k, "_query").unionByName(candidates(asked, catalog.filter(sharp), k, "_sharp"))
    if edits:
        listed = stored(listed, "listed")
        listed = listed.unionByName(_near_candidates(asked, listed, catalog, k, edits))
    picked = _picked(listed, asked, catalog)
    fields = ["ref_id", "source", "source_rank", "rank", "title_score", "author_score", "journal_score", "confidence", "score", "retracted", "issues", "found"]
    year = F.coalesce(filled(F.col("year")), extract.year(F.col("raw")))
    score = result_score(F.col("title_score"), F.col("author_score"), year, F.col("found.year"), F.col("journal"), F.col("found.venue"))
    gated = stored(picked.filter(f"source = 'CrossRef' and _title >= {validate.LEAST_TITLE}"), "gated")  # the check rejects all others
    checked = _field_checks(gated).withColumn("score", score).select(*fields)

    title = title_similarity(F.col("_query"), F.col("found.title"))
    author = author_similarity(F.coalesce(filled(F.col("authors")), F.col("raw")), F.col("found.authors"))
    others = picked.filter("source <> 'CrossRef'").withColumn("title_score", title)
    others = stored(others, "others").filter(F.col("title_score") >= least).withColumn("author_score", author)
    cap = F.coalesce(*[F.when(F.col("source") == s, c[0]) for s, c in CAPS.items()])
    venue = F.coalesce(*[F.when(F.col("source") == s, F.when(filled(F.col("found.venue")).isNotNull(), c[1]).otherwise(50)) for s, c in CAPS.items()])
    others = others.withColumns(
        {
            "journal_score": venue.cast("long"),
            "confidence": F.least(cap.cast("double"), (F.col("title_score") * 2 + F.col("author_score")) / 3),
            "score": score,
            "retracted": F.coalesce("found.retracted", F.lit(False)),
            "issues": F.when(F.col("author_score") < 50, F.array(F.concat(F.lit("Author Mismatch in "), F.col("source"), F.lit(" fallback")))).otherwise(F.array().cast("array<string>")),
        }
    )
    return checked.unionByName(others.select(*fields))


def _field_checks(picked: DataFrame) -> DataFrame:
    """CrossRef's best candidates that pass: the structured check with a title, the free-text check without."""
    plain = lambda c: F.col(f"found.{c}").alias(f"found_{c}")
    rows = picked.select(
        "ref_id", "source", "source_rank", "rank", "raw", "title", "authors", "journal", "year", "found",
        F.col("found.title").alias("found_title"), plain("families"), plain("givens"), plain("year"), plain("years"),
        F.coalesce("found.venue", F.lit("")).alias("found_venue"), plain("publisher"), plain("retracted"),
    )
    titled = filled(F.col("title")).isNotNull()
    # written first: the filter would go before the checks with all of their expressions in it, several times over
    return stored(validate.check_batch(rows.filter(titled)).unionByName(validate.check_quick(rows.filter(~titled))), "checked").filter("accepted")


def _winner(pool: DataFrame) -> DataFrame:
    order = Window.partitionBy("ref_id").orderBy(F.desc("score"), "source_rank")
    return pool.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


#: Fixed value: the least title score of a candidate that can win.
LEAST = 70


def best_overall(pool: DataFrame, least: int = LEAST) -> DataFrame:
    """Two phases: a confident winner of the first three sources ends the search,
    else the last two join in.  Candidates need a title of ``least``."""
    pool = pool.filter(F.col("title_score") >= least)
    pool = pool if "issues" in pool.columns else pool.withColumn("issues", F.array().cast("array<string>"))
    first = _winner(pool.filter(F.col("source_rank") <= 3))
    sure = first.filter((F.col("author_score") >= 70) & (F.col("title_score") >= 85))
    rest = _winner(pool.join(sure.select("ref_id"), "ref_id", "left_anti"))
    won = sure.unionByName(rest)
    crossref = pool.filter(F.col("source") == "CrossRef").select("ref_id", F.col("confidence").alias("_c"))
    better = F.concat(F.lit("Better match found in "), F.col("source"), F.lit(" (CrossRef confidence was "), F.regexp_replace(F.col("_c").cast("string"), r"\.0$", ""), F.lit("%)"))
    return won.join(crossref, "ref_id", "left").withColumn("issues", F.when((F.col("source") != "CrossRef") & F.col("_c").isNotNull(), F.array(better)).otherwise(F.col("issues"))).drop("_c")


def search(refs: DataFrame, catalog: DataFrame, k: int = 5, edits: int = 0) -> DataFrame:
    """The best candidate of all sources for each reference that has one."""
    with Scratch() as scratch:
        found = scratch.keep(stored(best_overall(stored(best_per_source(refs, catalog, k, edits, LEAST), "pool")), "found"))
    return found.select("ref_id", F.lit("search").alias("path"), "confidence", "title_score", "author_score", "journal_score", "retracted", "issues", "found")


#: Issues of a reference as a whole.
NOWHERE = "Title not found in any source (CrossRef, Semantic Scholar, OpenAlex, DBLP, arXiv)"
BAD_DOI = ("⚠️ The provided DOI (", ") is invalid or points to an unrelated article.")


def resolve(refs: DataFrame, catalog: DataFrame, k: int = 5, as_of_year: int | None = None, edits: int = 0) -> DataFrame:
    """The waterfall: DOI, arXiv id, search, and search again by the likely title; one row per reference, with its path.

    A reference whose DOI leads nowhere and that no search finds exists still, with
    confidence 0.  Years after the year following ``as_of_year`` are remarked on
    where a search decided.
    """
    catalog = stored(catalog, "catalog")  # every step reads it
    by_doi = stored(doi_lookup(refs, catalog), "by-doi")
    left = refs.join(by_doi.select("ref_id"), "ref_id", "left_anti")
    by_arxiv = stored(arxiv_lookup(left, catalog), "by-arxiv")
    left = stored(left.join(by_arxiv.select("ref_id"), "ref_id", "left_anti"), "left")
    by_search = search(left, catalog, k, edits)
    lost = left.join(by_search.select("ref_id"), "ref_id", "left_anti").filter(filled(F.col("title")).isNull())
    again = lost.withColumn("_likely", extract.likely_title(F.col("raw"))).filter(F.col("_likely").isNotNull() & (F.col("_likely") != F.col("raw")))
    again = stored(again.withColumn("raw", F.col("_likely")).drop("_likely"), "again")
    found = by_doi.unionByName(by_arxiv).unionByName(by_search)
    if not again.isEmpty():
        found = found.unionByName(search(again, catalog, k, edits).withColumn("path", F.lit("retry")))
    none = F.array().cast("array<string>")
    year = F.coalesce(filled(F.col("year")), extract.year(F.col("raw")))
    searched = F.col("path").isin("search", "retry")
    future = F.when(searched, validate.future_year_issue(year, as_of_year)) if as_of_year is not None else F.lit(None).cast("string")
    no_doi = F.col("doi").isNotNull() & ~F.coalesce(F.col("path") == "doi", F.lit(False))
    bad = F.when(no_doi, F.concat(F.lit(BAD_DOI[0]), F.col("doi"), F.lit(BAD_DOI[1])))
    nowhere = F.when(F.col("path").isNull() & ~no_doi, F.lit(NOWHERE))
    return (
        refs.select("ref_id", "raw", "year", "doi")
        .join(found, "ref_id", "left")
        .select(
            "ref_id",
            F.coalesce("path", F.lit("none")).alias("path"),
            (F.col("path").isNotNull() | no_doi).alias("exists"),
            F.coalesce("found.source", F.lit("NotFound")).alias("source"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("title_score", F.lit(0).cast("long")).alias("title_score"),
            F.coalesce("author_score", F.lit(0).cast("long")).alias("author_score"),
            F.coalesce("journal_score", F.lit(0).cast("long")).alias("journal_score"),
            F.coalesce("retracted", F.lit(False)).alias("retracted"),
            F.concat(F.coalesce("issues", none), F.array_compact(F.array(future, bad, nowhere))).alias("issues"),
            "found",
        )
    )
