"""Citations in four styles for five sources, and export formats.

Rows follow ``sources.catalogs``; one builder serves all sources, because they
differ only in how names, the venue part and the link are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.text import filled
from refloom.operators.report import service_status


def _empty() -> Column:
    return F.lit("")


def _or(col: Column, other) -> Column:
    return F.coalesce(filled(col.cast("string")), F.lit(other) if isinstance(other, str) else other)


def _is(source: str) -> Column:
    return F.col("source") == source


def _split_name(name: Column, last: Column) -> Column:
    parts = F.split(name, " ")
    initials = F.array_join(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(F.substring(p, 1, 1), F.lit("."))), " ")
    return F.concat(F.when(last, F.lit("& ")).otherwise(_empty()), F.element_at(parts, -1), F.lit(", "), initials)


def _year() -> Column:
    return F.when(F.coalesce("cited_year", _empty()).isin("", "0"), F.lit("n.d.")).otherwise(F.col("cited_year"))


def _title() -> Column:
    return F.when(_is("CrossRef"), _or(F.col("title"), "Untitled")).otherwise(F.coalesce("title", _empty()))


def _link() -> Column:
    address = F.when(_is("OpenAlex"), F.col("doi")).otherwise(F.concat(F.lit("https://doi.org/"), F.col("doi")))
    return F.when(filled(F.col("doi")).isNotNull(), address).otherwise(F.coalesce("link", _empty()))


def _preprint() -> Column:
    return F.concat(F.lit("arXiv preprint arXiv:"), F.col("rec_id"))


def _venue(mark: str) -> Column:
    venue = F.when(_is("arXiv"), _preprint()).otherwise(F.coalesce("venue", _empty()))
    return F.when(venue != "", F.concat(F.lit(" "), venue, F.lit(mark))).otherwise(_empty())


def _spaced(col: Column, end: str = "") -> Column:
    return F.when(col != "", F.concat(F.lit(" "), col, F.lit(end))).otherwise(_empty())


def apa() -> Column:
    own = F.array_join(F.transform(F.arrays_zip("families", "givens"), lambda a: F.concat(a["families"], F.lit(", "), F.when(F.coalesce(a["givens"], _empty()) != "", F.concat(F.substring(a["givens"], 1, 1), F.lit("."))).otherwise(_empty()))), ", ")
    n = F.size("authors")
    other = F.array_join(F.transform("authors", lambda a, i: _split_name(a, (i == n - 1) & (n > 1))), ", ")
    names = F.when(_is("CrossRef"), own).otherwise(other)
    return F.concat(F.coalesce(names, _empty()), F.lit(" ("), _year(), F.lit("). "), _title(), F.lit("."), _venue("."), _spaced(_link()))


def mla() -> Column:
    n = F.size("authors")
    fam, giv = (lambda i: F.get("families", i)), (lambda i: F.coalesce(F.get("givens", i), _empty()))
    own = F.when(n == 1, F.concat(fam(0), F.lit(", "), giv(0))).when(n == 2, F.concat(fam(0), F.lit(", "), giv(0), F.lit(", and "), giv(1), F.lit(" "), fam(1))).when(n > 2, F.concat(fam(0), F.lit(", "), giv(0), F.lit(", et al"))).otherwise(_empty())
    full = lambda i: F.get("authors", i)
    other = F.when(n == 1, full(0)).when(n == 2, F.concat(full(0), F.lit(" and "), full(1))).when(n > 2, F.concat(full(0), F.lit(", et al"))).otherwise(_empty())
    names = F.trim(F.when(_is("CrossRef"), own).otherwise(other))
    dotted = F.when((names != "") & ~names.endswith("."), F.concat(names, F.lit("."))).otherwise(names)
    return F.concat(F.when(dotted != "", F.concat(dotted, F.lit(" "))).otherwise(_empty()), F.lit('"'), _title(), F.lit('."'), _venue(","), F.lit(" "), _year(), F.lit("."), _spaced(_link(), "."))


def iso690() -> Column:
    own = F.transform(F.arrays_zip("families", "givens"), lambda a: F.concat(F.upper(F.coalesce(a["families"], _empty())), F.when(F.coalesce(a["givens"], _empty()) != "", F.concat(F.lit(", "), a["givens"])).otherwise(_empty())))
    names = F.array_join(F.when(_is("CrossRef"), own).otherwise(F.transform("authors", F.upper)), "; ")
    return F.concat(F.when(names != "", F.concat(names, F.lit(". "))).otherwise(_empty()), _title(), F.lit("."), _venue(","), F.lit(" "), _year(), F.lit("."), _spaced(_link()))


def bibtex() -> Column:
    own = F.transform(F.arrays_zip("families", "givens"), lambda a: F.concat(a["families"], F.when(F.coalesce(a["givens"], _empty()) != "", F.concat(F.lit(", "), a["givens"])).otherwise(_empty())))
    names = F.array_join(F.when(_is("CrossRef"), own).otherwise(F.col("authors")), " and ")
    first = F.when(_is("CrossRef"), F.get("families", 0)).otherwise(F.element_at(F.split(F.get("authors", 0), " "), -1))
    word = F.regexp_replace(F.get(F.split(_title(), " "), 0), "[^a-zA-Z0-9]", "")
    key = F.concat(_or(first, "Unknown"), _year(), word)
    meeting = _is("DBLP") & F.lower(F.coalesce("rec_type", _empty())).rlike("conference|workshop")
    kind = F.when(_is("arXiv"), "misc").when(meeting, "inproceedings").otherwise("article")
    line = lambda tag, v: F.concat(F.lit(f",\n  {tag}={{"), v, F.lit("}"))
    some = lambda tag, col: F.when(filled(col).isNotNull(), line(tag, col)).otherwise(_empty())
    doi = F.when(_is("OpenAlex"), F.regexp_replace("doi", "^https?://doi.org/", "")).otherwise(F.col("doi"))
    venue = F.when(_is("arXiv"), F.concat(line("eprint", F.col("rec_id")), F.lit(",\n  archivePrefix={arXiv}"), some("primaryClass", F.col("category")))).when(meeting, some("booktitle", F.col("venue"))).otherwise(some("journal", F.col("venue")))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, line("title", _title()), line("author", names), line("year", _year()), venue, some("doi", doi), F.lit("\n}"))


def with_citations(records: DataFrame) -> DataFrame:
    return records.withColumns({"apa": apa(), "mla": mla(), "iso690": iso690(), "bibtex": bibtex()})


def numbered_list(results: DataFrame, style: str, batch: str = "batch_id") -> DataFrame:
    """(batch, seq, line): existing citations, renumbered after the filter."""
    kept = results.filter(F.col("exists") & (F.coalesce(F.col(style), _empty()) != ""))
    n = F.row_number().over(Window.partitionBy(batch).orderBy("seq"))
    return kept.select(batch, "seq", F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.col(style)).alias("line"))


def joined_text(lines: DataFrame, batch: str = "batch_id", col: str = "line") -> DataFrame:
    """One text per batch, its parts in order with blank lines between."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(col).alias("x")))), lambda p: p["x"])
    return lines.groupBy(batch).agg(F.array_join(parts, "\n\n").alias("text"))


def ris(row=F.col) -> Column:
    """The RIS record of a result with title, authors (text), year, journal, doi, url."""
    names = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(row("authors"), _empty()), r"\s*&\s*", ", "), r"(?i)\s+and\s+", ", "), r";\s*|,\s*(?=[A-Z])")
    names = F.filter(F.transform(names, lambda a: F.trim(a)), lambda a: (F.length(a) > 1) & ~a.rlike(r"(?i)^et\s+al"))
    tag = lambda t, c: F.concat(F.lit(f"{t}  - "), filled(c.cast("string")))
    lines = F.concat(
        F.array(F.lit("TY  - JOUR"), tag("TI", row("title"))),
        F.transform(names, lambda a: F.concat(F.lit("AU  - "), a)),
        F.array(tag("PY", row("year")), tag("JO", row("journal")), tag("DO", row("doi")), tag("UR", row("url")), F.lit("ER  - ")),
    )
    return F.array_join(F.array_compact(lines), "\n")


#: The columns of the report table.
SHEET = ["No.", "Original Reference", "Status", "Found Title", "Found Authors", "Found Year", "Found Journal", "DOI", "Confidence (%)", "Issues", "Retracted", "Predatory", "Source"]


def spreadsheet(results: DataFrame) -> DataFrame:
    """The report table: a row per result, numbered; without ``exists`` a reference is still loading."""
    c, known = F.col, F.col("exists").isNotNull()
    status = F.when(~c("exists"), "Not Found").when(c("confidence") > 80, "Verified").when(c("confidence") > 50, "Partial Match").otherwise("Mismatch / Error")
    told = lambda col: F.when(known, F.coalesce(col.cast("string"), _empty())).otherwise(_empty())
    yes = lambda col: told(F.when(F.coalesce(col, F.lit(False)), "YES").otherwise("NO"))
    plain = F.regexp_replace(F.when(c("exists"), c("confidence")).otherwise(0.0).cast("string"), r"\.0$", "")
    values = [
        F.row_number().over(Window.partitionBy("batch_id").orderBy("seq")), c("raw"), F.when(known, status).otherwise("Loading/Error"),
        told(c("title")), told(c("authors")), told(c("year")), told(c("journal")), told(c("doi")), told(plain), told(F.array_join("issues", "; ")),
        yes(c("retracted")), yes(c("predatory")), told(c("source")),
    ]
    return results.select("batch_id", *[v.alias(n) for n, v in zip(SHEET, values, strict=True)])


#: Marks and names of the service's classes.
CLASSES = {"verified": ("✅", "Verified", "Verified"), "partial_match": ("⚠️", "Partial Match", "Partial"), "mismatch": ("❌", "Mismatch", "Mismatch"), "not_found": ("🔍", "Not Found", "Not Found")}


def _class(part: int) -> Column:
    return F.coalesce(*[F.when(F.col("_class") == k, v[part]) for k, v in CLASSES.items()])


def service_report(results: DataFrame) -> DataFrame:
    """Per batch: the Markdown report and the JSON of its results.

    Rows have batch_id, seq, raw, exists, source, confidence, title, authors, year,
    journal, doi, url, citations, retracted and issues.  A batch of one has no header
    and no numbers.
    """
    c = F.col
    rows = results.withColumn("_class", service_status(c("exists"), c("source"), c("confidence")))
    every = Window.partitionBy("batch_id")
    rows = rows.withColumn("_n", F.row_number().over(every.orderBy("seq"))).withColumn("_all", F.count("*").over(every))
    plain = F.regexp_replace(c("confidence").cast("string"), r"\.0$", "")
    there = c("exists") & (c("source") != "NotFound")
    line = lambda head, col, when=F.lit(True): F.when(there & when, F.concat(F.lit(f"   {head}: "), filled(col.cast("string"))))
    head = F.concat(F.when(c("_all") > 1, F.concat(F.lit("["), c("_n").cast("string"), F.lit("] "))).otherwise(""), _class(0), F.lit(" **"), _class(1), F.lit("** (confidence: "), plain, F.lit("%)"))
    lines = F.array(
        head,
        F.concat(F.lit("   Input: "), F.substring("raw", 1, 120), F.when(F.length("raw") > 120, "…").otherwise("")),
        line("Title", c("title")),
        line("Authors", c("authors")),
        line("Year", c("year")),
        line("Journal/Venue", c("journal")),
        line("DOI", F.concat(F.lit("https://doi.org/"), filled(c("doi")))),
        line("URL", c("url"), filled(c("doi")).isNull()),
        line("Citations", c("citations")),
        line("Source", c("source")),
        F.when(there & c("retracted"), "   🚨 **RETRACTED/WITHDRAWN**"),
        F.when(F.size("issues") > 0, F.concat(F.lit("   Issues: "), F.array_join("issues", "; "))),
    )
    one = F.to_json(F.struct(c("raw").alias("input"), c("_class").alias("status"), "exists", "title", "authors", "year", "journal", "doi", "source", c("confidence").alias("matchConfidence"), "issues"))
    rows = rows.withColumn("_text", F.array_join(F.array_compact(lines), "\n")).withColumn("_json", one)
    parts = lambda col: F.transform(F.array_sort(F.collect_list(F.struct("seq", c(col).alias("x")))), lambda p: p["x"])
    counted = [F.concat(F.lit(f" | {mark} {short}: "), F.count_if(c("_class") == k).cast("string")) for k, (mark, _, short) in CLASSES.items()]
    summary = F.concat(F.lit("# Reference Verification Report\n**Total: "), F.count("*").cast("string"), F.lit("**"), *counted, F.lit("\n---\n"))
    return rows.groupBy("batch_id").agg(
        F.concat(F.when(F.count("*") > 1, summary).otherwise(""), F.array_join(parts("_text"), "\n\n")).alias("markdown"),
        F.concat(F.lit("["), F.array_join(parts("_json"), ","), F.lit("]")).alias("json"),
    )


def bib_file(results: DataFrame, batch: str = "batch_id") -> DataFrame:
    """One .bib text per batch: the entries of what exists and has one."""
    kept = results.filter(F.col("exists") & (F.coalesce(F.col("bibtex"), _empty()) != ""))
    return joined_text(kept, batch, "bibtex")


def entry_text(kind: Column, key: Column, tags: Column) -> Column:
    """A parsed BibTeX entry as text again."""
    lines = F.transform(F.array_sort(F.map_entries(tags)), lambda t: F.concat(F.lit("  "), t["key"], F.lit(" = {"), t["value"], F.lit("}")))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
