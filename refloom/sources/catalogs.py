"""Catalogs of five providers as one schema, and other inputs.

``source_rank`` (1 to 5) and ``rank_in_source`` make every choice among
candidates deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import extract as E
from refloom.functions.text import SPACE, catalog_author, catalog_title, filled, trim

#: The providers in order of precedence.
SOURCES = {"CrossRef": 1, "SemanticScholar": 2, "OpenAlex": 3, "arXiv": 4, "DBLP": 5}

#: Publishers and journals on the denylist.
DENYLIST_PUBLISHERS = [
    "OMICS Publishing Group", "OMICS International", "WASET", "World Academy of Science, Engineering and Technology", "Bentham Open",
    "MDPI", "Frontiers Media", "SCIRP", "Scientific Research Publishing", "Hindawi", "Baishideng Publishing Group",
    "Longdom Publishing", "Hilaris", "Allied Academies", "Pulsus Group",
]
DENYLIST_JOURNALS = [
    "International Journal of Advanced Research", "International Journal of Current Research",
    "Asian Journal of Pharmaceutical and Clinical Research", "International Journal of Recent Scientific Research",
    "Journal of Fundamental and Applied Sciences",
]


def denylist(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(kind, name), from a JSON file of {publishers, journals} or the fixed values."""
    if path:
        raw = spark.read.json(path, multiLine=True)
        return raw.select(F.lit("publisher").alias("kind"), F.explode("publishers").alias("name")).unionByName(raw.select(F.lit("journal").alias("kind"), F.explode("journals").alias("name")))
    rows = [("publisher", x) for x in DENYLIST_PUBLISHERS] + [("journal", x) for x in DENYLIST_JOURNALS]
    return spark.createDataFrame(rows, "kind string, name string")


def text_files(spark: SparkSession, path: str, glob: str = "*.{txt,bib}") -> DataFrame:
    """Whole text files: path, text."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def append_upload(current: Column, upload: Column) -> Column:
    """An upload goes after the present input, with a blank line between."""
    return F.when(F.coalesce(current, F.lit("")) == "", upload).otherwise(F.concat(current, F.lit("\n\n"), upload))


def docx_text(spark: SparkSession, path: str) -> DataFrame:
    """Raw text of .docx files: path, text; paragraphs end in a newline."""

    def run(batches):
        import html
        import io
        import re
        import zipfile

        import pandas as pd

        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8")
                texts.append(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", xml))))
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, text string")


def page_text(pages: DataFrame, last: int = 50) -> DataFrame:
    """Text of the last pages of each file (file_id, file_name, page, text)."""
    total = pages.groupBy("file_id").agg(F.max("page").alias("_n"))
    kept = pages.join(total, "file_id").filter(F.col("page") > F.col("_n") - last)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return kept.groupBy("file_id", "file_name").agg(F.array_join(parts, "\n--- PAGE BREAK ---\n").alias("text"))


def _unified(df: DataFrame, source: str, **columns) -> DataFrame:
    names = {
        "rec_id": "string", "title": "string", "authors": "array<string>", "families": "array<string>", "givens": "array<string>", "year": "string",
        "years": "array<string>", "cited_year": "string", "venue": "string", "publisher": "string", "doi": "string", "arxiv_id": "string", "url": "string", "link": "string", "citations": "bigint",
        "category": "string", "rec_type": "string", "retracted": "boolean", "related": "boolean",
    }
    columns.setdefault("cited_year", columns["year"])
    values = [F.lit(source).alias("source"), F.lit(SOURCES[source]).alias("source_rank")]
    return df.select(*values, *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])


def crossref(items: DataFrame) -> DataFrame:
    """CrossRef items: years of five date fields; print, published, issued in that order."""
    date = lambda c: F.try_element_at(F.try_element_at(F.col(c), F.lit(1)), F.lit(1))
    first = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit(1)), F.lit(""))
    return _unified(
        items,
        "CrossRef",
        rec_id=F.col("DOI"),
        title=first("title"),
        authors=F.transform("author", lambda a: F.concat_ws(" ", a["given"], a["family"])),
        families=F.transform("author", lambda a: a["family"]),
        givens=F.transform("author", lambda a: a["given"]),
        year=F.coalesce(date("published_print"), date("published"), date("issued")),
        cited_year=date("published"),
        years=E.catalog_years(date("published"), date("published_print"), date("published_online"), date("issued"), date("created")),
        venue=first("container_title"),
        publisher=F.col("publisher"),
        doi=F.col("DOI"),
        url=F.col("URL"),
        link=F.col("URL"),
        citations=F.col("is_referenced_by_count"),
        retracted=F.exists("update_to", lambda u: u["type"] == "retraction"),
        related=F.size("is_retracted_by") > 0,
    )


def semantic_scholar(papers: DataFrame) -> DataFrame:
    return _unified(
        papers,
        "SemanticScholar",
        rec_id=F.col("paperId"), title=F.col("title"), authors=F.col("authors"), year=F.col("year"), venue=F.col("venue"),
        doi=F.col("externalIds.DOI"), url=F.col("url"), citations=F.col("citationCount"),
        retracted=F.col("isRetracted") | F.lower("title").contains("retract"),
    )


def openalex(works: DataFrame) -> DataFrame:
    return _unified(
        works,
        "OpenAlex",
        rec_id=F.col("id"), title=F.col("title"), authors=F.col("authors"), year=F.col("year"), venue=F.col("journal"), doi=F.col("doi"),
        url=F.col("url"), citations=F.col("citations"), retracted=F.col("isRetracted") | F.lower("title").contains("retract"),
    )


def arxiv(entries: DataFrame) -> DataFrame:
    return _unified(
        entries,
        "arXiv",
        rec_id=F.col("id"), title=F.col("title"), authors=F.col("authors"), year=F.col("year"), venue=F.lit("arXiv"), doi=F.col("doi"),
        arxiv_id=F.regexp_replace("id", r"v\d+$", ""), url=F.col("url"), link=F.col("url"), category=F.col("category"), retracted=F.lit(False),
    )


def dblp(hits: DataFrame) -> DataFrame:
    return _unified(
        hits,
        "DBLP",
        rec_id=F.col("key"), title=catalog_title(F.col("title")), authors=F.filter(F.transform("authors", catalog_author), lambda a: a != ""),
        year=F.col("year"), venue=F.col("venue"), doi=F.coalesce(filled(F.col("doi")), E.doi_of_link(F.col("eeUrl"))), url=F.coalesce(filled(F.col("eeUrl")), F.col("url")), link=F.col("eeUrl"),
        rec_type=F.col("type"), retracted=F.lit(False),
    )


def dblp_authors(raw: Column) -> Column:
    """Names from JSON that is a string, an object with text, or a list of either."""
    listed = F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    items = F.from_json(listed, "array<string>")
    name = lambda x: F.coalesce(F.get_json_object(x, "$.text"), x)
    return F.filter(F.transform(items, lambda x: catalog_author(name(x))), lambda a: a != "")


#: What is read of a feed: elements by local name, attributes with a leading underscore.
_FEED = (
    "entry array<struct<id: array<string>, title: array<string>, published: array<string>, author: array<struct<name: array<string>>>, "
    "primary_category: array<struct<_term: string>>, doi: array<string>, link: array<struct<_rel: string, _href: string, _type: string>>>>"
)


def atom_entries(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Records of Atom feeds: id, title, authors, year, category, doi, url, pdfUrl.

    Feeds are decoded as XML (entities, CDATA, name spaces); one that is not well formed
    has no records.  Ids lose the version; of several links of a kind the last counts; an
    entry without a title is none.
    """
    feed = F.from_xml(F.col(xml_col), F.lit(_FEED), {"ignoreNamespace": "true", "attributePrefix": "_"})
    rows = feeds.select(feed.alias("feed")).select(F.explode("feed.entry").alias("e"))
    first = lambda c: F.coalesce(F.get(c, 0), F.lit(""))
    number = F.regexp_extract(trim(first(F.col("e.id"))), r"abs/(.+?)(?:v\d+)?$", 1)
    link = lambda kind, mark: F.try_element_at(F.filter("e.link", lambda x: (x[kind] == mark) & (x["_href"] != "")), F.lit(-1))["_href"]
    names = F.filter(F.transform("e.author", lambda a: first(a["name"])), lambda n: n != "")
    return rows.select(
        F.coalesce(filled(number), trim(first(F.col("e.id")))).alias("id"),
        trim(F.regexp_replace(first(F.col("e.title")), f"[{SPACE}]+", " ")).alias("title"),
        F.coalesce(F.transform(names, trim), F.array().cast("array<string>")).alias("authors"),
        filled(F.regexp_extract(trim(first(F.col("e.published"))), r"^(\d{4})", 1)).cast("int").alias("year"),
        filled(F.get(F.col("e.primary_category"), 0)["_term"]).alias("category"),
        filled(trim(first(F.col("e.doi")))).alias("doi"),
        link("_rel", "alternate").alias("url"),
        link("_type", "application/pdf").alias("pdfUrl"),
    ).filter("title <> ''").withColumns({"url": F.coalesce("url", F.concat(F.lit("https://arxiv.org/abs/"), "id")), "pdfUrl": F.coalesce("pdfUrl", F.concat(F.lit("https://arxiv.org/pdf/"), "id"))})
