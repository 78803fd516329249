"""Queries of the column functions: inputs are built around columns of ``part``, and the SQL names what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import extract, similarity, text
from refloom.operators import citations, corpus, parsing, report
from refloom.plans.base import query, spread, table


def _columns() -> list[Column]:
    return [F.col(c) for c in ("p_name", "p_brand", "p_type", "p_partkey")]


def _around(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])


@query(
    """select p_partkey, p_name || ' & ' || p_type as query, 'Muller and Jose c c ' || p_name as latex, lower(left(p_name, 1)) as letter, left(lower(p_name), 1) = 'b' as same_letter,
p_name || chr(10) || p_type as lines, 'fi' || p_name || 'e ff x x2 12 No A kg TEL' as ascii, p_name || chr(10) || p_type as printable, lower(replace(p_name, ' ', '') || replace(p_brand, '#', '')) as alnum,
p_type as journal, p_name || '. , in ' || p_type as bare, p_name as unbraced, p_name as title, p_name as author,
'https://scholar.google.com/scholar?q=' || replace(p_name, ' ', '%20') || '%20x' as link, p_name || chr(10) || chr(10) || p_type as extracted from part"""
)
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand, kind, key = _columns()
    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey",
        text.clean_query(_around("{\\textbf{", name, "}}~\\&  ", kind)).alias("query"),
        text.decode_latex(_around('M{\\"u}ller and Jos\\\'{e} \\v{c} \\c{c} ', name)).alias("latex"),
        text.first_letter(_around("#7 ", F.upper(name))).alias("letter"),
        text.first_letter_matches(name, brand).alias("same_letter"),
        text.drop_latex_lines(_around("\\begin{x}\n", name, "\n\n  \\vspace{1}\n", kind)).alias("lines"),
        text.plain_ascii(_around("\ufb01", name, "é\n\t\ufb00  x\u65e5 x\u00b2 \u00bd \u2116 \uff21 \u338f \u2121")).alias("ascii"),
        text.drop_controls(_around(name, "\x01\x1f\n", kind)).alias("printable"),
        text.alnum_key(_around(F.upper(name), "-", brand)).alias("alnum"),
        text.journal_key(_around("// ", kind, " Springer, 12-34.")).alias("journal"),
        text.without_metadata(_around(name, "[J]//Series x. DOI: 10.1/ab, vol. 3 no. 4 pp. 12-19 in 2001 et al. ", kind)).alias("bare"),
        text.without_braces(_around("{", name, "}")).alias("unbraced"),
        text.catalog_title(_around(name, ".")).alias("title"),
        text.catalog_author(_around(name, " 0001")).alias("author"),
        extract.search_link(_around(name, " https://x.y/z doi: 10.1234/abc @{x}")).alias("link"),
        text.clean_extracted(_around(name, "\n 12 \nDownloaded from here\nhttps://a.b/c\n\n\n", kind)).alias("extracted"),
    )


@query(
    """select p_partkey, '2101.' || lpad(p_partkey::varchar, 5, '0') as arxiv_id, (2000 + p_size) || ',1999' as years, '1999,' || (2000 + p_size % 30) as audit, '10.1/' || p_partkey as doi,
'2001,' || (2010 + p_size) as catalog_years, p_name || ' Smith' as sharp, p_partkey % 2 = 0 as bibtex, p_partkey % 3 = 0 as preprint,
'The role of ' || p_name || ' in steel making' as likely, 3 / (p_partkey + 1) as bound, floor(p_size / 50 * 100 + 0.5)::bigint as progress, p_partkey % 3 < 2 as near,
case when p_partkey % 2 = 0 then 'Ada Low|B. High' else 'One' end as names from part"""
)
def text_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand, kind, key = _columns()
    number = F.lpad(key.cast("string"), 5, "0")
    year = (2000 + F.col("p_size")).cast("string")
    listed = F.when(key % 2 == 0, '["Ada Low 0001", {"text": "B. High"}]').otherwise('{"text": "One"}')
    from refloom.sources.catalogs import dblp_authors

    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey",
        extract.arxiv_id_of_doi(_around("10.48550/arXiv.2101.", number, "v3")).alias("arxiv_id"),
        F.array_join(extract.years(_around("in 1850, ", year, " and 1999")), ",").alias("years"),
        F.array_join(extract.audit_years(_around("1999 (", (2000 + F.col("p_size") % 30), ") 2031 18999")), ",").alias("audit"),
        extract.doi_of_link(_around("https://doi.org/10.1/", key)).alias("doi"),
        F.array_join(extract.catalog_years(F.lit(2001), F.lit(0), 2010 + F.col("p_size"), F.lit(2001)), ",").alias("catalog_years"),
        extract.sharp_query(name, F.lit("Jo Smith, A B")).alias("sharp"),
        extract.is_bibtex(F.when(key % 2 == 0, _around("x\n @article {", name)).otherwise(_around("at @ ", name))).alias("bibtex"),
        extract.is_preprint(F.when(key % 3 == 0, _around(kind, " arXiv")).otherwise(kind)).alias("preprint"),
        extract.likely_title(_around("Smith J, The role of ", name, " in steel making, Annals of x, vol. 3, 2001")).alias("likely"),
        corpus.upper_bound(key + 1).alias("bound"),
        report.progress(F.col("p_size"), F.lit(50)).alias("progress"),
        similarity.paper_year_match(F.lit(2000), 2000 + (key % 3).cast("int")).alias("near"),
        F.array_join(dblp_authors(listed), "|").alias("names"),
    )


@query(
    """select p_partkey, 95::bigint as contained, 100::bigint as inside, 97::bigint as mostly, round(len(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 4)) / (len(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 4)) + 1), 6) as windowed,
1.0::double as windowed_whole, round(2 / 3, 6) as ratio, round(greatest(length(p_name) / (length(p_name) + 5), 2 / 3), 6) as paper_title, 0.5::double as paper_author, 0.0::double as paper_nobody from part"""
)
def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand, kind, key = _columns()
    tail = "of the long winded study of things"
    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey",
        similarity.title_similarity(_around(name, " ", tail), F.lit(tail)).alias("contained"),
        similarity.free_text_similarity(_around(brand, " ", name, " ", kind), name).alias("inside"),
        similarity.free_text_similarity(_around("alpha beta ", name, " gamma delta"), _around(name, " alpha beta omega")).alias("mostly"),
        F.round(similarity.windowed_similarity(_around("see ", name, " here"), _around(name, " unseen")), 6).alias("windowed"),
        similarity.windowed_similarity(_around("see ", F.upper(name), " here"), name).alias("windowed_whole"),
        F.round(similarity.sequence_ratio(F.upper(name), _around(name, name)), 6).alias("ratio"),
        F.round(similarity.paper_title_score(name, _around(name, " zzzz")), 6).alias("paper_title"),
        similarity.paper_author_score(F.array(brand), F.array(brand, kind)).alias("paper_author"),
        similarity.paper_author_score(F.array(F.lit("x")), F.array(brand, kind)).alias("paper_nobody"),
    )


@query(
    """with p as (select *, p_partkey % 3 as k from part), many as (select p_partkey, unnest([0, 1, 2]) as seq, p_name, p_type from p where k = 0)
select p_partkey, seq::int as seq, case seq when 2 then p_name || '[' else p_name end as title, case seq when 0 then 'Doe, J' when 1 then 'Roe A' else 'Li W' end as authors,
case seq when 0 then 'Journal of ' || p_type when 1 then 'Annals of ' || p_type else 'Steel Letters' end as journal, case seq when 0 then '2001' when 1 then '1999' else '2005' end as year,
case seq when 0 then null else seq + 1 end::int as ref_number from many
union all select p_partkey, 0, 'The making of ' || p_name || ' in mills', 'Smith J', 'Journal of ' || p_type, '2003', null from p where k = 1
union all select p_partkey, 0, p_name, 'Poe, E.', p_type, '2010', null from p where k = 2"""
)
def parse_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several lines in three styles, one free line, or BibTeX."""
    name, brand, kind, key = _columns()
    lines = _around("Doe, J. (2001). ", name, ". Journal of ", kind, ", 12, 3-9.\n[2]. Roe A. ", name, ". Annals of ", kind, ". 1999;12(3):9.\n[3] Li W. ", name, "[J]. Steel Letters, 2005")
    one = _around("Smith J. The making of ", name, " in mills. Journal of ", kind, ". 2003")
    bib = _around("@article{k12, title={{", name, "}}, author={Poe, E.},\n journal={", kind, "}, year={2010}}")
    texts = spread(table(spark, sf_dir, "part")).select("p_partkey", F.when(key % 3 == 0, lines).when(key % 3 == 1, one).otherwise(bib).alias("text"))
    return parsing.parse_input(texts).select("p_partkey", "seq", "parsed.title", "parsed.authors", "parsed.journal", "parsed.year", "parsed.ref_number")


@query(
    """select p_partkey, case p_partkey % 3 when 1 then 'Unsupported file type' when 2 then 'Too little text' end as error, p_partkey % 3 = 0 as found,
case p_partkey % 3 when 0 then 'REFERENCES' else '' end as heading, case p_partkey % 3 when 0 then '[1] ' || p_name || ' of the first kind' || chr(10) || '[2] ' || p_type || ' of the second kind' end as section,
case p_partkey % 3 when 0 then p_name || ' of the first kind|' || p_type || ' of the second kind' end as refs from part"""
)
def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand, kind, key = _columns()
    file = F.when(key % 3 == 1, "a.txt").otherwise("A.PDF")
    body = _around("Some introduction of a paper on ", name, "\nREFERENCES\n[1] ", name, " of the first kind\n[2] ", kind, " of the second kind")
    files = spread(table(spark, sf_dir, "part")).select(key.alias("file_id"), file.alias("file_name"), F.when(key % 3 == 2, "short").otherwise(body).alias("text"))
    out = parsing.extract_files(files)
    heading = F.when(F.col("error").isNull(), F.col("heading")).otherwise("")
    split = F.array_join(parsing.split_simple(F.concat(F.lit("\n"), "section")), "|")
    return out.select(F.col("file_id").alias("p_partkey"), "error", (F.col("error").isNull() & F.col("found")).alias("found"), heading.alias("heading"), "section", split.alias("refs"))


@query(
    """select p_partkey, '@book{' || p_brand || ',' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  year = {' || p_size || '}' || chr(10) || '}' as entry from part"""
)
def bibtex_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand, kind, key = _columns()
    tags = F.create_map(F.lit("year"), F.col("p_size").cast("string"), F.lit("title"), name)
    return spread(table(spark, sf_dir, "part")).select("p_partkey", citations.entry_text(F.lit("book"), brand, tags).alias("entry"))


@query(
    """select p_partkey, p_partkey % 2 = 1 as title_off, p_partkey % 3 = 2 as year_off from part where p_partkey % 2 = 1 or p_partkey % 3 = 2"""
)
def strict_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A found title that is wholly other, or a found year two off."""
    name, brand, kind, key = _columns()
    year = 2000 + F.col("p_size") % 20
    rows = spread(table(spark, sf_dir, "part")).select(
        "p_partkey", _around(name, " (", year, ")").alias("reference"), F.when(key % 2 == 1, "QQQQQQQQQQQQQQQQQQ").otherwise(_around(name, " x")).alias("found_title"), (year + (key % 3).cast("int")).alias("found_year")
    )
    return corpus.strict_audit(rows).select("p_partkey", "title_off", "year_off")
