"""Queries of catalogs, the waterfall, whole batches, reports and progressive runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import extract
from refloom.operators import citations, duplicates, parsing, report, resolve, verify
from refloom.operators.stored import shared_folder
from refloom.plans.base import query, table
from refloom.sources import catalogs
from refloom.streaming import progress

#: The clock of the queries.
AS_OF = 2000


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper for each part: k, title (unlike any other), year, venue, arXiv id."""
    part = table(spark, sf_dir, "part")
    key = F.md5(F.col("p_partkey").cast("string"))
    return part.select(
        F.col("p_partkey").alias("k"),
        F.concat_ws(" ", F.substring(key, 1, 16), F.col("p_name"), F.substring(key, 17, 16)).alias("title"),
        (1990 + F.col("p_size")).cast("int").alias("year"),
        F.when(F.col("p_size") % 10 == 0, "Hindawi Letters").otherwise(F.concat(F.lit("Journal of "), F.col("p_type"))).alias("venue"),
        F.concat(F.lit("2101."), F.lpad(F.col("p_partkey").cast("string"), 5, "0")).alias("arxiv_id"),
    )


_PAPERS_SQL = """with p as (select p_partkey as k, substr(md5(p_partkey::varchar), 1, 16) || ' ' || p_name || ' ' || substr(md5(p_partkey::varchar), 17, 16) as title, 1990 + p_size as year,
case when p_size % 10 = 0 then 'Hindawi Letters' else 'Journal of ' || p_type end as venue, '2101.' || lpad(p_partkey::varchar, 5, '0') as arxiv_id from part) """


def _catalog(papers: DataFrame) -> DataFrame:
    """Papers in the schema of one provider or another: CrossRef, Semantic Scholar, OpenAlex, arXiv (as a feed), DBLP."""
    number = F.col("k").cast("string")
    of = lambda *rest: papers.filter((F.col("k") % 6).isin(*rest))
    doi = F.concat(F.lit("10.1000/"), number)
    date = F.array(F.array("year"))
    crossref = of(0, 1, 3).select(
        doi.alias("DOI"), F.array("title").alias("title"), F.array(F.struct(F.lit("Doe").alias("family"), F.lit("J").alias("given"))).alias("author"), F.array("venue").alias("container_title"),
        *[date.alias(c) for c in ("published", "published_print", "published_online", "issued")], F.array(F.array(F.lit(0))).alias("created"), F.concat(F.lit("https://x.org/"), number).alias("URL"),
        F.lit("X").alias("publisher"), F.array(F.struct(F.lit("correction").alias("type"))).alias("update_to"), F.array().cast("array<string>").alias("is_retracted_by"), F.lit(3).alias("is_referenced_by_count"),
    )
    scholar = of(4).select(
        number.alias("paperId"), "title", F.array(F.lit("J Doe")).alias("authors"), "year", "venue", F.struct(doi.alias("DOI")).alias("externalIds"), F.lit("u").alias("url"), F.lit(5).alias("citationCount"), F.lit(False).alias("isRetracted")
    )
    alex = of(2).select(
        number.alias("id"), F.concat(F.lit("Retracted: "), F.reverse("title")).alias("title"), F.array(F.lit("J Doe")).alias("authors"), "year", F.col("venue").alias("journal"), F.concat(F.lit("https://doi.org/"), doi).alias("doi"),
        F.lit("u").alias("url"), F.lit(7).alias("citations"), F.lit(False).alias("isRetracted"),
    )
    tag = lambda name, col: F.concat(F.lit(f"<{name}>"), col, F.lit(f"</{name}>"))
    entry = F.concat(
        tag("id", F.concat(F.lit("http://arxiv.org/abs/"), F.col("arxiv_id"), F.lit("v2"))), tag("title", F.concat(F.regexp_replace("title", " ", "\n  "), F.lit(" &amp; <![CDATA[<]]>"))), tag("published", F.concat(F.col("year").cast("string"), F.lit("-01-01T00:00:00Z"))),
        F.lit("<author><name>J D&#111;e</name></author>"), F.lit('<arxiv:primary_category term="cs.AI"/><link href="http://arxiv.org/abs/'), F.col("arxiv_id"), F.lit('" rel="alternate"/>'),
    )
    feeds = of(5).select(F.concat(F.lit("<feed>"), tag("entry", entry), F.lit("</feed>")).alias("xml"))
    dblp = of(2).select(
        F.concat(F.lit("k/"), number).alias("key"), F.concat(F.reverse("title"), F.lit(".")).alias("title"), F.array(F.lit("Jo Doe 0002")).alias("authors"), "year", "venue", F.lit("Conference").alias("type"), F.lit(None).cast("string").alias("doi"),
        F.lit("u").alias("url"), F.concat(F.lit("https://doi.org/"), doi).alias("eeUrl"),
    )
    parts = [catalogs.crossref(crossref), catalogs.semantic_scholar(scholar), catalogs.openalex(alex), catalogs.arxiv(catalogs.atom_entries(feeds)), catalogs.dblp(dblp)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    _PAPERS_SQL
    + """, c as (select 'CrossRef' as source, '10.1000/' || k as rec_id, title, 'J Doe' as authors, year::varchar as year, venue, '10.1000/' || k as doi, 3::bigint as citations, false as retracted from p where k % 6 in (0, 1, 3)
union all select 'SemanticScholar', k::varchar, title, 'J Doe', year::varchar, venue, '10.1000/' || k, 5, false from p where k % 6 = 4
union all select 'OpenAlex', k::varchar, 'Retracted: ' || reverse(title), 'J Doe', year::varchar, venue, 'https://doi.org/10.1000/' || k, 7, true from p where k % 6 = 2
union all select 'arXiv', arxiv_id, title || ' & <', 'J Doe', year::varchar, 'arXiv', null, null, false from p where k % 6 = 5
union all select 'DBLP', 'k/' || k, reverse(title), 'Jo Doe', year::varchar, venue, '10.1000/' || k, null, false from p where k % 6 = 2)
select * from c"""
)
def catalog_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(_papers(spark, sf_dir)).select("source", "rec_id", "title", F.array_join("authors", "|").alias("authors"), "year", "venue", "doi", "citations", "retracted")


@query(
    _PAPERS_SQL
    + """, c as (select 'CrossRef' as source, '10.1000/' || k as id, title as t, venue as v, year as y, 'https://doi.org/10.1000/' || k as link, 'Doe, J' as mla, 'DOE, J' as iso, 'Doe, J' as bib, 'article' as kind, 'journal={' || venue || '}' as own, '10.1000/' || k as doi from p where k % 6 in (0, 1, 3)
union all select 'SemanticScholar', k::varchar, title, venue, year, 'https://doi.org/10.1000/' || k, 'J Doe', 'J DOE', 'J Doe', 'article', 'journal={' || venue || '}', '10.1000/' || k from p where k % 6 = 4
union all select 'OpenAlex', k::varchar, 'Retracted: ' || reverse(title), venue, year, 'https://doi.org/10.1000/' || k, 'J Doe', 'J DOE', 'J Doe', 'article', 'journal={' || venue || '}', '10.1000/' || k from p where k % 6 = 2
union all select 'arXiv', arxiv_id, title || ' & <', 'arXiv preprint arXiv:' || arxiv_id, year, 'http://arxiv.org/abs/' || arxiv_id, 'J Doe', 'J DOE', 'J Doe', 'misc', 'eprint={' || arxiv_id || '},' || chr(10) || '  archivePrefix={arXiv},' || chr(10) || '  primaryClass={cs.AI}', null from p where k % 6 = 5
union all select 'DBLP', 'k/' || k, reverse(title), venue, year, 'https://doi.org/10.1000/' || k, 'Jo Doe', 'JO DOE', 'Jo Doe', 'inproceedings', 'booktitle={' || venue || '}', '10.1000/' || k from p where k % 6 = 2)
select source, id as rec_id, 'Doe, J. (' || y || '). ' || t || '. ' || v || '. ' || link as apa, mla || '. "' || t || '." ' || v || ', ' || y || '. ' || link || '.' as mla, iso || '. ' || t || '. ' || v || ', ' || y || '. ' || link as iso690,
'@' || kind || '{Doe' || y || regexp_replace(string_split(t, ' ')[1], '[^a-zA-Z0-9]', '', 'g') || ',' || chr(10) || '  title={' || t || '},' || chr(10) || '  author={' || bib || '},' || chr(10) || '  year={' || y || '},' || chr(10) || '  ' || own
|| coalesce(',' || chr(10) || '  doi={' || doi || '}', '') || chr(10) || '}' as bibtex from c"""
)
def catalog_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four styles of the records of all five catalogs."""
    return citations.with_citations(_catalog(_papers(spark, sf_dir))).select("source", "rec_id", "apa", "mla", "iso690", "bibtex")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four references of each batch, one line each, and the first of them again."""
    papers = _papers(spark, sf_dir)
    k = F.col("k") % 6
    year = F.col("year") + F.when(k == 3, 10).otherwise(0)
    journal = F.when(k == 3, "Physics of stones").otherwise(F.col("venue"))
    link = F.when(k == 1, F.concat(F.lit(" https://doi.org/10.1000/"), F.col("k").cast("string"))).when(k == 5, F.concat(F.lit(" arXiv:"), F.col("arxiv_id"), F.lit("v2"))).otherwise("")
    line = F.concat(F.lit("Doe, J. ("), year.cast("string"), F.lit("). "), F.col("title"), F.lit(". "), journal, F.lit(", 12, 3-9."), link)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("x")))), lambda r: r["x"])
    texts = papers.groupBy(F.floor(F.col("k") / 4).alias("batch_id")).agg(lines.alias("lines"))
    return texts.select("batch_id", F.array_join(F.concat("lines", F.slice("lines", 1, 1)), "\n").alias("text"))


_VERIFY_SQL = (
    _PAPERS_SQL
    + f""", r as (select *, k // 4 as batch_id, (k % 4)::int as seq, k % 6 as c from p), f as (select * replace (4 as seq) from r where k % 4 = 0),
v as (select batch_id, seq, k, case c when 1 then 'doi' when 5 then 'arxiv' when 2 then 'none' else 'search' end as path, c <> 2 as e,
case c when 2 then 'NotFound' when 4 then 'SemanticScholar' when 5 then 'arXiv' else 'CrossRef' end as source, case c when 2 then 0.0 when 3 then 65.0 when 4 then 95.0 else 100.0 end::double as conf,
(case c when 2 then 1 when 3 then 2 else 0 end + (c in (0, 3, 4) and year + case c when 3 then 10 else 0 end > {AS_OF + 1})::int)::int as n_issues, venue like 'Hindawi%' and c <> 5 as predatory, case seq when 4 then 1 end::bigint as duplicate_of
from (from r union all by name from f)) """
)


@query(
    _VERIFY_SQL
    + """select batch_id, seq, path, e as "exists", source, conf as confidence, n_issues, predatory, duplicate_of,
case when not e then 'Not Found' when conf > 80 then 'Verified' else 'Partial' end as status, case when not e then 'not_found' when conf >= 80 then 'verified' else 'partial_match' end as service_status from v"""
)
def verify_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = verify.verify_batch(_batches(spark, sf_dir), _catalog(_papers(spark, sf_dir)), catalogs.denylist(spark), AS_OF)
    return checked.select(
        "batch_id", "seq", "path", "exists", "source", "confidence", F.size("issues").alias("n_issues"), "predatory", F.col("duplicate_of").cast("long").alias("duplicate_of"), "status", "service_status"
    )


@query(
    _PAPERS_SQL
    + f"""select k as ref_id, case k % 3 when 0 then 'search' when 1 then 'none' else 'none' end as path, k % 3 <> 1 as "exists", case k % 3 when 0 then 'CrossRef' else 'NotFound' end as source,
case k % 3 when 0 then '' when 1 then '{resolve.NOWHERE}' else '{resolve.BAD_DOI[0]}10.9999/' || k || '{resolve.BAD_DOI[1]}' end as issues from p"""
)
def free_text_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text without parsed fields: found by its words, not at all, or by a DOI that leads nowhere."""
    papers = _papers(spark, sf_dir)
    null, case = F.lit(None).cast("string"), F.col("k") % 3
    raw = F.when(case == 0, F.concat(F.lit("Doe J. "), F.col("title"), F.lit(". "), F.col("venue"), F.lit(". "), F.col("year").cast("string"))).otherwise(F.concat(F.reverse(F.md5("title")), F.lit(" nothing of the kind")))
    doi = F.when(case == 2, F.concat(F.lit("10.9999/"), F.col("k").cast("string")))
    refs = papers.select(F.col("k").alias("ref_id"), raw.alias("raw"), null.alias("title"), null.alias("authors"), null.alias("journal"), null.alias("year"), doi.alias("doi"), null.alias("arxiv_id"))
    return resolve.resolve(refs, _catalog(_papers(spark, sf_dir))).select("ref_id", "path", "exists", "source", F.array_join("issues", "|").alias("issues"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of batches, one batch for each customer."""
    key = F.col("o_orderkey").cast("string")
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("batch_id"),
        F.col("o_orderkey").alias("seq"),
        F.repeat("o_orderpriority", F.lit(20)).alias("raw"),
        (F.col("o_orderstatus") != "P").alias("exists"),
        F.when(F.col("o_orderkey") % 7 == 0, "NotFound").otherwise("CrossRef").alias("source"),
        (F.floor("o_totalprice") % 101).cast("double").alias("confidence"),
        F.col("o_orderpriority").alias("title"),
        F.lit("Doe, J").alias("authors"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.when(F.col("o_orderkey") % 3 == 0, "J").alias("journal"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("10.1/"), key)).alias("doi"),
        F.concat(F.lit("u/"), key).alias("url"),
        F.when(F.col("o_orderkey") % 5 == 0, 9).alias("citations"),
        (F.col("o_orderkey") % 11 == 0).alias("retracted"),
        (F.col("o_orderkey") % 13 == 0).alias("predatory"),
        F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("issues"),
        F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("@x{"), key, F.lit("}"))).alias("bibtex"),
    )


_ROWS_SQL = """with r as (select o_custkey as batch_id, o_orderkey as seq, repeat(o_orderpriority, 20) as raw, o_orderstatus <> 'P' as e, case when o_orderkey % 7 = 0 then 'NotFound' else 'CrossRef' end as source,
floor(o_totalprice)::bigint % 101 as conf, o_orderpriority as title, year(o_orderdate)::varchar as year, case when o_orderkey % 3 = 0 then 'J' end as journal, case when o_orderkey % 2 = 0 then '10.1/' || o_orderkey end as doi,
'u/' || o_orderkey as url, o_orderkey % 5 = 0 as cited, o_orderkey % 11 = 0 as retracted, o_orderkey % 13 = 0 as predatory, case when o_orderkey % 4 = 0 then 'a; b' else '' end as issues,
row_number() over (partition by o_custkey order by o_orderkey) as n, count(*) over (partition by o_custkey) as alln from orders),
s as (select *, case when not e or source = 'NotFound' then 'not_found' when conf >= 80 then 'verified' when conf >= 50 then 'partial_match' else 'mismatch' end as class, e and source <> 'NotFound' as there from r) """


@query(
    _ROWS_SQL
    + """, t as (select *, case when alln > 1 then '[' || n || '] ' else '' end || case class when 'verified' then '✅ **Verified' when 'partial_match' then '⚠️ **Partial Match' when 'mismatch' then '❌ **Mismatch' else '🔍 **Not Found' end
|| '** (confidence: ' || conf || '%)' || chr(10) || '   Input: ' || left(raw, 120) || case when length(raw) > 120 then '…' else '' end
|| case when there then chr(10) || '   Title: ' || title || chr(10) || '   Authors: Doe, J' || chr(10) || '   Year: ' || year || coalesce(chr(10) || '   Journal/Venue: ' || journal, '')
|| coalesce(chr(10) || '   DOI: https://doi.org/' || doi, chr(10) || '   URL: ' || url) || case when cited then chr(10) || '   Citations: 9' else '' end || chr(10) || '   Source: ' || source
|| case when retracted then chr(10) || '   🚨 **RETRACTED/WITHDRAWN**' else '' end else '' end || case when issues <> '' then chr(10) || '   Issues: ' || issues else '' end as text from s)
select batch_id, case when count(*) > 1 then '# Reference Verification Report' || chr(10) || '**Total: ' || count(*) || '** | ✅ Verified: ' || count(*) filter (class = 'verified') || ' | ⚠️ Partial: ' || count(*) filter (class = 'partial_match')
|| ' | ❌ Mismatch: ' || count(*) filter (class = 'mismatch') || ' | 🔍 Not Found: ' || count(*) filter (class = 'not_found') || chr(10) || '---' || chr(10) else '' end || string_agg(text, chr(10) || chr(10) order by seq) as markdown from t group by batch_id"""
)
def service_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.service_report(_rows(spark, sf_dir)).select("batch_id", "markdown")


@query(
    _ROWS_SQL
    + """select batch_id, n::int as "No", raw as "Original Reference", case when not e then 'Not Found' when conf > 80 then 'Verified' when conf > 50 then 'Partial Match' else 'Mismatch / Error' end as "Status", title as "Found Title",
'Doe, J' as "Found Authors", year as "Found Year", coalesce(journal, '') as "Found Journal", coalesce(doi, '') as "DOI", case when e then conf else 0 end::varchar as "Confidence (%)", issues as "Issues",
case when retracted then 'YES' else 'NO' end as "Retracted", case when predatory then 'YES' else 'NO' end as "Predatory", source as "Source" from s"""
)
def spreadsheet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.spreadsheet(_rows(spark, sf_dir)).withColumnRenamed("No.", "No")


@query(_ROWS_SQL + "select batch_id, string_agg('@x{' || seq || '}', chr(10) || chr(10) order by seq) as text from s where e and seq % 3 > 0 group by batch_id")
def export_bib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.bib_file(_rows(spark, sf_dir))


@query(
    _ROWS_SQL
    + """, w as (select *, unnest(['all', 'verified', 'partial', 'mismatch', 'notfound']) as which from s)
select which, batch_id as file_id, string_agg(seq::varchar, ',' order by seq) as kept from w
where which = 'all' or which = case when not e then 'notfound' when conf > 80 then 'verified' when conf > 50 then 'partial' else 'mismatch' end group by all"""
)
def file_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("file_id", F.col("batch_id")).withColumn("result", F.col("seq").cast("string"))
    out = None
    for which in ("all", "verified", "partial", "mismatch", "notfound"):
        part = report.by_file_filter(rows, which).select(F.lit(which).alias("which"), "file_id", F.array_join("results", ",").alias("kept"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    _ROWS_SQL
    + """select count(*) as total, count(*) filter (e and conf > 80) as verified, count(*) filter (e and conf > 50 and conf <= 80) as partial, count(*) filter (e and conf <= 50) as mismatch, count(*) filter (not e) as not_found,
count(distinct batch_id) as n_files, count(*) as n_refs from s"""
)
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    files = rows.groupBy(F.col("batch_id").alias("file_id")).agg(F.collect_list("seq").alias("refs"))
    return report.page_counts(rows).crossJoin(report.file_totals(files).select("n_files", F.col("n_refs").cast("long").alias("n_refs")))  # one row each


@query(
    _ROWS_SQL
    + """select count(*) filter (seq % 2 = 0 and seq % 40 > 20) as found_after_all, count(*) filter (not (seq % 2 = 0 and seq % 40 > 20)) as missing, count(*) as total from s where not e"""
)
def second_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was not found is looked up again; every second reference has two hits."""
    rows = _rows(spark, sf_dir).select(F.col("seq").alias("ref_id"), F.when(F.col("exists"), "Verified").otherwise("Not Found").alias("status"))
    score = (F.col("ref_id") % 40).cast("double")
    hits = rows.filter("ref_id % 2 = 0").select("ref_id", F.explode(F.array(score, score - 1)).alias("score")).withColumn("found_title", F.lit("t"))
    return report.verdict_counts(report.reprobed(rows, hits))


@query(
    f"""select p_partkey, p_partkey % 24 < 20 and p_partkey % 3 = 0 as listed, case when p_partkey % 2 = 0 then '@book{{k' || p_partkey || ', title={{' || p_name || '}}}}' end as entry,
'Doe, J. (2001). ' || p_name || '. J, 1.|Roe, A. (2002b). ' || p_type || '. K, 2.' as refs, 'body of ' || p_name as first_section from part"""
)
def listed_and_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*catalogs.DENYLIST_PUBLISHERS, *catalogs.DENYLIST_JOURNALS, "a", "b", "c", "d"]
    name = F.get(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % 24).cast("int"))
    venue = F.when(F.col("p_partkey") % 3 == 0, F.upper(name)).otherwise(F.concat(name, F.lit(" Letters")))
    number, title = F.col("p_partkey").cast("string"), F.col("p_name")
    bib = F.concat(F.lit("@article{a, title={x}}\n@book{k"), F.when(F.col("p_partkey") % 2 == 0, number).otherwise("?"), F.lit(", title={"), title, F.lit("}}\n  @misc{k"), F.lit("z, title={y}}"))
    glued = F.concat(F.lit("Doe, J. (2001). "), title, F.lit(". J, 1. Roe, A. (2002b). "), F.col("p_type"), F.lit(". K, 2."))
    paper = F.concat(F.lit("Text\nReferences\nbody of "), title, F.lit("\nAppendix\nmore\nReferences\nlast"))
    rows = duplicates.exactly_listed(table(spark, sf_dir, "part").withColumn("venue", venue), catalogs.denylist(spark))
    return rows.select(
        "p_partkey",
        "listed",
        F.nullif(extract.bibtex_slice(bib, F.concat(F.lit("k"), number)), F.lit("")).alias("entry"),
        F.array_join(parsing.deglue(glued), "|").alias("refs"),
        parsing.find_section(paper, first=True)["section"].alias("first_section"),
    )


@query("select event_type, count(*) as n, round(sum(value), 3) as total from events group by event_type")
def progressive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events published progressively by a stream, in two runs of which the second finds nothing new."""
    folder = f"{shared_folder(spark)}/progressive-{uuid.uuid4().hex}"
    source = f"{sf_dir}/events*.parquet"
    schema = table(spark, sf_dir, "events").schema
    for _ in range(2):
        progress.process_new(spark, source, schema, lambda b: b.select("event_id", "event_type", "value"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
