"""Catalog adapters, sources, and the citations of all five catalogs."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from refloom.operators import citations
from refloom.sources import catalogs

PAPER = "title string, authors array<string>, year int"


def cited(records):
    return citations.with_citations(records).first()


def test_semantic_scholar(spark):
    rows = spark.createDataFrame([("s1", "A title: on x", ["Ann B Cee", "Dan Eff"], 2019, "Venue", ("10.1/x",), "http://u", 3, False)], f"paperId string, {PAPER}, venue string, externalIds struct<DOI:string>, url string, citationCount int, isRetracted boolean")
    got = cited(catalogs.semantic_scholar(rows))
    assert got.apa == "Cee, A. B., & Eff, D. (2019). A title: on x. Venue. https://doi.org/10.1/x"
    assert got.mla == 'Ann B Cee and Dan Eff. "A title: on x." Venue, 2019. https://doi.org/10.1/x.'
    assert got.iso690 == "ANN B CEE; DAN EFF. A title: on x. Venue, 2019. https://doi.org/10.1/x"
    assert got.bibtex == "@article{Cee2019A,\n  title={A title: on x},\n  author={Ann B Cee and Dan Eff},\n  year={2019},\n  journal={Venue},\n  doi={10.1/x}\n}"
    bare = cited(catalogs.semantic_scholar(rows.withColumn("externalIds", F.lit(None).cast("struct<DOI:string>")).withColumn("year", F.lit(0)).withColumn("venue", F.lit(""))))
    assert bare.apa == "Cee, A. B., & Eff, D. (n.d.). A title: on x."
    assert bare.mla == 'Ann B Cee and Dan Eff. "A title: on x." n.d..'


def test_openalex(spark):
    rows = spark.createDataFrame([("https://openalex.org/W1", "Retracted: x", ["Solo"], 2020, "J", "https://doi.org/10.2/y", "https://doi.org/10.2/y", 1, False)], f"id string, {PAPER}, journal string, doi string, url string, citations int, isRetracted boolean")
    got = cited(catalogs.openalex(rows))
    assert got.retracted and got.apa.endswith(" J. https://doi.org/10.2/y") and "doi={10.2/y}" in got.bibtex


def test_arxiv(spark):
    rows = spark.createDataFrame([("1706.03762v5", "Attention", ["A Vas", "N Sha", "N Par"], 2017, "cs.CL", None, "http://arxiv.org/abs/1706.03762", None)], f"id string, {PAPER}, category string, doi string, url string, pdfUrl string")
    got = cited(catalogs.arxiv(rows))
    assert got.apa == "Vas, A., Sha, N., & Par, N. (2017). Attention. arXiv preprint arXiv:1706.03762v5. http://arxiv.org/abs/1706.03762"
    assert got.mla == 'A Vas, et al. "Attention." arXiv preprint arXiv:1706.03762v5, 2017. http://arxiv.org/abs/1706.03762.'
    assert got.bibtex == "@misc{Vas2017Attention,\n  title={Attention},\n  author={A Vas and N Sha and N Par},\n  year={2017},\n  eprint={1706.03762v5},\n  archivePrefix={arXiv},\n  primaryClass={cs.CL}\n}"
    assert got.arxiv_id == "1706.03762"


def test_dblp(spark):
    schema = f"key string, {PAPER}, venue string, type string, doi string, url string, eeUrl string"
    rows = spark.createDataFrame([("k", "Deep nets.", ["Jo Ho 0001"], 2018, "ICML", "Conference and Workshop Papers", None, "http://dblp/k", "http://ee/k"), ("m", "More.", [], 2018, "J", "Journal Articles", None, "http://dblp/m", "https://doi.org/10.3/z")], schema)
    got = {r.rec_id: r for r in citations.with_citations(catalogs.dblp(rows)).collect()}
    assert got["k"].apa == "Ho, J. (2018). Deep nets. ICML. http://ee/k" and got["k"].url == "http://ee/k"
    assert "@inproceedings{Ho2018Deep" in got["k"].bibtex and "booktitle={ICML}" in got["k"].bibtex
    assert got["m"].doi == "10.3/z" and "@article{Unknown2018More" in got["m"].bibtex


def test_dblp_authors(spark):
    raw = ['"One Name"', '{"text": "Two Name 0002"}', '[{"text": "A B"}, "C D"]']
    rows = spark.createDataFrame([(x,) for x in raw], "raw string")
    assert [list(r.a) for r in rows.select(catalogs.dblp_authors(F.col("raw")).alias("a")).collect()] == [["One Name"], ["Two Name"], ["A B", "C D"]]


def test_atom_authors_keep_their_digits(spark):
    xml = "<feed><entry><id>http://arxiv.org/abs/1</id><title>T</title><author><name> Group 10 </name></author><author><name>B1</name></author></entry></feed>"
    assert list(catalogs.atom_entries(spark.createDataFrame([(xml,)], "xml string")).first().authors) == ["Group 10", "B1"]


FEED = """<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>query</title>
<entry><id>http://arxiv.org/abs/2301.12345v2</id><title type="html">A &amp; B &lt; C
  <![CDATA[x < y]]> d</title><title>not this</title><published>2023-01-17T00:00:00Z</published><author><name>J &#233; Doe</name><arxiv:affiliation>X</arxiv:affiliation></author><author><name> R Roe </name></author>
<arxiv:doi> 10.1/x </arxiv:doi><link title="doi" href="http://dx" rel="related"/><link href="http://a" rel="alternate" type="text/html"/><link title="pdf" href="http://p" rel="related" type="application/pdf"/>
<arxiv:primary_category term="cs.CL" scheme="s"/></entry>
<entry><id>odd</id><title>t2</title></entry><entry><id>http://arxiv.org/abs/1</id><title> </title></entry></feed>"""


def test_feeds_are_decoded(spark):
    rows = spark.createDataFrame([(FEED,), ("<feed><entry><id>1</id><title>never closed</title>",), (None,), ("no & xml",), ("<feed></feed>",)], "xml string")
    got = {r.id: r for r in catalogs.atom_entries(rows).collect()}
    assert set(got) == {"2301.12345", "odd"}
    first, odd = got["2301.12345"], got["odd"]
    assert (first.title, list(first.authors), first.year, first.category, first.doi) == ("A & B < C x < y d", ["J é Doe", "R Roe"], 2023, "cs.CL", "10.1/x")
    assert (first.url, first.pdfUrl) == ("http://a", "http://p")
    assert (list(odd.authors), odd.year, odd.category, odd.doi, odd.url, odd.pdfUrl) == ([], None, None, None, "https://arxiv.org/abs/odd", "https://arxiv.org/pdf/odd")


def test_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.txt").write_text("line 1\nline 2")
    (tmp_path / "c.pdf").write_text("no")
    (tmp_path / "list.json").write_text(json.dumps({"publishers": ["Bad Press"], "journals": ["J of Bad"]}))
    assert catalogs.docx_text(spark, str(tmp_path)).first().text.split() == ["One", "&", "two", "three"]
    assert [r.text for r in catalogs.text_files(spark, str(tmp_path)).collect()] == ["line 1\nline 2"]
    assert {(r.kind, r.name) for r in catalogs.denylist(spark, str(tmp_path / "list.json")).collect()} == {("publisher", "Bad Press"), ("journal", "J of Bad")}
