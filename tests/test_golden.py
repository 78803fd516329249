"""Golden rows worked out by hand: similarity, extraction, parsing, classes, statistics."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from refloom.functions import extract, similarity, text
from refloom.operators import citations, corpus, duplicates, parsing, report, resolve
from refloom.sources import catalogs

LONG = "Silver, D., Huang, A. (2016). Mastering the game of Go with deep neural networks and tree search. Nature, 529, 484-489."


def one(spark, expression, **values):
    """The value of an expression over one row of strings."""
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "whole", "title"),
    [
        ("Produção e uso setorial de tecnologia no Brasil", "Produção e uso de tecnologia setorial no Brasil", 100, 100),
        ("Attention is all you need", "Attention Is All You Need.", 100, 100),
        ("Deep Learning", "Deep Residual Learning", 67, 67),
        ("Generative Adversarial Nets", "Generative adversarial networks", 87, 87),
        ("", "x", 0, 0),
        ("深度学习", "学习", 100, 0),
        (LONG, "Mastering the game of Go with deep neural networks and tree search", None, 95),
    ],
)
def test_similarity(spark, a, b, whole, title):
    if whole is not None:
        assert one(spark, similarity.similarity(F.col("a"), F.col("b")), a=a, b=b) == whole
    assert one(spark, similarity.title_similarity(F.col("a"), F.col("b")), a=a, b=b) == title


@pytest.mark.parametrize(
    ("expected", "authors", "score"),
    [
        ("LeCun, Yann and Bengio, Yoshua and Hinton, Geoffrey", ["Yann LeCun", "Yoshua Bengio", "Geoffrey E. Hinton"], 100),
        ("Vaswani, A. et al.", ["Ashish Vaswani", "Noam Shazeer"], 100),
        ("Vaswani", ["Ashish Vaswani", "Noam Shazeer", "Niki Parmar"], 33),
        ("Smith, J.", ["Ashish Vaswani", "Noam Shazeer"], 0),
        ("Smith, J.", [], 100),
        ("Ho, J.", ["Jonathan Ho 0001"], 100),
    ],
)
def test_author_similarity(spark, expected, authors, score):
    assert one(spark, similarity.author_similarity(F.col("a"), F.col("b")), a=expected, b=authors) == score


@pytest.mark.parametrize(("title", "author", "asked", "found", "score"), [(100, 100, "2017", "2017", 140), (90, 60, "2016", "2017", 95), (85, 50, "2015", "2017", 78.3333333)])
def test_result_score(spark, title, author, asked, found, score):
    nothing = F.lit("")
    value = one(spark, resolve.result_score(F.lit(title), F.lit(author), F.col("a"), F.col("b"), nothing, nothing), a=asked, b=found)
    assert value == pytest.approx(score)


@pytest.mark.parametrize(("raw", "number"), [("[12] Foo", 12), ("1. Foo", 1), ("(3) Foo", 3), ("2015. Foo", 2015), ("[12]Foo", None), ("12Foo", None)])
def test_reference_number(spark, raw, number):
    assert one(spark, extract.number(F.col("a")), a=raw) == number


@pytest.mark.parametrize(("raw", "rest"), [("[12]Foo", "Foo"), ("3D reconstruction of", "D reconstruction of"), ("2016 was", "was")])
def test_number_is_stripped(spark, raw, rest):
    assert one(spark, extract.without_number(F.col("a")), a=raw) == rest


def test_ids(spark):
    assert one(spark, extract.doi(F.col("a")), a="x. https://doi.org/10.1038/nature14539.") == "10.1038/nature14539"
    assert one(spark, extract.arxiv_id(F.col("a")), a="arXiv:1706.03762v5") == "1706.03762"
    assert one(spark, extract.year(F.col("a")), a="in 1850, 2017 and 2018") == "2017"


def test_ligatures_are_spelled_out(spark):
    assert one(spark, text.plain_ascii(F.col("a")), a="ﬀ ﬁ ﬂ ﬃ ﬄ ﬅ ﬆ") == "ff fi fl ffi ffl st st"


def test_compatibility_characters_are_those_of_unicode(spark):
    """Every code point, as decomposition and removal of what is not ASCII give it."""
    marks = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c) not in "\n\t\r " and not chr(c).isspace()]
    rows = [(k, "".join(f"<{chr(c)}>" for c in marks[k : k + 2000])) for k in range(0, len(marks), 2000)]
    got = dict(spark.createDataFrame(rows, "k int, t string").select("k", text.plain_ascii(F.col("t"))).collect())
    plain = lambda t: re.sub(" +", " ", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()).strip()
    assert got == {k: plain(t) for k, t in rows}


def test_a_pattern_is_matched_once_a_row(spark):
    """The dearest expressions stand once in the optimised plan."""
    refs = spark.createDataFrame([("Doe, J. (2001). A title. J, 1.",)], "raw string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(refs.select(parsing.apa_style(F.col("raw")).alias("p")).select("p.title", "p.authors", "p.year", "p.journal")).count(r"\((\d{4})\)\.") == 1
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert plan(pairs.select(similarity.title_similarity(F.col("a"), F.col("b")).alias("s"))).count("translate(") == 2
    venues = spark.createDataFrame([("x",)], "venue string")
    assert plan(duplicates.on_denylist(venues, catalogs.denylist(spark))).count("lower(") == 1


def test_styles(spark):
    assert one(spark, parsing.apa_style(F.col("a")), a="Doe, J. (2016). Foo bar. Nature, 5").title == "Foo bar"
    assert one(spark, parsing.chinese_style(F.col("a")), a="[12] Foo") is None or one(spark, parsing.chinese_style(F.col("a")), a="[12] Foo").title is None
    parsed = one(spark, parsing.parse_reference(F.col("a")), a="1. Vaswani A. Attention is all you need. Nature. 2017;12(3):9.")
    assert (parsed.title, parsed.authors, parsed.journal, parsed.year, parsed.ref_number) == ("Attention is all you need", "Vaswani A", "Nature", "2017", 1)


def test_bibtex(spark):
    source = "@article{lecun2015deep, title={Deep {L}earning}, year = 2015, journal = \"Nature\"}\n@misc{x, title={A\nB}}"
    rows = parsing.parse_bibtex(spark.createDataFrame([(source,)], "text string")).orderBy("seq").collect()
    assert [(r.entry_type, r.citation_key) for r in rows] == [("article", "lecun2015deep"), ("misc", "x")]
    assert rows[0].tags["title"] == "Deep {L}earning" and rows[0].tags["year"] == "2015" and rows[0].tags["journal"] == "Nature"


@pytest.mark.parametrize(
    ("source", "entries"),
    [
        ('@article{a, title="x } y", year={2001}}', [("article", "a", {"title": "x } y", "year": "2001"})]),
        ('@a{b, month = jan # " 1"}', []),
        ("@a{b, t={x}, }", []),
        ("@a{b, t={x},\n}", [("a", "b", {"t": "x"})]),
        ("@a{b, t={x {y} z", [("a", "b", {"t": "x {y} z"})]),
        ('@a{b, t="never closed }', [("a", "b", {"t": "never closed }"})]),
        ("@a @b{c, t=1}", []),
        ("@Ab{K:1/x, T = 1, t = {}, t={two\r\nlines}}junk@c{d}", [("Ab", "K:1/x", {"t": "twolines"}), ("c", "d", {})]),
        ("@comment{just words} @x{y, z = {1}}", [("x", "y", {"z": "1"})]),
        ("nothing", []),
        ("", []),
        (None, []),
    ],
)
def test_bibtex_scanner(source, entries):
    assert list(parsing.BibtexScanner(source or "").entries()) == entries


def test_bibtex_of_null_text(spark):
    assert parsing.parse_bibtex(spark.createDataFrame([(1, None), (2, "@x{y}")], "id int, text string")).collect() == [(2, 0, "x", "y", {})]


@pytest.mark.parametrize(
    ("exists", "source", "confidence", "ui", "service"),
    [
        (True, "CrossRef", 80.0, "Partial", "verified"),
        (True, "CrossRef", 80.5, "Verified", "verified"),
        (True, "CrossRef", 50.0, "Mismatch", "partial_match"),
        (True, "NotFound", 0.0, "Mismatch", "not_found"),
        (False, "NotFound", 0.0, "Not Found", "not_found"),
    ],
)
def test_status_boundaries(spark, exists, source, confidence, ui, service):
    row = spark.createDataFrame([(exists, source, confidence)], "e boolean, s string, c double")
    got = row.select(report.ui_status(F.col("e"), F.col("c")).alias("u"), report.service_status(F.col("e"), F.col("s"), F.col("c")).alias("m")).first()
    assert (got.u, got.m) == (ui, service)


def test_cohorts(spark):
    sizes = {"2016": (80, 8905), "2023": (101, 7620), "2025": (86, 3541), "2026": (40, 2413)}
    rows = spark.createDataFrame([(y, yes, n - yes) for y, (yes, n) in sizes.items()], "y string, yes long, no long")
    every = rows.select("y", F.explode(F.array(F.struct(F.lit(True).alias("f"), F.col("yes").alias("n")), F.struct(F.lit(False).alias("f"), F.col("no").alias("n")))).alias("c"))
    every = every.select("y", "c.f", F.explode(F.sequence(F.lit(1), F.col("c.n"))).alias("i"))
    assert corpus.chi_square(corpus.crosstab(every, "y", "f")).first().statistic == pytest.approx(45.7590, abs=1e-3)
    assert corpus.chi_square(corpus.crosstab(every.filter("y <> '2026'"), "y", "f")).first().statistic == pytest.approx(45.1945, abs=1e-3)
    tested = corpus.independence(every.filter("y <> '2026'"), "y", "f").first()
    assert (tested.statistic, tested.dof) == (pytest.approx(45.1945, abs=1e-3), 2) and tested.p_value == pytest.approx(1.5e-10, rel=0.1)


@pytest.mark.parametrize(("tp", "fp", "fn", "tn", "p", "r", "f1", "fpr"), [(200, 114, 0, 86, 0.6369, 1, 0.7782, 0.57), (197, 1, 3, 199, 0.9949, 0.985, 0.9899, 0.005)])
def test_detector(spark, tp, fp, fn, tn, p, r, f1, fpr):
    rows = [(True, True)] * tp + [(False, True)] * fp + [(True, False)] * fn + [(False, False)] * tn
    got = corpus.detector_metrics(spark.createDataFrame(rows, "t boolean, p boolean"), "t", "p").first()
    assert (got.precision, got.recall, got.f1, got.fpr) == pytest.approx((p, r, f1, fpr), abs=1e-4)


def test_duplicates_and_denylist(spark):
    refs = [("b", 1, None, "Deep learning for everyone and all"), ("b", 2, None, "deep learning for everyone, and all!"), ("b", 3, None, "Other"), ("c", 1, None, "Other")]
    pairs = duplicates.duplicate_pairs(spark.createDataFrame(refs, "batch_id string, seq long, raw string, title string")).collect()
    assert [(r.batch_id, r.orig_seq, r.dup_seq) for r in pairs] == [("b", 1, 2)]
    venues = spark.createDataFrame([("Hindawi Letters",), ("Nature",), (None,)], "venue string")
    flags = {r.venue: r.predatory for r in duplicates.on_denylist(venues, catalogs.denylist(spark)).collect()}
    assert flags["Hindawi Letters"] and not flags["Nature"] and not flags[None]


def test_lists_are_renumbered_after_the_filter(spark):
    rows = spark.createDataFrame([("b", 1, True, "A"), ("b", 2, False, "B"), ("b", 3, True, "C"), ("b", 4, True, None)], "batch_id string, seq int, exists boolean, apa string")
    assert citations.joined_text(citations.numbered_list(rows, "apa")).first().text == "[1] A\n\n[2] C"


def test_atom_feed(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1706.03762v5</id><title>Attention\n  is all</title><published>2017-06-12T00:00:00Z</published><author><name>A B</name></author></entry></feed>'
    row = catalogs.atom_entries(spark.createDataFrame([(xml,)], "xml string")).first()
    assert row.title == "Attention is all" and row.year == 2017 and list(row.authors) == ["A B"]


def test_a_denylist_of_any_length_is_used_whole(spark):
    names = [(f"Publisher number {i} of the world",) for i in range(5000)] + [(f"Press{i}",) for i in range(5000)] + [("Last Name",)]
    listed = spark.createDataFrame(names, "name string")
    venues = ["The PUBLISHER number 4999 of the world, Inc.", "Publisher number 4999 of the", "xpress4999x", "The last name.", "Nature", "", None]
    rows = spark.createDataFrame([(v, 1) for v in venues], "venue string, predatory_old int")
    got = {r.venue: r.predatory for r in duplicates.on_denylist(rows, listed).collect()}
    assert got == dict(zip(venues, [True, False, True, True, False, False, False], strict=True))
    short = spark.createDataFrame(names[:3] + names[-1:], "name string")
    assert sum(r.predatory for r in duplicates.on_denylist(rows, short).collect()) == 1


def test_years_beyond_an_int_are_no_years(spark):
    assert one(spark, extract.parsed_int(F.col("a")), a="99999999999") is None and one(spark, extract.parsed_int(F.col("a")), a=" 12x") == 12


def test_empty_titles_are_copies(spark):
    refs = spark.createDataFrame([("b", 1, "!!!", None), ("b", 2, "???", None)], "batch_id string, seq long, raw string, title string")
    assert duplicates.duplicate_pairs(refs).count() == 1


def test_arxiv_records_of_one_id_are_chosen_in_order(spark):
    record = "source string, source_rank int, rec_id string, title string, authors array<string>, arxiv_id string"
    catalog = spark.createDataFrame([("arXiv", 4, "b", "Deep things", ["X"], "1"), ("arXiv", 4, "a", "Deep things", ["X"], "1")], record)
    refs = spark.createDataFrame([(1, "raw", "Deep things", None, None, None, None, "1")], "ref_id int, raw string, title string, authors string, journal string, year string, doi string, arxiv_id string")
    assert [r.found.rec_id for r in resolve.arxiv_lookup(refs, catalog).collect()] == ["a"]


def test_independence_with_two_groups_is_corrected(spark):
    rows = spark.createDataFrame([("a", True)] * 10 + [("a", False)] * 20 + [("b", True)] * 15 + [("b", False)] * 5, "k string, f boolean")
    cells = {r.k: r for r in corpus.contingency(rows, "k", "f").collect()}
    assert (cells["a"].yes, cells["a"].no, cells["a"].expected_yes, cells["a"].dof) == (10, 20, 15.0, 1)
    statistic = 4.5**2 / 15 * 2 + 4.5**2 / 10 * 2
    assert cells["a"].statistic == pytest.approx(statistic) and cells["a"].p_value == pytest.approx(math.erfc(math.sqrt(statistic / 2)))


@pytest.mark.parametrize(("dof", "x"), [(1, 0.3), (1, 9.0), (2, 1.0), (2, 40.0), (3, 2.5), (7, 30.0), (10, 4.0), (40, 35.0), (41, 80.0)])
def test_upper_gamma(spark, dof, x):
    """Against the closed forms for whole and half arguments."""
    h = x / 2
    if dof % 2 == 0:
        want = math.exp(-h) * sum(h**k / math.factorial(k) for k in range(dof // 2))
    else:
        want = math.erfc(math.sqrt(h)) + math.exp(-h) * sum(h ** (k + 0.5) / math.gamma(k + 1.5) for k in range(dof // 2))
    got = spark.range(1).select(corpus.upper_gamma(F.lit(dof / 2), F.lit(h)).alias("q")).first().q
    assert got == pytest.approx(want, rel=1e-9)


def test_many_denylisted_names_are_one_automaton(spark, monkeypatch):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(12_000)})[:10_000]
    names = [n for n in names if len(n) >= 6]
    venues = [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(800)] + ["", None]
    want = {v: any(n in (v or "") for n in names) for v in venues}
    assert 0 < sum(want.values()) < len(want)
    rows, listed = spark.createDataFrame([(v,) for v in venues], "venue string"), spark.createDataFrame([(n,) for n in names], "name string")
    for shard, part in ((50_000, 100_000), (3000, 300)):
        monkeypatch.setattr(duplicates, "SHARD_NAMES", shard)
        monkeypatch.setattr(duplicates, "PART_VENUES", part)
        assert {r.venue: r.predatory for r in duplicates.on_denylist(rows, listed).collect()} == want


def test_last_originals_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(11)
    stems = ["learning representations of graphs", "learning representations", "deep learning representations of graphs again", "internationalization of standards", "xinternationalization ofx", "internationalizationof", "", "short", "the art of learning representations of graphs"]
    rows = [(b, i, "raw", rng.choice(stems), rng.choice([None, 0, 7, i + 100])) for b in ("x", "y") for i in range(60)]
    refs = spark.createDataFrame(rows, "batch_id string, seq long, raw string, title string, ref_number long")
    want = {}
    for b, j, _, t, _ in rows:
        for b2, i, _, u, label in rows:
            p, q = u or "raw", t or "raw"
            if b2 == b and i < j and (p == q or (len(p) > 20 and len(q) > 20 and (p in q or q in p))):
                want[b, j] = label or i + 1  # the last one stays
    assert {(r.batch_id, r.seq): r.duplicate_of for r in duplicates.last_originals(refs).collect()} == want
    pairs = {(r.batch_id, r.orig_seq, r.dup_seq) for r in duplicates.duplicate_pairs(refs).collect()}
    assert {(b, j) for b, _, j in pairs} == set(want)


def test_copies_make_no_pairs(spark):
    """Three thousand equal references give three thousand rows."""
    refs = spark.range(3000).select(F.lit(1).alias("batch_id"), F.col("id").alias("seq"), F.lit("r").alias("raw"), F.lit("one and the same long title of all").alias("title"), F.lit(None).cast("int").alias("ref_number"))
    got = duplicates.last_originals(refs)
    assert got.count() == 2999 and got.filter("duplicate_of <> seq").count() == 0


def test_classes_count_the_links_of_the_pairs_and_copies_make_none(spark):
    titles = ["a study of very long things", "more on a study of very long things indeed", "another of the very long studies", "short one", "a study of very long things"]
    refs = spark.createDataFrame([("b", i, "", titles[i % 5]) for i in range(40)] + [("c", 0, "", titles[0])], "batch_id string, seq long, raw string, title string")
    linked = Counter()
    for r in duplicates.duplicate_pairs(refs).collect():
        linked.update([(r.batch_id, r.orig_seq), (r.batch_id, r.dup_seq)])
    got = {(r.batch_id, r.seq): r for r in duplicates.duplicate_classes(refs).collect()}
    assert len(got) == 41 and {k: r.n_links for k, r in got.items() if r.n_links} == linked
    assert (got["b", 5].class_id, got["b", 5].linked, got["b", 6].class_id, got["b", 6].linked) == (0, [1], 1, [0])
    many = spark.range(20_000).selectExpr("'b' as batch_id", "id as seq", "'' as raw", "'the very same long title of all' as title")  # 200 million pairs
    assert duplicates.duplicate_classes(many).agg({"n_links": "sum", "class_id": "max"}).first().asDict() == {"sum(n_links)": 20_000 * 19_999, "max(class_id)": 0}


def test_folding_is_that_of_the_patterns(spark):
    """Every character of the first planes, alone and between letters, against the plain definitions."""
    space = "[ \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
    rows = [(c, f"{c} A{c}b-{c}Z9_.{c}") for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000), 0x1F600])]
    df = spark.createDataFrame(rows, "c string, s string").repartition(16)
    strip = lambda x: re.sub(f"^{space}+|{space}+\\Z", "", x)
    marks = lambda x: "".join(ch for ch in x if not 0x300 <= ord(ch) <= 0x36F)
    table = dict(zip(map(ord, text._FROM), text._TO, strict=True))
    folded = lambda x: strip(re.sub(f"(?!{space})[^a-z0-9_]", "", marks(x).translate(table).lower()))
    got = df.select("s", text.fold(F.col("s")).alias("f"), text.trim(F.col("s")).alias("t"), text.plain_key(F.col("s")).alias("p"), F.lower("s").alias("low")).collect()
    keep = lambda x: re.sub(f"(?!{space})[^a-zA-Z0-9_]", "", x)
    for r in got:
        assert (r.f, r.t, r.p) == (folded(r.s), strip(r.s), strip(re.sub(f"{space}+", " ", keep(r.low)))), ascii(r.s)


@pytest.mark.parametrize("unglue", [False, True])
def test_sections_are_split_within_their_row(spark, unglue):
    """No line travels: a section's references come from its own row, also where an id is used twice."""
    rows = [(1, "Doe, J. (2001). One thing of\nmany. J, 1\nRoe, A. (2002). Another thing. K, 2."), (1, "head of the list\n[1] first of its kind\n\n [2] second\nof its kind"), (2, None), (3, "too short")]
    got = parsing.split_references(spark.createDataFrame(rows, "id long, section string").coalesce(1), "id", unglue=unglue)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    texts = ["Doe, J. (2001). One thing of many. J, 1", "Roe, A. (2002). Another thing. K, 2."], ["head of the list", "[1] first of its kind", "[2] second of its kind"]
    assert [tuple(r) for r in got.collect()] == [(1, i, x) for part in texts for i, x in enumerate(part, 1)]


def test_years_stand_alone_and_are_searched_once_a_row(spark):
    old = r"(?<![A-Za-z0-9_])(?:19|20)\d{2}(?![A-Za-z0-9_])"
    odd = ["", "1999", "a1999", "19991", "x 2001y 2003", "é1999é", "_2001 2002_", "119 1920-1930", "2001\n2002", "\n1999", "192020", "\U0001f60019991999 2000"]
    rows = spark.createDataFrame([(a + b + c,) for a in odd for b in ("", " ", "a") for c in odd], "s string").select("s", extract.years(F.col("s")).alias("got"))
    assert [r.got for r in rows.collect()] == [re.findall(old, r.s) for r in rows.collect()]
    for style, n in ((parsing.apa_style, 0), (parsing.vancouver_style, 1), (parsing.generic_style, 1)):
        plan = rows.select(style(F.col("s")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count(extract.YEAR), plan.count(f"{extract.NUMBER}, 1)")) == (n, 1), style
