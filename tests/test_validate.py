"""Field checks with hand-derived scores, and the traps of the rules."""

from __future__ import annotations

import pytest

from refloom.operators import report, validate

SCHEMA = (
    "raw string, title string, authors string, journal string, year string, found_title string, found_families array<string>, found_givens array<string>, "
    "found_year string, found_years array<string>, found_venue string, found_publisher string, found_retracted boolean"
)
PAPER = dict(
    raw="Vaswani A. Attention is all you need. Nature. 2017", title="Attention is all you need", authors="Vaswani, A.", journal="Nature", year="2017", found_title="Attention is all you need",
    found_families=["Vaswani"], found_givens=["Ashish"], found_year="2017", found_years=["2017"], found_venue="Nature", found_publisher="", found_retracted=False,
)


def checked(spark, check, **changes):
    row = PAPER | changes
    return check(spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)).first()


@pytest.mark.parametrize(
    ("changes", "scores", "confidence", "issues"),
    [
        ({}, (100, 100, 100, 100), 100.0, 0),
        ({"authors": "Vaswani, A. and Nobody, Q"}, (100, 80, 100, 100), 95.0, 1),
        ({"journal": None, "year": None, "authors": None}, (100, 100, 100, 100), 100.0, 0),
        ({"year": "2016", "found_venue": "arXiv", "journal": None}, (100, 100, 100, 85), 96.25, 1),
        ({"year": "2016"}, (100, 100, 100, 85), 96.25, 1),
        ({"year": "2016", "found_years": ["2017", "2016"]}, (100, 100, 100, 100), 100.0, 0),
        ({"year": "2010"}, (100, 100, 100, 0), 75.0, 1),
        ({"found_venue": "arXiv"}, (100, 100, 70, 100), 92.5, 1),
        ({"found_venue": ""}, (100, 100, 95, 100), 98.75, 0),
        ({"authors": "Vaswani, A. et al."}, (100, 100, 100, 100), 100.0, 0),
    ],
)
def test_batch(spark, changes, scores, confidence, issues):
    got = checked(spark, validate.check_batch, **changes)
    assert (got.title_score, got.author_score, got.journal_score, got.year_score) == scores
    # a sure match of at most 80 is lifted to 65 at least, never lowered
    assert got.accepted and got.confidence == pytest.approx(confidence) and len(got.issues) == issues


def test_wrong_papers_are_rejected(spark):
    got = checked(spark, validate.check_batch, found_title="Something else entirely about nothing")
    assert not got.accepted and got.confidence == 0 and len(got.issues) == 0
    got = checked(spark, validate.check_batch, authors="Zed, Q. and Yak, W.", journal="Physics of stones", year="1990")
    assert not got.accepted and len(got.issues) == 1


def test_quick(spark):
    got = checked(spark, validate.check_quick)
    assert (got.title_score, got.author_score, got.journal_score) == (100, 100, 100) and got.confidence == 100 and not got.issues
    # the year's penalty is only a remark
    got = checked(spark, validate.check_quick, raw="Vaswani A. Attention is all you need. Nature. 2010")
    assert got.confidence == 100 and [i for i in got.issues if i.startswith("Year Mismatch")]
    got = checked(spark, validate.check_quick, raw="Attention is all you need", found_venue="")
    assert (got.author_score, got.journal_score, got.confidence) == (0, 50, 50.0)


def test_retraction_and_future_years(spark):
    assert checked(spark, validate.check_batch, found_title="Retracted: Attention is all you need", title="Retracted: Attention is all you need").retracted
    rows = spark.createDataFrame([("2030",), ("2026",), (None,)], "y string")
    assert [r.i is not None for r in rows.select(validate.future_year_issue(rows.y, 2025).alias("i")).collect()] == [True, False, False]


def test_published_rule(spark):
    rows = [(1, 0.9, 0.6, True), (1, 0.1, 0.0, False), (2, 0.9, 0.6, False), (3, 0.6, 0.0, True), (4, 0.4, 1.0, True)]
    got = {r.ref_id: r.status for r in report.paper_status(spark.createDataFrame(rows, "ref_id int, title double, author double, year_ok boolean")).collect()}
    assert got == {1: "Verified", 2: "Typo/Fuzzy", 3: "Typo/Fuzzy", 4: "Suspicious"}


def test_filters_counts_and_guards(spark):
    rows = spark.createDataFrame([(1, True, 90.0, ["x"]), (2, None, None, None), (3, False, 0.0, [])], "seq int, exists boolean, confidence double, issues array<string>")
    assert sorted(r.seq for r in report.select_rows(rows, "verified").collect()) == [1, 2]
    assert sorted(r.seq for r in report.select_rows(rows, "issues").collect()) == [1, 2]
    with pytest.raises(ValueError):
        report.guarded(spark.range(16))
    assert report.guarded(spark.range(15)).count() == 15
