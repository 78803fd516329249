"""Uploads, request sizes, and issues that stand in no other test."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from refloom.operators import report, resolve
from refloom.sources import catalogs


@pytest.mark.parametrize(("current", "upload", "both"), [("a", "b", "a\n\nb"), ("", "b", "b"), (None, "b", "b"), ("a", "", "a\n\n")])
def test_an_upload_is_appended(spark, current, upload, both):
    rows = spark.createDataFrame([(current, upload)], "c string, u string")
    assert rows.select(catalogs.append_upload(F.col("c"), F.col("u"))).first()[0] == both


def test_requests_of_more_than_fifteen_references_are_errors(spark):
    assert report.guarded(spark.range(15)).count() == 15
    with pytest.raises(ValueError, match="at most 15"):
        report.guarded(spark.range(16))


def test_a_better_source_replaces_the_issues(spark):
    """The winner of another source says what CrossRef's confidence was."""
    rows = [
        ("r1", "CrossRef", 1, 75, 40, 60.5, 80.0, ["old"]), ("r1", "OpenAlex", 3, 90, 80, 86.0, 120.0, ["own"]),
        ("r2", "CrossRef", 1, 95, 90, 93.0, 130.0, ["kept"]), ("r2", "OpenAlex", 3, 90, 80, 86.0, 120.0, []),
        ("r3", "DBLP", 5, 90, 20, 70.0, 90.0, ["alone"]), ("r4", "CrossRef", 1, 72, 10, 50.0, 60.0, []), ("r4", "arXiv", 4, 71, 50, 64.0, 61.0, []),
        ("r5", "OpenAlex", 3, 69, 90, 76.0, 99.0, []),
    ]
    pool = spark.createDataFrame(rows, "ref_id string, source string, source_rank int, title_score int, author_score int, confidence double, score double, issues array<string>")
    got = {r.ref_id: (r.source, list(r.issues)) for r in resolve.best_overall(pool).collect()}
    assert got == {
        "r1": ("OpenAlex", ["Better match found in OpenAlex (CrossRef confidence was 60.5%)"]),
        "r2": ("CrossRef", ["kept"]),
        "r3": ("DBLP", ["alone"]),
        "r4": ("arXiv", ["Better match found in arXiv (CrossRef confidence was 50%)"]),
    }


def test_a_search_leaves_one_table(spark, tmp_path, monkeypatch):
    """What a search stores on its way is deleted; what it returns can still be read."""
    from refloom.operators import stored
    from tests.test_retrieval import resolve_catalog

    monkeypatch.setattr(stored, "shared_folder", lambda _: str(tmp_path))
    catalog = resolve_catalog(spark, [("d1", "Deep learning for protein folding"), ("d2", "Shallow ideas")])
    refs = spark.createDataFrame([(1, "x", "Deep learning for protein folding", None, None, None, None, None)], "ref_id long, raw string, title string, authors string, journal string, year string, doi string, arxiv_id string")
    found = resolve.search(refs, catalog)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["found"] and found.count() == 1
    with stored.Scratch() as outer, stored.Scratch() as inner:
        kept = inner.keep(stored.stored(spark.range(3), "kept"))
        stored.stored(spark.range(3), "gone")
        assert outer.paths == {} or kept._stored_path in outer.paths
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["found"]
