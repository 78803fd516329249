"""The pipeline: each stage against brute force over what came before it."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.brute import SPACED, classes, cut
from tests.llm.test_decontaminate import brute as windows


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, DATA)
        after = out.collect()
        if name != names[-1]:
            assert out.columns == columns, name
        if name == "language_id":
            blank = {r.doc_id for r in before if not (r.text or "").strip()}
            assert not blank & {r.doc_id for r in after} and len(after) > 0.8 * len(before)
        elif name == "near_duplicates":
            assert sorted(r.doc_id for r in after) == sorted(set(classes([(r.doc_id, r.text) for r in before]).values()))
        elif name == "substring_duplicates":
            want = {(i, d) for i, n, gone, d in cut([(r.doc_id, r.text) for r in before]) if not gone or gone < n}
            import hashlib

            assert {(r.doc_id, hashlib.sha256(" ".join(SPACED.findall(r.text or "")).encode()).hexdigest()) for r in after} == want
        elif name == "benchmark_passages":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert sorted(r.doc_id for r in after) == sorted(x[0] for x in windows([(r.doc_id, r.text) for r in before], items) if not x[4])
        else:
            sizes = Counter()
            for r in before:
                sizes[r.source] += len(SPACED.findall(r.text or ""))
            assert {r.source: r.source_size for r in after} == {s: n for s, n in sizes.items() if n}
            assert all(0 < r.taken <= 3 * r.size for r in after)
        docs = corpus_pipeline.durable(out, name)


def test_run_gives_the_rows_of_the_last_stage(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and got.count() > 0


def test_a_rejected_row_takes_no_clean_row_of_its_id(spark):
    text = "the cat sat on the mat and they were happy with the weather of that day"
    rows = [(None, text, "en", "a", 1), (None, " ", "en", "a", 1), (None, None, None, None, 1), (7, text, "en", "a", 1), (7, "", "en", "a", 1), (7, "?!", None, "b", 1), (7, text, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.language_id(spark, docs, DATA)
    assert got.columns == docs.columns
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([rows[0], rows[3], rows[6]], key=str)


def test_every_stage_takes_nulls_empty_tables_repeated_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, content string, node string, `row` string, keep string, _hit int"
    text = "the cat sat on the mat and they were happy with the weather of that day and so on"
    more = ("i", "t", "c", "n", "r", "k", 1)
    rows = [(None, None, None, None, None, *more), (1, text, "en", "a", 80, *more), (1, text, "en", "a", 80, *more), (None, text + " again", "en", None, 86, *more), (2, "", "en", "a", 0, *more), (3, "word " * 30000, "en", "b", 150000, *more)]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(rows, schema)
        out = stage(spark, docs, DATA)
        got = out.collect()
        assert 0 < len(got) <= len(rows), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and all(tuple(r)[5:] == more for r in got), name
        assert stage(spark, spark.createDataFrame([], schema), DATA).count() == 0, name
