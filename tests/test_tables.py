"""Workbooks and tables merged by key."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from refloom.operators import upsert
from refloom.sources import workbooks

SCHEMA = "dataset string, id long, title string, score double, ok boolean"
ROWS = [("a b", 1, "x & <y> \"z\"", 1.5, True), ("a b", 2, "", None, False), ("c/d", 3, None, -2.0, None), ("c/d", 2**60, "two\nlines\r\n é日 \x01", 1e300, True), ("a b", None, " padded ", 0.1, False)]


def seen(rows):
    return sorted(map(tuple, rows), key=repr)


def test_written_workbooks_read_as_the_rows(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    workbooks.write_by_folder(rows, str(tmp_path), "dataset")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a_b.xlsx", "c_d.xlsx", "merged.xlsx"]
    plain = [(d, i, None if t is None else t.replace("\x01", ""), s, o) for d, i, t, s, o in ROWS]
    back = workbooks.read(spark, str(tmp_path), "id long, title string, score double, ok boolean, file_name string").collect()
    assert seen(r[:4] for r in back if r.file_name == "a_b.xlsx") == seen(r[1:] for r in plain if r[0] == "a b")
    assert seen(r[:4] for r in back if r.file_name == "c_d.xlsx") == seen(r[1:] for r in plain if r[0] == "c/d")
    merged = workbooks.read(spark, f"{tmp_path}/merged.xlsx", SCHEMA).collect()
    assert seen(merged) == seen(plain)
    assert workbooks.read(spark, f"{tmp_path}/merged.xlsx").columns == ["dataset", "id", "title", "score", "ok", "file_name"]
    with zipfile.ZipFile(tmp_path / "merged.xlsx") as book:
        assert book.testzip() is None and "xl/workbook.xml" in book.namelist()


def test_full_sheets_roll_to_numbered_files(spark, tmp_path):
    spark.dataSource.register(workbooks.Workbooks)
    spark.range(25).coalesce(1).write.format("workbook").option("name", "r").option("rows", "10").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r-1.xlsx", "r-2.xlsx", "r-3.xlsx"]
    assert workbooks.read(spark, str(tmp_path), "id long").agg(F.sum("id")).first()[0] == 300


def test_numbered_files_read_as_one_workbook(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "SHEET_ROWS", 10)
    rows = spark.range(60).select("id", F.when(F.col("id") < 5, "few-1").when(F.col("id") < 20, "few").otherwise("many").alias("dataset"))
    workbooks.write_by_folder(rows, str(tmp_path), "dataset")
    back = workbooks.read(spark, str(tmp_path), "id long, workbook string, file_name string")
    assert {tuple(r) for r in back.groupBy("workbook").agg(F.count("*"), F.sum("id")).collect()} == {("few-1.xlsx", 5, 10), ("few.xlsx", 15, 180), ("many.xlsx", 40, 1580), ("merged.xlsx", 60, 1770)}
    assert len({p.name for p in tmp_path.iterdir() if p.name.startswith("merged-")}) >= 6


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(workbooks.Workbooks)
    bad = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise("x").cast("string").alias("title"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("workbook").option("name", "r").mode("append").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_overwrite_and_nothing_to_write(spark, tmp_path):
    spark.dataSource.register(workbooks.Workbooks)
    for n in (3, 2):
        spark.range(n).coalesce(1).write.format("workbook").option("name", f"r{n}").mode("overwrite").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["r2.xlsx"]
    spark.range(0).write.format("workbook").mode("overwrite").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_shared_strings_and_missing_cells_are_read(tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>far</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c></row><row r="3"><c r="AB3"><v>2.5</v></c></row></sheetData></worksheet>')
    rows = list(workbooks.sheet_rows(str(tmp_path / "s.xlsx")))
    assert rows[0][0] == "name" and rows[0][27] == "far" and rows[1] == ["rich"] and rows[2][27] == "2.5"
    assert [workbooks.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbooks._index(workbooks.column_name(i)) == i for i in range(2000))


def table(spark, path):
    return {(r.k, r.v, r.at) for r in upsert.read(spark, path).collect()}


def test_merge_by_key(spark, tmp_path):
    path, make = str(tmp_path / "t"), lambda rows: spark.createDataFrame(rows, "k string, v string, at int")
    assert upsert.read(spark, path) is None
    assert upsert.merge(make([("a", "1", 1), ("a", "2", 2), ("b", "1", 1), (None, "n", 1)]), path, ["k"], "at", run="one") == 1
    assert table(spark, path) == {("a", "2", 2), ("b", "1", 1), (None, "n", 1)}
    second = make([("b", "9", 5), ("c", "9", 5), (None, "m", 5)])
    assert upsert.merge(second, path, ["k"], "at", run="two") == 2
    assert upsert.merge(second, path, ["k"], "at", run="two") == 2  # a retry changes nothing
    assert table(spark, path) == {("a", "2", 2), ("b", "9", 5), ("c", "9", 5), (None, "m", 5)}
    assert upsert.merge(make([]), path, ["k"], "at") == 3 and len(table(spark, path)) == 4


def test_only_touched_buckets_are_rewritten_and_of_two_merges_one_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    upsert.merge(spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v"), F.lit(1).alias("at")), path, ["k"], "at")
    before = upsert.manifest(spark, path)
    upsert.merge(spark.createDataFrame([("7", "y", 2)], "k string, v string, at int"), path, ["k"], "at")
    after = upsert.manifest(spark, path)
    assert sum(before["buckets"][b] != after["buckets"][b] for b in after["buckets"]) == 1 and len(table(spark, path)) == 500
    monkeypatch.setattr(upsert, "manifest", lambda *a: before)  # a merge that began before the other ended
    with pytest.raises(upsert.Conflict):
        upsert.merge(spark.createDataFrame([("8", "z", 3)], "k string, v string, at int"), path, ["k"], "at")
    monkeypatch.undo()
    assert upsert.manifest(spark, path) == after and ("8", "x", 1) in table(spark, path)
