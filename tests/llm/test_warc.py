"""WARC round trips, determinism, rolling and recovery."""

from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from refloom.llm import warc

SCHEMA = "page_id long, url string, html string, shard int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*x, 7, "clash") for x in rows], SCHEMA)


ROWS = [
    (1, "http://a/ b\r\nX: y", "<html>one</html>"),
    (2, "http://b", "<html>one</html>"),
    (3, "http://c", "é\r\n\r\n日本"),
    (4, None, None),
    (5, "http://d", ""),
    (6, "http://e", "<html>one</html>"),
    (-7, "http://f", "x" * 300000),
    (8, "http://g", "WARC/1.1\r\n\r\n"),
]


def test_round_trip(spark, tmp_path):
    warc.write(frame(spark, ROWS), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(ROWS)
    last: dict = {}
    for i, _, h in ROWS:
        last[h or ""] = max(last.get(h or "", i), i)
    for i, u, h in ROWS:
        data, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert r.record_type == "revisit" or bytes(r.payload) == data
    assert got[1].url == "http://a/%20b%0D%0AX:%20y" and got[4].url == ""


def test_small_payloads_stay_responses(spark, tmp_path):
    warc.write(frame(spark, ROWS), str(tmp_path / "w"), min_revisit=100)
    assert {r.record_type for r in warc.read(spark, str(tmp_path / "w")).collect()} == {"response"}


def test_files_are_the_same_again_and_roll_by_size(spark, tmp_path):
    rows = [(i, f"http://x/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(400)]
    sums = []
    for n, order in enumerate((rows, rows[::-1])):
        folder = tmp_path / str(n)
        listed = warc.write(frame(spark, order).repartition(3 + n), str(folder), shard_bytes=300_000, roll_bytes=5_000).collect()
        assert len({r.shard for r in listed}) > 2 and len(listed) > len({r.shard for r in listed})
        for r in listed:
            content = (folder / r.file).read_bytes()
            assert (len(content), hashlib.sha256(content).hexdigest()) == (r.bytes, r.sha256) and gzip.decompress(content).startswith(b"WARC/1.1\r\n")
        sums.append(sorted((r.file, r.sha256, r.records) for r in listed))
        assert not list(folder.glob(".*.tmp"))
    assert sums[0] == sums[1]


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    folder = tmp_path / "w"
    warc.write(frame(spark, ROWS[:3]), str(folder))
    (folder / "part-000099-00000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read(spark, str(folder)).count() == 3


def test_damage_is_found(spark, tmp_path):
    raw = warc.record(1, 0, "u", b"payload", (False, None))
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


def test_null_ids_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = [(None, "u", "same"), (None, "v", "same"), (3, "w", "same"), (3, "w", "same"), (None, "z", "alone")]
    warc.write(frame(spark, rows), str(tmp_path / "w"))
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.read(spark, str(tmp_path / "w")).collect())
    assert got == [("3", "response", "None"), ("3", "response", "None"), ("None", "response", "None"), ("None", "revisit", "3"), ("None", "revisit", "3")]
    warc.write(frame(spark, []), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
    assert Path(tmp_path / "e").exists()


def test_ids_far_apart_hot_ids_and_clashing_columns(spark, tmp_path):
    rows = [(-(2**63), "a", "x" * 500), (2**63 - 1, "b", "y" * 500), *[(None, f"n{i}", f"{i}" * 300) for i in range(100)]]
    schema = "page_id long, url string, html string, spot string, part int, refers_to long, size string"
    source = spark.createDataFrame([(*r, "s", 1, 2, "t") for r in rows], schema)
    listed = warc.write(source, str(tmp_path / "w"), shard_bytes=5000).collect()
    assert len({r.shard for r in listed}) > 5 and max(r.records for r in listed) < 30  # the null id fills many shards
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes) for r in got) == sorted((i is None, i or 0, len(h)) for i, _, h in rows)


def test_a_file_of_many_members_is_read_in_turn():
    records = [warc.record(i, 0, "u", bytes([65 + i % 26]) * (i * 37), (False, None)) for i in range(300)]
    data = b"".join(gzip.compress(r) for r in records)
    assert list(warc._members(data)) == records
