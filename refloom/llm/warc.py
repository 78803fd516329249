"""A deterministic, sharded WARC writer, and its reader.

Records are sorted by a key made of their id and payload digest and cut into
shards of ``shard_bytes``, wherever the running sum of all bytes before them
passes a multiple of it, so the same records always make the same files and one
id with very many rows still fills many shards.  Sums run over ids and digests in
two levels (range partitions, then rows); the driver sees one number for each
partition and one bound for each shard.  Payloads are shuffled once, straight to
the task of their shard, and meet there the short list of its revisits.  A shard
is written record by record as gzip members, and rolled to the next file once it
has ``roll_bytes`` compressed.  Headers and digests are made anew.  A file is written under a temporary name and
renamed when complete; a retried task replaces it by the same bytes.  The
manifest (file, records, bytes, sha256) is a Parquet table written last: readers
take files that it lists, and nothing else.

Of records with equal payloads the one with the largest id is a response, the
others are revisits that refer to it; payloads under ``min_revisit`` bytes are
always responses.

Defined cases: null html is an empty payload; a null id is "null", sorts first
and is a response only if no record with the payload has an id; repeated rows
are records of their own; a null url is empty; control characters and spaces in
urls are percent-encoded; a page of any length is one record, so a shard may be
larger by one page; ids may lie anywhere in the range of a long; an empty table
gives an empty manifest; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.llm.durable import durable

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

SHARD_BYTES = 32_000_000
ROLL_BYTES = 8_000_000
_MANIFEST = "shard int, roll int, file string, records long, bytes long, sha256 string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _filesystem(path: str):
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def record(page_id, number: int, url: str, payload: bytes, refers_to) -> bytes:
    """One uncompressed record; ``refers_to`` is (has one, id)."""
    revisit, target = refers_to
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    digest = _digest(payload)
    name = lambda x, n=0: f"<urn:page:{'null' if x is None else x}:{digest}:{n}>"
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id, number)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(target)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """A file under a temporary name until it is complete."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, root = _filesystem(folder)
        self.shard, self.roll, self.name = shard, roll, f"part-{shard:06d}-{roll:05d}.warc.gz"
        self.final, self.temp = f"{root}/{self.name}", f"{root}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(root, recursive=True)
        self.out, self.records, self.bytes, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()

    def write(self, data: bytes, level: int) -> None:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.records += 1
        self.bytes += len(member)

    def commit(self) -> dict:
        self.out.close()
        self.fs.move(self.temp, self.final)
        return {"shard": self.shard, "roll": self.roll, "file": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def _write(folder: str, roll_bytes: int, level: int):
    def run(key, pages, revisits):
        shard = key[0].as_py()
        keys = [("page_id", "ascending"), ("key", "ascending"), ("url", "ascending")]
        pages = pages.take(pa.compute.sort_indices(pages, sort_keys=keys, null_placement="at_start"))
        refers = {(r["page_id"], r["key"]): (True, r["refers_to"]) for r in revisits.to_pylist()}
        done, file, last, number = [], None, (), 0
        for batch in pages.to_batches(max_chunksize=500):
            for row in batch.to_pylist():
                if file is None or file.bytes >= roll_bytes:
                    done += [file.commit()] if file else []
                    file = _File(folder, shard, file.roll + 1 if file else 0)
                here = (row["page_id"], row["key"])
                number, last = number + 1 if here == last else 0, here
                payload = row["html"].encode("utf-8", "surrogatepass")
                file.write(record(row["page_id"], number, row["url"], payload, refers.get(here, (False, None))), level)
        return pa.Table.from_pylist([*done, *([file.commit()] if file else [])], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("shard", pa.int32()), ("roll", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def _spot(page_id: Column, key: Column) -> Column:
    """The place of a record in the order of all: null ids, then ids, each by digest."""
    ordered = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(ordered, F.lit("")), F.lit(" "), F.substring(key, 1, 12))


def _bounds(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """The first spot of every shard, in order."""
    by_spot = sizes.groupBy("spot").agg(F.sum("size").alias("bytes"))
    order = durable(by_spot.repartitionByRange("spot").select(F.spark_partition_id().alias("part"), "spot", "bytes"), "order")
    sums = sorted((r["part"], r["bytes"]) for r in order.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect())
    if not sums:
        return np.zeros(0, "U29")
    before = dict(zip((p for p, _ in sums), np.cumsum([0] + [b for _, b in sums]).tolist(), strict=False))
    offsets = F.broadcast(sizes.sparkSession.createDataFrame(list(before.items()), "part int, offset long"))
    running = F.sum("bytes").over(Window.partitionBy("part").orderBy("spot")) - F.col("bytes")
    cut = order.withColumn("running", running).join(offsets, "part").withColumn("shard", F.floor((F.col("offset") + F.col("running")) / shard_bytes))
    return np.array(sorted(r["first"] for r in cut.groupBy("shard").agg(F.min("spot").alias("first")).collect()), "U29")


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Write the archives below ``folder`` and return the manifest, read back."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha1("html"))
    rows = rows.withColumn("spot", _spot(F.col("page_id"), F.col("key")))
    narrow = durable(rows.select("page_id", "key", F.octet_length("html").cast("long").alias("size"), "spot"), "payloads")
    bounds = _bounds(narrow, shard_bytes)
    shards = max(1, len(bounds))

    @F.pandas_udf("int")
    def shard(spots: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, spots.to_numpy("U29"), "right") - 1).astype("int32")

    first = narrow.groupBy("key", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("size") >= min_revisit)).drop("n")
    revisits = narrow.join(first, ["key", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.groupBy("page_id", "key", "spot").agg(F.max("refers_to").alias("refers_to"))
    placed = rows.withColumn("shard", shard("spot")).select("shard", "page_id", "url", "html", "key").repartitionById(shards, "shard")
    listed = revisits.withColumn("shard", shard("spot")).select("shard", "page_id", "key", "refers_to").repartitionById(shards, "shard")
    manifest = f"{folder}/_manifest"
    written = placed.groupBy("shard").cogroup(listed.groupBy("shard")).applyInArrow(_write(folder, roll_bytes, level), _MANIFEST)
    written.write.mode("overwrite").parquet(manifest)
    return pages.sparkSession.read.parquet(manifest)


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, read some bytes at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        reader, out = zlib.decompressobj(31), []
        while not reader.eof and at < len(view):
            piece = view[at : at + (1 << 16)]
            out.append(reader.decompress(piece))
            at += len(piece) - len(reader.unused_data)
        yield b"".join(out) + reader.flush()


def parse(raw: bytes) -> dict:
    """The fields of one uncompressed record; its digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != VERSION or rest[len(block) :] != b"\r\n\r\n" or f"sha1:{_digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or _digest(payload) != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda x: None if x in (None, "null") else int(x)
    page = lambda x: x and x.strip("<>").split(":")[2]
    return {
        "page_id": number(page(fields["WARC-Record-ID"])),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(page(fields.get("WARC-Refers-To"))),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _read(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for raw in _members(content.as_py()):
                    rows.append(parse(raw) | ({} if with_payload else {"payload": None}))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read(spark: SparkSession, folder: str, *, payload: bool = True) -> DataFrame:
    """The records of all files that the manifest lists."""
    listed = spark.read.parquet(f"{folder}/_manifest").select(F.col("file").alias("_file"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    files = files.join(listed, F.element_at(F.split("path", "/"), -1) == F.col("_file"), "left_semi")
    return files.select("content").mapInArrow(_read(payload), _RECORDS)
