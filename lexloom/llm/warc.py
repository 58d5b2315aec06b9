"""WARC archives as a chunked record table.

Reading never holds a record whole: a payload travels as rows (record, chunk number, bytes), and each chunk row carries the
SHA-1 of the payload up to its end, so a record's last chunk has the full digest. Writing does hold each payload whole, as
the table gives it: one cell, digested before it is cut into records.

Writing: a payload beyond ``chunk_bytes`` becomes a segmented record (WARC-Segment-Number, then ``continuation``
records), so no record of an archive is longer than a chunk. Of equal payloads the one with the largest key is a
``response``; the others are ``revisit`` records that name it and carry its HTTP header only. Archives are gzip files of
WARC/1.1 records, written and read through Spark's own file layer (any store that Spark reaches): a record ends with
two line ends, which is the row separator, and the reader goes by Content-Length, so payloads may hold separators.

Defined cases: a null payload is empty; a record whose key is null is a response unless another of its group has a
key; rows repeated with the same key and payload are one record written again (all responses, if theirs is the largest
key), rows that share a key have record ids of their own, which name the payload's digest too; a null url is left out; an
empty table gives no records; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = b"\r\n\r\n"
SEPARATOR = "\r\n\r\n"
CHUNK_BYTES = 1 << 16
URN = "urn:x-record:"
CHUNKS = "record_id string, record_type string, key string, refers_to string, chunk int, offset long, length int, data binary, running_sha1 string, last boolean, payload_bytes long, payload_digest string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def key_of(record_id: str) -> str:
    return record_id.removeprefix(URN).rpartition(";sha1=")[0] or record_id.removeprefix(URN)


def _head(fields: list[tuple[str, str]], length: int) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {length}\r\n\r\n").encode()


def _clean(url: str) -> str:
    return "".join(x if x.isprintable() and x != " " else "".join(f"%{b:02X}" for b in x.encode()) for x in url)


def encode_record(key: str | None, url: str | None, payload: memoryview, refers_to: str | None, chunk_bytes: int, date: str) -> Iterator[bytes]:
    """The WARC records of one payload, without their closing line ends."""
    sha = hashlib.sha1()
    for i in range(0, len(payload), chunk_bytes):
        sha.update(payload[i : i + chunk_bytes])
    digest = base32(sha.digest())
    own_name = lambda k: f"{URN}{'null' if k is None else k};sha1={digest}"  # rows that share a key differ by payload
    name = f"<{own_name(key)}>"
    fields = [("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    fields += [("WARC-Target-URI", _clean(url))] if url is not None else []
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        yield _head([("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{own_name(refers_to)}>"), *fields], len(http)) + http
        return
    cuts = range(0, max(len(payload), 1), chunk_bytes)
    for i, at in enumerate(cuts):
        part = payload[at : at + chunk_bytes]
        if not i:
            own = [("WARC-Type", "response"), *fields] + ([("WARC-Segment-Number", "1")] if len(cuts) > 1 else [])
            yield _head(own, len(http) + len(part)) + http + part
        else:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{own_name(key)};segment={i + 1}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(i + 1))]
            own += [("WARC-Segment-Total-Length", str(len(http) + len(payload)))] if i == len(cuts) - 1 else []
            yield _head(own, len(part)) + part


def write_archives(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str | None = "url", chunk_bytes: int = CHUNK_BYTES, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one record for each row. Groups of equal payloads are found on narrow rows (digest, key) with partial sums."""
    body = common.utf8(payload)
    narrow = pages.select(F.sha2(body, 256).alias("digest"), F.col(key).alias("key"))
    groups = narrow.groupBy("digest").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    wide = pages.select(F.sha2(body, 256).alias("digest"), F.col(key).alias("key"), body.alias("body"), (F.col(url).cast("string") if url else F.lit(None).cast("string")).alias("url"))
    # A large group's rows stream past one build row; adaptive execution splits them over several tasks.
    joined = wide.join(groups.hint("shuffle_hash"), "digest", "left").select(F.col("key").cast("string").alias("key"), "body", "url", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("refers_to"))

    def encode(batches):
        for batch in batches:
            keys, urls, refs = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out, size = [], 0
            for i in range(batch.num_rows):
                for record in encode_record(keys[i], urls[i], memoryview(batch.column(1)[i].as_buffer()), refs[i], chunk_bytes, date):
                    out.append(record)
                    size += len(record)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = joined.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


class Reader:
    """Parses one archive from pieces of its bytes and yields rows of the chunk table."""

    def __init__(self):
        self.state, self.buffer, self.left, self.record = "head", b"", 0, None

    def feed(self, data: bytes) -> Iterator[dict]:
        while data or (self.state == "body" and not self.left):
            if self.state == "head":
                self.buffer += data
                end = self.buffer.find(END)
                while end >= 0 and not self.buffer[:end].strip():  # separators between records
                    self.buffer = self.buffer[end + 4 :]
                    end = self.buffer.find(END)
                if end < 0:
                    return
                head, data, self.buffer = self.buffer[:end], self.buffer[end + 4 :], b""
                self._begin(head.decode("utf-8", "replace").strip())
            else:
                part, data = data[: self.left], data[self.left :]
                self.left -= len(part)
                yield from self._body(part)
                if not self.left:
                    self.state = "head"

    def _begin(self, head: str) -> None:
        first, *rest = head.split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {first[:80]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
        self.state, self.left = "body", int(fields["content-length"])
        kind = fields.get("warc-type")
        if kind == "continuation":
            self.record["last"] = "warc-segment-total-length" in fields
        else:
            name = fields["warc-record-id"].strip("<>")
            self.record = {"id": name, "type": kind, "key": key_of(name), "refers": key_of(fields.get("warc-refers-to", "").strip("<>")) or None, "sha": hashlib.sha1(), "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "http": b"" if kind in ("response", "revisit") else None, "length": None, "at": 0, "chunk": 0, "last": "warc-segment-number" not in fields}

    def _body(self, part: bytes) -> Iterator[dict]:
        r = self.record
        if r["http"] is not None:
            r["http"] += part
            end = r["http"].find(END)
            if end < 0:
                return
            head, part, r["http"] = r["http"][:end].decode(), r["http"][end + 4 :], None
            r["length"] = next((int(x.split(":")[1]) for x in head.split("\r\n") if x.lower().startswith("content-length:")), None)
            if r["type"] == "revisit":
                yield self._row(b"", True, r["length"], r["digest"])
                return
        if r["type"] != "response":
            return
        done = r["last"] and not self.left
        r["sha"].update(part)
        digest = base32(r["sha"].digest()) if done else None
        if done and (digest != r["digest"] or r["length"] not in (None, r["at"] + len(part))):
            raise ValueError(f"{r['id']}: the payload does not have its digest or length")
        yield self._row(part, done, r["at"] + len(part) if done else None, digest)

    def _row(self, part: bytes, last: bool, length: int | None, digest: str | None) -> dict:
        r = self.record
        row = {"record_id": r["id"], "record_type": r["type"], "key": r["key"], "refers_to": r["refers"], "chunk": r["chunk"], "offset": r["at"], "length": len(part), "data": part, "running_sha1": r["sha"].hexdigest(), "last": last, "payload_bytes": length, "payload_digest": digest}
        r["chunk"] += 1
        r["at"] += len(part)
        return row

    def close(self) -> None:
        if self.state != "head" or self.buffer.strip():
            raise ValueError("the archive ends inside a record")


def read_chunks(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    """The chunk table of the archives in a folder; ``data=False`` leaves the bytes out once they are digested.

    A row holds one chunk at most. gzip files are not split, so a task meets an archive's records in order.
    """

    def parse(batches):
        reader, at, rows, size = Reader(), None, [], 0
        for batch in batches:
            files, values = batch.column(0).to_pylist(), batch.column(1)
            for i, name in enumerate(files):
                if name != at:
                    reader.close()
                    reader, at = Reader(), name
                for piece in (values[i].as_py(), END):
                    for row in reader.feed(piece):
                        size += row["length"]
                        rows.append(row if data else row | {"data": None})
                if size > 1 << 22 or len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                    rows, size = [], 0
        reader.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    lines = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(parse, CHUNKS)


SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("key", pa.string()), ("refers_to", pa.string()), ("chunk", pa.int32()), ("offset", pa.int64()), ("length", pa.int32()), ("data", pa.binary()), ("running_sha1", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def records(chunks: DataFrame) -> DataFrame:
    """One row for each record, from its last chunk: no shuffle."""
    return chunks.where("last").select("key", "record_type", "refers_to", "payload_bytes", "payload_digest", (F.col("chunk") + 1).alias("n_chunks"))


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str | None = "url", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the archives into the shared folder and read them back, a row for each record."""
    spark = pages.sparkSession
    path = common.scratch_path(spark, "warc")
    write_archives(pages, path, key, payload, url, chunk_bytes)
    kind = pages.schema[key].dataType.simpleString()
    number = lambda c: F.expr(f"try_cast({c} as {kind})")
    return records(read_chunks(spark, path, data=False)).select(number("key").alias(key), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "n_chunks")
