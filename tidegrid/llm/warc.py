"""WARC archives: writing, gzip normalising with a sidecar index, and reading back.

1. Records are written as monolithic archives: each file is one gzip stream over all its records.
2. The normaliser inflates each file's stream once, cuts the records by their Content-Length, and writes every record as a gzip
   member of its own into a new archive, with a sidecar index (offset, length, id, type) beside it.
3. The reader follows the index: each member is read from its offset and inflated by itself.

A file is written under a name of its own attempt and renamed when whole, so a repeated or lost attempt leaves no part of an
archive; the reader takes the files that the index table names. Archives are of bounded size (ROWS_PER_FILE records).
Executors reach the shared folder through pyarrow's file systems, whatever its scheme.

Defined results: a null html is an empty payload; payloads of fewer than MIN_REVISIT bytes, and rows with a null page_id,
are responses; repeated rows with the smallest page_id of their payload are all responses; rows that share a page_id but not the
payload are records of their own; an empty table gives no rows. The normaliser refuses a stream without its trailer, with a wrong
checksum, or that ends inside a record.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import as_uri, scratch_path, table

MIN_REVISIT = 100
ROWS_PER_FILE = 5000
#: zlib level of the members.
LEVEL = 3
_READ = 1 << 20
_END = b"\r\n\r\n"

INDEX = "archive string, offset long, length long, record_id string, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def first_copies(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """pages(page_id, digest, n) -> (digest, refers_to): the smallest id of each payload that pages of several ids share.

    The ids are combined before the shuffle, so a payload that very many pages share is a few rows here.
    """
    sums = pages.filter((F.col("n") >= least) & F.col("page_id").isNotNull())
    return sums.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("last > refers_to").drop("last")


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def record_text(page_id: Column, url: Column, html: Column, digest: Column, refers_to: Column) -> Column:
    """A WARC/1.1 record up to its last line feed, which the text writer adds."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    octets = lambda c: F.octet_length(c).cast("string")
    body = F.when(refers_to.isNull(), html).otherwise("")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", octets(html)), F.lit("\r\n"))
    revisit = F.concat(line("WARC-Refers-To", _uri(refers_to)), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(refers_to.isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", _uri(page_id)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]+", "%0A")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(refers_to.isNotNull(), revisit).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, http, body, F.lit("\r\n\r"))


def write_monolithic(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write pages as archives that are one gzip stream each."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    full = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    # written, so that the join reads two plain shuffles and Spark can split a payload that very many pages share
    firsts = scratch_path(pages.sparkSession, "warc-first-copies")
    first_copies(full.select("page_id", "digest", F.octet_length("html").alias("n"))).write.parquet(firsts)
    joined = full.join(pages.sparkSession.read.parquet(firsts), "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("refers_to"), F.col("refers_to")))
    value = record_text(*(F.col(c) for c in ("page_id", "url", "html", "digest", "refers_to")))
    joined.select(value.alias("value")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", rows_per_file).text(path)


class Inflated:
    """The bytes of a gzip stream of one or more members; at most _READ of them are inflated at once, whatever the ratio.

    A stream that ends before its trailer is an error, so what has been read has also passed its checksum.
    """

    def __init__(self, raw) -> None:
        self.raw, self.out, self.engine = raw, bytearray(), zlib.decompressobj(31)
        self.packed = b""

    def take(self, n: int) -> bytes:
        """Exactly n bytes, fewer only at the end."""
        while len(self.out) < n and self._more():
            pass
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``; empty at the end of the stream, an error if other bytes stand there."""
        seen = 0
        while (at := self.out.find(mark, seen)) < 0:
            seen = max(0, len(self.out) - len(mark) + 1)
            if not self._more():
                if self.out:
                    raise ValueError("the stream ends inside the head of a record")
                return b""
        return self.take(at + len(mark))

    def _more(self) -> bool:
        """Inflate a further piece; False at the end."""
        if not self.packed:
            self.packed = self.raw.read(_READ)
            if not self.packed:
                if not self.engine.eof:
                    raise ValueError("the gzip stream is cut short")
                return False
        if self.engine.eof:
            self.engine = zlib.decompressobj(31)
        self.out += self.engine.decompress(self.packed, _READ)
        self.packed = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
        return True


def parse_head(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def records_in(stream: Inflated) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) in order."""
    while head := stream.until(_END):
        fields = parse_head(head)
        size = int(fields["Content-Length"])
        block = stream.take(size + 4)
        if len(block) != size + 4:
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut short")
        yield fields, head + block


def member(record: bytes) -> bytes:
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return engine.compress(record) + engine.flush()


def archives(spark: SparkSession, path: str) -> DataFrame:
    """Locations and sizes of the archives in a folder; their bytes aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", F.col("length").alias("size"))


def normalise(found: DataFrame, target: str) -> DataFrame:
    """Rewrite each archive record by record under ``target``; the rows of all sidecar indexes.

    found(path, size). Each archive is a task's work of its own: it is streamed, never held whole.
    """
    target = as_uri(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(target)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                from_system, place = fs.FileSystem.from_uri(as_uri(source))
                name = posixpath.basename(place).split(".")[0] + ".warc.gz"
                whole, part = posixpath.join(folder, name), posixpath.join(folder, f".{name}.{TaskContext.get().taskAttemptId()}.{uuid.uuid4().hex}")
                rows, at = [], 0
                with from_system.open_input_stream(place, compression=None) as raw, system.open_output_stream(part, compression=None) as out:
                    for fields, record in records_in(Inflated(raw)):
                        packed = member(record)
                        out.write(packed)
                        rows.append((f"{target}/{name}", at, len(packed), fields["WARC-Record-ID"], fields["WARC-Type"]))
                        at += len(packed)
                with system.open_output_stream(part + ".idx", compression=None) as out:
                    for row in rows:
                        out.write((json.dumps(dict(zip(("archive", "offset", "length", "record_id", "record_type"), row, strict=True))) + "\n").encode())
                system.move(part, whole)
                system.move(part + ".idx", whole + ".idx")
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "offset", "length", "record_id", "record_type"])

    return found.select("path").mapInArrow(run, INDEX)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar indexes of a folder of normalised archives."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(path)


def _page(uri: str | None) -> int | None:
    return int(uri[len("<urn:page:") : -1]) if uri and uri != "<urn:page:none>" else None


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the members that the index lists, each by itself, and check every payload against its digest.

    The index rows of one archive stay together and in order, so that the archive is read forwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                rows = []
                for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if archive != opened:
                        system, place = fs.FileSystem.from_uri(archive)
                        opened, file = archive, system.open_input_file(place)
                    file.seek(offset)
                    record = zlib.decompress(file.read(length), 31)
                    cut = record.index(_END) + 4
                    fields, block = parse_head(record[:cut]), record[cut:-4]
                    http = block.index(_END) + 4
                    payload, digest = block[http:], fields["WARC-Payload-Digest"].partition(":")[2]
                    kind, size = fields["WARC-Type"], int(parse_head(block[:http])["Content-Length"])
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't agree with its digest")
                    rows.append((_page(fields["WARC-Record-ID"]), size, digest, kind, _page(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), payload if with_payload and kind == "response" else None))
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return index.select("archive", "offset", "length").mapInArrow(run, RECORDS)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, target = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_monolithic(table(spark, sf_dir, "pages"), raw)
    index = scratch_path(spark, "warc-index")
    found = archives(spark, raw)
    normalise(found.repartition(max(1, found.count())), target).write.parquet(index)
    back = read_records(spark.read.parquet(index), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH full_pages AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sums AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM full_pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM sums WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT s.page_id, s.payload_bytes, s.payload_digest,
       CASE WHEN f.first_id < s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < s.page_id THEN f.first_id END AS refers_to
FROM sums s LEFT JOIN firsts f ON s.payload_digest = f.payload_digest AND s.payload_bytes >= 100
"""
